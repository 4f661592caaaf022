"""Exact sampling and splits.

Randomness is a hash order (see ``functions.columns``): the same seed gives the same rows
under any partitioning and after any task retry.

Scale notes
* Per-category top-k (E1) is ``row_number() <= k`` over the category, which Spark plans as a
  partial ``WindowGroupLimit`` before the shuffle: a category holding a third of all rows
  still ships only k rows per input partition.
* Proportional splits (E4/E5) cannot use a per-class window (a class may be a third of the
  table). Rows are placed in 65,536 hash buckets per class; bucket counts and their running
  sums form a small table; whole buckets go to train or test, and only the one boundary
  bucket per class is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_bucket, hash_key

SPLIT_BUCKET_HEX = 4  # 16 bits -> 65,536 buckets per class


def initial_stratified_sample(df: DataFrame, k: int, category_col: str = "category",
                              id_col: str = "row_id", seed: int = 42,
                              categories: list[str] | None = None) -> DataFrame:
    """Exactly k rows per category, none from a category with fewer than k rows."""
    base = df.filter(F.col(category_col).isNotNull())
    if categories is not None:
        base = base.filter(F.col(category_col).isin(list(categories)))
    big = base.groupBy(category_col).agg(F.count(F.lit(1)).alias("_n")) \
              .filter(F.col("_n") >= k).select(category_col)
    w = Window.partitionBy(category_col).orderBy(hash_key(seed, "initial", id_col), F.col(id_col))
    ranked = base.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
    return ranked.join(big, category_col, "left_semi")


def random_candidates(df: DataFrame, n: int, id_col: str = "row_id", seed: int = 42,
                      iteration: int = 0, local_col: str | None = "local_idx") -> DataFrame:
    """``min(n, rows)`` rows uniformly without replacement (a top-n on the hash order).

    ``local_idx`` numbers the picked rows 0..n-1 in that order (window over at most n rows).
    """
    key = hash_key(seed, f"candidates:{iteration}", id_col)
    picked = df.withColumn("_h", key).orderBy("_h", id_col).limit(n)
    if local_col:
        picked = picked.withColumn(local_col, F.row_number().over(
            Window.orderBy("_h", id_col)) - 1)
    return picked.drop("_h")


def random_fallback_pick(df: DataFrame, n: int, local_col: str = "local_idx", seed: int = 42,
                         iteration: int = 0, group_cols: list[str] | None = None) -> DataFrame:
    """N of the candidate positions at random (per candidate batch when grouped)."""
    g = list(group_cols or [])
    w = (Window.partitionBy(*g) if g else Window.partitionBy()).orderBy(
        hash_key(seed, f"fallback:{iteration}", *g, local_col), F.col(local_col))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def split_quotas(df: DataFrame, label_col: str, test_size: float) -> DataFrame:
    """Per-class train/test counts of a stratified shuffle split.

    ``n_test = ceil(test_size * n)`` (floating point, as in the published algorithm);
    train share per class by largest remainder of ``count / n * n_train``; ties go to the
    smaller label. Every class needs at least two rows.
    """
    cc = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_c"))
    tot = cc.agg(F.sum("_c").alias("_n"), F.min("_c").alias("_min_c"))
    n_test = F.ceil(F.lit(float(test_size)) * F.col("_n"))
    q = cc.crossJoin(F.broadcast(tot)).withColumn("_n_train", F.col("_n") - n_test)
    q = q.withColumn("_cont", F.col("_c") / F.col("_n") * F.col("_n_train"))
    q = q.withColumn("_floor", F.floor("_cont")).withColumn("_rem", F.col("_cont") - F.col("_floor"))
    w_all = Window.partitionBy()  # one row per class: a small table
    q = q.withColumn("_need", F.col("_n_train") - F.sum("_floor").over(w_all))
    q = q.withColumn("_rk", F.row_number().over(
        Window.orderBy(F.desc("_rem"), F.asc(label_col))))
    train_q = F.col("_floor") + (F.col("_rk") <= F.col("_need")).cast("long")
    guard = F.when(F.col("_min_c") < 2, F.raise_error(F.lit(
        "The least populated class has only 1 member; stratified split needs 2")))
    return q.select(label_col, F.col("_c").alias("class_count"),
                    F.coalesce(guard.cast("long"), train_q).alias("train_quota"),
                    (F.col("_c") - train_q).alias("test_quota"))


def split_cuts(df: DataFrame, label_col: str, id_col: str, test_size: float = 0.2, seed: int = 42,
               tag: str = "test") -> DataFrame:
    """One row per class (a null label is a class too): the (hash, id) of its last ``first`` row.

    Rows per (class, hash bucket) give the bucket in which each class's quota ends; only the rows of
    those buckets are ranked. Fitted eagerly and written, like a model: a row per class."""
    from ..session import write_table
    base = df.select(label_col, id_col).withColumn("_k", hash_key(seed, tag, id_col)).withColumn("_b", hash_bucket(F.col("_k"), SPLIT_BUCKET_HEX))
    quotas = split_quotas(df, label_col, test_size).select(F.col(label_col).alias("_label"), "train_quota")
    counts = base.groupBy(F.col(label_col).alias("_cl"), "_b").agg(F.count(F.lit(1)).alias("_bc"))
    w = Window.partitionBy("_cl").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_bc").over(w), F.lit(0)))
    ends = (counts.join(quotas, F.col("_cl").eqNullSafe(F.col("_label")))
            .filter((F.col("_before") < F.col("train_quota")) & (F.col("train_quota") <= F.col("_before") + F.col("_bc")))
            .select("_label", F.col("_b").alias("_end"), (F.col("train_quota") - F.col("_before")).alias("_need")))
    ends = write_table(ends, "split_ends")
    edge = base.join(F.broadcast(ends), F.col(label_col).eqNullSafe(F.col("_label")) & (F.col("_b") == F.col("_end")))
    rank = F.row_number().over(Window.partitionBy("_label", "_b").orderBy("_k", id_col))
    return write_table(edge.withColumn("_rn", rank).filter(F.col("_rn") == F.col("_need"))
                       .select("_label", F.col("_k").alias("_cut_k"), F.col(id_col).alias("_cut_id")), "split_cuts")


def stratified_split(df: DataFrame, label_col: str, id_col: str, test_size: float = 0.2,
                     seed: int = 42, tag: str = "test", out_col: str = "split",
                     first: str = "train", rest: str = "test") -> DataFrame:
    """Exact stratified split. The first ``train_quota`` rows of each class in hash order
    are labelled ``first``, the others ``rest``. No row is shuffled: each compares its own hash
    with its class's cut (one broadcast row per class). Null labels form a class of their own."""
    cuts = split_cuts(df, label_col, id_col, test_size, seed, tag)
    k = hash_key(seed, tag, id_col)
    inside = (k < F.col("_cut_k")) | ((k == F.col("_cut_k")) & (F.col(id_col) <= F.col("_cut_id")))
    tagged = df.join(F.broadcast(cuts), F.col(label_col).eqNullSafe(F.col("_label")), "left")
    return tagged.select(*df.columns, F.when(F.coalesce(inside, F.lit(False)), F.lit(first)).otherwise(F.lit(rest)).alias(out_col))


def train_val_test_split(df: DataFrame, label_col: str, id_col: str, test_size: float = 0.2,
                         val_size: float = 0.1, seed: int = 42, out_col: str = "split") -> DataFrame:
    """E4 + E5: test split first, then ``val_size`` of the remaining rows as validation."""
    first = stratified_split(df, label_col, id_col, test_size, seed, "test", out_col)
    test = first.filter(F.col(out_col) == "test")
    train_val = first.filter(F.col(out_col) == "train").drop(out_col)
    second = stratified_split(train_val, label_col, id_col, val_size, seed, "val", out_col,
                              first="train", rest="val")
    return second.unionByName(test)
