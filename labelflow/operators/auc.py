"""ROC-AUC by midranks (Mann-Whitney), exact and distributed.

For one group, AUC = sum over distinct scores s of pos(s) * (neg_below(s) + neg(s) / 2),
divided by P * N: ties count one half, exactly like the trapezoid ROC area. The inputs are
first reduced to ``(group, score) -> (pos, neg)`` with map-side partial aggregation, then the
running ``neg_below`` comes from the distributed prefix kernel, so no group is ever sorted in
a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import prefix_totals


def auc_from_counts(counts: DataFrame, group_cols: list[str], score_col: str = "score",
                    n_rows: int | None = None) -> DataFrame:
    """``counts``: unique per (group, score) with ``pos``, ``neg`` -> per group ``auc``, ``n_pos``,
    ``n_neg`` (``auc`` null when a group lacks positives or negatives). ``n_rows`` is an upper
    bound of the number of count rows (sizes the range buckets; counted when omitted)."""
    run = prefix_totals(counts, group_cols, score_col, ["neg"], n_rows=n_rows)
    part = run.groupBy(*group_cols).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") * 0.5)).alias("_u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg")))
    return part.select(*group_cols, auc.alias("auc"), "n_pos", "n_neg")


def binary_auc(df: DataFrame, label_col: str, score_col: str, positive, n_rows: int | None = None) -> DataFrame:
    """One row ``auc`` for ``label == positive`` vs the rest."""
    is_pos = (F.col(label_col) == F.lit(positive)).cast("long")
    counts = df.filter(F.col(score_col).isNotNull() & F.col(label_col).isNotNull()) \
        .groupBy(F.col(score_col).cast("double").alias("score")) \
        .agg(F.sum(is_pos).alias("pos"), F.sum(1 - is_pos).alias("neg")) \
        .withColumn("_g", F.lit(0))
    return auc_from_counts(counts, ["_g"], n_rows=n_rows).drop("_g")


def score_counts(long_probs: DataFrame, true_col: str = "true_label") -> DataFrame:
    """``(label, true_label, score, n)``: everything that the per-class and pairwise AUCs need."""
    return long_probs.groupBy("label", F.col(true_col).alias("true_label"), F.col("prob").cast("double").alias("score")) \
        .agg(F.count(F.lit(1)).alias("n"))


def split_counts(counts: DataFrame, group_cols: list[str]) -> DataFrame:
    """Positives (true label = label) and negatives per (group, score)."""
    is_pos = F.col("true_label") == F.col("label")
    return counts.groupBy(*group_cols, "score").agg(F.sum(F.when(is_pos, F.col("n")).otherwise(0)).alias("pos"),
                                                    F.sum(F.when(is_pos, 0).otherwise(F.col("n"))).alias("neg"))


def ovr_auc(long_probs: DataFrame, true_col: str = "true_label", n_rows: int | None = None) -> DataFrame:
    """H13 per class: AUC of ``prob(label)`` for ``true == label`` vs rest.

    ``long_probs``: ``(id, true, label, prob)``."""
    return auc_from_counts(split_counts(score_counts(long_probs, true_col), ["label"]), ["label"], n_rows=n_rows)


def ovo_auc(long_probs: DataFrame, labels: DataFrame, true_col: str = "true_label",
            n_rows: int | None = None) -> DataFrame:
    """H14 per unordered pair (a < b): mean of AUC(a vs b on prob_a) and AUC(b vs a on prob_b)
    over the rows whose true label is a or b (Hand & Till)."""
    return ovo_from_counts(score_counts(long_probs, true_col), [r[0] for r in labels.collect()], n_rows)


def ovo_from_counts(counts: DataFrame, labels: list[str], n_rows: int | None = None) -> DataFrame:
    """H14 from the score counts: only counts are paired with the other classes, never rows."""
    everyone = F.array(*[F.lit(x) for x in labels])
    is_pos = F.col("true_label") == F.col("label")
    others = F.when(is_pos, F.array_except(everyone, F.array("label"))).otherwise(F.array("true_label"))
    allc = counts.select(F.col("label").alias("a"), F.explode(others).alias("b"), "score",
                         F.when(is_pos, F.col("n")).otherwise(0).alias("pos"), F.when(is_pos, 0).otherwise(F.col("n")).alias("neg"))
    per = allc.groupBy("a", "b", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    directed = auc_from_counts(per, ["a", "b"], n_rows=n_rows)
    pair = F.when(F.col("a") < F.col("b"), F.struct(F.col("a"), F.col("b"))).otherwise(
        F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return directed.groupBy(pair.alias("_p")).agg(F.avg("auc").alias("auc"),
                                                   F.count(F.lit(1)).alias("_dirs")) \
        .select(F.col("_p.a").alias("label_a"), F.col("_p.b").alias("label_b"),
                F.when(F.col("_dirs") == 2, F.col("auc")).alias("auc"))
