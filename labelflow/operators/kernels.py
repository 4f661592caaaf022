"""Two distributed kernels the operators build on.

``prefix_totals``
    Exclusive running sums over a sorted value, per group, without a single-task window.
    The value axis is cut into range buckets from approximate quantiles (one sketch job);
    bucket totals form a small table whose running sums give each bucket's offset; the
    remaining running sum is a window over ``(group, bucket)``, which spreads over as many
    tasks as there are buckets. The answer is exact for any bucketing (buckets only split the
    sorted order; equal values always share a bucket). Used by ROC-AUC, ECDF distances and
    dense row numbering.

``exact_percentile``
    Linear-interpolated percentile (numpy's default) per group: rows shrink to distinct values with
    counts, and running counts tell which value holds the wanted rank.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TARGET_ROWS_PER_BUCKET = 1_000_000


def _bucket_count(n_rows: int, target: int) -> int:
    return max(1, math.ceil(n_rows / max(1, target)))


def add_value_buckets(df: DataFrame, value_col: str, n_rows: int | None = None,
                      target_rows_per_bucket: int = TARGET_ROWS_PER_BUCKET,
                      bucket_col: str = "_bucket") -> DataFrame:
    """Range bucket id (monotone in ``value_col``); 0 everywhere when one bucket suffices. The cut
    points (one number per million distinct values) are all that passes through the driver."""
    if n_rows is None:
        n_rows = df.count()
    n_buckets = _bucket_count(n_rows, target_rows_per_bucket)
    if n_buckets <= 1:
        return df.withColumn(bucket_col, F.lit(0.0))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    cuts = df.select(F.col(value_col).cast("double").alias("_v")) \
             .na.drop().approxQuantile("_v", probs, 1.0 / (4 * n_buckets))
    splits = sorted(set(c for c in cuts if c is not None and not math.isnan(c)))
    splits = [-math.inf] + splits + [math.inf]
    tmp = "_bucket_in"
    out = Bucketizer(splits=splits, inputCol=tmp, outputCol=bucket_col, handleInvalid="keep") \
        .transform(df.withColumn(tmp, F.col(value_col).cast("double")))
    return out.drop(tmp)


def prefix_totals(df: DataFrame, group_cols: list[str], value_col: str, sum_cols: list[str],
                  n_rows: int | None = None,
                  target_rows_per_bucket: int = TARGET_ROWS_PER_BUCKET) -> DataFrame:
    """For rows unique per ``(group, value)``, add ``<c>_before``: the sum of ``c`` over all
    rows of the same group with a strictly smaller value."""
    b = add_value_buckets(df, value_col, n_rows, target_rows_per_bucket)
    gb = [*group_cols, "_bucket"]
    totals = b.groupBy(*gb).agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    w_off = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()) \
        .orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*gb, *[F.coalesce(F.sum(f"_tot_{c}").over(w_off), F.lit(0))
                                  .alias(f"_off_{c}") for c in sum_cols])
    w_in = Window.partitionBy(*gb).orderBy(value_col) \
        .rowsBetween(Window.unboundedPreceding, -1)
    out = b.join(offsets, gb, "left")
    out = out.select(*b.columns, *[
        (F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(w_in), F.lit(0))).alias(f"{c}_before")
        for c in sum_cols])
    return out.drop("_bucket")


def ecdf_distance(df: DataFrame, group_cols: list[str], value_col: str, side_col: str = "side",
                  ref: str = "ref", cur: str = "cur", weight_col: str | None = None) -> DataFrame:
    """Wasserstein-1 distance between the reference and current samples of each group:
    the integral of |F_ref - F_cur| over the pooled sorted values.

    Values are reduced to ``(group, value) -> (n_ref, n_cur)`` first; the running counts come
    from ``prefix_totals`` and the gap to the next distinct value from a window inside each
    range bucket plus a small bucket table, so no group is sorted in one task."""
    g = list(group_cols)
    v = F.col(value_col).cast("double")
    wt = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    counts = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*g, v.alias("_x")).agg(
        F.sum(F.when(F.col(side_col) == ref, wt).otherwise(F.lit(0))).alias("_nr"),
        F.sum(F.when(F.col(side_col) == cur, wt).otherwise(F.lit(0))).alias("_nc"))
    from ..session import write_table
    counts = write_table(counts, "value_counts")  # read five times below
    b = add_value_buckets(counts, "_x")
    gb = [*g, "_bucket"]
    totals = b.groupBy(*gb).agg(F.sum("_nr").alias("_tr"), F.sum("_nc").alias("_tc"), F.min("_x").alias("_bmin"))
    wb = (Window.partitionBy(*g) if g else Window.partitionBy()).orderBy("_bucket")
    off = totals.select(*gb,
                        F.coalesce(F.sum("_tr").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_or"),
                        F.coalesce(F.sum("_tc").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_oc"),
                        F.lead("_bmin").over(wb).alias("_next_bucket_min"))
    grand = totals.groupBy(*g).agg(F.sum("_tr").alias("_all_r"), F.sum("_tc").alias("_all_c"))
    wi = Window.partitionBy(*gb).orderBy("_x")
    j = b.join(off, gb).join(grand, g) if g else b.join(off, gb).crossJoin(grand)
    j = j.withColumn("_cr", F.col("_or") + F.sum("_nr").over(wi.rowsBetween(Window.unboundedPreceding, 0))) \
         .withColumn("_cc", F.col("_oc") + F.sum("_nc").over(wi.rowsBetween(Window.unboundedPreceding, 0))) \
         .withColumn("_nx", F.coalesce(F.lead("_x").over(wi), F.col("_next_bucket_min")))
    gap = F.coalesce(F.col("_nx") - F.col("_x"), F.lit(0.0))
    fr = F.when(F.col("_all_r") > 0, F.col("_cr") / F.col("_all_r")).otherwise(F.lit(0.0))
    fc = F.when(F.col("_all_c") > 0, F.col("_cc") / F.col("_all_c")).otherwise(F.lit(0.0))
    term = F.abs(fr - fc) * gap
    return j.groupBy(*g).agg(F.sum(term).alias("wasserstein"), F.first("_all_r").alias("n_ref"),
                             F.first("_all_c").alias("n_cur"))


def exact_percentile(df: DataFrame, value_col: str, q: float, group_cols: list[str] | None = None,
                     out_col: str = "percentile", nan_propagates: bool = True) -> DataFrame:
    """Per group: ``count``, ``percentile`` (numpy ``linear``), ``has_nan``.

    Rows shrink to (group, value, n) first, so ties never meet in one task; running counts over the
    distinct values (``prefix_totals``) then tell which value holds each wanted rank. One path for
    every size. numpy returns NaN as soon as one value is NaN; with ``nan_propagates`` the result
    follows that rule (Spark alone would sort NaN last and stay finite). Nulls are ignored.
    """
    from ..session import write_table
    g = list(group_cols or [])
    v = F.col(value_col).cast("double")
    counts = write_table(df.select(*g, v.alias("_v")).filter(F.col("_v").isNotNull())
                         .groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_n")), "value_counts")
    finite = counts.filter(~F.isnan("_v"))
    totals = counts.groupBy(*g).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("count"), F.coalesce(F.sum(F.when(~F.isnan("_v"), F.col("_n"))), F.lit(0)).alias("_total"),
        F.coalesce(F.max(F.isnan("_v").cast("int")), F.lit(0)).alias("_has_nan"))
    run = prefix_totals(finite, g, "_v", ["_n"])
    run = _with_totals(run, totals.select(*g, "_total"), g)
    pos = F.lit(q) * (F.col("_total") - 1)

    def holds(rank):
        return (F.col("_n_before") <= rank) & (rank < F.col("_n_before") + F.col("_n"))

    picked = run.groupBy(*g).agg(F.max(F.when(holds(F.floor(pos)), F.col("_v"))).alias("_lo_v"),
                                 F.max(F.when(holds(F.ceil(pos)), F.col("_v"))).alias("_hi_v"))
    res = totals.join(picked, g, "left") if g else totals.crossJoin(picked)  # one row each
    pct = F.when(F.col("count") == 0, F.lit(None).cast("double"))
    if nan_propagates:
        pct = pct.when(F.col("_has_nan") == 1, F.lit(float("nan")))
    pct = pct.otherwise(F.col("_lo_v") + (F.col("_hi_v") - F.col("_lo_v")) * (pos - F.floor(pos)))
    return res.select(*g, F.col("count"), pct.alias(out_col), (F.col("_has_nan") == 1).alias("has_nan"))


def _with_totals(df: DataFrame, totals: DataFrame, g: list[str]) -> DataFrame:
    return df.join(totals, g) if g else df.crossJoin(F.broadcast(totals))  # without groups: one row
