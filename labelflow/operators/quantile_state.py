"""Percentiles from states that merge (C11, I1): saved per batch, joined later, still exact.

A state is one row per group: a KLL sketch of the finite values, their number, the number of NaN and
the moments of the confidence profile. States of batches are written once and merged at will; no row
is read again for that. The exact percentile then takes one scan of the rows: the sketch names two values
between which the wanted rank lies, rows below and above them are only counted, and rows between
them shrink to (value, n). A sketch errs by chance, so the counts are checked against the wanted
rank; a bracket that missed is widened and the scan repeated, at last without any bound.

Nulls are ignored, NaN makes the percentile NaN (numpy's rule), a group without values has a null
percentile, null group keys form a group, an ungrouped empty frame gives one row with count 0. States
that do not describe the rows at hand (other counts) are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import prefix_totals

SKETCH_K = 800  # items a sketch level keeps; its rank error is then about 0.4 % of the rows
SLACK = 0.01    # half width of the bracket as a share of the rows


def _key(g: list[str]):
    """The group as one column that is never null (a struct equals itself also with null fields)."""
    return F.struct(*g) if g else F.lit(0)


def quantile_states(df: DataFrame, value_col: str, group_cols: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """One state per group, map-side combined: a task sends one sketch a group."""
    g = list(group_cols or [])
    v = F.col(value_col).cast("double")
    finite = F.when(~F.isnan(v), v)
    return df.groupBy(*g).agg(
        F.kll_sketch_agg_double(finite, F.lit(k)).alias("sketch"), F.count(finite).alias("n"),
        F.count_if(F.isnan(v)).alias("n_nan"), F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("low"), F.max(v).alias("high"))


def merge_quantile_states(states: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """States of disjoint sets of rows -> the state of their union, per group. The squared deviations
    are taken around the joint mean, so that nothing cancels."""
    g = list(group_cols or [])
    s = states.withColumn("_g", _key(g)).withColumn("_all", F.col("n") + F.col("n_nan"))
    mean = s.groupBy("_g").agg((F.sum(F.col("mean") * F.col("_all")) / F.nullif(F.sum("_all"), F.lit(0))).alias("_mean"))
    about = s.join(mean, "_g")
    out = about.groupBy("_g").agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("n_nan"), F.lit(0)).alias("n_nan"), F.first("_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("_all") * (F.col("mean") - F.col("_mean")) ** 2).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"))
    return out.select(*[F.col(f"_g.{c}").alias(c) for c in g], *out.columns[1:])


def _bracket(states: DataFrame, q: float, slack: float) -> DataFrame:
    def bound(rank: float, open_end: float):
        if not 0.0 < rank < 1.0:
            return F.lit(open_end)
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(rank)))
    return states.select("_g", "n", "n_nan", bound(q - slack, float("-inf")).alias("_lo"), bound(q + slack, float("inf")).alias("_hi"))


def percentile_from_states(df: DataFrame, states: DataFrame, value_col: str, q: float, group_cols: list[str] | None = None,
                           out_col: str = "percentile", slack: float = SLACK) -> DataFrame:
    """Per group ``count``, the exact percentile (numpy ``linear``) and ``has_nan``. ``states`` holds one
    state per group of exactly these rows."""
    from ..session import write_table
    g = list(group_cols or [])
    v = F.col(value_col).cast("double")
    rows = df.select(_key(g).alias("_g"), v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    states = states.withColumn("_g", _key(g))
    pos = F.lit(q) * (F.col("n") - 1)
    for width in (slack, 5 * slack, 1.0):
        bounds = write_table(_bracket(states, q, width), "quantile_bracket")  # one row per group
        side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
        placed = rows.join(bounds.select("_g", "_lo", "_hi"), "_g", "left").select("_g", side.alias("_side"), "_v")
        counts = write_table(placed.groupBy("_g", "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_v"))
                             .agg(F.count(F.lit(1)).alias("_n")), "quantile_counts")
        found = counts.groupBy("_g").agg(
            F.sum("_n").alias("_rows"), F.coalesce(F.sum(F.when(F.col("_side") < 0, F.col("_n"))), F.lit(0)).alias("_below"),
            F.coalesce(F.sum(F.when(F.col("_side") == 0, F.col("_n"))), F.lit(0)).alias("_inside"))
        seen = bounds.join(found, "_g", "full").select("_g", F.col("n").isNull().alias("_new"), F.coalesce("n", F.lit(0)).alias("n"), *[
            F.coalesce(c, F.lit(0)).alias(c) for c in ("_rows", "_below", "_inside")])
        wrong = F.col("_new") | (F.col("n") != F.col("_rows"))
        missed = (F.col("n") > 0) & ((F.floor(pos) < F.col("_below")) | (F.ceil(pos) >= F.col("_below") + F.col("_inside")))
        check = seen.agg(F.count_if(wrong).alias("wrong"), F.count_if(missed).alias("missed")).first()
        if check["wrong"]:
            raise ValueError(f"{check['wrong']} states do not describe the rows: their counts differ")
        if not check["missed"]:
            break
    run = prefix_totals(counts.filter("_side = 0").select("_g", "_v", "_n"), ["_g"], "_v", ["_n"])
    run = run.join(seen.select("_g", "n", "_below"), "_g").withColumn("_from", F.col("_below") + F.col("_n_before"))

    def at(rank):
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_n")), F.col("_v")))

    picked = run.groupBy("_g").agg(at(F.floor(pos)).alias("_a"), at(F.ceil(pos)).alias("_b"))
    out = bounds.join(picked, "_g", "left")
    pct = (F.when(F.col("n_nan") > 0, F.lit(float("nan")))
           .when(F.col("n") > 0, F.col("_a") + (F.col("_b") - F.col("_a")) * (pos - F.floor(pos))))
    return out.select(*[F.col(f"_g.{c}").alias(c) for c in g], (F.col("n") + F.col("n_nan")).alias("count"), pct.alias(out_col),
                      (F.col("n_nan") > 0).alias("has_nan"))
