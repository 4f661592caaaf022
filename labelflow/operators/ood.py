"""Out-of-distribution flagging on prediction confidence.

fit: threshold = the alpha percentile (numpy ``linear``) of the reference confidences, plus
the confidence profile. detect: rows with ``confidence < threshold`` (strict) are flagged;
one severity per run from the flagged share (0 -> none, < 0.1 low, < 0.3 medium, else high;
compared on integer counts, so boundary shares are exact). A NaN confidence in the reference
makes the threshold NaN and then nothing is flagged (the reference's numpy behaviour).

Scale: the percentile comes from the bracketed exact kernel (no group held in one task); the
threshold and the run statistics are one-row frames attached by a one-row broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import iso_timestamp
from .curate import require_columns
from .kernels import exact_percentile
from .quantile_state import merge_quantile_states, percentile_from_states, quantile_states

OOD_OUTPUT_COLUMNS = ["batch_id", "ood_confidence", "threshold", "ood_severity", "timestamp"]


@dataclass(frozen=True)
class OODConfig:
    alpha: float = 0.05
    text_column: str = "text"
    confidence_column: str = "confidence"
    predicted_label_column: str = "predicted_label"
    batch_id_column: str | None = None


# Severity cuts on the flagged share — 0 none, below 0.1 low, below 0.3 medium,
# otherwise high — and the default alpha 0.05; compared as 10*count < total and
# 10*count < 3*total so the boundaries are exact.
def severity(count: Column, total: Column) -> Column:
    """Severity from integer counts (ratio 0, < 0.1, < 0.3, else)."""
    return (F.when((total == 0) | (count == 0), F.lit("none"))
             .when(count * 10 < total, F.lit("low"))
             .when(count * 10 < total * 3, F.lit("medium"))
             .otherwise(F.lit("high")))


def confidence_profile(df: DataFrame, col: str = "confidence") -> DataFrame:
    """Count, mean, population std, min, max (0.0 for mean/min/max when empty)."""
    c = F.col(col).cast("double")
    return df.agg(F.count(c).alias("count"),
                  F.coalesce(F.avg(c), F.lit(0.0)).alias("mean_confidence"),
                  F.stddev_pop(c).alias("std_confidence"),
                  F.coalesce(F.min(c), F.lit(0.0)).alias("min_confidence"),
                  F.coalesce(F.max(c), F.lit(0.0)).alias("max_confidence"))


def ood_fit(reference: DataFrame, config: OODConfig = OODConfig()) -> DataFrame:
    """One row ``threshold, alpha, reference_samples, mean/std/min/max``."""
    require_columns(reference, config.confidence_column)
    pct = exact_percentile(reference, config.confidence_column, config.alpha)
    prof = confidence_profile(reference, config.confidence_column)
    guard = F.when(F.col("reference_samples") == 0,
                   F.raise_error(F.lit("Reference DataFrame cannot be empty")))
    out = pct.select(F.col("percentile").alias("threshold")).crossJoin(prof.withColumnRenamed("count", "reference_samples"))
    return out.select(F.coalesce(guard.cast("double"), F.col("threshold")).alias("threshold"),
                      F.lit(float(config.alpha)).alias("alpha"), "reference_samples",
                      "mean_confidence", "std_confidence", "min_confidence", "max_confidence")


def ood_states(reference: DataFrame, config: OODConfig = OODConfig(), group_cols: list[str] | None = None) -> DataFrame:
    """I1, kept per batch: one mergeable state per group of the reference's confidences. Write it next to
    the batch; later fits merge states and need no other statistic of the rows."""
    require_columns(reference, config.confidence_column)
    return quantile_states(reference, config.confidence_column, group_cols)


def ood_fit_from_states(states: DataFrame, reference: DataFrame, config: OODConfig = OODConfig(),
                        group_cols: list[str] | None = None) -> DataFrame:
    """I1 from saved states: ``ood_fit``'s columns, one row (``group_cols``: one per group). The states of
    all batches in ``reference`` are merged per group; the profile comes from them alone, the exact
    threshold from one scan that keeps only the values next to the wanted rank."""
    g = list(group_cols or [])
    merged = merge_quantile_states(states, g)
    pct = percentile_from_states(reference, merged, config.confidence_column, config.alpha, g, "threshold")
    n = F.col("n") + F.col("n_nan")
    prof = merged.select(*g, n.alias("reference_samples"), F.coalesce("mean", F.lit(0.0)).alias("mean_confidence"),
                         F.sqrt(F.col("m2") / n).alias("std_confidence"), F.coalesce("low", F.lit(0.0)).alias("min_confidence"),
                         F.coalesce("high", F.lit(0.0)).alias("max_confidence"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in g]
    on = same[0] if same else F.lit(True)  # without groups both sides have one row
    for c in same[1:]:
        on = on & c
    j = pct.alias("p").join(prof.alias("f"), on)
    guard = F.when(F.col("reference_samples") == 0, F.raise_error(F.lit("Reference DataFrame cannot be empty")))
    return j.select(*[F.col(f"p.{c}").alias(c) for c in g], F.coalesce(guard.cast("double"), F.col("threshold")).alias("threshold"),
                    F.lit(float(config.alpha)).alias("alpha"), "reference_samples", "mean_confidence", "std_confidence",
                    "min_confidence", "max_confidence")


def _is_ood(conf: Column, threshold: Column) -> Column:
    # Spark orders NaN above everything (x < NaN is true): test NaN explicitly (rule N8)
    return conf.isNotNull() & ~F.isnan(threshold) & (conf < threshold)


def _batch_column(df: DataFrame, config: OODConfig, batch_id: str | None) -> Column:
    """The configured column when present, else the parameter, else an error."""
    if config.batch_id_column and config.batch_id_column in df.columns:
        return F.col(config.batch_id_column).cast("string")
    if batch_id:
        return F.lit(batch_id)
    raise ValueError("Either batch_id parameter must be provided or batch_id_column must be "
                     "configured and present in DataFrame")


def ood_stats(df: DataFrame, fit: DataFrame, config: OODConfig = OODConfig(),
              group_cols: list[str] | None = None) -> DataFrame:
    """I4: ``total_samples, ood_count, ood_ratio, ood_severity, threshold, alpha,
    mean/min/max_confidence, timestamp`` (per group when ``group_cols`` is given: I7)."""
    g = list(group_cols or [])
    conf = F.col(config.confidence_column).cast("double")
    th = fit.select("threshold", "alpha")
    j = df.crossJoin(F.broadcast(th))
    agg = j.groupBy(*g).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(_is_ood(conf, F.col("threshold"))).alias("ood_count"),
        F.coalesce(F.avg(conf), F.lit(0.0)).alias("mean_confidence"),
        F.coalesce(F.min(conf), F.lit(0.0)).alias("min_confidence"),
        F.coalesce(F.max(conf), F.lit(0.0)).alias("max_confidence"))
    # the fitted threshold is one row: attach it again so an empty input still reports it
    agg = agg.crossJoin(F.broadcast(th.select(F.col("threshold").alias("_th"), F.col("alpha").alias("_alpha"))))
    ratio = F.when(F.col("total_samples") > 0, F.col("ood_count") / F.col("total_samples")).otherwise(F.lit(0.0))
    return agg.select(*g, "total_samples", "ood_count", ratio.cast("double").alias("ood_ratio"),
                      severity(F.col("ood_count"), F.col("total_samples")).alias("ood_severity"),
                      F.col("_th").alias("threshold"), F.col("_alpha").alias("alpha"),
                      "mean_confidence", "min_confidence", "max_confidence",
                      iso_timestamp(F.current_timestamp()).alias("timestamp"))


def ood_detect(df: DataFrame, fit: DataFrame, config: OODConfig = OODConfig(),
               batch_id: str | None = None, scope: str = "run") -> tuple[DataFrame, DataFrame]:
    """I2 (+ I4, I6, I7): ``(flagged_rows, stats)``.

    flagged rows = input columns + ``batch_id, ood_confidence, threshold, ood_severity,
    timestamp``. ``scope='run'`` gives one severity for the whole input (the reference);
    ``scope='batch'`` computes it per batch id. No flagged row -> empty frame, same columns.
    """
    require_columns(df, config.text_column, config.confidence_column, config.predicted_label_column)
    batch = _batch_column(df, config, batch_id)
    base = df.withColumn("batch_id", batch)  # an existing batch_id column is overwritten
    keep = [c for c in df.columns if c != "batch_id"]
    conf = F.col(config.confidence_column).cast("double")
    if scope == "batch":
        stats = ood_stats(base, fit, config, ["batch_id"])
        j = base.join(stats.select("batch_id", "ood_severity", "threshold", "timestamp"), "batch_id")
    elif scope == "run":
        stats = ood_stats(base, fit, config)
        j = base.crossJoin(F.broadcast(stats.select("ood_severity", "threshold", "timestamp")))
    else:
        raise ValueError("scope must be 'run' or 'batch'")
    flagged = j.filter(_is_ood(conf, F.col("threshold"))).select(
        *keep, "batch_id", conf.alias("ood_confidence"), "threshold", "ood_severity", "timestamp")
    return flagged, stats
