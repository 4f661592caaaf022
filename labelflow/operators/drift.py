"""Drift aggregation across methods (J1-J4, J23, A9, DR severity rules).

Each method yields a row ``(method, drift_detected, details map<string,double>)`` (J23). The
batch result (J2) counts the methods that detected drift (exploratory methods such as
``text_overview`` never vote): d = 0 -> none; d = 1 -> low (also when only one method is
configured); d = t -> high; otherwise medium. ``drift_detected = d > 0``,
``detection_rate = d / t``; no method -> none with a reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import auto_batch_id, iso_timestamp
from .curate import require_columns, require_non_empty

EXPLORATORY = ("text_overview",)


@dataclass(frozen=True)
class DriftConfig:
    methods: tuple = ("domain_classifier", "embedding")
    text_column: str = "text"
    batch_id_column: str | None = None
    time_start_column: str | None = None
    time_end_column: str | None = None
    embedding_drift_method: str = "mmd"
    use_bootstrap: bool = True
    quantile_probability: float = 0.05
    id_column: str = "doc_id"
    n_boot: int = 100
    seed: int = 42
    sigma: float | None = None      # both are needed for fits that are to be merged,
    name_digits: int | None = None  # see drift_embed.fit_embedding


@dataclass
class DriftFit:
    """What a fitted detector keeps: the reference's ids and term counts (domain classifier, a
    ``term_blocks.TermBlocks``) and vector statistics with the threshold (embedding), all written."""
    config: DriftConfig
    terms: object | None = None
    embedding: object | None = None


def written_vectors(texts: DataFrame, keep: str | None = None, embed=None) -> DataFrame:
    """``([keep], embedding)`` of ``texts``, written: what reads the vectors (size, bandwidth, halvings,
    null filters) neither makes them again nor adds the encoder's Python workers to its own."""
    from ..session import prepare_udfs, write_table
    from . import drift_embed as DE
    prepare_udfs(texts.sparkSession)
    return write_table((embed or DE.embed_letter_profile)(texts).select(*([keep] if keep else []), "embedding"), "drift_vectors")


def drift_fit(reference: DataFrame, config: DriftConfig = DriftConfig(), embed=None) -> DriftFit:
    """Fit every configured method once on the reference. ``embed``: adds the column
    ``embedding`` to a frame of texts (default: the letter profile)."""
    from . import drift_embed as DE
    from . import term_blocks as TB
    require_columns(reference, config.text_column, config.id_column)
    require_non_empty(reference)
    fit = DriftFit(config)
    ref = reference.select(config.id_column, F.col(config.text_column).alias("text"), F.lit("ref").alias("side"))
    for method in config.methods:
        if method == "domain_classifier":
            fit.terms = TB.term_blocks(ref, config.id_column, seed=config.seed)
        elif method == "embedding":
            vectors = written_vectors(ref, config.id_column, embed)
            fit.embedding = DE.fit_embedding(vectors, config.embedding_drift_method, config.use_bootstrap, config.quantile_probability,
                                             config.id_column, n_boot=config.n_boot, seed=config.seed,
                                             sigma=config.sigma, name_digits=config.name_digits)
        elif method not in EXPLORATORY:
            raise ValueError(f"unknown drift method {method!r}")
    return fit


def merge_fits(a: DriftFit, b: DriftFit) -> DriftFit:
    """A reference that grows: the fit of two disjoint references with the same settings, made of what
    both fits keep. The written term counts stand side by side, embedding statistics add up."""
    from . import drift_embed as DE
    if a.config != b.config:
        raise ValueError("fits of different settings cannot be merged")
    out = DriftFit(a.config)
    if a.terms is not None:
        out.terms = a.terms.union(b.terms)
    if a.embedding is not None:
        out.embedding = DE.merge_embedding(a.embedding, b.embedding)
    return out


def drift_method_rows(current: DataFrame, fit: DriftFit, embed=None) -> DataFrame:
    """A row per configured voting method, the batch against the fitted reference."""
    from . import drift_embed as DE
    from . import drift_text as DT
    from . import term_blocks as TB
    c = fit.config
    cur = current.select(c.id_column, F.col(c.text_column).alias("text"), F.lit("cur").alias("side"))
    rows = []
    for method in c.methods:
        if method == "domain_classifier":
            blocks = fit.terms.union(TB.term_blocks(cur, c.id_column, seed=c.seed))
            got = DT.domain_classifier(None, c.id_column, seed=c.seed, blocks=blocks)
            rows.append(got.select(*method_result(method, F.col("drift_detected"), {"roc_auc": F.col("roc_auc"), "threshold": F.col("threshold")})))
        elif method == "embedding":
            got = DE.detect_embedding(fit.embedding, written_vectors(cur, embed=embed))
            rows.append(got.select(*method_result(method, F.col("drift_detected"), {"drift_score": F.col("drift_score"), "threshold": F.col("threshold")})))
    if not rows:
        return current.sparkSession.createDataFrame([], "method string, drift_detected boolean, details map<string,double>")
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def drift_detect(current: DataFrame, fit: DriftFit, embed=None) -> DataFrame:
    """J2 + J3: the aggregated result of one batch against a fitted detector."""
    return aggregate_methods(drift_method_rows(current, fit, embed))


def method_result(method: str, drift_detected: Column, details: dict[str, Column]) -> list[Column]:
    """Columns of one method row; a missing flag counts as no drift."""
    keys = sorted(details)
    return [F.lit(method).alias("method"),
            F.coalesce(drift_detected, F.lit(False)).alias("drift_detected"),
            F.map_from_arrays(F.array(*[F.lit(k) for k in keys]),
                              F.array(*[details[k].cast("double") for k in keys])).alias("details")]


def drift_severity(d: Column, t: Column) -> Column:
    """J3 in the order of the rules."""
    return (F.when(t == 0, F.lit("none")).when(d == 0, F.lit("none")).when(d == 1, F.lit("low"))
             .when(d == t, F.lit("high")).otherwise(F.lit("medium")))


def aggregate_methods(methods: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """J2/J3 on method rows (per batch when grouped)."""
    g = list(group_cols or [])
    voting = methods.filter(~F.col("method").isin(*EXPLORATORY))
    a = voting.groupBy(*g).agg(F.count(F.lit(1)).alias("total_methods"),
                               F.count_if("drift_detected").alias("no_of_methods_detected_drift"),
                               F.map_from_entries(F.collect_list(F.struct(
                                   "method", F.struct("method", "drift_detected", "details")))).alias("method_results"))
    t, d = F.col("total_methods"), F.col("no_of_methods_detected_drift")
    return a.select(*g, (d > 0).alias("drift_detected"), drift_severity(d, t).alias("drift_severity"),
                    "total_methods", "no_of_methods_detected_drift",
                    F.when(t > 0, d / t).otherwise(F.lit(0.0)).alias("detection_rate"), "method_results",
                    F.when(t == 0, F.lit("no methods configured")).alias("reason"))


def batch_envelope(df: DataFrame, order_col: str, config: DriftConfig, batch_id: str | None = None,
                   time_start=None, time_end=None) -> DataFrame:
    """Batch id and start from the FIRST row, end from the LAST row (by ``order_col``),
    each falling back to the parameter, then to a generated id / the current time."""
    now = F.current_timestamp()
    aggs = [F.count(F.lit(1)).alias("_n")]
    if config.batch_id_column and config.batch_id_column in df.columns:
        aggs.append(F.min_by(F.col(config.batch_id_column).cast("string"), order_col).alias("_bid"))
    if config.time_start_column and config.time_start_column in df.columns:
        aggs.append(F.min_by(F.col(config.time_start_column), order_col).alias("_ts"))
    if config.time_end_column and config.time_end_column in df.columns:
        aggs.append(F.max_by(F.col(config.time_end_column), order_col).alias("_te"))
    a = df.agg(*aggs)
    if "_bid" in a.columns:
        bid = F.coalesce(F.col("_bid"), F.lit("unknown"))
    elif batch_id:
        bid = F.lit(batch_id)
    else:
        bid = auto_batch_id(now)
    ts = F.col("_ts").cast("timestamp") if "_ts" in a.columns else (F.lit(time_start).cast("timestamp") if time_start else now)
    te = F.col("_te").cast("timestamp") if "_te" in a.columns else (F.lit(time_end).cast("timestamp") if time_end else now)
    return a.select(bid.alias("batch_id"), ts.alias("time_start"), te.alias("time_end"), now.alias("timestamp"))


def drift_output(envelope: DataFrame, aggregated: DataFrame) -> DataFrame:
    """The one-row batch result (both inputs are single rows)."""
    return envelope.crossJoin(aggregated)


def drift_result_json(output: DataFrame) -> DataFrame:
    """Nested JSON text with enum values and ISO timestamps."""
    return output.select(F.to_json(F.struct(
        "batch_id", "drift_detected", "drift_severity",
        iso_timestamp("timestamp").alias("timestamp"), iso_timestamp("time_start").alias("time_start"),
        iso_timestamp("time_end").alias("time_end"), "method_results",
        F.struct("total_methods", "no_of_methods_detected_drift", "detection_rate").alias("aggregation_details")))
        .alias("json"))
