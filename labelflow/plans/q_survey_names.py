"""Queries registered under the remaining operator names of the survey inventory (each runs
the operator on the test tables; several share their DuckDB twin with a sibling query)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hash_half
from ..operators import curate as C
from ..operators import drift_text as DT
from ..sources.tables import read_table
from . import q_active, q_drift
from .registry import REGISTRY, register, rounded

SEED = 42


@register("require_columns", "SELECT doc_id, lang, text FROM documents")
def q_require_columns(spark, sf):
    """The column check runs on the driver before any job; the projection follows."""
    d = read_table(spark, sf, "documents")
    return C.require_columns(d, "doc_id", "lang", "text").select("doc_id", "lang", "text")


@register("require_non_empty", "SELECT count(*) AS reference_rows FROM documents")
def q_require_non_empty(spark, sf):
    """An empty reference is an error (one short ``isEmpty`` job), then it is used."""
    ref = C.require_non_empty(read_table(spark, sf, "documents"))
    return ref.agg(F.count(F.lit(1)).alias("reference_rows"))


register("batch_bounds", REGISTRY["drift_batch_envelope"].sql)(REGISTRY["drift_batch_envelope"].build)


@register("drift_severity", q_drift.DETECT_SQL + """SELECT CASE WHEN count(*) = 0 THEN 'none'
WHEN count(*) FILTER (WHERE drift_detected) = 0 THEN 'none' WHEN count(*) FILTER (WHERE drift_detected) = 1 THEN 'low'
WHEN count(*) FILTER (WHERE drift_detected) = count(*) THEN 'high' ELSE 'medium' END AS drift_severity,
count(*) FILTER (WHERE drift_detected) > 0 AS drift_detected FROM methods""")
def q_drift_severity(spark, sf):
    """J3 on the method rows of the English vs other languages."""
    from ..operators import drift as DR
    return DR.aggregate_methods(q_drift._detect(spark, sf)).select("drift_severity", "drift_detected")


@register("domain_classifier_fit", "WITH " + q_drift.TFIDF_SQL + f""",
wtr AS (SELECT * FROM w WHERE substr(md5('{SEED}:domain:' || doc_id), 1, 1) < '8')
SELECT term, round(log_odds, 6) AS log_odds FROM ({q_drift._logodds_sql('wtr')}) lo""")
def q_domain_classifier_fit(spark, sf):
    """The fitted relational domain classifier (per-term log-odds on the train half)."""
    w = DT.tfidf_features(q_drift.text_corpus(spark, sf))
    lo = DT.term_log_odds(w.filter(hash_half(SEED, "domain", "doc_id")))
    return rounded(lo.select("term", "log_odds"))


register("drift_method_result", REGISTRY["drift_method_results"].sql)(REGISTRY["drift_method_results"].build)


@register("active_learning_result", q_active.RUN_SQL + "SELECT category, count(*) AS count FROM log GROUP BY category")
def q_active_learning_result(spark, sf):
    """K9: the final category distribution of a run (one row per category)."""
    res = q_active._run(spark, sf)
    return res.final_distribution.select(F.explode("distribution").alias("category", "count"))
