"""Registered time-window and streaming queries (L1-L3) and file sources/sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ood as O
from ..functions.columns import hash_half
from ..operators import sampling as SM
from ..operators import scoring as S
from ..operators.kernels import exact_percentile
from ..session import ensure_checkpoint_dir, shared_path
from ..sources import files as FS
from ..sources.tables import read_table
from ..streaming import monitors as MO
from .q_model import scorer_cte, with_scorer_all
from .registry import REGISTRY, register, rounded

ALPHA = 0.05
REF_END = "2024-01-08 00:00:00"


def events_reference_threshold(spark, sf):
    """Threshold = alpha percentile of ``events.value`` over the reference week."""
    e = read_table(spark, sf, "events")
    ref = e.filter(F.col("ts") < F.to_timestamp_ntz(F.lit(REF_END)))
    return exact_percentile(ref, "value", ALPHA).select(F.col("percentile").alias("threshold"))


@register("ood_by_time_window", f"""WITH th AS (SELECT quantile_cont(value, CAST({ALPHA} AS DOUBLE)) AS t FROM events
WHERE ts < TIMESTAMP '{REF_END}'),
w AS (SELECT date_trunc('day', ts) AS window_start, count(*) AS total_samples,
             count(*) FILTER (WHERE value < (SELECT t FROM th)) AS ood_count FROM events GROUP BY 1)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, total_samples, ood_count,
       round(ood_count / total_samples, 6) AS ood_ratio,
       CASE WHEN ood_count = 0 THEN 'none' WHEN ood_count * 10 < total_samples THEN 'low'
            WHEN ood_count * 10 < total_samples * 3 THEN 'medium' ELSE 'high' END AS ood_severity FROM w""", bench=True)
def q_ood_by_time_window(spark, sf):
    """L1 (batch form): daily tumbling windows of ``events``."""
    e = read_table(spark, sf, "events")
    out = MO.windowed_ood_counts(e, events_reference_threshold(spark, sf), "ts", "value", "1 day")
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
                   .withColumn("window_end", F.col("window_end").cast("timestamp_ntz")))


@register("ood_by_time_window_stream", REGISTRY["ood_by_time_window"].sql.replace(
    "       round(ood_count / total_samples, 6) AS ood_ratio,\n", ""))
def q_ood_by_time_window_stream(spark, sf):
    """L1 (streaming form): the events file as a feed, watermark + window, update mode, file sink."""
    e = read_table(spark, sf, "events")
    th = events_reference_threshold(spark, sf).first()["threshold"]
    stream = MO.file_stream(spark, sf, e, "events.parquet")
    q = MO.stream_ood_by_time_window(stream, th, "ts", "value", "1 day", "1 day")
    out = MO.run_to_files(q, shared_path(spark, "ood_windows"), shared_path(spark, "ckpt_ood_windows"), "update", ["window_start"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@register("drift_by_time_window", f"""WITH ref AS (SELECT value, count(*) AS nr FROM events WHERE ts < TIMESTAMP '{REF_END}' AND value IS NOT NULL GROUP BY value),
cur AS (SELECT date_trunc('day', ts) AS window_start, value, count(*) AS nc FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
u AS (SELECT window_start, value, nr, 0 AS nc FROM ref, (SELECT DISTINCT window_start FROM cur) d UNION ALL SELECT window_start, value, 0, nc FROM cur),
c AS (SELECT window_start, value, sum(nr) AS nr, sum(nc) AS nc FROM u GROUP BY 1, 2),
cum AS (SELECT window_start, sum(nr) OVER w / sum(nr) OVER (PARTITION BY window_start) AS fr, sum(nc) OVER w / sum(nc) OVER (PARTITION BY window_start) AS fc,
  lead(value) OVER w0 - value AS gap, nr, nc FROM c
  WINDOW w AS (PARTITION BY window_start ORDER BY value ROWS UNBOUNDED PRECEDING), w0 AS (PARTITION BY window_start ORDER BY value))
SELECT window_start, round(sum(abs(fr - fc) * coalesce(gap, 0.0)), 6) AS wasserstein, CAST(sum(nr) AS BIGINT) AS n_ref, CAST(sum(nc) AS BIGINT) AS n_cur
FROM cum GROUP BY window_start""")
def q_drift_by_time_window(spark, sf):
    """L2: foreachBatch over the events feed; per day, distance of ``value`` to the reference week."""
    ensure_checkpoint_dir(spark)
    e = read_table(spark, sf, "events")
    ref = e.filter(F.col("ts") < F.to_timestamp_ntz(F.lit(REF_END)))
    out = MO.drift_by_time_window(MO.file_stream(spark, sf, e, "events.parquet"), ref, "value", "ts",
                                  shared_path(spark, "drift_windows"), shared_path(spark, "ckpt_drift_windows"))
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@register("stream_scoring", "WITH " + scorer_cte(True).strip() + f""",
fit AS (SELECT quantile_cont(confidence, CAST({ALPHA} AS DOUBLE)) AS threshold FROM scored
  WHERE NOT substr(md5('42:train:' || doc_id), 1, 1) < '8' AND substr(md5('42:ood:' || doc_id), 1, 1) < '8')
SELECT doc_id, lang, predicted_label_id, predicted_label, round(confidence, 6) AS confidence, confidence < threshold AS is_ood FROM scored, fit""")
def q_stream_scoring(spark, sf):
    """L3: score a document feed with the fitted letter model and flag low confidence (file sink)."""
    from .q_model import letter_model, ood_reference_and_batch
    ref, _ = ood_reference_and_batch(spark, sf)
    fit = O.ood_fit(ref)
    d = read_table(spark, sf, "documents")
    stream = MO.file_stream(spark, sf, d, "documents.parquet")
    scored = S.predict(stream.select("doc_id", "lang", "text"), letter_model(spark, sf), "text", keep_probs=False)
    flagged = MO.flag_stream(scored.drop("text"), fit)
    return rounded(MO.run_to_files(flagged, shared_path(spark, "scored_stream"), shared_path(spark, "ckpt_scoring")))


# ---------------------------------------------------------------- file sources and sinks

@register("scan_csv", "SELECT doc_id, lang, text FROM documents")
def q_scan_csv(spark, sf):
    """A2: a CSV source (header, multi-line quoted fields) read with a declared schema; the
    CSV path skips the label and year filters. Round trip of the documents table."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = FS.write_csv(d, shared_path(spark, "documents_csv"))
    return FS.scan_csv(spark, path, d.schema)


def _state_csv_sql(where: str) -> str:
    from .q_active import RUN_SQL
    return (RUN_SQL + "SELECT CAST(pool.doc_id AS VARCHAR) AS doc_id, pool.category, "
            "CASE WHEN log.doc_id IS NOT NULL THEN 'true' ELSE 'false' END AS selected, "
            "CAST(coalesce(log.iteration, -1) AS VARCHAR) AS iteration FROM pool LEFT JOIN log USING (doc_id) " + where)


@register("write_training_csv", _state_csv_sql("WHERE log.doc_id IS NOT NULL"))
def q_write_training_csv(spark, sf):
    """A3: selected rows of an active-learning run, written as CSV and read back."""
    from .q_active import _run
    res = _run(spark, sf)
    path = FS.write_csv(res.training_data.select("doc_id", "category", "selected", "iteration"),
                        shared_path(spark, "training_data"))
    return spark.read.option("header", True).csv(path)


@register("write_pool_csv", _state_csv_sql(""))
def q_write_pool_csv(spark, sf):
    """A4: the whole pool with the selection columns."""
    from .q_active import _run
    res = _run(spark, sf)
    path = FS.write_csv(res.pool_with_selections.select("doc_id", "category", "selected", "iteration"),
                        shared_path(spark, "pool_with_selections"))
    return spark.read.option("header", True).csv(path)


@register("write_predictions_csv", with_scorer_all(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CAST(predicted_label_id AS VARCHAR) AS predicted_label_id, "
    "predicted_label AS predicted_category, CASE WHEN coalesce(lang = predicted_label, false) THEN 'true' ELSE 'false' END "
    "AS correct FROM scored"))
def q_write_predictions_csv(spark, sf):
    """A5: test rows + predicted id / category + correct."""
    from .q_model import scored_all
    s = scored_all(spark, sf).select("doc_id", "lang", "predicted_label_id",
                                      F.col("predicted_label").alias("predicted_category"),
                                      F.coalesce(F.col("lang") == F.col("predicted_label"), F.lit(False)).alias("correct"))
    path = FS.write_csv(s, shared_path(spark, "test_predictions"))
    return spark.read.option("header", True).csv(path)


def _history_json_sql() -> str:
    from .q_active import RUN_SQL
    return (RUN_SQL + "SELECT CAST(hist.iteration AS BIGINT) AS iteration, selected_indices, reasoning, selected_categories, "
            "len(map_keys(category_breakdown)) AS n_categories FROM hist JOIN brk USING (iteration)")


@register("write_selection_history", _history_json_sql())
def q_write_selection_history(spark, sf):
    """Selection history records as JSON lines, read back."""
    from .q_active import _run
    hist = _run(spark, sf).selection_history
    path = FS.write_json(hist, shared_path(spark, "selection_history"))
    back = spark.read.schema(hist.schema).json(path)
    return back.select(F.col("iteration").cast("long").alias("iteration"), "selected_indices", "reasoning", "selected_categories",
                       F.size("category_breakdown").cast("long").alias("n_categories"))


SPLIT_SIZES_SQL = """t AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
s AS (SELECT n, CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS n_test FROM t),
v AS (SELECT n_test, CAST(ceil(CAST(0.1 AS DOUBLE) * (n - n_test)) AS BIGINT) AS n_val FROM s)"""


def _split_documents(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "text").filter("text IS NOT NULL AND lang IS NOT NULL")
    return SM.train_val_test_split(d, "lang", "doc_id", 0.2, 0.1, 42)


def _evaluated(model, split):
    """Accuracy on the validation and the test rows, and the share of their most frequent label."""
    out = S.PipelineScorer(model).transform(split.filter(F.col("split") != "train"))
    per = out.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == F.col("predicted_label")).alias("right"))
    return per.groupBy("split").agg(F.sum("n").alias("n_rows"), (F.sum("right") / F.sum("n")).alias("accuracy"), (F.max("n") / F.sum("n")).alias("majority"))


TRAINED_SQL = f"""WITH {SPLIT_SIZES_SQL} SELECT 'test' AS split, n_test AS n_rows, true AS beats_majority FROM v
UNION ALL SELECT 'val', n_val, true FROM v"""


@register("train_text_classifier", TRAINED_SQL)
def q_train_text_classifier(spark, sf):
    """Trained on the training rows of the 80/20 and 90/10 splits, evaluated on validation and
    test rows."""
    split = _split_documents(spark, sf)
    model = S.fit_mllib_text_classifier(split.filter(F.col("split") == "train"), "text", "lang")
    return _evaluated(model, split).select("split", "n_rows", (F.col("accuracy") > F.col("majority")).alias("beats_majority"))


@register("train_weighted", TRAINED_SQL)
def q_train_weighted(spark, sf):
    """Class-weighted loss (balanced weights of C7 joined to the training rows)."""
    from ..operators.curate import class_weights
    split = _split_documents(spark, sf)
    train = split.filter(F.col("split") == "train")
    w = class_weights(train.select(F.col("lang").alias("label")), "label").select(
        F.col("label").alias("lang"), F.col("weight").alias("w"))
    model = S.fit_mllib_text_classifier(train.join(F.broadcast(w), "lang"), "text", "lang", weight_col="w")  # a row per class
    return _evaluated(model, split).select("split", "n_rows", (F.col("accuracy") > F.col("majority")).alias("beats_majority"))


@register("model_save_load", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_differing FROM documents WHERE text IS NOT NULL")
def q_model_save_load(spark, sf):
    """A fitted model saved and loaded again scores every document like the original."""
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    model = S.fit_mllib_text_classifier(docs.filter(hash_half(42, "train", "doc_id")), "text", "lang")
    path = S.save_model(model, shared_path(spark, "text_model"))
    before = S.PipelineScorer(model).transform(docs.select("doc_id", "text")).select("doc_id", F.col("predicted_label").alias("a"), F.col("confidence").alias("c"))
    after = S.PipelineScorer(path).transform(docs.select("doc_id", "text")).select("doc_id", F.col("predicted_label").alias("b"), F.col("confidence").alias("d"))
    same = F.col("a").eqNullSafe(F.col("b")) & (F.abs(F.col("c") - F.col("d")) < 1e-12)
    return before.join(after, "doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~same).alias("n_differing"))


from .q_drift import PROFILE_BATCH_SQL, domain_batches_sql  # noqa: E402


@register("drift_on_closed_windows", f"WITH {domain_batches_sql('doc_id % 30')}, {PROFILE_BATCH_SQL} "
          "SELECT TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * b AS window_start, drift_detected, drift_severity, roc_auc, auc_threshold, drift_score FROM br")
def q_drift_on_closed_windows(spark, sf):
    """L2: a feed of documents with event times over 30 days; the detector with a saved fit runs on
    every day that the watermark closes, the last days when the feed ends."""
    from ..operators import drift_batches as DB
    from . import q_drift as QD
    day = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST(batch AS INT), CAST(doc_id % 24 AS INT))")
    feed = shared_path(spark, "document_feed")
    docs = QD.batched_documents(spark, sf).withColumn("ts", day)
    for part in range(5):  # the feed arrives in five parts of six days
        docs.filter((F.col("batch") >= 6 * part) & (F.col("batch") < 6 * part + 6)).drop("batch").write.parquet(f"{feed}/part{part}")
    like = spark.read.parquet(f"{feed}/part0")
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 8).parquet(f"{feed}/*")
    fit = QD.drift_reference(spark, sf, **QD.STATIC)
    out = MO.drift_on_closed_windows(stream, lambda rows, key: DB.drift_detect_batches(rows, fit, key), "ts", shared_path(spark, "closed_windows"),
                                     shared_path(spark, "ckpt_closed_windows"), "1 day", "6 days", flush=True)
    return QD._flat(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
