"""Many batches against their single runs, windows that close inside a stream, the log of results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from labelflow.operators import drift as DR
from labelflow.operators import drift_batches as DB
from labelflow.operators import drift_embed as DE
from labelflow.session import shared_path
from labelflow.sources.tables import read_table
from labelflow.streaming import monitors as MO


@pytest.fixture(scope="module")
def documents(spark):
    return read_table(spark, SF_SMALL, "documents").select("doc_id", "lang", "text")


@pytest.mark.parametrize("method, bootstrap", [("euclidean", False), ("cosine", False), ("mmd", True), ("ratio", False)])
def test_batches_equal_single_runs(spark, documents, method, bootstrap):
    ref = documents.where("lang = 'en'")
    cur = documents.where("lang <> 'en'").withColumn("day", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3))
    cur = cur.unionByName(documents.where("lang = 'en' AND doc_id % 7 = 0").withColumn("day", F.lit(9)))
    fit = DR.drift_fit(ref, DR.DriftConfig(embedding_drift_method=method, use_bootstrap=bootstrap, n_boot=20))
    got = {r.batch_id: r for r in DB.drift_detect_batches(cur, fit, "day").collect()}
    assert sorted(got) == ["1", "2", "9", "unknown"]
    for key in ("2", "9", "unknown"):
        one = DR.drift_detect(cur.where(F.coalesce(F.col("day").cast("string"), F.lit("unknown")) == key), fit).first()
        mine = got[key]
        assert (mine.drift_detected, mine.drift_severity, mine.total_methods) == (one.drift_detected, one.drift_severity, one.total_methods)
        for m, row in one.method_results.items():
            assert mine.method_results[m].drift_detected == row.drift_detected
            assert mine.method_results[m].details == pytest.approx(row.details, abs=1e-9)


def test_empty_batches(spark, documents):
    fit = DR.drift_fit(documents.where("lang = 'en'"), DR.DriftConfig(embedding_drift_method="euclidean", use_bootstrap=False))
    assert DB.drift_detect_batches(documents.where("false").withColumn("day", F.lit(1)), fit, "day").count() == 0
    one = spark.createDataFrame([(1, None, "a"), (2, "", "a")], "doc_id long, text string, day string")
    assert [r.batch_id for r in DB.drift_detect_batches(one, fit, "day").collect()] == ["a"]


def test_ecdf_distance_to_one_reference(spark, monkeypatch):
    monkeypatch.setattr(DE, "RANGE_ROWS", 25)
    rng = np.random.default_rng(5)
    ref = {d: rng.normal(d, 1, 300).round(1) for d in (0, 1)}
    cur = {(b, d): rng.normal(b - 1, 2, 10 + 40 * b).round(1) for b in (0, 1, 2) for d in (0, 1)}
    cur[3, 0] = np.array([-50.0])
    count = lambda x: zip(*np.unique(x, return_counts=True))
    r = spark.createDataFrame([(d, float(v), int(n)) for d, x in ref.items() for v, n in count(x)], "dim int, value double, w long")
    c = spark.createDataFrame([(b, d, float(v), int(n)) for (b, d), x in cur.items() for v, n in count(x)], "batch int, dim int, value double, w long")
    got = {(x.batch, x.dim): x for x in DB.ecdf_to_reference(r, c).collect()}
    assert set(got) == set(cur)
    for key, x in cur.items():
        a = ref[key[1]]
        u = np.unique(np.concatenate([a, x]))
        f, g = (np.searchsorted(np.sort(s), u, side="right") / len(s) for s in (a, x))
        assert got[key].wasserstein == pytest.approx((np.abs(f - g)[:-1] * np.diff(u)).sum())
        assert (got[key].n_ref, got[key].n_cur) == (300, len(x))


def feed_of(spark, days):
    return spark.createDataFrame([(10 * d + h, float(d + h), f"2024-01-{d:02d} {h:02d}:00:00") for d in days for h in (1, 5, 23)],
                                 "id long, value double, at string").select("id", "value", F.to_timestamp("at").alias("ts"))


def test_windows_close_while_the_stream_goes_on(spark):
    feed, out, ckpt = (shared_path(spark, n) for n in ("feed", "closed", "ckpt"))
    calls = []

    def detect(rows, key):
        calls.append(sorted(r[0] for r in rows.select(key).distinct().collect()))
        return rows.groupBy(F.col(key).alias("batch_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    def go(flush=False):
        stream = spark.readStream.schema("id long, value double, ts timestamp").parquet(feed)
        return {str(r.window_start)[:10]: (r.n, r.total) for r in MO.drift_on_closed_windows(stream, detect, "ts", out, ckpt, "1 day", "12 hours", flush).collect()}

    feed_of(spark, [1, 2, 3]).write.mode("append").parquet(feed)
    assert go() == {"2024-01-01": (3, 32.0), "2024-01-02": (3, 35.0)}              # day 3 is open
    feed_of(spark, [4]).unionByName(feed_of(spark, [1])).write.mode("append").parquet(feed)  # day 1 again: too late
    assert go() == {"2024-01-01": (3, 32.0), "2024-01-02": (3, 35.0), "2024-01-03": (3, 38.0)}
    assert go(flush=True)["2024-01-04"] == (3, 41.0)
    assert calls == [["20240101T000000", "20240102T000000"], ["20240103T000000"], ["20240104T000000"]]


def test_log_keeps_one_result_per_batch(spark):
    path = shared_path(spark, "log")
    rows = lambda ids, v: spark.createDataFrame([(i, v, {"m": {"x": 1.0}}) for i in ids], "batch_id string, score double, details map<string,map<string,double>>")
    DB.append_results(rows(["a", "b", "007"], 1.0), path)
    DB.append_results(rows(["b", "c"], 2.0), path)
    DB.append_results(rows(["b"], 3.0), path)
    got = {r.batch_id: r.score for r in DB.latest_results(spark, path).collect()}
    assert {k: got[k] for k in ("a", "b", "c")} == {"a": 1.0, "b": 3.0, "c": 2.0} and len(got) == 4
    assert spark.read.parquet(path).count() == 4
