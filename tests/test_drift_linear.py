"""The L1 domain classifier against plain numpy, the simulated random-AUC threshold, hot-key joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from labelflow.operators import drift_linear as DL
from labelflow.operators import drift_text as DT
from labelflow.sources.tables import read_table


@pytest.fixture(scope="module")
def corpus(spark):
    d = read_table(spark, SF_MID, "documents").select("doc_id", "lang", "text")
    return DT.with_side(d.orderBy("doc_id").limit(200), F.col("lang") == "en").drop("lang").cache()


def test_equals_plain_proximal_gradient(spark, corpus):
    got, fit = DL.domain_classifier_l1(corpus, rounds=12)
    x = DT.tfidf_features(corpus).collect()
    train = {r.doc_id for r in corpus.filter(DL.hash_half(42, "domain", "doc_id")).collect()}
    docs = sorted(train)
    terms = sorted({r.term for r in x if r.doc_id in train})
    at, col = {d: i for i, d in enumerate(docs)}, {t: i for i, t in enumerate(terms)}
    a = np.zeros((len(docs), len(terms)))
    for r in x:
        if r.doc_id in train:
            a[at[r.doc_id], col[r.term]] = r.weight
    side = {r.doc_id: r.side for r in corpus.collect()}
    y = np.array([1.0 if side[d] == "cur" else -1.0 for d in docs])
    w, b, losses = np.zeros(len(terms)), 0.0, []
    for _ in range(12):
        m = y * (a @ w + b)
        losses.append(np.where(m >= 1, 0, np.where(m >= -1, (1 - m) ** 2, -4 * m)).mean() + DL.ALPHA * np.abs(w).sum())
        if len(losses) > 1 and losses[-2] - losses[-1] < DL.TOLERANCE * losses[-2]:
            break
        s = y * np.where(m >= 1, 0, np.where(m >= -1, -2 * (1 - m), -4.0))
        v = w - DL.STEP * (a.T @ s) / len(docs)
        w = np.sign(v) * np.maximum(np.abs(v) - DL.STEP * DL.ALPHA, 0)
        b -= DL.STEP * s.mean()
    assert fit.losses == pytest.approx(losses) and all(q < p for p, q in zip(fit.losses, fit.losses[1:]))
    mine = {r.term: r.w for r in fit.weights.collect()}
    assert set(mine) == {t for t, v in zip(terms, w) if v} and fit.bias == pytest.approx(b)
    assert all(mine[t] == pytest.approx(v) for t, v in zip(terms, w) if v)
    row = got.first()
    assert row["drift_detected"] and row["roc_auc"] > 0.9


def test_no_documents(spark, corpus):
    fit = DL.fit_l1(DT.tfidf_features(corpus).where("false"), corpus.where("false"))
    assert fit.losses == [] and fit.weights.count() == 0
    fit = DL.fit_l1(DT.tfidf_features(corpus).where("false"), corpus, rounds=3)
    assert fit.weights.count() == 0 and len(fit.losses) > 1 and fit.losses[1] < fit.losses[0]


def test_simulated_threshold_is_near_the_closed_form(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "cur").otherwise("ref").alias("side"))
    r = DT.simulated_auc_threshold(docs).first()
    assert (r.n_pos, r.n_neg) == (1000, 2000) and r.simulated == pytest.approx(r.closed_form, abs=0.005)
    one = DT.simulated_auc_threshold(docs.where("side = 'ref'")).first()
    assert one.simulated is None and one.closed_form is None
    sims = DT.random_auc_simulation(docs.limit(50), n_sim=40)
    assert sims.count() == 40 and sims.where("auc < 0 OR auc > 1").isEmpty()


def test_only_hot_keys_are_spread(spark):
    rows = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("term"))
    assert [r.term for r in DT.hot_keys(rows, "term").collect()] == ["hot"]
    keyed = rows.select("term").distinct().withColumn("v", F.lit(1))
    out = DT.salted_join(rows, keyed, "term", "id")
    assert out.count() == 4000 and out.columns == ["term", "id", "v"]
    assert "_salt" in out._jdf.queryExecution().toString()


def test_equal_ids_on_both_sides_stay_apart(spark, corpus):
    same = DT.tag_sides(corpus.where("side = 'ref'").drop("side"), corpus.where("side = 'ref'").drop("side"))
    r = DT.domain_classifier(same).first()
    assert r["roc_auc"] == pytest.approx(0.5) and not r["drift_detected"] and r["n_ref_test"] == r["n_cur_test"]
