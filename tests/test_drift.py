"""Drift rules (J3 truth table), RFF MMD against the exact statistic, directional checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from labelflow.operators import drift as DR
from labelflow.operators import drift_embed as DE
from labelflow.operators import drift_text as DT
from labelflow.sources.tables import read_table


@pytest.mark.parametrize("flags,sev", [([True], "low"), ([False], "none"), ([True, True], "high"),
                                       ([True, False], "low"), ([True, True, False], "medium"),
                                       ([True, True, True], "high"), ([False, False], "none")])
def test_severity_truth_table(spark, flags, sev):
    rows = [(f"m{i}", f, {"x": 1.0}) for i, f in enumerate(flags)] + [("text_overview", True, {"x": 0.0})]
    m = spark.createDataFrame(rows, "method string, drift_detected boolean, details map<string,double>")
    r = DR.aggregate_methods(m).first()
    assert r["drift_severity"] == sev and r["total_methods"] == len(flags)
    assert r["detection_rate"] == pytest.approx(sum(flags) / len(flags))


def test_rff_mmd_close_to_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 5))
    y = rng.normal(loc=0.7, size=(150, 5))
    rows = [("ref", list(map(float, v))) for v in x] + [("cur", list(map(float, v))) for v in y]
    df = spark.createDataFrame(rows, "side string, embedding array<double>")
    got = DE.drift_mmd(df, n_features=4000, seed=1).first()
    exact = DE.exact_mmd2_numpy(x, y, got["sigma"])
    assert got["mmd2"] == pytest.approx(exact, abs=0.02)
    same = DE.drift_mmd(df.filter("side = 'ref'").unionByName(df.filter("side = 'ref'").withColumn("side", F.lit("cur"))),
                        n_features=500, seed=1).first()
    assert same["mmd2"] == pytest.approx(0.0, abs=1e-9)


def test_wasserstein_matches_bruteforce(spark):
    from labelflow.operators.kernels import ecdf_distance
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=400).round(2), rng.normal(0.3, 1.2, size=300).round(2)
    rows = [("ref", float(v)) for v in a] + [("cur", float(v)) for v in b]
    df = spark.createDataFrame(rows, "side string, value double").withColumn("g", F.lit(1))
    got = ecdf_distance(df, ["g"], "value").first()["wasserstein"]
    xs = np.sort(np.unique(np.concatenate([a, b])))
    fa = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    want = float(np.sum(np.abs(fa - fb)[:-1] * np.diff(xs)))
    assert got == pytest.approx(want)


def test_directional_text_drift(spark):
    d = read_table(spark, SF_MID, "documents").select("doc_id", "lang", "text")
    en = d.filter("lang = 'en'").drop("lang")
    fr = d.filter("lang = 'fr'").drop("lang")
    drift = DT.domain_classifier(DT.tag_sides(en, fr)).first()
    assert drift["drift_detected"] and drift["roc_auc"] > 0.9
    h = F.substring(F.md5(F.concat_ws(":", F.lit("7"), F.col("doc_id").cast("string"))), 1, 1) < "8"
    none = DT.domain_classifier(DT.tag_sides(en.filter(h), en.filter(~h))).first()
    assert not none["drift_detected"]


def test_bootstrap_threshold_bounds_noise(spark):
    e = read_table(spark, SF_MID, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    h = F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1) < "8"
    c = DT.tag_sides(e.filter(h), e.filter(~h))
    thr = DE.bootstrap_threshold(c, "euclidean", n_boot=50)
    dist = DE.drift_distance(c, "euclidean").first()["distance"]
    shifted = DT.tag_sides(e.filter(h), e.filter(~h).withColumn("embedding", F.transform("embedding", lambda x: x + 0.5)))
    assert DE.drift_distance(shifted, "euclidean").first()["distance"] > thr
    assert thr > 0 and dist >= 0


def halves(ids, n_boot, seed, hexes):
    import hashlib
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    return np.array([[md5(f"{seed}:half:{b}:{md5(f'{seed}:bootstrap:{i}')[:hexes]}")[0] < "8" for i in ids] for b in range(n_boot)])


@pytest.mark.parametrize("method", ["euclidean", "cosine", "mmd", "ratio"])
def test_bootstrap_equals_plain_halvings(spark, method, monkeypatch):
    monkeypatch.setattr(DE, "RANGE_ROWS", 60)
    monkeypatch.setattr(DE, "HOT_ROWS", 40)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(200, 3)), 1)
    x[:120, 2] = 0.5                                   # a value that most rows share
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    fit = DE.fit_embedding(df, method, n_boot=30, seed=9, n_features=16)
    found = []
    for h in halves(range(200), 30, 9, 2):
        a, b = x[h], x[~h]
        if method == "mmd":
            w, p = DE.rff_params(3, 16, fit.sigma, 9)
            f = lambda y: (np.sqrt(2 / 16) * np.cos(y @ w.T + p)).mean(axis=0)
            found.append(((f(a) - f(b)) ** 2).sum())
        elif method == "ratio":
            hit = []
            for d in range(3):
                xs = np.unique(x[:, d])
                gap = np.diff(xs)
                fa, fb = (np.searchsorted(np.sort(s[:, d]), xs, side="right") / len(s) for s in (a, b))
                area = (np.abs(fa - fb)[:-1] * gap).sum()
                hit.append(area / a[:, d].std() >= 0.1 if a[:, d].std() > 0 else area >= 0.1)
            found.append(np.mean(hit))
        else:
            m, k = a.mean(axis=0), b.mean(axis=0)
            found.append(np.linalg.norm(m - k) if method == "euclidean" else 1 - m @ k / np.linalg.norm(m) / np.linalg.norm(k))
    assert fit.threshold == pytest.approx(np.quantile(found, 0.95), abs=1e-9)


def test_names_follow_the_number_of_rows():
    assert [DE._name_digits(n) for n in (1, 16, 17, 65_536, 65_537, 10 ** 9)] == [1, 1, 2, 4, 5, 8]


def test_one_block_is_the_exact_mmd(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(90, 4)), rng.normal(0.5, 1.0, size=(70, 4))
    rows = [(f"r{i}", "ref", v.tolist()) for i, v in enumerate(x)] + [(f"c{i}", "cur", v.tolist()) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "name string, side string, embedding array<double>")
    one = DE.block_mmd(df, "name", n_blocks=1).first()
    assert one["mmd2"] == pytest.approx(DE.exact_mmd2_numpy(x, y, one["sigma"])) and one["n_blocks"] == 1 and one["standard_error"] is None
    many = DE.block_mmd(df, "name", n_blocks=4).first()
    assert many["n_blocks"] == 4 and many["mmd2"] > 0 and many["standard_error"] > 0
    none = DE.block_mmd(df.filter("side = 'ref'"), "name").first()
    assert none["mmd2"] is None and none["n_blocks"] == 0


def test_vectors_with_gaps_count_what_they_have(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, [None, 4.0]), (4, None)], "vec_id long, embedding array<double>")
    fit = DE.fit_embedding(df, "euclidean", False)
    assert sorted(tuple(r) for r in fit.stats.collect()) == [(0, 2.0), (1, 3.0)] and fit.n == 3
