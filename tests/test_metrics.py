"""Hand-computed tables for the metric rules."""

import math

import pytest

from labelflow.operators import auc as AU
from labelflow.operators import metrics as M


def _conf(spark, pairs):
    df = spark.createDataFrame(pairs, "t string, p string")
    return M.confusion_counts(df, "t", "p")


def test_binary_auc_with_tie(spark):
    # scores 0.1(neg) 0.4(pos) 0.35(neg) 0.8(pos) 0.4(neg): pairs (pos>neg)=5, ties=1 -> 5.5/6
    df = spark.createDataFrame([(0, 0.1), (1, 0.4), (0, 0.35), (1, 0.8), (0, 0.4)], "y int, s double")
    auc = AU.binary_auc(df, "y", "s", 1).first()["auc"]
    assert auc == pytest.approx(5.5 / 6)


def test_auc_invariance_and_symmetry(spark):
    import random
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), rnd.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    a = AU.binary_auc(df, "y", "s", 1).first()["auc"]
    b = AU.binary_auc(df.selectExpr("y", "exp(3 * s) + 1 AS s"), "y", "s", 1).first()["auc"]
    c = AU.binary_auc(df.selectExpr("y", "-s AS s"), "y", "s", 1).first()["auc"]
    assert a == pytest.approx(b) and a + c == pytest.approx(1.0)
    # brute force Mann-Whitney
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert a == pytest.approx(u / (len(pos) * len(neg)))


def test_auc_many_buckets_equals_one_bucket(spark):
    """The bucketed prefix kernel is exact whatever the bucketing."""
    from labelflow.operators import kernels as K
    import random
    rnd = random.Random(3)
    rows = [(i % 3, round(rnd.random(), 2), rnd.randint(0, 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, v double, c int").groupBy("g", "v").agg({"c": "sum"}) \
        .withColumnRenamed("sum(c)", "c")
    one = {(r.g, r.v): r.c_before for r in K.prefix_totals(df, ["g"], "v", ["c"]).collect()}
    many = {(r.g, r.v): r.c_before for r in K.prefix_totals(df, ["g"], "v", ["c"], target_rows_per_bucket=7).collect()}
    assert one == many
    brute = {}
    for (g, v) in one:
        brute[(g, v)] = sum(c for gg, vv, c in rows if gg == g and vv < v)
    assert one == brute


def test_balanced_accuracy_ignores_predicted_only_label(spark):
    conf = _conf(spark, [("a", "a"), ("a", "c"), ("b", "b"), ("b", "b")])
    o = M.overall_metrics(conf).first()
    # recalls: a=0.5, b=1.0, c (support 0) excluded from balanced, included (0) in macro
    assert o["balanced_accuracy"] == pytest.approx(0.75)
    assert o["recall_macro"] == pytest.approx(0.5)
    assert o["num_classes"] == 3 and o["num_samples"] == 4
    assert o["accuracy"] == pytest.approx(0.75) == o["f1_micro"]


def test_mcc_kappa_known_values(spark):
    conf = _conf(spark, [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "a")] * 2)
    o = M.overall_metrics(conf).first()
    # 2x2: tp=3, fn=1, fp=2, tn=2 -> MCC = (3*2-2*1)/sqrt(5*4*4*3)
    assert o["matthews_corrcoef"] == pytest.approx((6 - 2) / math.sqrt(5 * 4 * 4 * 3))
    po, pe = 5 / 8, (4 / 8) * (5 / 8) + (4 / 8) * (3 / 8)
    assert o["cohen_kappa"] == pytest.approx((po - pe) / (1 - pe))


def test_degenerate_single_class(spark):
    o = M.overall_metrics(_conf(spark, [("a", "a")] * 4)).first()
    assert o["matthews_corrcoef"] == 0.0
    assert math.isnan(o["cohen_kappa"])
    assert o["accuracy"] == 1.0


def test_misclassified_keeps_null_truth(spark):
    df = spark.createDataFrame([(1, "a", "a", 0.9), (2, None, "a", 0.8), (3, "b", "a", 0.7), (4, "a", "b", 0.95)],
                               "id int, t string, p string, confidence double")
    rows = M.misclassified(df, "t", "p", order_key="id").collect()
    assert [r["id"] for r in rows] == [4, 2, 3]
    top = M.misclassified(df, "t", "p", order_key="id", top_n=1).collect()
    assert [r["id"] for r in top] == [4]


def test_calibration_constant_confidence(spark):
    df = spark.createDataFrame([("a", "a", 0.5)] * 3 + [("a", "b", 0.5)], "t string, p string, confidence double")
    rows = M.confidence_calibration(df, "t", "p").collect()
    assert len(rows) == 1
    r = rows[0]
    # min = max = 0.5 -> edges 0.4995 .. 0.5005, all rows in the middle bin (index 4 of 10... right-closed)
    assert r["total_samples"] == 4 and r["correct_predictions"] == 3 and r["accuracy"] == 0.75
    assert r["bin_lower"] < 0.5 <= r["bin_upper"]


def test_calibration_edges_match_numpy(spark):
    import numpy as np
    xs = [0.31, 0.4, 0.55, 0.555, 0.7, 0.99, 1.0, 0.62]
    df = spark.createDataFrame([("a", "a", x) for x in xs], "t string, p string, confidence double")
    got = {r["confidence_bin"]: r["total_samples"] for r in M.confidence_calibration(df, "t", "p").collect()}
    mn, mx = min(xs), max(xs)
    edges = np.linspace(mn, mx, 11)
    edges[0] -= (mx - mn) * 0.001
    ids = np.searchsorted(edges, xs, side="left") - 1
    want = {}
    for i in ids:
        want[int(i)] = want.get(int(i), 0) + 1
    assert got == want
