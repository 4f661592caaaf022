"""Percentiles from merged states (C11, I1) against numpy: ties, NaN, nulls, missed brackets, wrong states."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.operators import ood as O
from labelflow.operators import quantile_state as QS


def _rows(spark, n=40000):
    x = np.random.default_rng(5).random(n)
    return spark.createDataFrame([(i % 7, 0.25 if i % 10 < 6 else float(v)) for i, v in enumerate(x)], "batch long, confidence double")


def test_states_merge_to_the_exact_percentile(spark):
    df = _rows(spark)
    x = np.array([r[0] for r in df.select("confidence").collect()])
    states = QS.quantile_states(df, "confidence", ["batch"])
    for q in (0.0, 0.05, 0.5, 0.99, 1.0):
        got = QS.percentile_from_states(df, QS.merge_quantile_states(states), "confidence", q).first()
        assert got["count"] == len(x) and got["percentile"] == pytest.approx(np.quantile(x, q), rel=1e-12), q


def test_only_values_next_to_the_rank_are_kept(spark, monkeypatch):
    import labelflow.session as S
    kept, plain = [], S.write_table

    def spy(df, name):
        t = plain(df, name)
        if name == "quantile_counts":
            kept.append(t.count())
        return t

    monkeypatch.setattr(S, "write_table", spy)
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(1).permutation(50000)], "v double")
    got = QS.percentile_from_states(df, QS.quantile_states(df, "v"), "v", 0.3).first()
    assert got["percentile"] == pytest.approx(np.quantile(np.arange(50000), 0.3))
    assert len(kept) == 1 and kept[0] < 50000 * 0.04


def test_missed_bracket_is_widened(spark, monkeypatch):
    df = spark.createDataFrame([(float(v),) for v in range(5000)], "v double")
    right = QS._bracket

    def wrong(states, q, slack):
        b = right(states, q, slack)
        return b if slack >= 1 else b.withColumn("_lo", F.lit(10.0)).withColumn("_hi", F.lit(20.0))

    monkeypatch.setattr(QS, "_bracket", wrong)
    got = QS.percentile_from_states(df, QS.quantile_states(df, "v"), "v", 0.5).first()
    assert got["percentile"] == 2499.5


def test_nan_nulls_empty_and_null_groups(spark):
    rows = [("a", 1.0), ("a", float("nan")), ("b", None), (None, 3.0), (None, 5.0), (None, None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in QS.percentile_from_states(df, QS.quantile_states(df, "v", ["g"]), "v", 0.5, ["g"]).collect()}
    assert np.isnan(got["a"]["percentile"]) and got["a"]["has_nan"] and got["a"]["count"] == 2
    assert got["b"]["percentile"] is None and got["b"]["count"] == 0
    assert got[None]["percentile"] == 4.0
    none = spark.createDataFrame([], "v double")
    empty = QS.percentile_from_states(none, QS.merge_quantile_states(QS.quantile_states(none, "v")), "v", 0.5).first()
    assert empty["count"] == 0 and empty["percentile"] is None


def test_states_of_other_rows_are_refused(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    with pytest.raises(ValueError, match="do not describe"):
        QS.percentile_from_states(df, QS.quantile_states(df.filter("v < 3"), "v"), "v", 0.5)


def test_fit_from_states_equals_fit(spark):
    df = _rows(spark, 3000)
    one = O.ood_fit(df).first().asDict()
    merged = O.ood_fit_from_states(O.ood_states(df, group_cols=["batch"]), df).first().asDict()
    assert merged.keys() == one.keys()
    for k, v in one.items():
        assert merged[k] == pytest.approx(v, rel=1e-12), k
    by = {r["batch"]: r["threshold"] for r in O.ood_fit_from_states(O.ood_states(df, group_cols=["batch"]), df, group_cols=["batch"]).collect()}
    for b in range(7):
        assert by[b] == pytest.approx(O.ood_fit(df.filter(F.col("batch") == b)).first()["threshold"], rel=1e-12)
    none = df.filter("batch < 0")
    with pytest.raises(Exception, match="cannot be empty"):
        O.ood_fit_from_states(O.ood_states(none), none).collect()
