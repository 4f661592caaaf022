"""OOD rules: strict threshold, severity boundaries, NaN threshold, empty results."""

import math

import numpy as np
import pytest

from labelflow.operators import ood as O
from labelflow.operators.kernels import exact_percentile


def _scored(spark, confs, batch=None):
    rows = [(i, "t", "x", float(c), batch) for i, c in enumerate(confs)]
    return spark.createDataFrame(rows, "id int, text string, predicted_label string, confidence double, b string")


def test_threshold_is_numpy_linear_percentile(spark):
    ref = _scored(spark, [i / 100 for i in range(100)])
    th = O.ood_fit(ref).first()["threshold"]
    assert th == pytest.approx(np.percentile([i / 100 for i in range(100)], 5))


@pytest.mark.parametrize("n_flag,total,sev", [(0, 20, "none"), (1, 20, "low"), (2, 20, "medium"),
                                              (5, 20, "medium"), (6, 20, "high"), (1, 10, "medium")])
def test_severity_boundaries(spark, n_flag, total, sev):
    ref = _scored(spark, [0.5] * 10)
    fit = O.ood_fit(ref)  # threshold 0.5; flagged = confidence < 0.5 (strict)
    cur = _scored(spark, [0.1] * n_flag + [0.5] * (total - n_flag))
    flagged, stats = O.ood_detect(cur, fit, batch_id="b1")
    s = stats.first()
    assert s["ood_count"] == n_flag and s["ood_severity"] == sev
    assert flagged.count() == n_flag
    if n_flag:
        assert set(flagged.columns) >= {"batch_id", "ood_confidence", "threshold", "ood_severity", "timestamp"}


def test_nan_in_reference_flags_nothing(spark):
    ref = _scored(spark, [0.1, 0.2, float("nan"), 0.9])
    fit = O.ood_fit(ref)
    assert math.isnan(fit.first()["threshold"])
    flagged, stats = O.ood_detect(_scored(spark, [0.0, 0.01]), fit, batch_id="b")
    assert flagged.count() == 0 and stats.first()["ood_severity"] == "none"


def test_empty_reference_raises(spark):
    ref = _scored(spark, [0.5]).filter("id < 0")
    with pytest.raises(Exception):
        O.ood_fit(ref).collect()


def test_missing_batch_id_raises(spark):
    fit = O.ood_fit(_scored(spark, [0.5, 0.6]))
    with pytest.raises(ValueError):
        O.ood_detect(_scored(spark, [0.1]), fit)


def test_batch_scope(spark):
    fit = O.ood_fit(_scored(spark, [0.5] * 5))
    cur = _scored(spark, [0.1, 0.9, 0.9], "x").unionByName(_scored(spark, [0.9] * 3, "y"))
    cfg = O.OODConfig(batch_id_column="b")
    _, stats = O.ood_detect(cur, fit, cfg, scope="batch")
    got = {r["batch_id"]: r["ood_severity"] for r in stats.collect()}
    assert got == {"x": "high", "y": "none"}


def test_exact_percentile_bracket_path(spark):
    """Groups larger than the sketch accuracy go through the bracket; result stays exact."""
    rng = np.random.default_rng(1)
    vals = rng.normal(size=5000)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(vals)], "g int, v double")
    got = {r["g"]: r["percentile"] for r in exact_percentile(df, "v", 0.05, ["g"]).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(np.percentile(vals[g::2], 5), rel=1e-12)
