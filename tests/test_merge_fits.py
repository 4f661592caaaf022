"""A merged drift fit equals the fit of the union."""

import numpy as np
import pytest

from labelflow.operators import drift_embed as DE


def _vectors(spark):
    x = np.random.default_rng(4).normal(size=(160, 3))
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("method,bootstrap", [("euclidean", True), ("mmd", True), ("mmd", False), ("ratio", False)])
def test_merged_fit_equals_fit_of_union(spark, method, bootstrap):
    df = _vectors(spark)
    fit = lambda part: DE.fit_embedding(part, method, bootstrap, n_boot=20, n_features=16, sigma=1.5, name_digits=8)
    whole = fit(df)
    merged = DE.merge_embedding(fit(df.filter("vec_id % 3 = 0")), fit(df.filter("vec_id % 3 > 0")))
    assert merged.n == whole.n and merged.threshold == pytest.approx(whole.threshold, rel=1e-9)
    rows = lambda f: sorted(tuple(r) for r in f.stats.collect())
    assert np.allclose(rows(merged), rows(whole), rtol=1e-9, atol=1e-12)


def test_fits_of_other_settings_are_refused(spark):
    df = _vectors(spark)
    a, b = df.filter("vec_id < 100"), df.filter("vec_id >= 100")
    with pytest.raises(ValueError, match="sigma"):
        DE.merge_embedding(DE.fit_embedding(a, "mmd", False, sigma=1.0), DE.fit_embedding(b, "mmd", False, sigma=2.0))
    with pytest.raises(ValueError, match="name_digits"):
        DE.merge_embedding(DE.fit_embedding(a, "euclidean", n_boot=4, name_digits=3), DE.fit_embedding(b, "euclidean", n_boot=4, name_digits=4))
    ratio = DE.fit_embedding(a, "ratio", True, n_boot=4, name_digits=3)
    with pytest.raises(ValueError, match="needs the rows"):
        DE.merge_embedding(ratio, DE.fit_embedding(b, "ratio", True, n_boot=4, name_digits=3))
