"""Rules of the reworked operators: percentile on counts, splits by cut, scorers, answers, drift by name."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from labelflow.operators import active as A
from labelflow.operators import drift as DR
from labelflow.operators import drift_embed as DE
from labelflow.operators import metrics as M
from labelflow.operators import sampling as SM
from labelflow.operators import scoring as S
from labelflow.operators.kernels import exact_percentile
from labelflow.sources.tables import read_table


def test_percentile_with_one_value_in_nine_tenths_of_the_rows(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(F.lit(7.0)).alias("v"))
    x = np.array([i if i % 10 == 0 else 7.0 for i in range(20000)])
    for q in (0.0, 0.05, 0.5, 0.93, 1.0):
        got = exact_percentile(df, "v", q).first()
        assert got["percentile"] == pytest.approx(np.quantile(x, q)) and got["count"] == 20000
    counts = exact_percentile(df, "v", 0.5)
    assert counts.first()["has_nan"] is False


def test_percentile_of_nothing_and_of_nan(spark):
    none = exact_percentile(spark.createDataFrame([], "v double"), "v", 0.5).first()
    assert none["count"] == 0 and none["percentile"] is None
    nan = exact_percentile(spark.createDataFrame([(1.0,), (float("nan"),)], "v double"), "v", 0.5).first()
    assert np.isnan(nan["percentile"]) and nan["has_nan"]


def test_split_keeps_null_labels_and_meets_quotas(spark):
    rows = [(i, "a" if i < 50 else "b" if i < 80 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, label string").repartition(5)
    out = SM.stratified_split(df, "label", "id", 0.2)
    assert out.count() == 100
    sizes = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert sizes == {("a", "train"): 40, ("a", "test"): 10, ("b", "train"): 24, ("b", "test"): 6, (None, "train"): 16, (None, "test"): 4}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_pipeline_scores_rows_without_a_known_label(spark):
    train = spark.createDataFrame([("good day sir", "x"), ("bad night madam", "y")] * 8, "text string, lang string")
    model = S.fit_mllib_text_classifier(train, "text", "lang", max_iter=5)
    rows = spark.createDataFrame([("good day", None), ("bad night", "never seen"), (None, "x"), ("good sir", "x")], "text string, lang string")
    for scorer in (S.PipelineScorer(model),):
        out = scorer.transform(rows).collect()
        assert len(out) == 3 and [r["predicted_label"] for r in out] == ["x", "y", "x"]
    assert S.PipelineScorer(model).transform(rows.select("text")).count() == 3


def test_letter_counts_equal_plain_counting():
    import pandas as pd
    texts = pd.Series(["Äpfel und ÖL", "", "日本 abc 😀 z", "ñandú"])
    got = S._count_matrix(texts)
    assert got.tolist() == [[t.lower().count(a) for a in S.ALPHABET] for t in texts]


STRICT = [('{"selected_indices": [1]} trailing words', False), ("{'selected_indices': [1]}", False), ('{"selected_indices": [1, null]}', False),
          ('{"selected_indices": ["a"]}', False), ('{"selected_indices": [1.5]}', False), ('{"selected_indices": 3}', False), ("[1, 2]", False),
          ('{"selected_indices": [1]} {"selected_indices": [1]}', False), ('{"selected_indices": [4, 0]}', True), ('\n {"selected_indices": [0]} \n', True)]


@pytest.mark.parametrize("text,ok", STRICT)
def test_strict_answers(spark, text, ok):
    p = A.parse_selection_response(spark.createDataFrame([(text,)], "response string"))
    assert p.select(A.validate_selection(p, F.lit(5)).alias("v")).first()["v"] is ok


def test_answer_fields(spark):
    text = '{"selected_indices": [1], "reasoning": null, "category_breakdown": {"a": 2, "b": "many"}}'
    r = A.parse_selection_response(spark.createDataFrame([(text,)], "response string")).first()
    assert r["reasoning"] is None and r["category_breakdown"] == {"a": "2", "b": "many"}


def test_metric_lookup_and_json(spark):
    conf = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "b", 4)], "true_label string, pred_label string, n long")
    long = M.metrics_long(M.overall_metrics(conf), spark.createDataFrame([(0.75, None)], "roc_auc_ovr double, roc_auc_ovo double"))
    assert M.get_metric(long, "accuracy") == pytest.approx(7 / 8) and M.get_metric(long, "roc_auc", "ovr") == 0.75
    for bad in (("speed", "none"), ("accuracy", "macro"), ("roc_auc", "ovo")):
        with pytest.raises(ValueError):
            M.get_metric(long, *bad)
    nested = json.loads(M.metrics_json(long).first()["json"])
    assert nested["accuracy"]["none"] == pytest.approx(7 / 8) and set(nested["f1"]) == {"macro", "micro", "weighted"}


def test_drift_tests_by_name(spark):
    assert DE.resolve_method("MMD")[0] == "mmd" and DE.resolve_method("nonsense") == ("mmd", "MMD (Maximum Mean Discrepancy) [default]")
    rng = np.random.default_rng(0)
    make = lambda shift: spark.createDataFrame([(i, [float(x) for x in rng.normal(shift, 1, 4)]) for i in range(300)], "vec_id long, embedding array<double>")
    ref, same, moved = make(0), make(0), make(1.5)
    for name in ("mmd", "euclidean", "cosine", "ratio"):
        fit = DE.fit_embedding(ref, name, True, n_boot=20)
        assert DE.detect_embedding(fit, moved).first()["drift_detected"], name
    fit = DE.fit_embedding(ref, "mmd", False)
    assert fit.threshold == 0.015 and not DE.detect_embedding(fit, same).first()["drift_detected"]
    assert not DE.detect_embedding(fit, same.limit(0)).first()["drift_detected"]


def test_drift_without_methods_and_with_an_unknown_one(spark):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text").limit(20)
    fit = DR.drift_fit(docs, DR.DriftConfig(methods=()))
    r = DR.drift_detect(docs, fit).first()
    assert r["drift_severity"] == "none" and r["reason"] == "no methods configured" and r["total_methods"] == 0
    with pytest.raises(ValueError):
        DR.drift_fit(docs, DR.DriftConfig(methods=("tea leaves",)))
    with pytest.raises(ValueError):
        DR.drift_fit(docs.limit(0), DR.DriftConfig())


def test_prompts_without_category_or_named_fields(spark):
    s = spark.createDataFrame([(1, [(0, 7, "Title", "Body"), (1, 8, "", "Only body")])],
                              "batch int, samples array<struct<local_idx:int,index:long,headline:string,body:string>>")
    dist = spark.createDataFrame([({"a": 2},)], "distribution map<string,bigint>")
    text = A.selection_prompts(s, dist, dist, 1).first()["prompt"]
    assert "Headline: Title" in text and "Body: Only body" in text and "Category:" not in text
