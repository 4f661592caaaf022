"""Scorer contract."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from labelflow.operators import scoring as S
from labelflow.sources.tables import read_table


@pytest.fixture(scope="module")
def scored(spark):
    d = read_table(spark, SF_SMALL, "documents").select("doc_id", "lang", "text")
    model = S.fit_letter_nb(d.filter("doc_id % 2 = 0"), "text", "lang")
    return model, d, S.predict(d.filter("doc_id % 2 = 1"), model, "text")


def test_probabilities_sum_to_one(scored):
    _, _, s = scored
    rows = s.select(F.aggregate("probs", F.lit(0.0), lambda a, b: a + b).alias("t"), "confidence",
                    F.array_max("probs").alias("m")).collect()
    assert all(abs(r["t"] - 1) < 1e-9 and r["confidence"] == r["m"] for r in rows)


def test_batched_scoring_equals_predict(scored):
    model, d, s = scored
    row = model.first().asDict()
    b = {r["doc_id"]: (r["predicted_label"], r["confidence"])
         for r in S.score_in_batches(d.filter("doc_id % 2 = 1"), row, "text", 16).collect()}
    for r in s.collect():
        assert b[r["doc_id"]][0] == r["predicted_label"]
        assert b[r["doc_id"]][1] == pytest.approx(r["confidence"])


def test_null_text_dropped(spark, scored):
    model, _, _ = scored
    df = spark.createDataFrame([(1, None), (2, "hello world")], "doc_id int, text string")
    assert S.predict(df, model, "text").count() == 1


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],)], "v array<double>")
    assert df.select(S.argmax_index(F.col("v"))).first()[0] == 1


def test_require_checks(spark):
    from labelflow.operators.curate import require_columns, require_non_empty
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    with pytest.raises(ValueError, match="Missing required columns"):
        require_columns(df, "text", "confidence")
    with pytest.raises(ValueError, match="cannot be empty"):
        require_non_empty(df.filter("id < 0"))
    assert require_columns(df, "text") is df


def test_scores_independent_of_partitioning(scored):
    model, d, s = scored
    again = S.predict(d.filter("doc_id % 2 = 1").repartition(5), model, "text")
    a = {r["doc_id"]: (r["predicted_label"], round(r["confidence"], 12)) for r in s.collect()}
    b = {r["doc_id"]: (r["predicted_label"], round(r["confidence"], 12)) for r in again.collect()}
    assert a == b
