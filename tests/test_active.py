"""Selection responses (K5, K6), selection state (D4-D7) and run invariants."""

import pytest
from pyspark.sql import functions as F

from labelflow.operators import active as A
from labelflow.operators import scoring as S

FENCE = "`" * 3
CASES = [
    (1, FENCE + 'json\n{"selected_indices": [1, 2], "reasoning": "r", "category_breakdown": {"a": 2}}\n' + FENCE, True, [1, 2], "r"),
    (2, "text " + FENCE + '\n{"selected_indices": [0]}\n' + FENCE + " tail", True, [0], "No reasoning provided"),
    (3, '{"selected_indices": [3, 3], "reasoning": "dup"}', True, [3, 3], "dup"),
    (4, '{"selected_indices": []}', False, [], "No reasoning provided"),
    (5, '{"selected_indices": [-1, 2]}', False, [-1, 2], "No reasoning provided"),
    (6, '{"selected_indices": [1, 10]}', False, [1, 10], "No reasoning provided"),
    (7, "no json here at all", False, [], "No reasoning provided"),
    (8, FENCE + 'json\n{"selected_indices": [4]}', True, [4], "No reasoning provided"),
]


def test_parse_and_validate(spark):
    df = spark.createDataFrame([(i, r) for i, r, *_ in CASES], "id int, response string")
    p = A.parse_selection_response(df, "response")
    out = {r["id"]: r for r in p.select("id", "selected_indices", "reasoning",
                                         A.validate_selection(p, F.lit(10)).alias("valid")).collect()}
    for i, _, valid, idx, reason in CASES:
        assert out[i]["valid"] == valid, i
        assert list(out[i]["selected_indices"]) == idx, i
        assert out[i]["reasoning"] == reason, i


def test_state_joins(spark):
    pool = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(10)], "row_id long, category string")
    log = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 5), (2, 0, 2)], "iteration int, pick_pos int, row_id long")
    st = {r["row_id"]: (r["selected"], r["iteration"]) for r in A.apply_selection(pool, log).collect()}
    assert st[2] == (True, 2) and st[5] == (True, 1) and st[0] == (False, -1)
    assert A.remaining_pool(pool, log).count() == 7
    assert A.training_rows(pool, log).count() == 3
    sc = {r["iteration"]: list(r["selected_categories"]) for r in A.selected_categories(pool, log).collect()}
    assert sc[0] == ["a", "b"]


def test_run_invariants(spark):
    from labelflow.sources.tables import read_table
    from conftest import SF_MID
    docs = read_table(spark, SF_MID, "documents").select("doc_id", F.col("lang").alias("category"), "text")
    model = S.fit_letter_nb(docs.filter("doc_id % 2 = 0"), "text", "category")
    pool = S.predict(docs, model, "text")
    res = A.active_learning_run(pool, 10, 20, 3, 100, 42, "category", "text", "doc_id")
    log = res.log.collect()
    ids = [r["row_id"] for r in log]
    assert len(ids) == len(set(ids)) == 40 + 3 * 20
    assert res.training_data.count() == 100
    hist = res.selection_history.orderBy("iteration").collect()
    assert [h["iteration"] for h in hist] == [1, 2, 3]
    assert all(len(h["selected_indices"]) == 20 for h in hist)
    summ = A.selection_summary(res.training_data, res.selection_history).first()
    assert summ["total_training_samples"] == 100 and summ["num_iterations"] == 3
    assert sum(summ["final_distribution"].values()) == 100


def test_prompt_lists_samples(spark):
    cands = spark.createDataFrame([(0, 10, "Head one", "", "en"), (1, 11, "Head two", "more", "fr")],
                                  "local_idx int, row_id long, headline string, short_description string, category string")
    samples = A.candidate_samples(cands, ["headline", "short_description"])
    cur = A.distribution_map(cands)
    p = A.selection_prompts(samples, cur, cur, 1, ["headline", "short_description"]).first()["prompt"]
    assert "[Sample 0]\nHeadline: Head one\nCategory: en" in p
    assert "Short Description: more" in p and "from 0 to 1" in p


def test_resolve_selection_fallback(spark):
    df = spark.createDataFrame([(1, '{"selected_indices": [3, 1]}'), (2, "junk")], "batch int, response string")
    p = A.resolve_selection(A.parse_selection_response(df, "response"), 10, 4, 42, 1, "batch")
    out = {r["batch"]: r for r in p.collect()}
    assert list(out[1]["final_indices"]) == [3, 1] and out[1]["valid"]
    fb = list(out[2]["final_indices"])
    assert not out[2]["valid"] and len(fb) == 4 == len(set(fb)) and all(0 <= i < 10 for i in fb)
    assert out[2]["final_reasoning"] == A.FALLBACK_REASON and out[2]["final_breakdown"] == {}
