"""Farthest-first selection (K7) against a plain greedy version, and the label mapping's fallback."""

import random
import re

import pytest
from pyspark.sql import functions as F

from labelflow.operators import active as A
from labelflow.operators import labels as L

WORDS = "storm rain vote party match goal bank rate song film ära 42".split()


def _pool(spark, seed=1):
    rng, rows = random.Random(seed), []
    for b in range(4):
        for i in range(30):
            text = None if i == 7 else "" if i == 8 else " ".join(rng.choices(WORDS, k=rng.randint(1, 12))) + "!"
            p = rng.random()
            rows.append((b, i, rng.choice(["x", "y", None]), text, [p, 1 - p], "extra"))
        rows.append((b, 30, "x", "Storm, rain", [0.5, 0.5], "extra"))
        rows.append((b, 31, "x", "rain storm", [0.5, 0.5], "extra"))
    df = spark.createDataFrame(rows, "batch int, local_idx int, category string, text string, probs array<double>, words string")
    return df, spark.createDataFrame([({"x": 3, "y": 1},)], "distribution map<string,long>")


def _greedy(rows, n, weight=0.5):
    """One candidate after the other, with sets."""
    words = {r["local_idx"]: set(w.lower() for w in re.findall(r"\w{2,}", r["text"] or "")) for r in rows}
    picks = []
    while len(picks) < min(n, len(rows)):
        best = None
        for r in rows:
            if any(r["local_idx"] == p[0] for p in picks):
                continue
            near = 1.0
            for i, c, _ in picks:
                if c == r["category"]:
                    a, b = words[r["local_idx"]], words[i]
                    near = min(near, 1 - len(a & b) / len(a | b) if a | b else 0.0)
            rank = (near == 0, -round(r["informativeness"] + weight * near, 12), r["local_idx"])
            if best is None or rank < best[0]:
                best = rank, (r["local_idx"], r["category"], near)
        picks.append(best[1])
    return [p[0] for p in picks]


@pytest.mark.parametrize("n", [1, 12, 50])
def test_picks_equal_plain_greedy(spark, n):
    df, dist = _pool(spark)
    scored = A.informativeness(df, dist).collect()
    got = A.rank_diverse(df, n, dist, group_cols=["batch"])
    assert got.columns == df.columns + ["informativeness", "novelty", "pick_pos"]
    rows = got.collect()
    for b in range(4):
        mine = [r["local_idx"] for r in sorted((r for r in rows if r["batch"] == b), key=lambda r: r["pick_pos"])]
        assert mine == _greedy([r for r in scored if r["batch"] == b], n)


def test_equal_words_come_last(spark):
    df, dist = _pool(spark)
    rows = [r for r in A.rank_diverse(df, 32, dist, group_cols=["batch"]).collect() if r["batch"] == 0]
    zero = [r["pick_pos"] for r in rows if r["novelty"] == 0]
    assert zero and sorted(zero) == list(range(32 - len(zero), 32))
    twins = sorted(r["pick_pos"] for r in rows if r["local_idx"] in (30, 31))
    assert twins[1] in zero


def test_without_groups_and_without_rows(spark):
    df, dist = _pool(spark)
    one = df.filter("batch = 2")
    assert sorted(r["local_idx"] for r in A.rank_diverse(one, 5, dist).collect()) == sorted(
        _greedy(A.informativeness(one, dist).collect(), 5))
    assert A.rank_diverse(df.filter("batch > 9"), 5, dist).collect() == []


def test_selector_in_the_loop(spark):
    df, _ = _pool(spark)
    pool = df.filter("category IS NOT NULL").select(
        (F.col("batch") * 100 + F.col("local_idx")).cast("long").alias("row_id"), "category", "text", "probs")
    res = A.active_learning_run(pool, 5, 6, 2, 20, 42, selector=A.InformativenessSelector(diversity=0.5))
    ids = [r["row_id"] for r in res.log.collect()]
    assert len(ids) == len(set(ids)) == 10 + 2 * 6


def test_label_mapping_falls_back_to_the_model(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import IndexToString, StringIndexer
    rows = spark.createDataFrame([("b",), ("a",), ("b",)], "lang string")
    model = Pipeline(stages=[StringIndexer(inputCol="lang", outputCol="label", stringOrderType="alphabetAsc")]).fit(rows)
    path = str(tmp_path / "mapping")
    read = lambda m: {r["label_id"]: r["label"] for r in L.model_label_dimension(spark, path, m).collect()}
    assert read(model) == {0: "a", 1: "b"}
    named = PipelineModel([IndexToString(inputCol="p", outputCol="q", labels=["n", "m"])])
    assert read(named) == {0: "n", 1: "m"}
    with pytest.raises(ValueError, match="no labels"):
        read(object())
    L.write_label_mappings(L.label_dimension_from_list(spark, ["z", "y"]), path)
    assert read(model) == {0: "z", 1: "y"}
