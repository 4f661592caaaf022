import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from labelflow.llm import language, quality, sharding, topk
from llm_fixtures import odd_rows, table  # noqa: F401 - fixtures

MID = SF_SMALL.replace("0.001", "0.01")


# -- top-k ---------------------------------------------------------------------------------------
def brute_topk(rows, k, scale=256):
    ok = {(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, x in ok:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in ok if c != q and len(y) == len(x))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, label int, c string").repartition(3)


@pytest.mark.parametrize("block", [7, 1000])
def test_topk_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # one very common vector
    rows += [(500, None), (501, []), (505, [float("nan")] + [0.0] * 7), (510, [float("inf")] + [0.0] * 7), (515, [None] + [0.1] * 7),
             (520, [0.0] * 8), (None, [0.1] * 8), (525, [0.5, 0.5]), (526, [0.5, -0.5]), rows[10]]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 5 == 0, 5, 256, block, 20).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, 5)


def test_topk_few_and_none(spark):
    assert topk.top_k(vectors(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 5 == 0).count() == 0
    assert topk.top_k(vectors(spark, [(0, [1.0]), (1, [2.0])]), F.col("vec_id") % 5 == 0).collect()[0].score == 256 * 512
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.col("vec_id") % 5 == 0).count() == 0


def test_bounds_let_queries_stop_early():
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (2000, 8))
    x[:5] = 200
    q = np.full((1, 8), 10)
    got = topk.search_block(q, np.array([-1]), x, np.arange(2000), 5)
    assert sorted(got[1].tolist()) == [0, 1, 2, 3, 4]


# -- sharding ------------------------------------------------------------------------------------
def checked_shards(rows, got, shards):
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len((t or "").encode()) + 16) for d, t in rows)
    by_shard = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by_shard[r.shard].append(r)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in by_shard[s]) for s in range(shards)]


def test_shards(table, odd_rows, monkeypatch):
    rng = np.random.default_rng(3)
    rows = odd_rows + [(1000 + i, "z" * int(rng.integers(1, 400))) for i in range(900)]
    monkeypatch.setattr(sharding, "BUCKET", 128)
    got = sharding.shard_by_bytes(table(rows), 4).collect()
    loads = checked_shards(rows, got, 4)
    assert max(loads) - min(loads) <= 0.001 * sum(loads)
    text = {}
    for d, t in rows:
        text[d] = t or ""
    got = [r for r in got if r.doc_id is not None]
    where = defaultdict(set)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    share = sum(loads) / 4
    sizes = Counter()
    for d, t in rows:
        sizes[t or ""] += len((t or "").encode()) + 16
    assert all(len(s) == 1 for t, s in where.items() if sizes[t] <= share)


def test_oversize_group_is_cut_and_empty_table(table):
    rows = [(i, "copy " * 20) for i in range(300)] + [(1000 + i, f"own {i}") for i in range(100)]
    loads = checked_shards(rows, sharding.shard_by_bytes(table(rows), 4).collect(), 4)
    assert min(loads) > 0
    assert sharding.shard_by_bytes(table([])).count() == 0


def test_differencing_beats_greedy():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1000, 100000, 200))[::-1]
    spread = {}
    for name, own in (("kk", sharding.difference(sizes, 8)), ("round robin", np.arange(200) % 8)):
        loads = np.bincount(own, weights=sizes, minlength=8)
        spread[name] = loads.max() - loads.min()
    greedy = np.zeros(8)
    for s in sizes:
        greedy[greedy.argmin()] += s
    assert spread["kk"] <= greedy.max() - greedy.min() < spread["round robin"]


# -- language ------------------------------------------------------------------------------------
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    model = language.learn(language.training_rows(docs))
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out()).collect()
    assert len(got) > 250 and np.mean([r.lang_pred == r.lang for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) <= 3
    kept = language.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() >= docs.count() - 6
    noise = spark.createDataFrame([(1, "qxzj vkwq xjq zzqx kqjx wvvq jjxk qqzx " * 9), (2, "123 !!"), (3, None), (4, "")], "doc_id long, text string")
    assert [r.rejected for r in language.predict(noise, model).orderBy("doc_id").collect()] == [True] * 4


def test_language_odd_rows(table, odd_rows):
    model = language.learn(language.training_rows(table(odd_rows)))
    got = language.predict(table(odd_rows), model).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 and by[d].rejected for d in (1, 2, 3, 24))
    assert by[7].lang_pred == "en" and by[22].lang_pred == "en"
    nothing = language.learn(table([]))
    assert {r.lang_pred for r in language.predict(table(odd_rows), nothing).collect()} == {"und"}
    assert language.predict(table([]), model).count() == 0


@pytest.mark.parametrize("garbled", [1, 3])
def test_garbage_among_held_back_rows_leaves_the_rejection(spark, garbled):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    held = defaultdict(list)
    for r in language.sample_ids(language.training_rows(docs)).where("held").orderBy("doc_id").collect():
        held[r.lang].append(r.doc_id)
    bad = [d for own in held.values() for d in own[:garbled if len(own) >= language.FEW else 1]]
    junk = "".join(chr(0x4E00 + i) for i in np.random.default_rng(6).integers(0, 20000, 400))
    model = language.learn(language.training_rows(docs.withColumn("text", F.when(F.col("doc_id").isin(bad), junk).otherwise(F.col("text")))))
    assert set(model.langs) == set(held)
    noise = spark.createDataFrame([(1, "qxzj vkwq xjq zzqx kqjx wvvq jjxk qqzx " * 9), (2, junk[::-1])], "doc_id long, text string")
    assert [r.rejected for r in language.predict(noise, model).orderBy("doc_id").collect()] == [True] * 2
    got = language.predict(docs.where(~F.col("doc_id").isin(bad)), model).where(language.held_out()).collect()
    assert len(got) > 250 and sum(r.rejected for r in got) <= 3


def test_large_texts_and_rare_languages_are_learnt(table):
    small = [(i, f"kurzer satz nummer {'abcdefghij'[i % 10]} aus dem wald", "de") for i in range(60)]
    large = [(100 + i, "sehr langer text " * 400_000, "de") for i in range(30)]
    rare = [(1000 + i, f"palavra rara {i}", f"r{i}") for i in range(30)]  # one row each
    letterless = [(2000 + i, "123 !!", "xx") for i in range(9)] + [(2009, "viimeinen sana", "xx")]
    rows = table(small + large[:9] + rare)
    ids = {r.doc_id: r.held for r in language.sample_ids(rows).collect()}
    assert set(range(60)) <= set(ids) and not set(ids) & set(range(100, 130))
    assert sum(ids[i] for i in range(60)) == 6 and not any(ids[1000 + i] for i in range(30))
    assert language.sample_ids(table(large[:3])).count() == 1
    model = language.learn(table(small[:5] + rare + letterless))
    assert set(model.langs) == {"de", "xx"} | {f"r{i}" for i in range(30)}


def test_kneser_ney_sums_to_one():
    codes, off = language.characters(["the cat sat on the mat and the rat"])
    g, n = np.unique(language.grams(codes, language.ORDER)[language.inside(off)], return_counts=True)
    letters = np.unique(codes)
    model = language.fit(g, n, len(letters))
    context = int(g[0]) >> 16
    every = [np.array([(context << 16 | int(c)) & ((1 << 16 * k) - 1) for c in letters], np.uint64) for k in range(1, language.ORDER + 1)]
    assert abs(model.probability(every).sum() - 1) < 1e-9


# -- quality -------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    chain = quality.learn(docs, labels.where(~quality.held_out()))
    got = quality.score(docs, chain).join(labels, "doc_id").where(quality.held_out()).collect()
    assert np.mean([(r.score >= quality.THRESHOLD) == (r.quality == 1) for r in got]) > 0.93
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_odd_rows(spark, table, odd_rows):
    labels = spark.createDataFrame([(7, 1), (14, 0), (15, 0), (9, 1), (1, 1), (None, 0), (999, 1)], "doc_id long, quality int")
    chain = quality.learn(table(odd_rows), labels)
    got = {r.doc_id: r.score for r in quality.score(table(odd_rows), chain).collect()}
    assert got[1] == got[2] == chain.base and 0 <= got[14] < got[7] <= 1
    none = quality.learn(table(odd_rows), labels.limit(0))
    assert {r.score for r in quality.score(table(odd_rows), none).collect()} == {0.5}
    assert quality.score(table([]), chain).count() == 0


def test_quality_sample_bounds(spark, table, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 50)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 5000)
    monkeypatch.setattr(quality, "LARGE", 300)
    docs = table([(i, "x" * (4000 if i % 10 == 0 else 90)) for i in range(600)])
    labels = spark.createDataFrame([(i, int(i >= 597)) for i in range(600)], "doc_id long, quality int")
    got = {r.doc_id: r.quality for r in quality.sample_ids(docs, labels).collect()}
    assert {d for d, q in got.items() if q} == {597, 598, 599}  # one label in 200 rows
    assert sum(not q for q in got.values()) == 50 and not any(d % 10 == 0 for d in got)
    few = quality.sample_ids(docs, labels.where("doc_id in (0, 10, 20, 31, 41, 599)")).collect()
    assert {r.doc_id for r in few} - {0, 10, 20} == {31, 41, 599} and len(few) == 4


def test_marginals_equal_enumeration():
    chain = quality.Chain(1)
    rng = np.random.default_rng(0)
    chain.trans, chain.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    e = rng.normal(size=7)
    got, pair = chain.marginals(e, np.array([0, 4]), np.array([4, 3]))
    want, pairs = [], np.zeros((2, 2))
    for lo, n in ((0, 4), (4, 3)):
        weight = np.zeros(n)
        total, own = 0.0, np.zeros((2, 2))
        for m in range(2 ** n):
            y = [(m >> i) & 1 for i in range(n)]
            w = math.exp(chain.start[y[0]] + sum(e[lo + i] * y[i] for i in range(n)) + sum(chain.trans[a, b] for a, b in zip(y, y[1:])))
            total += w
            weight += w * np.array(y)
            for a, b in zip(y, y[1:]):
                own[a, b] += w
        want += list(weight / total)
        pairs += own / total
    assert np.allclose(got, want) and np.allclose(pair, pairs)
