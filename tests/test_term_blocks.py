"""Term counts in blocks: the same counts as one row per entry, and nothing of a round stays on disk."""

import os
import time

import pytest
from pyspark.sql import functions as F

from labelflow.operators import drift as DR
from labelflow.operators import drift_batches as DB
from labelflow.operators import drift_linear as DL
from labelflow.operators import drift_text as DT
from labelflow.operators import term_blocks as TB
from labelflow.session import shared_path, write_table

EN = ["green apples fall on a wet garden", "the garden is green and wet x y", "Apples, APPLES and pears_2", ""]
FR = ["la maison verte près du lac", "Straße und Haus près du lac 12 1", None, "İstanbul ΣΑΣ maison"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "ref", EN[i % 4]) for i in range(24)] + [(i, "cur", FR[i % 4]) for i in range(12, 40)]
    rows += [(3, "ref", EN[1]), (3, "ref", EN[2]), (14, "cur", None), (15, "cur", ""), (15, "cur", "")]
    rows += [(None, "ref", EN[0]), (None, "ref", EN[1]), (None, "cur", FR[0])]
    return spark.createDataFrame(rows, "doc_id long, side string, text string").repartition(3)


def tables(spark, name):
    folder = os.path.dirname(shared_path(spark, "tables", "x")).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith(f"{name}-")}


@pytest.mark.parametrize("tokens", [10, TB.BLOCK_TOKENS])
def test_blocks_hold_the_terms_of_documents(spark, corpus, monkeypatch, tokens):
    monkeypatch.setattr(TB, "BLOCK_TOKENS", tokens)
    blocks = TB.term_blocks(corpus)
    each = blocks.docs.select("block", "id", "side", F.explode(F.arrays_zip("codes", "tf")).alias("e")).select("block", "id", "side", F.col("e.codes").alias("code"), "e.tf")
    names = blocks.terms.where("lead").select("block", "code", "term")
    got = sorted(map(str, each.join(names, ["block", "code"]).select("id", "side", "term", F.col("tf").cast("long")).collect()))
    want = DT.doc_terms(corpus)
    assert got == sorted(map(str, want.select(F.col("doc_id").alias("id"), "side", "term", "tf").collect()))
    docs = corpus.groupBy("doc_id", "side").count().collect()
    assert {(r.id, r.side): r.copies for r in blocks.docs.collect()} == {(r.doc_id, r.side): r["count"] for r in docs}
    df = {(r.term, r.side): r["count"] for r in want.groupBy("term", "side").count().collect()}
    assert {(r.term, r.side): r.df for r in blocks.stats().collect()} == df
    train = want.where(DL.hash_half(42, "domain", "doc_id")).groupBy("term", "side").agg(F.count("doc_id").alias("tr"), F.count_if(F.col("doc_id").isNull()).alias("tz"))
    assert {(r.term, r.side): (r.tr, r.tz) for r in blocks.stats().where("tr + tz > 0").collect()} == {(r.term, r.side): (r.tr, r.tz) for r in train.collect()}


def by_rows(corpus):
    """The domain classifier from one row per document and term."""
    w = DT.tfidf_features(corpus)
    train = DL.hash_half(42, "domain", "doc_id")
    lo = DT.term_log_odds(w.filter(train))
    s = w.filter(~train).join(lo, "term").groupBy("doc_id", "side").agg(F.sum(F.col("weight") * F.col("log_odds")).alias("score"))
    rows = corpus.filter(~train).join(s, ["doc_id", "side"], "left").select("side", F.round(F.coalesce("score", F.lit(0.0)), 12).alias("x")).collect()
    pos, neg = ([r.x for r in rows if (r.side == "cur") == p] for p in (True, False))
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)), len(pos), len(neg)


def test_domain_classifier_equals_one_row_per_entry(spark, corpus, monkeypatch):
    monkeypatch.setattr(TB, "BLOCK_TOKENS", 20)
    r = DT.domain_classifier(corpus).first()
    auc, n_cur, n_ref = by_rows(corpus)
    assert (r.n_cur_test, r.n_ref_test) == (n_cur, n_ref) and r.roc_auc == pytest.approx(auc, abs=1e-12)


def test_l1_from_blocks_equals_l1_from_entries(spark, corpus, monkeypatch):
    monkeypatch.setattr(TB, "BLOCK_TOKENS", 20)
    before = {n: tables(spark, n) for n in ("linear_step", "linear_margins", "linear_weights", "linear_blocks")}
    _, fit = DL.domain_classifier_l1(corpus, rounds=3)
    left = {n: len(tables(spark, n) - before[n]) for n in before}
    assert left == {"linear_step": 0, "linear_margins": 0, "linear_weights": 1, "linear_blocks": 0}  # rounds leave nothing
    train = DL.hash_half(42, "domain", "doc_id")
    other = DL.fit_l1(write_table(DT.tfidf_features(corpus).filter(train), "entries"), corpus.filter(train), rounds=3)
    assert fit.losses == pytest.approx(other.losses, rel=1e-12) and fit.bias == pytest.approx(other.bias, rel=1e-12)
    mine, theirs = ({r.term: r.w for r in f.weights.collect()} for f in (fit, other))
    assert mine == pytest.approx(theirs, rel=1e-9) and mine


def test_batches_write_no_texts_and_count_repeated_rows(spark, corpus):
    rows = corpus.where("doc_id IS NOT NULL")
    ref, cur = rows.where("side = 'ref'"), rows.where("side = 'cur'").withColumn("day", F.col("doc_id") % 2)
    fit = DR.drift_fit(ref, DR.DriftConfig(methods=("domain_classifier",)))
    assert fit.terms.docs.count() == ref.select("doc_id").distinct().count()  # a row a document, not an entry
    before = tables(spark, "batches")
    got = {r.batch_id: r.method_results["domain_classifier"] for r in DB.drift_detect_batches(cur, fit, "day").collect()}
    assert tables(spark, "batches") == before and sorted(got) == ["0", "1"]
    for day in got:
        one = DR.drift_method_rows(cur.where(F.col("day") == int(day)), fit).first()
        assert got[day].details == pytest.approx(one.details, abs=1e-12)


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        seq = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {seq.apply(i).getName() for i in range(seq.size())}

    before = files()
    rows = spark.range(20000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("v"))
    assert write_table(rows, "cleaned").count() == 7
    for _ in range(20):
        left = {n for n in files() - before if n.startswith("shuffle_")}
        if len(left) <= 4:  # those of the count
            return
        time.sleep(0.5)
    raise AssertionError(left)
