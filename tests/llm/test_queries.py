"""Every registered query of the folder and the pipeline, on the small tables and on odd rows."""

import re

import duckdb
import pytest

import corpus_pipeline
from conftest import SF_SMALL
from labelflow.llm.queries import ORACLE, QUERIES
from labelflow.llm import language, packing
from tools.oracle_check import TABLES, digest

from llm_fixtures import odd_rows, table  # noqa: F401 - fixtures
from test_dedup import brute_components


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    cur = con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(columns, cur.fetchall())[0]


COLUMNS = {"op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op5_quality": "doc_id held_out score predicted",
           "op6_chunk_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op8_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
           "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op10_language": "doc_id held_out lang_pred score",
           "op13_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_whole_tables(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    ids = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id")
    assert df.select("doc_id").distinct().exceptAll(ids).isEmpty() and df.select("doc_id").distinct().count() == ids.count()


def test_pipeline_equals_brute_force(spark, table, odd_rows):
    """Each stage against plain Python on what the stage before it kept."""
    docs = table(odd_rows)
    model = language.learn(language.training_rows(docs))
    want = [r for r in odd_rows if not model.predict([r[1] or ""])[0][3]]
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = stages[name](spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        return spark.createDataFrame(rows, out.schema), sorted([(r.doc_id, r.text) for r in rows], key=key)

    docs, got = step("language", docs)
    assert got == sorted(want, key=key) and got
    last = {}
    for d, t in got:
        last[t] = max(last.get(t, -1), -1 if d is None else d)
    docs, now = step("exact dedup", docs)
    assert now == sorted({(d, t) for d, t in got if (-1 if d is None else d) == last[t]}, key=key)
    comp = brute_components(now, 5, 80, 100)
    docs, then = step("near dedup", docs)
    assert sorted(-1 if d is None else d for d, _ in then) == sorted(d for d, _, c in comp if d == c)
    first = {}
    for d, t in then:
        raw = t.encode()
        for i in range(len(raw) - 49 if d is not None else 0):
            first[raw[i:i + 50]] = min(first.get(raw[i:i + 50], d), d)
    cut = []
    for d, t in then:
        raw = t.encode()
        gone = set()
        for i in range(len(raw) - 49 if d is not None else 0):
            if first[raw[i:i + 50]] < d:
                gone.update(range(i, i + 50))
        cut.append((d, bytes(b for i, b in enumerate(raw) if i not in gone).decode(errors="ignore")))
    docs, end = step("substring dedup", docs)
    assert end == sorted(cut, key=key) and end != then
    assert all(r.n_chars == len(r.text) for r in docs.where("doc_id = 12").collect())
    pieces = stages["packing"](spark, docs, "").collect()
    code = packing.coder(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {}
    for p in pieces:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    assert tokens == {d: len(code.encode(t)) + 1 for d, t in end}


def test_pipeline_runs_on_an_empty_table(spark, table):
    docs = table([])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
