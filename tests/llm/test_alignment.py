"""Token alignment against whole-text encodings in plain Python."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from conftest import SF_SMALL
from labelflow.llm import alignment

from llm_fixtures import odd_rows, table  # noqa: F401 - fixtures

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """Whole texts, one byte at a time: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    pair = alignment.tokenizer_pair(A, B)
    found = []
    for doc_id, text in rows:
        links, groups = [], []
        if text:
            whole = (" " + text).encode()
            ids = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            tables = pair.bytes_a, pair.bytes_b
            if all(b"".join(t[i] for i in x) == whole for t, x in zip(tables, ids)):
                owner, ends = [], []
                for t, x in zip(tables, ids):
                    owner.append([k for k, i in enumerate(x) for _ in t[i]])
                    at = 0
                    ends.append({at := at + len(t[i]) for i in x})
                links = sorted(set(zip(*owner)))
                a = b = 0
                for cut in sorted(ends[0] & ends[1]):
                    x, y = owner[0][cut - 1] + 1, owner[1][cut - 1] + 1
                    groups.append(",".join(map(str, ids[0][a:x])) + "|" + ",".join(map(str, ids[1][b:y])))
                    a, b = x, y
                links = [(ids[0][i], ids[1][k]) for i, k in links]
                found.append((doc_id, len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)))
                continue
        found.append((doc_id, 0, 0, 0, [], ""))
    count = Counter(p for f in found for p in f[4])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return [(d, a, b, g, len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), text)
            for d, a, b, g, links, text in found]


COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
ODD = ["né ☃ 漢字 😀! ½ ﬁ", "tabs\tand\nlines \n  deep", "▁x literal", " lead", "trail ", "a  b   c", "<s> <unk> </s> <|endoftext|> <0x41>",
       "e\u0301 ä \u200d \u00a0x \u2003y", "Ａ１ 。", "don't they'll 12345 x1y2", "ends with mark ▁", "\ud7ff\ue000 \ufffd", "🏴\u200d☠️ x", "don't(it's),they'LL--we're_x a.b\nc,\nd\n\ne \nf\n g", "für, Äh! ÿ. ²., x².y 3.14,a1,b", "a,,,'s's 's'll'x", "\n", "\nx", ",", "x\n"]


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(alignment, "SLICE", 500)
    monkeypatch.setattr(alignment, "ENCODE_ROWS", 37)


def same(df, rows):
    key = lambda r: tuple((x is None, x) for x in r)
    got = df.collect()
    assert sorted([tuple(r[c] for c in COLS) for r in got], key=key) == sorted(brute(rows), key=key)
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in got)


def test_odd_texts_equal_brute_force(spark, table, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, ODD[0]) for i in range(30)]
    same(alignment.align(table(rows), A, B), rows)


def test_small_chunks_and_slices_change_nothing(spark, small_parts):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pair = alignment.tokenizer_pair(A, B)
    got = [r for i in range(0, len(rows), 20) for chunk in [alignment.Chunk(i)] for d, t in rows[i:i + 20]
           for r in [chunk.add(d, t or "", 1)]]
    assert len(got) == 60
    for _, text in rows:
        parts = [u for part in alignment.units(" " + text) for u in part] if text else []
        assert not text or "".join(parts) == " " + text
        ids = [i for u in parts for i in pair.a.encode(u, add_special_tokens=False).ids]
        assert not text or ids == pair.a.encode(" " + text, add_special_tokens=False).ids


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    same(alignment.align(docs, A, B), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark, table):
    assert alignment.align(table([]), A, B).count() == 0


def test_coarse_spans_are_refined_only_where_bytes_differ():
    import numpy as np
    size = np.array([2, 1, 1, 3])
    seg = np.array([0, 0, 0, 1])
    out = alignment.refined(np.array([2, 4, 4, 7]), size, seg, np.array([3, 1]), np.array([0, 4]))
    assert out.tolist() == [2, 3, 4, 7]


def test_memo_stays_within_its_bound():
    from labelflow.llm.common import Memo
    memo = Memo(limit=10_000)
    for i in range(10_000):
        memo.put(f"k{i}", i, 100)
        assert memo.get("k0") == 0
    memo.put("x" * 65, 1, 1)
    assert memo.get("x" * 65) is None and len(memo.young) + len(memo.old) < 120
