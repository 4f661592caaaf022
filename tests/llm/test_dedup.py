import hashlib
from collections import defaultdict

import numpy as np
import pytest

from labelflow.llm import chunk_dedup, common, exact_dedup, minhash, suffix
from llm_fixtures import odd_rows, table  # noqa: F401 - fixtures


def norm_id(d):
    return -1 if d is None else d


def test_exact(table, odd_rows):
    groups = defaultdict(list)
    for d, t in odd_rows:
        groups[t or ""].append(norm_id(d))
    want = sorted((norm_id(d), max(groups[t or ""]), len(groups[t or ""]), norm_id(d) == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
                  for d, t in odd_rows)
    got = sorted((norm_id(r.doc_id), norm_id(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(table(odd_rows)).collect())
    assert got == want
    assert exact_dedup.exact_dedup(table([])).count() == 0


def test_index_of_many_owners_and_hot_chains(table, monkeypatch):
    """Small buckets, many key ranges, and a text with a third of all rows among single ones."""
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i // 2}") for i in range(600)]
    want = defaultdict(list)
    for d, t in rows:
        want[t].append(d)
    want = sorted((d, max(want[t]), len(want[t]), d == max(want[t])) for d, t in rows)
    monkeypatch.setattr(exact_dedup, "OWNER_BYTES", 300)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 10)
    got = exact_dedup.exact_dedup(table(rows), capacity=8).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    assert len({(r.bucket_depth, r.bucket) for r in got}) > 20


def test_owners_are_key_ranges_of_whole_buckets(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "OWNER_BYTES", 1000)
    chains = spark.range(3000).selectExpr("xxhash64(id) h", "10L bytes")
    cells, bits = exact_dedup.directory(chains, capacity=20)
    got = sorted(map(tuple, exact_dedup.owners(chains, cells, bits).collect()))
    assert [r[3] for r in got] == sorted(r[3] for r in got) and got[-1][3] >= 25
    owner_of = defaultdict(set)
    for _, depth, bucket, owner in got:
        owner_of[depth, bucket].add(owner)
    assert all(len(o) == 1 for o in owner_of.values())


def test_directory_splits_overfull_buckets(spark):
    chains = spark.range(5000).selectExpr("xxhash64(id) h")
    cells, bits = exact_dedup.directory(chains, capacity=45)
    placed = chains.withColumn("cell", exact_dedup.leading_bits("h", bits)).join(cells, "cell").groupBy("depth", "bucket").count().collect()
    assert sum(r["count"] for r in placed) == 5000
    assert max(r["count"] for r in placed) <= 45 and len({r["depth"] for r in placed}) > 1


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_components(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    big = float("inf")
    least = defaultdict(lambda: big)
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], big if d is None else d)
    return sorted((norm_id(d), len(sets[i]), norm_id(None if least[root(i)] == big else least[root(i)])) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(table, odd_rows, k, num):
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in rng.integers(0, 500, 300)]
    rows = list(odd_rows)
    for i in range(40):  # a loose group: not all pairs are linked
        own = list(base)
        for at in rng.integers(0, 300, 1 + i % 9):
            own[at] = f"n{i}x{at}"
        rows.append((100 + i, " ".join(own)))
    got = minhash.near_duplicates(table(rows), k, num, 100).collect()
    assert sorted((norm_id(r.doc_id), r.n_shingles, norm_id(r.component_id)) for r in got) == brute_components(rows, k, num, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_empty(table):
    assert minhash.near_duplicates(table([])).count() == 0
    only = minhash.near_duplicates(table([(3, None), (4, " ")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in only) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(1, 2 ** 63, 400, dtype=np.uint64)
    sets = [np.sort(x[:300]), np.sort(x[100:])]
    h, d = np.concatenate(sets), np.repeat([0, 1], 300)
    errors = []
    for salt in range(20):
        sig = minhash.signatures(common.mix(h + np.uint64(salt)), d, 2, 200)
        assert np.isfinite(sig).all()
        errors.append((sig[0] == sig[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (5, 5)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect())
    assert got == {**{i: 0 for i in range(51)}, 100: 0, 200: 200, 201: 200}


def brute_removed(rows, covered):
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = covered(d, raw)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((norm_id(d), len(raw), sum(gone), runs, kept))
    return sorted(out)


def removal(df):
    return sorted((norm_id(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def test_suffix_equals_brute_force(table, odd_rows):
    rows = odd_rows + [(40 + i, f"start{i} " + ("the very same line that many documents hold, again and again " * 2) + f"end{i * 7} ") for i in range(8)]
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - 49 if d is not None else 0):
            w = raw[i:i + 50]
            first[w] = min(first.get(w, d), d)

    def covered(d, raw):
        gone = [False] * len(raw)
        for i in range(len(raw) - 49 if d is not None else 0):
            if first[raw[i:i + 50]] < d:
                gone[i:i + 50] = [True] * 50
        return gone
    want = brute_removed(rows, covered)
    assert any(x[2] for x in want)
    assert removal(suffix.dedup_substrings(table(rows))) == want
    assert suffix.dedup_substrings(table([])).count() == 0


def test_hot_anchors_take_the_exact_other_way(table, monkeypatch):
    rows = [(i, f"{i * 7919} before " + "one line of more than fifty bytes that all of them share, yes " + f" {i * 104729} after") for i in range(30)]
    want = removal(suffix.dedup_substrings(table(rows)))
    monkeypatch.setattr(suffix, "HOT", 3)
    monkeypatch.setattr(suffix, "SHARE_BYTES", 500)
    assert removal(suffix.dedup_substrings(table(rows))) == want
    assert sum(x[2] > 0 for x in want) == 29


@pytest.mark.parametrize("hot", [None, 3])
def test_megabytes_of_one_repeated_unit(table, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix, "HOT", hot)
    rows = [(1, "the " * 90), (2, "the " * 600_000 + "end"), (3, "x" + "the " * 700_000), (4, "he t" * 55 + "he")]
    want = [(1, 360, 0, 0, b"the " * 90), (2, 2_400_003, 2_400_000, 1, b"end"), (3, 2_800_001, 2_800_000, 1, b"x"), (4, 222, 222, 1, b"")]
    assert removal(suffix.dedup_substrings(table(rows))) == want


def test_largest_cold_anchor_is_sorted_alone():
    import pyarrow as pa
    rng = np.random.default_rng(7)
    passage = rng.integers(97, 123, 60).astype(np.uint8).tobytes()
    one = lambda i: rng.integers(97, 123, 99).astype(np.uint8).tobytes() if i % 1000 else passage + b"%039d" % i
    raw = [one(i) for i in range(9_000)] + [one(i) for i in range(19_999)]  # two anchors
    anchor, doc = np.repeat([1, 2], [9_000, 19_999]), np.arange(len(raw))
    got = suffix.settle(pa.table({"anchor": anchor, "doc_id": doc, "rid": doc, "start": np.zeros(len(raw), np.int32),
                                  "n": np.full(len(raw), 50, np.int32), "bytes": pa.array(raw, pa.binary())}))
    first, want = {}, defaultdict(set)
    for a, d, r in zip(anchor.tolist(), doc.tolist(), raw):
        for i in range(50):
            if first.setdefault((a, r[i:i + 50]), d) < d:
                want[d].update(range(i, i + 50))
    spans = defaultdict(set)
    for r in got.to_pylist():
        spans[r["rid"]].update(range(r["s"], r["e"]))
    assert spans == want and len(want) == 27 and suffix.HOT * suffix.ROW_BYTES < (1 << 21) - 3


def test_suffix_order():
    rng = np.random.default_rng(3)
    for n in [*range(40), 300]:
        c = rng.integers(1, 4, n)
        assert suffix.suffix_order(c).tolist() == sorted(range(n), key=lambda i: c[i:].tolist())


def brute_chunks(raw):
    """Chunk ends, one byte at a time."""
    table, state, at, out = chunk_dedup._GEAR.tolist(), 0, 0, []
    for i, b in enumerate(raw):
        state = ((state << 1) + table[b]) & 0xFFFFFFFF
        size, whole = i + 1 - at, i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80
        if whole and size >= chunk_dedup.MIN_CHUNK and (state >> (32 - chunk_dedup.MEAN_BITS) == 0 or size >= chunk_dedup.MAX_CHUNK):
            out.append((at, i + 1))
            at = i + 1
    return out + [(at, len(raw))] * (at < len(raw))


def test_chunks_equal_brute_force(table, odd_rows):
    cuts, first = {}, {}
    for d, t in odd_rows:
        raw = (t or "").encode()
        cuts[raw] = brute_chunks(raw)
        for s, e in cuts[raw] if d is not None else ():
            first[raw[s:e]] = min(first.get(raw[s:e], d), d)

    def covered(d, raw):
        gone = [False] * len(raw)
        for s, e in cuts[raw] if d is not None else ():
            if first[raw[s:e]] < d:
                gone[s:e] = [True] * (e - s)
        return gone
    want = brute_removed(odd_rows, covered)
    got = removal(chunk_dedup.dedup_chunks(table(odd_rows, 1)))
    assert got == want
    by_id = {x[0]: x for x in got}
    assert by_id[8][2] == by_id[8][1] and by_id[12][2] > 300 and by_id[7][2] == 0
    assert chunk_dedup.dedup_chunks(table([])).count() == 0


def test_insertion_shifts_few_chunks():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 20000).astype(np.uint8).tobytes()
    moved = raw[:5000] + b"inserted" + raw[5000:]
    a, b = ({x[s:e] for s, e in brute_chunks(x)} for x in (raw, moved))
    assert len(a - b) <= 3
