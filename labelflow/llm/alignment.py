"""Alignment of the tokens of two tokenizers through the bytes they cover.

Method. A blank and the text are cut into units where both tokenizers always start a new token: in
front of a single blank or line break between two other characters, and between a letter and a
punctuation mark (checked against the vocabulary of the piece model). Each distinct unit of a task's
chunk of texts is encoded once; a unit without a blank in front is given to the piece model behind a
line break, whose tokens are taken off again. The character offsets of the byte-level tokenizer and
the byte spans of the piece model's protos are the coarse token ends. Tokens whose coarse span
differs from their decoded bytes (parts of a multibyte character, byte-fallback tokens) get their
ends from the decoded bytes. Byte offsets where both end cut the tokens into groups; every interval
between neighbouring ends of either side is one link.

Corpus counts: a chunk gives its distinct id pairs with their links, which are summed over all
chunks by pair; the highest count of an id of the second tokenizer comes from that table. The
counts a chunk needs return to it by its number, so only distinct pairs of bounded chunks move.

The installed sentencepiece names its immutable protos ``proto``; their spans are byte offsets.

Defined results: texts that are null, empty or not reproduced by either tokenizer have no tokens:
zeros and an empty group string, and they add nothing to the counts. Repeated rows count again and
return again; null doc_ids are kept; an empty table gives an empty result; other columns are
ignored. A long text is cut into slices at blanks; a run of text without any such blank is encoded
whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, byte_chars, pieces_of, prepare, shared_table, text_or_empty

CHUNK_BYTES = 4 << 20
SLICE = 1 << 18
ENCODE_ROWS = 4096
MEMO_BYTES = 128 << 20
PARTS = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, "
         "segments binary, seg_ends binary, seg_pairs binary, pairs array<long>, counts array<long>")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, "
          "groups_sha256 string")
B_BITS = 32

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"!-/:-@\[-`{-~"
_CUT = re.compile(r" (?<=\S )(?=\S)")
# runs of marks and letters that end at a cut come first; anything else goes on to the next cut
_UNIT = re.compile(rf"[ \n]?[{_MARK}]*[{_LETTER}]+(?=[{_MARK}]|[ \n]\S|\Z)|[ \n]?[{_MARK}]+(?=[ \n]\S|\Z)"
                   rf"|[\s\S]+?(?=\Z|(?<=\S)[ \n]\S|(?<=[{_LETTER}])[{_MARK}])")
_JOINED = re.compile(rf"[{_LETTER}][{_MARK}]|\n")
_FALLBACK = re.compile(r"<0x([0-9A-F]{2})>\Z")


def units(text: str):
    """The parts of a text (with the blank in front) between safe cuts, in slices."""
    at = 0
    while len(text) - at > SLICE:
        m = _CUT.search(text, at + SLICE)
        if not m:
            break
        yield _UNIT.findall(text, at, m.start())
        at = m.start()
    yield _UNIT.findall(text, at)


class Pair:
    """Both tokenizers with the bytes of every id; records of segments, kept within a byte bound."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        spec = json.loads(self.a.to_str())
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("the first tokenizer must be byte level with its own word pattern")
        back = {c: b for b, c in byte_chars().items()}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(back[c] for c in token if c in back)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            special = self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i)
            if not special and ("▁" in piece.lstrip("▁") or _JOINED.search(piece)):
                raise ValueError(f"piece {piece!r} joins two units")
            m = _FALLBACK.match(piece)
            self.bytes_b.append(bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode())
        if [self.b.id_to_piece(i) for i in self.b.encode("\n")] != ["▁", "<0x0A>"]:
            raise ValueError("the piece model must keep line breaks as bytes")
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.str_a = [str(i) for i in range(len(self.bytes_a))]
        self.str_b = [str(i) for i in range(len(self.bytes_b))]
        self.memo = Memo(MEMO_BYTES)

    def records(self, segs: list[str]) -> list:
        """For each segment None (not reproduced) or (n_a, n_b, n_groups, groups, pair codes)."""
        memo = self.memo
        out = [memo.get(s) for s in segs]
        missing = [i for i, r in enumerate(out) if r is None]
        for lo in range(0, len(missing), ENCODE_ROWS):
            at = missing[lo:lo + ENCODE_ROWS]
            for i, r in zip(at, self.encode([segs[i] for i in at])):
                out[i] = r
                memo.put(segs[i], r, 300 + len(r[3]) + len(r[4]))
        return out

    def encode(self, segs: list[str]) -> list[tuple]:
        enc = self.a.encode_batch(segs, add_special_tokens=False)
        ids_a = [x.ids for x in enc]
        na = np.array([len(x) for x in ids_a], np.int64)
        fa = np.array([i for x in ids_a for i in x], np.int64)
        chars = np.array([e for x in enc for _, e in x.offsets], np.int64)
        led = [s[0] == " " for s in segs]
        # two tokens stand for the line break in front of a unit without a blank
        protos = self.b.encode([s[1:] if k else "\n" + s for s, k in zip(segs, led)], num_threads=1, return_type="proto")
        pieces = [p.pieces for p in protos]
        nb = np.array([len(p) for p in pieces], np.int64)
        found = np.array([(x.id, x.end) for p in pieces for x in p], np.int64).reshape(-1, 2)
        shift = np.where(led, 1, -1)  # the blank is no part of the piece model's text, the break none of ours
        first = np.concatenate([[0], np.cumsum(nb)[:-1]])
        real = np.ones(len(found), bool)
        real[first[shift < 0]] = real[first[shift < 0] + 1] = False
        nb -= np.where(led, 0, 2)
        fb, span_end = found[real, 0], found[real, 1]

        raw = [s.encode() for s in segs]
        text = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(r) for r in raw], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n_chars = np.array([len(s) for s in segs], np.int64)
        char_base = np.concatenate([[0], np.cumsum(n_chars)[:-1]])
        char_at = np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))
        sa, sb = np.repeat(np.arange(len(segs)), na), np.repeat(np.arange(len(segs)), nb)
        end_a = refined(char_at[char_base[sa] + chars], self.len_a[fa], sa, na, base)
        end_b = refined(base[sb] + shift[sb] + span_end, self.len_b[fb], sb, nb, base)
        good = reproduced(raw, fa, na, self.bytes_a) & reproduced(raw, fb, nb, self.bytes_b)
        ka, kb = good[sa], good[sb]
        fa, sa, end_a, fb, sb, end_b = fa[ka], sa[ka], end_a[ka], fb[kb], sb[kb], end_b[kb]

        ends = np.union1d(end_a, end_b)
        ia, ib = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        codes = (fa[ia] << B_BITS) | fb[ib] if len(ends) else np.zeros(0, np.int64)
        links = np.bincount(sa[ia], minlength=len(segs)) if len(ends) else np.zeros(len(segs), np.int64)
        link_at = np.concatenate([[0], np.cumsum(links)])
        both_a, both_b = np.isin(end_a, end_b), np.isin(end_b, end_a)
        groups = np.bincount(sa[both_a], minlength=len(segs))
        ga, gb = (np.flatnonzero(both_a) + 1).tolist(), (np.flatnonzero(both_b) + 1).tolist()
        ta, tb = [self.str_a[i] for i in fa.tolist()], [self.str_b[i] for i in fb.tolist()]
        parts = [",".join(ta[x:i]) + "|" + ",".join(tb[y:k]) for x, i, y, k in zip([0, *ga], ga, [0, *gb], gb)]
        codes, link_at, group_at = codes.tobytes(), (8 * link_at).tolist(), np.concatenate([[0], np.cumsum(groups)]).tolist()
        return [(n, k, m, parts[g] if m == 1 else ";".join(parts[g:g + m]), codes[lo:hi]) if ok else (-1, 0, 0, "", b"")
                for ok, n, k, m, g, lo, hi in zip(good.tolist(), na.tolist(), nb.tolist(), groups.tolist(), group_at, link_at, link_at[1:])]


def reproduced(raw: list[bytes], ids: np.ndarray, count: np.ndarray, table: list[bytes]) -> np.ndarray:
    """Whether the bytes of a unit's tokens are the unit."""
    tokens = [table[i] for i in ids.tolist()]
    if b"".join(tokens) == b"".join(raw) and (np.add.reduceat([len(t) for t in tokens], np.cumsum(count) - count) == [len(r) for r in raw]).all():
        return np.ones(len(raw), bool)
    end = np.cumsum(count).tolist()
    return np.array([b"".join(tokens[lo:hi]) == r for lo, hi, r in zip([0, *end], end, raw)], bool)


def refined(coarse: np.ndarray, size: np.ndarray, seg: np.ndarray, count: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse ones, or those of the decoded bytes in every segment where
    the span of a token and the number of its bytes differ."""
    if not len(coarse):
        return coarse
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    before = np.concatenate([[0], coarse[:-1]])
    before[first[count > 0]] = base[count > 0]
    off = np.zeros(len(count), bool)
    off[seg[coarse - before != size]] = True
    total = np.cumsum(size)
    start = np.concatenate([[0], total])[first[seg]]
    return np.where(off[seg], base[seg] + total - start, coarse)


_PAIRS: dict = {}


def tokenizer_pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


class Chunk:
    """The texts of up to CHUNK_BYTES of a task, as numbers of their distinct segments."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.local: dict[str, int] = {}
        self.ids: list = []
        self.docs: list[np.ndarray] = []

    def add(self, doc_id, text: str, size: int) -> None:
        number = self.local.setdefault
        local, idx = self.local, []
        if text:
            for part in units(" " + text):
                idx.extend([number(s, len(local)) for s in part])
        self.ids.append(doc_id)
        self.docs.append(np.array(idx, np.uint32))
        self.size += size

    def rows(self, pair: Pair, keep_groups: bool) -> pa.RecordBatch:
        rec = pair.records(list(self.local))
        n = [np.array([r[k] for r in rec], np.int64) for k in range(3)]
        link_end = np.cumsum([len(r[4]) // 8 for r in rec], dtype=np.int64) if rec else np.zeros(0, np.int64)
        links = np.diff(link_end, prepend=0)
        codes = np.frombuffer(b"".join([r[4] for r in rec]), np.int64)
        used = np.zeros(len(rec), np.int64)
        cols: list[list] = [[] for _ in range(4)]
        groups, shas, keep = [], [], []
        for idx in self.docs:
            ok = len(idx) > 0 and bool((n[0][idx] >= 0).all())
            for col, values in zip(cols, (*n, links)):
                col.append(int(values[idx].sum()) if ok else 0)
            text = ";".join([rec[i][3] for i in idx.tolist()]) if ok else ""
            shas.append(hashlib.sha256(text.encode()).hexdigest() if ok else "")
            groups.append(text if keep_groups else None)
            keep.append(idx.tobytes() if ok else b"")
            if ok:
                used += np.bincount(idx, minlength=len(rec))
        live = np.repeat(used > 0, links)
        pairs, inverse = np.unique(codes[live], return_inverse=True)
        counts = np.bincount(inverse, np.repeat(used, links)[live], len(pairs)).astype(np.int64)
        place = np.zeros(len(codes), np.uint32)
        place[live] = inverse
        rest = [None] * (len(self.docs) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.number] * len(self.docs), pa.int64()), pa.array(self.ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols),
             pa.array(groups, pa.string()), pa.array(shas, pa.string()), pa.array(keep, pa.binary()),
             pa.array([link_end.tobytes(), *rest], pa.binary()), pa.array([place.tobytes(), *rest], pa.binary()),
             pa.array([pairs, *rest], pa.list_(pa.int64())), pa.array([counts, *rest], pa.list_(pa.int64()))],
            [c.split()[0] for c in PARTS.split(", ")])


def chunks(a_path: str, b_path: str, keep_groups: bool):
    def run(batches):
        pair = tokenizer_pair(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk(number)
        for batch in batches:
            for piece in pieces_of(batch):
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    size = len(text.encode())
                    if chunk.docs and chunk.size + size > CHUNK_BYTES:
                        yield chunk.rows(pair, keep_groups)
                        number += 1
                        chunk = Chunk(number)
                    chunk.add(doc_id, text, size)
        if chunk.docs:
            yield chunk.rows(pair, keep_groups)
    return run


def with_counts(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one chunk with the sums of their links' corpus counts."""
    first = [i for i, x in enumerate(left.column("seg_ends").to_pylist()) if x is not None][0]
    ends = np.frombuffer(left.column("seg_ends")[first].as_py(), np.int64)
    place = np.frombuffer(left.column("seg_pairs")[first].as_py(), np.uint32)
    n = int(place.max()) + 1 if len(place) else 0
    total, best = np.zeros(max(n, right.num_rows), np.int64), np.zeros(max(n, right.num_rows), np.int64)
    at = right.column("place").to_numpy()
    total[at], best[at] = right.column("total").to_numpy(), right.column("best").to_numpy()

    def by_segment(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values[place])]) if len(place) else np.zeros(1, np.int64)
        return np.diff(sums[ends], prepend=0)

    total, best = by_segment(total), by_segment(best)
    docs = [np.frombuffer(x, np.uint32) for x in left.column("segments").to_pylist()]
    out = {c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    out["n_best"] = pa.array([int(best[i].sum()) for i in docs], pa.int64())
    out["count_sum"] = pa.array([int(total[i].sum()) for i in docs], pa.int64())
    return pa.table({**out, "groups": left.column("groups"), "groups_sha256": left.column("groups_sha256")})


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, total, best): links of every id pair in all texts, best = 1 for the highest of its
    second id. One id of the second tokenizer has at most as many pairs as the first has ids."""
    flat = parts.where("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs", "counts")))
    total = shared_table(flat.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total")), "pair_totals")
    b = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    top = total.groupBy(b.alias("b")).agg(F.max("total").alias("highest"))
    return total.withColumn("b", b).join(top, "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (``a1,a2|b1;a3|b2,b3``; null
    unless ``keep_groups``) and groups_sha256 of every row."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = shared_table(rows.mapInArrow(chunks(a_path, b_path, keep_groups), PARTS), "aligned")
    counts = pair_counts(parts)
    wanted = parts.where("pairs IS NOT NULL").select(F.col("chunk").alias("home"), F.posexplode("pairs").alias("place", "pair"))
    back = wanted.join(counts, "pair").select("home", "place", "total", "best")
    return parts.drop("pairs", "counts").groupBy("chunk").cogroup(back.groupBy("home")).applyInArrow(with_counts, RESULT)
