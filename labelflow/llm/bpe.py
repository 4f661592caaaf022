"""BPE encoding by speculation and verification, and decoding.

Method. A word's ids are proposed by greedy longest match. A sequence of ids is what the merges
produce exactly if every adjacent pair is: the merge process of the two halves of a pair is
independent until a merge joins them over their border, so it is enough to know, for each pair,
whether such a merge would have come before the border's neighbours grew. The check undoes the
latest merge next to the border on either side, again and again, and asks for a merge of the two
inner tokens that ranks before the moment at which one of them was used up; it runs for all pairs
of a batch at once in numpy. Only words with a failing pair (or an id that the merges never
produce) undergo exact merging. Words are remembered in a memo bounded by bytes.

The text is normalised as the vocabulary file says: NFC, white space, lower case by character,
words by pattern, bytes as printable characters, a mark on the last symbol of a word. Special
tokens in the text stay whole. Without a decoder in the file, decoding joins the tokens' strings
with single blanks.

Defined results: null and empty texts have no ids and an empty decoded text; null doc_ids and
repeated rows give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, byte_chars, pieces_of, prepare

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MEMO_BYTES = 192 << 20  # of words
WORD_END = "</w>"
PREFIX = 4
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+"  # the same in lower-case ASCII


class SpeculativeBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END:
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        v, size = self.vocab, max(self.strings) + 1
        self.digits = list(map(str, range(size)))
        self.result = [v[a + b] for a, b in merges]
        self.result_ids = np.array(self.result, np.int64)
        self.id_rank: dict[tuple[int, int], int] = {}
        self.made = np.full(size, -1, np.int64)  # rank of the merge that makes a token; -1: a symbol
        self.left, self.right = np.arange(size), np.arange(size)
        pair = {}
        for r, (a, b) in enumerate(merges):
            key, new = (v[a] << 20) | v[b], v[a + b]
            pair.setdefault(key, r)
            self.id_rank.setdefault((v[a], v[b]), r)
            if self.made[new] < 0:
                self.made[new], self.left[new], self.right[new] = r, v[a], v[b]
        keys = np.array(sorted(pair), np.int64)
        self.pair_keys, self.pair_rank = keys, np.array([pair[k] for k in keys], np.int64)
        self.longest = max(len(s.removesuffix(WORD_END)) for s in v)
        self.bytes = byte_chars()
        self.words, self.ascii_words = regex.compile(WORDS), re.compile(ASCII_WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # a token that the merges don't rebuild from its own characters is never proposed
        self.usable = {s: i for s, i in v.items() if not self._merged_differs(s, i)}
        # the longest token that starts with these PREFIX characters
        self.reach: dict[str, int] = {}
        for s in self.usable:
            s = s.removesuffix(WORD_END)
            if len(s) >= PREFIX:
                self.reach[s[:PREFIX]] = max(self.reach.get(s[:PREFIX], PREFIX), len(s))
        self.memo = Memo(MEMO_BYTES)

    # -- words ---------------------------------------------------------------------------------
    def symbols(self, token: str) -> list[str]:
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            body = token[:-len(WORD_END)]
            return [*body[:-1], body[-1] + WORD_END]
        return list(token)

    def _merged_differs(self, token: str, i: int) -> bool:
        return self.exact(self.symbols(token)) != [i]

    def exact(self, parts: list[str]) -> list[int]:
        """The merges of one word in order of rank, leftmost first, with a heap and a linked list."""
        ids = [self.vocab[p] for p in parts]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.id_rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.result[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (k := self.id_rank.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (k, p, ids[p], ids[q]))
        return [t for t in ids if t >= 0]

    def exact_many(self, words: list[str]) -> list[list[int]]:
        """Exact merging of many words of one length at once: a row each, one merge a round."""
        n, v = len(words[0]), self.vocab
        table = np.array([[v[c] for c in w[:-1]] + [v[w[-1] + WORD_END]] for w in words], np.int64)
        size, rows = np.full(len(words), n), np.arange(len(words))
        ranks = self.merge_rank(table[:, :-1].ravel(), table[:, 1:].ravel()).reshape(len(words), n - 1)
        none = np.iinfo(np.int64).max
        while len(rows):
            j = ranks[rows].argmin(1)
            best = ranks[rows, j]
            on = best < none
            rows, j, best = rows[on], j[on], best[on]
            if not len(rows):
                break
            move = np.arange(n) + (np.arange(n) > j[:, None])
            move[:, -1] = np.minimum(move[:, -1], n - 1)
            table[rows] = np.take_along_axis(table[rows], np.minimum(move, n - 1), 1)
            table[rows, j] = self.result_ids[best]
            size[rows] -= 1
            shift = np.arange(n - 1) + (np.arange(n - 1) >= j[:, None])
            own = np.take_along_axis(ranks[rows], np.minimum(shift, n - 2), 1)
            own[np.arange(n - 1) >= size[rows, None] - 1] = none
            left, right = j > 0, j < size[rows] - 1
            k = np.flatnonzero(left)
            own[k, j[k] - 1] = self.merge_rank(table[rows[k], j[k] - 1], table[rows[k], j[k]])
            k = np.flatnonzero(right)
            own[k, j[k]] = self.merge_rank(table[rows[k], j[k]], table[rows[k], j[k] + 1])
            ranks[rows] = own
        return [x[:m] for x, m in zip(table.tolist(), size.tolist())]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; ``word`` is in byte characters, without the mark."""
        out, at, n, find, longest, reach = [], 0, len(word), self.usable.get, self.longest, self.reach.get
        last = word + WORD_END
        while at < n:
            if n - at <= longest and (t := find(last[at:])) is not None:
                out.append(t)
                return out
            end = min(n - 1, at + reach(word[at:at + PREFIX], PREFIX - 1))
            while (t := find(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_rank[i], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: would the merges leave the border between a and b alone?"""
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)  # a merge over the border must rank before it
        while len(at):
            crossed = self.merge_rank(a, b) < limit
            ok[at[crossed]] = False
            on = ~crossed & ((self.made[a] >= 0) | (self.made[b] >= 0))
            at, a, b, limit = at[on], a[on], b[on], limit[on]
            back_a = self.made[a] > self.made[b]
            # the left side's own merge wins a tie (leftmost first), the right side's loses it
            limit = np.where(back_a, self.made[a], self.made[b] + 1)
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
        return ok

    def encode_words(self, words: list[str]) -> list[list[int]]:
        ids = [self.propose(w) for w in words]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for x in ids for t in x), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(ids)), n)
        inner = owner[1:] == owner[:-1]
        a, b, owner = flat[:-1][inner], flat[1:][inner], owner[1:][inner]
        by_length = defaultdict(list)
        for w in np.unique(owner[~self.compatible(a, b)]).tolist():
            by_length[len(words[w])].append(w)
        for length, which in by_length.items():
            if len(which) < 4 or length > 48:
                got = [self.exact([*words[w][:-1], words[w][-1] + WORD_END]) for w in which]
            else:
                got = self.exact_many([words[w] for w in which])
            for w, x in zip(which, got):
                ids[w] = x
        return ids

    # -- texts ---------------------------------------------------------------------------------
    def text_words(self, text: str) -> list[str]:
        """The words of a text after normalisation. No word holds white space, so the whole text is matched."""
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
        return self.words.findall(text.lower())

    def learn(self, words: list[str]) -> list[tuple[str, str]]:
        """(ids, decoded) of words that the memo lacks, checked in one pass."""
        string, digits, table, out = self.strings.__getitem__, self.digits.__getitem__, self.bytes.__getitem__, []
        shown = [w if w.isascii() and w.isprintable() else "".join(map(table, w.encode())) for w in words]
        for w, x in zip(words, self.encode_words(shown)):
            out.append((" ".join(map(digits, x)), " ".join(map(string, x))))
            self.memo.put(w, out[-1], 300 + len(out[-1][0]) + len(out[-1][1]))
        return out

    def encode_texts(self, texts: list[str]):
        """(number of ids, ids joined by blanks, decoded text) of every text."""
        split, ids, strings = [], {}, {}
        for text in texts:
            if self.specials is not None and self.specials.search(text):
                parts = self.specials.split(text)
                split.append([x for i, p in enumerate(parts) for x in ([(p,)] if i % 2 else self.text_words(p))])
            else:
                split.append(self.text_words(text))
        new = []
        for w in set().union(*split):
            if isinstance(w, tuple):
                ids[w], strings[w] = str(self.special[w[0]]), w[0]
            elif (known := self.memo.get(w)) is None:
                new.append(w)
            else:
                ids[w], strings[w] = known
        new.sort()
        for w, (i, x) in zip(new, self.learn(new)):
            ids[w], strings[w] = i, x
        for x in split:
            joined = " ".join(map(ids.__getitem__, x))
            yield joined.count(" ") + 1 if x else 0, joined, " ".join(map(strings.__getitem__, x))


_LOADED: dict[str, SpeculativeBpe] = {}


def loaded(path: str) -> SpeculativeBpe:
    if path not in _LOADED:
        _LOADED[path] = SpeculativeBpe(path)
    return _LOADED[path]


def digests(path: str):
    def run(batches):
        coder = loaded(path)
        for batch in batches:
            for part in pieces_of(batch, 2 << 20):
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                n, ids, decoded = [], [], []
                for k, i, d in coder.encode_texts(texts):
                    n.append(k)
                    ids.append(hashlib.sha256(i.encode()).hexdigest())
                    decoded.append(hashlib.sha256(d.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoded(path: str):
    def run(batches):
        coder = loaded(path)
        for batch in batches:
            for part in pieces_of(batch, 2 << 20):
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                got = list(coder.encode_texts(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), pa.array([[int(t) for t in x[1].split()] for x in got], pa.list_(pa.int32())),
                     pa.array([x[2] for x in got])], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded text."""
    prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(encoded(path), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(digests(path), SCHEMA)
