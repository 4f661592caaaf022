"""Document quality from a linear-chain conditional random field over lines.

Method. A line's features are shares of character classes, word statistics and repetition, for
itself and for its two neighbours; a document is the chain of its lines with labels bad (0) and
good (1). Weights of features, transitions and starts are learnt by gradient ascent on the chain
likelihood, where all lines of a labelled document carry its label; the sample is bounded and
documented. A document's raw score is the mean of its lines' forward-backward marginals, weighted
by line length; a two-parameter logistic on the same sample turns it into the probability of label
1. Features see the text only.

Defined results: null and empty texts score the share of label 1 in the sample; null ids, repeated
rows and very long texts are scored like others; an empty table gives an empty result; without
labels of both kinds every score is that share (0.5 if there are none); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SpanHash, pieces_of, prepare, shared_table, text_bytes

#: Bounds of the training sample, per label: ids in hash order of doc_id, whole texts. Ids with more
#: than LARGE bytes come last, the shortest first, so that none of them ends a sample early; the first
#: id of a label is taken whatever its size.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 12_000_000
LARGE = 600_000
ROUNDS = 250
THRESHOLD = 0.3
SCHEMA = "doc_id long, score double"

_CLASS = np.zeros((8, 256), bool)
_CLASS[0, [*range(65, 91)]] = True                                   # capitals
_CLASS[1, [*range(97, 123), *range(128, 256)]] = True                # small letters, other scripts
_CLASS[2, [*range(48, 58)]] = True                                   # digits
_CLASS[3, [9, 11, 12, 13, 32]] = True                                # blanks
_CLASS[4, list(b".,;:?'\"()-")] = True                               # ordinary punctuation
_CLASS[5, list(b"!")] = True
_CLASS[6, list(b"|<>{}[]/\\=_~^`@")] = True                          # markup and tables
_CLASS[7, list(b"#$%&*+")] = True
_BLANK = _CLASS[3].copy()
OWN = 20
WIDTH = 3 * OWN + 1


def lines_of(b: np.ndarray, off: np.ndarray):
    """Start, end and document of every non-empty line."""
    cut = np.concatenate([np.flatnonzero(b == 10), off[1:] - 0])
    cut = np.unique(np.concatenate([cut, off]))
    start, end = cut[:-1], cut[1:]
    start = start + ((start < len(b)) & (b[np.minimum(start, max(len(b) - 1, 0))] == 10) if len(b) else 0)
    keep = end > start
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(off, start, side="right") - 1


def features(b: np.ndarray, off: np.ndarray):
    """(lines x WIDTH) features, lengths and documents of the lines."""
    start, end, doc = lines_of(b, off)
    n = len(start)
    length = end - start
    x = np.zeros((n, OWN))
    if n == 0:
        return np.zeros((0, WIDTH)), length, doc
    size = np.maximum(length, 1).astype(float)
    shares = []
    for row in _CLASS:
        total = np.zeros(len(b) + 1, np.int64)
        np.cumsum(row[b], out=total[1:])
        shares.append((total[end] - total[start]) / size)
    x[:, :8] = np.array(shares).T
    letters = np.maximum(x[:, 0] + x[:, 1], 1e-9)
    x[:, 8] = x[:, 0] / letters
    x[:, 9:13] = np.sqrt(x[:, [2, 5, 6, 7]])
    # words of all lines: runs without blanks or line ends
    gap = _BLANK[b] | (b == 10)
    edge = np.zeros(len(b) + 1, bool)
    edge[off] = True
    begins = ~gap & (np.concatenate([[True], gap[:-1]]) | edge[:-1])
    ends = ~gap & (np.concatenate([gap[1:], [True]]) | edge[1:])
    ws, we = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = SpanHash(b)
    wh = hashes.spans(ws, we)
    line = np.searchsorted(start, ws, side="right") - 1
    words = np.bincount(line, minlength=n).astype(float)
    same = np.zeros(len(ws), bool)
    same[1:] = (wh[1:] == wh[:-1]) & (line[1:] == line[:-1])
    at_least = np.maximum(words, 1)
    x[:, 13] = np.bincount(line[same], minlength=n) / at_least
    order = np.lexsort((wh, line))
    first = np.ones(len(ws), bool)
    first[1:] = (wh[order][1:] != wh[order][:-1]) | (line[order][1:] != line[order][:-1])
    x[:, 14] = np.bincount(line[order][first], minlength=n) / at_least
    x[:, 15] = np.log1p(words)
    x[:, 16] = np.minimum(length / at_least, 40) / 10
    long_word = (we - ws) > 24
    x[:, 17] = np.bincount(line[long_word], minlength=n) / at_least
    # lines that occur again in the same document, and words that do
    lh = hashes.spans(start, end) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, back, times = np.unique(lh, return_inverse=True, return_counts=True)
    x[:, 18] = times[back] > 1
    three = np.zeros(len(ws), np.uint64)
    if len(ws) > 3:
        mul = np.uint64(0xD6E8FEB86659FD93)
        three[:-3] = ((wh[:-3] * mul + wh[1:-2]) * mul + wh[2:-1]) * mul + wh[3:] + doc[line[:-3]].astype(np.uint64)
        _, back, times = np.unique(three, return_inverse=True, return_counts=True)
        x[:, 19] = np.bincount(line[times[back] > 1], minlength=n) / at_least
    before, after = np.zeros_like(x), np.zeros_like(x)
    joined = doc[1:] == doc[:-1]
    before[1:][joined] = x[:-1][joined]
    after[:-1][joined] = x[1:][joined]
    return np.concatenate([x, before, after, np.ones((n, 1))], 1), length, doc


class Chain:
    """Weights of a two-label chain: emissions (per feature, for label 1 against 0), transitions, starts."""

    def __init__(self, width: int = WIDTH):
        self.w, self.trans, self.start = np.zeros(width), np.zeros((2, 2)), np.zeros(2)
        self.center, self.scale = np.zeros(width), np.ones(width)
        self.a, self.b, self.base = 1.0, 0.0, 0.5

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.center) / self.scale) @ self.w

    def marginals(self, e: np.ndarray, doc_first: np.ndarray, doc_len: np.ndarray):
        """P(label 1) of each line, pair expectations summed over all lines, log Z summed. ``e``: score of
        label 1 over label 0 of all lines, documents one after another."""
        order = np.argsort(-doc_len, kind="stable")
        first, length = doc_first[order], doc_len[order]
        steps = int(length[0]) if len(length) else 0
        alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]  # docs longer than t
        fwd, bwd = np.zeros((len(e), 2)), np.zeros((len(e), 2))
        for t in range(steps):
            at = first[:alive[t]] + t
            if t == 0:
                m = self.start + np.stack([np.zeros(len(at)), e[at]], 1)
            else:
                p = fwd[at - 1]
                m = np.logaddexp(p[:, :1] + self.trans[0], p[:, 1:] + self.trans[1]) + np.stack([np.zeros(len(at)), e[at]], 1)
            fwd[at] = m
        for t in range(steps - 2, -1, -1):
            at = first[:alive[t + 1]] + t
            nxt = bwd[at + 1] + np.stack([np.zeros(len(at)), e[at + 1]], 1)
            bwd[at] = np.stack([np.logaddexp(nxt[:, 0] + self.trans[0, 0], nxt[:, 1] + self.trans[0, 1]),
                                np.logaddexp(nxt[:, 0] + self.trans[1, 0], nxt[:, 1] + self.trans[1, 1])], 1)
        both = fwd + bwd
        z = np.logaddexp(both[:, 0], both[:, 1])
        p1 = np.exp(both[:, 1] - z)
        inner = np.ones(len(e), bool)
        inner[doc_first] = False
        at = np.flatnonzero(inner)
        pair = np.zeros((2, 2))
        emit = np.stack([np.zeros(len(at)), e[at]], 1)
        for i in range(2):
            for j in range(2):
                pair[i, j] = np.exp(fwd[at - 1, i] + self.trans[i, j] + emit[:, j] + bwd[at, j] - z[at]).sum()
        return p1, pair

    def fit(self, x: np.ndarray, length: np.ndarray, doc: np.ndarray, label: np.ndarray) -> "Chain":
        """doc: number of the line's document; label: of each document (only those with lines count)."""
        self.base = float(label.mean()) if len(label) else 0.5
        if len(x) == 0 or label.min() == label.max():
            return self
        self.center, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        self.center[-1], self.scale[-1] = 0.0, 1.0
        xs = (x - self.center) / self.scale
        docs, first, count = np.unique(doc, return_index=True, return_counts=True)
        y = label[docs].astype(float)
        ly = np.repeat(y, count)
        weight = np.repeat(1.0 / np.sqrt(count), count)  # a long document doesn't outweigh many short ones
        n1, n0 = y.sum(), len(y) - y.sum()
        n_pairs = np.repeat(y, count - 1)
        seen = np.diag([float((n_pairs == 0).sum()), float((n_pairs == 1).sum())])
        params = [self.w, self.trans, self.start]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, ROUNDS + 1):
            p1, pair = self.marginals(xs @ self.w, first, count)
            starts = np.array([n0 - (1 - p1[first]).sum(), n1 - p1[first].sum()])
            grads = [xs.T @ ((ly - p1) * weight) / len(y) - 1e-3 * self.w, (seen - pair) / max(len(ly), 1) - 0.05 * self.trans,
                     starts / len(y) - 1e-2 * self.start]
            rate = 0.1 * (1 - step / (ROUNDS + 1)) + 0.005
            for k, (p, g) in enumerate(zip(params, grads)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p += rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
        raw = self.raw(x, length, doc, len(label))[docs]
        t = logit(raw)
        for _ in range(400):  # two-parameter logistic by Newton steps, damped
            p = 1 / (1 + np.exp(-np.clip(self.a * t + self.b, -30, 30)))
            s = np.maximum(p * (1 - p), 1e-6)
            g = np.array([((y - p) * t).sum() - 1e-2 * (self.a - 1), (y - p).sum()])
            h = np.array([[(s * t * t).sum() + 1e-2, (s * t).sum()], [(s * t).sum(), s.sum() + 1e-9]])
            d = np.linalg.solve(h, g)
            self.a, self.b = self.a + 0.5 * d[0], self.b + 0.5 * d[1]
            if np.abs(d).max() < 1e-6:
                break
        return self

    def raw(self, x: np.ndarray, length: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, np.nan)
        if len(x):
            docs, first, count = np.unique(doc, return_index=True, return_counts=True)
            p1, _ = self.marginals(self.emissions(x), first, count)
            out[docs] = np.add.reduceat(p1 * length, first) / np.add.reduceat(length.astype(float), first)
        return out

    def score(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        x, length, doc = features(b, off)
        raw = self.raw(x, length, doc, n)
        if not self.w.any():
            return np.full(n, self.base)
        p = 1 / (1 + np.exp(-np.clip(self.a * logit(np.nan_to_num(raw, nan=0.5)) + self.b, -30, 30)))
        return np.where(np.isnan(raw), self.base, p)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def sample_ids(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality of the sample, chosen without moving texts; at most SAMPLE_ROWS ids a label."""
    hashed = F.xxhash64("doc_id")
    labelled = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    place = F.row_number().over(Window.partitionBy("quality").orderBy(hashed, "doc_id"))
    near = labelled.withColumn("r", place).where(F.col("r") <= 2 * SAMPLE_ROWS)  # some ids have no text
    sizes = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
             .join(F.broadcast(near), "doc_id").groupBy("quality", "r", "doc_id").agg(F.sum("size").alias("size")))
    by_label = Window.partitionBy("quality")
    order = [F.when(F.col("size") > LARGE, F.col("size")).otherwise(0), "r"]
    first = sizes.withColumn("r", F.row_number().over(by_label.orderBy(*order))).where(F.col("r") <= SAMPLE_ROWS)
    total = F.sum("size").over(by_label.orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("total", total).where((F.col("total") <= SAMPLE_BYTES) | (F.col("r") == 1)).select("doc_id", "quality")


def learn(docs: DataFrame, labels: DataFrame) -> Chain:
    """``labels``: doc_id, quality (0 or 1) of the rows to learn from."""
    spark = docs.sparkSession
    prepare(spark)
    wanted = F.broadcast(sample_ids(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
    rows = shared_table(rows, "quality_sample")

    def lines(batches):
        for batch in batches:
            for part in pieces_of(batch, 1 << 18):
                x, length, doc = features(*text_bytes(part.column(part.schema.get_field_index("text"))))
                ids = part.column(part.schema.get_field_index("doc_id")).to_numpy()
                y = part.column(part.schema.get_field_index("quality")).to_numpy()
                count = np.bincount(doc, minlength=len(ids))
                cut = np.concatenate([[0], np.cumsum(count)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(y), pa.array([x[s:e].astype(np.float32).tobytes() for s, e in zip(cut, cut[1:])], pa.binary()),
                     pa.array([length[s:e].astype(np.int64).tobytes() for s, e in zip(cut, cut[1:])], pa.binary())], ["doc_id", "quality", "x", "lengths"])

    got = rows.where("text is not null").mapInArrow(lines, "doc_id long, quality int, x binary, lengths binary").toArrow().sort_by("doc_id")
    xs = [np.frombuffer(v, np.float32).reshape(-1, WIDTH) for v in got.column("x").to_pylist()]
    x = np.concatenate([*xs, np.zeros((0, WIDTH), np.float32)]).astype(float)
    length = np.concatenate([*(np.frombuffer(v, np.int64) for v in got.column("lengths").to_pylist()), np.zeros(0, np.int64)])
    doc = np.repeat(np.arange(len(xs)), [len(v) for v in xs]) if xs else np.zeros(0, np.int64)
    return Chain().fit(x, length, doc, np.array(got.column("quality").to_pylist(), np.int64))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, score of every row."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(chain)  # a few hundred numbers

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, 1 << 18):
                s = shared.value.score(*text_bytes(part.column(part.schema.get_field_index("text"))))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
