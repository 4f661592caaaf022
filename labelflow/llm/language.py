"""Language identification by interpolated Kneser-Ney character models, one per language.

Method. Texts are lower-cased; every run of characters that are not letters counts as one blank.
For each language the character n-grams of a bounded, documented training sample are counted in
Spark; discounts come from the counts of counts; the highest order uses counts, the lower orders
the numbers of different left neighbours, interpolated down to a uniform model. A model is a pair
of sorted arrays (64-bit n-gram code, log probability); an unseen n-gram takes the shorter one's
probability times its context's rest weight, whose codes are sorted arrays too. A text gets the
language of the lowest cross-entropy per character. Scoring looks up the distinct n-grams of a
batch and never sees lang, source or doc_id.

Rejection: a text without letters is ``und``. Others keep the best language, and ``rejected`` says
that their cross-entropy lies above what nearly all held-back training texts of that language
reach, with ``SLACK``; the limit loosens as 1 / sqrt(length) for short texts. Its scale is the
``KEEP_SHARE`` quantile of the distances above the median, at most ``ROBUST`` robust deviations, so
a few garbage or wrongly labelled texts don't lift it. Languages with under ``FEW`` held-back
texts take the scale of all languages together; one without any rejects nothing.

Defined results: null and empty texts are ``und`` with score 0 and rejected; null ids, repeated
rows and very long texts are scored like others; an empty table gives an empty result; if nothing
can be learnt, every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, mix, pieces_of, prepare, shared_table

ORDER = 4
#: Bounds of the training sample, per language: rows in hash order of doc_id, whole texts. Ids with
#: more than LARGE bytes come last, the shortest first, so that none of them ends a sample early;
#: the first id of a language is taken whatever its size.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 6_000_000
LARGE = 300_000
CALIBRATION = 10  # of so many sampled rows of a language the last is held back to calibrate the rejection
KEEP_SHARE = 0.99
ROBUST = 6.0
FEW = 20
SLACK = 2.5
SCHEMA = "doc_id long, lang_pred string, score double, entropy double, rejected boolean"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes of all texts, each led by ORDER - 1 blanks and closed by one, and offsets."""
    parts, off = [], [0]
    lead = " " * (ORDER - 1)
    for t in texts:
        s = _NOT_LETTERS.sub(" ", t.lower()).strip()
        parts.append(f"{lead}{s} " if s else "")
        off.append(off[-1] + len(parts[-1]))
    raw = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
    wide = raw > 0xFFFF
    codes = raw.astype(np.uint64)
    if wide.any():
        codes[wide] = mix(codes[wide]) & U(0xFFFF)
    return codes, np.array(off, np.int64)


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of the n characters that end at each position, for positions from ORDER - 1 on."""
    m = len(codes) - ORDER + 1
    out = np.zeros(max(m, 0), np.uint64)
    for i in range(n):
        at = ORDER - n + i
        out = (out << U(16)) | codes[at:at + len(out)]
    return out


def inside(off: np.ndarray) -> np.ndarray:
    """Positions (from ORDER - 1 on) whose whole n-gram lies in one text."""
    total = int(off[-1])
    ok = np.zeros(max(total - ORDER + 1, 0), bool)
    for s, e in zip(off[:-1], off[1:]):
        if e > s:
            ok[s:e - ORDER + 1] = True
    return ok


@dataclass
class KneserNey:
    """Per order n (1 .. ORDER): sorted codes with probabilities, sorted contexts with rest weights."""

    codes: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    rests: list[np.ndarray]
    uniform: float

    def probability(self, grams_by_order: list[np.ndarray]) -> np.ndarray:
        """Of the distinct n-grams given as codes of their suffixes of every order."""
        p = np.full(len(grams_by_order[-1]), self.uniform)
        for n in range(1, ORDER + 1):
            g = grams_by_order[n - 1]
            seen, own = find(self.codes[n - 1], g)
            known, ctx = find(self.contexts[n - 1], g >> U(16))
            p = np.where(known, self.rests[n - 1][ctx] * p + np.where(seen, self.probs[n - 1][own], 0.0), p)
        return p


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[i] == keys, i


def fit(codes: np.ndarray, counts: np.ndarray, alphabet: int) -> KneserNey:
    """From the counts of n-grams of the highest order (codes sorted)."""
    levels: list[tuple] = [None] * ORDER
    c, n = codes, counts.astype(np.float64)
    for order in range(ORDER, 0, -1):
        ones, twos = float((n == 1).sum()), float((n == 2).sum())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        ctx, first = np.unique(c >> U(16), return_index=True)
        sums = np.add.reduceat(n, first) if len(c) else n
        kinds = np.diff(np.append(first, len(c)))
        at = np.searchsorted(ctx, c >> U(16))
        levels[order - 1] = (c, np.maximum(n - d, 0) / sums[at] if len(c) else n, ctx, d * kinds / sums if len(c) else n)
        if order > 1:  # how many different characters stand before each shorter n-gram
            c, n = np.unique(c & U((1 << (16 * (order - 1))) - 1), return_counts=True)
            n = n.astype(np.float64)
    return KneserNey(*(list(x) for x in zip(*levels)), uniform=1.0 / max(alphabet, 1))


class Model:
    def __init__(self, by_lang: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(by_lang)
        letters = np.unique(np.concatenate([c & U(0xFFFF) for c, _ in by_lang.values()] or [np.zeros(0, np.uint64)]))
        self.models = [fit(*by_lang[x], alphabet=len(letters) + 1) for x in self.langs]
        self.middle = np.zeros(len(self.langs))
        self.spread = np.full(len(self.langs), np.inf)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) bits per character, and the numbers of characters scored."""
        codes, off = characters(texts)
        length = np.maximum(np.diff(off) - ORDER + 1, 0)
        out = np.full((len(texts), len(self.langs)), np.inf)
        has = np.flatnonzero(length > 0)
        if not len(has) or not self.langs:
            return out, length
        ok = inside(off)
        g = grams(codes, ORDER)[ok]
        distinct, back = np.unique(g, return_inverse=True)
        by_order = [distinct & U((1 << (16 * n)) - 1) for n in range(1, ORDER + 1)]
        starts = np.concatenate([[0], np.cumsum(length[has])[:-1]])
        for k, m in enumerate(self.models):
            bits = -np.log2(m.probability(by_order))
            out[has, k] = np.add.reduceat(bits[back], starts) / length[has]
        return out, length

    def limit(self, lang: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.middle[lang] + self.spread[lang] * (1 + 8 / np.sqrt(np.maximum(length, 1)))

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Median entropy of each language and the spread that nearly all held-back texts keep."""
        h, n = self.entropies(texts)
        far = {}
        for k, lang in enumerate(self.langs):
            own = np.array([x == lang for x in langs], bool) & (n > 0)
            if own.any():
                self.middle[k] = np.quantile(h[own, k], 0.5, method="lower")
                far[k] = (h[own, k] - self.middle[k]) / (1 + 8 / np.sqrt(n[own]))
        for k, own in far.items():
            d = own if len(own) >= FEW else np.concatenate(list(far.values()))
            reach = np.quantile(d, KEEP_SHARE, method="lower")  # below the worst one, however few they are
            self.spread[k] = SLACK * max(min(float(reach), ROBUST * 1.4826 * float(np.median(np.abs(d)))), 0.1)

    def predict(self, texts: list[str]):
        """(language, score, entropy, rejected) of every text."""
        h, n = self.entropies(texts)
        if not self.langs:
            return [("und", 0.0, None, True)] * len(texts)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        with np.errstate(invalid="ignore"):
            gap = (h - low[:, None]) * np.minimum(n, 64)[:, None]
            score = 1 / np.exp2(-gap).sum(1)
        rejected = low > self.limit(best, n)
        return [(self.langs[b], float(s), float(e), bool(r)) if m else ("und", 0.0, None, True)
                for b, s, e, r, m in zip(best, score, low, rejected, n)]


def learn(docs: DataFrame) -> Model:
    """``docs``: doc_id, text, lang of the rows to learn from."""
    spark = docs.sparkSession
    prepare(spark)
    ids = sample_ids(docs)
    rows = docs.join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "text", "lang", "held")
    rows = shared_table(rows, "language_sample")

    def count(batches):
        for batch in batches:
            for part in pieces_of(batch):
                langs = np.array(part.column(part.schema.get_field_index("lang")).to_pylist(), object)
                texts = np.array([t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()], object)
                for lang in sorted(set(langs)):
                    codes, off = characters(list(texts[langs == lang]))
                    g, n = np.unique(grams(codes, ORDER)[inside(off)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    def counted(some: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        counts = some.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
        table = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
        out = {}
        names = np.array(table.column("lang").to_pylist(), object)
        grams_, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
        for lang in sorted(set(names)):
            own = names == lang
            order = np.argsort(grams_[own])
            out[lang] = (grams_[own][order], n[own][order])
        return out

    by_lang = counted(rows.where("not held"))
    kept = rows.where("held").select("text", "lang").toArrow()
    held = [(t or "", x) for t, x in zip(kept.column("text").to_pylist(), kept.column("lang").to_pylist())]
    calibrating = [x for x in held if x[1] in by_lang]
    if len(calibrating) < len(held):  # languages with letters in held-back rows only learn from those
        by_lang.update(counted(rows.where(F.col("held") & ~F.col("lang").isin(sorted(by_lang)))))
    model = Model(by_lang)
    model.calibrate([t for t, _ in calibrating], [x for _, x in calibrating])
    return model


def sample_ids(docs: DataFrame) -> DataFrame:
    """doc_id, lang, held of the sample, chosen without moving texts; at most SAMPLE_ROWS ids a language.
    Of a language's ids every CALIBRATION-th is held back, so one with fewer keeps all to learn from."""
    light = docs.where("lang is not null and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    # rows with a small hash, about twice as many as wanted, so that ranking moves no more than those
    counts = light.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    light = light.join(counts, "lang").where(place * F.col("n") < 2 * SAMPLE_ROWS)
    light = light.groupBy("lang", "doc_id").agg(F.sum("size").alias("size"))  # repeated rows come together
    order = [F.when(F.col("size") > LARGE, F.col("size")).otherwise(0), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)), "doc_id"]
    first = light.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= SAMPLE_ROWS)
    total = F.sum("size").over(Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    first = first.withColumn("total", total).where((F.col("total") <= SAMPLE_BYTES) | (F.col("r") == 1))
    return first.select("doc_id", "lang", (F.col("r") % CALIBRATION == 0).alias("held"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, entropy (null: no letter), rejected of every row."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch):
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                lang, score, entropy, rejected = zip(*shared.value.predict(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not rejected."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch):
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                yield part.filter(pa.array([not r for *_, r in shared.value.predict(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
