"""What several operators share: reading, shared tables, views on Arrow strings, 64-bit hashing.

Rows with a null ``doc_id`` are kept by every operator unless its docstring says otherwise; a null
text is an empty text. Every numpy helper works on one Arrow batch, so memory is bounded by the
batch limits of the session, whatever the size of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.session import shared_path, ship_package

BATCH_ROWS = 2000
BATCH_BYTES = 2 << 20
PIECE_BYTES = 1 << 19  # of text that a numpy step works on at once


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors, keep Arrow batches small (long texts) and let Spark remove
    the shuffle files of each finished job (every step's result is a table in the shared folder)."""
    ship_package(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, "llm", name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path  # noqa: SLF001 - remembered so that drop_table can remove the files
    return out


def drop_table(df: DataFrame) -> None:
    """Remove the files of a shared table that no later step reads."""
    spark, path = df.sparkSession, getattr(df, "_llm_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver's collector finds their plans
    unreachable; between the phases of a long operator it is asked to look."""
    import gc
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n+1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def pieces_of(batch: pa.RecordBatch, limit: int = PIECE_BYTES):
    """Slices of a batch with at most ``limit`` text bytes each (at least one row)."""
    if batch.num_rows == 0:
        return
    i = batch.schema.get_field_index("text")
    _, off = text_bytes(batch.column(i))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


class Memo:
    """What a worker remembers of texts it has seen, within a bound in bytes: two generations, of
    which the older one goes when the younger is full, so frequent texts stay. Long texts are not
    kept. Values are never None."""

    def __init__(self, limit: int = 64 << 20, longest: int = 64):
        self.limit, self.longest, self.size = limit // 2, longest, 0
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key: str):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found, 300)
        return found

    def put(self, key: str, value, size: int) -> None:
        if len(key) > self.longest:
            return
        self.size += size + len(key)
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, size + len(key)
        self.young[key] = value


def byte_chars() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
_MUL = 0xD1342543DE82EF95
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        m = max(n, 1 << 16)
        for key, base in (("p", _MUL), ("i", pow(_MUL, -1, 1 << 64))):
            x = np.full(m, U(base))
            x[0] = U(1)
            _POW[key] = np.cumprod(x, dtype=np.uint64)
    return _POW["p"], _POW["i"]


class SpanHash:
    """64-bit polynomial hashes of byte spans of one buffer, all spans in one numpy pass."""

    def __init__(self, b: np.ndarray):
        p, self.inv = _powers(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * p[:len(b)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64))

    def fixed(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.inv[:n] + U(k)) if n > 0 else np.zeros(0, np.uint64)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length) for every pair."""
    length = np.asarray(length, np.int64)
    if length.sum() == 0:
        return np.zeros(0, np.int64)
    first = np.repeat(np.asarray(start, np.int64) - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return first + np.arange(len(first))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes other than ASCII white space."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = _SPACE[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | edge[:-1]))
    end = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def shingle_sets(b: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles and their text numbers, sorted by text and hash. A text
    with one to k - 1 words has one shingle, the whole sequence."""
    low = _LOWER[b]
    start, end, doc = word_spans(low, off)
    n = len(off) - 1
    h = SpanHash(low).spans(start, end) if len(start) else np.zeros(0, np.uint64)
    words = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    mul = U(0x9FB21C651E98DF25)

    def joined(at: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(at), U(size))
        for i in range(size):
            out = mix(out * mul + h[at + i])
        return out

    parts, docs = [], []
    full = np.flatnonzero(words >= k)
    at = ranges(first[full], words[full] - k + 1)
    parts.append(joined(at, k))
    docs.append(np.repeat(full, words[full] - k + 1))
    for size in range(1, k):
        few = np.flatnonzero(words == size)
        parts.append(joined(first[few], size))
        docs.append(few)
    s, d = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], d[new]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (a, b: long): union-find inside every task, then
    large-star and small-star rounds until nothing changes. Only links move, never groups."""
    import pandas as pd
    spark = links.sparkSession

    def forest(frames):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        for f in frames:
            for a, b in zip(f["a"].tolist(), f["b"].tolist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        kept = [(x, root(x)) for x in parent if root(x) != x]
        yield pd.DataFrame(kept, columns=["a", "b"]).astype("int64")

    # a > b from here on
    edges = shared_table(links.where("a <> b").mapInPandas(forest, "a long, b long").distinct(), "forest")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = shared_table(large, "large_star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        new = shared_table(small, "small_star")
        same = edges.exceptAll(new).isEmpty() and new.count() == edges.count()
        edges = new
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
