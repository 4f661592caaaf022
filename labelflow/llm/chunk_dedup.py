"""Substring dedup by content-defined chunking.

Method. A gear hash rolls over the bytes: each step shifts the 32-bit state left and adds the
byte's table value, so the state depends on the last 32 bytes only; it is computed for all
positions of a batch by doubling the window. A chunk ends where the state's masked bits are zero
and a character ends, not before ``MIN_CHUNK`` bytes and not after ``MAX_CHUNK``. So boundaries
follow the content, and an insertion shifts only the chunks around it. Chunks are known by a
128-bit digest. A chunk is removed from every document but the one with the smallest doc_id that
holds it. Copies inside one document stay. Digests that only one document holds are left behind by
a pre-aggregated minimum and maximum; no list of documents per digest is ever formed.

Defined results: null and empty texts have no chunks; a text shorter than ``MIN_CHUNK`` bytes is one
chunk and stays whole; a null doc_id neither removes nor loses anything; repeated rows (equal id)
don't remove each other's chunks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, mix, pieces_of, prepare, release_shuffles, shared_table, text_bytes
from .spans import named_rows, remove

MIN_CHUNK = 32
MEAN_BITS = 5  # a boundary every 32 bytes on average beyond the minimum
MAX_CHUNK = 1024
_GEAR = mix(np.arange(1000, 1256, dtype=np.uint64)).astype(np.uint32)


def gear(b: np.ndarray) -> np.ndarray:
    """State after each byte: the sum of table values of the last 32 bytes, each shifted by its age."""
    h = _GEAR[b]
    size = 1
    while size < 32:
        older = np.zeros_like(h)
        older[size:] = h[:-size] << np.uint32(size)
        h = h + older
        size *= 2
    return h


def chunks(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the chunks of all texts of a batch. The state may reach back
    into the text before for the first 31 bytes, which are below the minimum anyway."""
    ends_char = np.ones(len(b), bool)
    ends_char[:-1] = (b[1:] & 0xC0) != 0x80
    cut = np.flatnonzero(((gear(b) >> np.uint32(32 - MEAN_BITS)) == 0) & ends_char) + 1
    start, doc = [], []
    for d in range(len(off) - 1):
        at, end = int(off[d]), int(off[d + 1])
        mine = cut[np.searchsorted(cut, at):np.searchsorted(cut, end, side="left")].tolist()
        i, n = 0, len(mine)
        while at < end:
            start.append(at)
            doc.append(d)
            limit = at + MAX_CHUNK
            while i < n and mine[i] < at + MIN_CHUNK:
                i += 1
            if i < n and mine[i] <= limit:
                at = mine[i]
            elif limit < end:
                at = limit
                while at < end and (b[at] & 0xC0) == 0x80:
                    at += 1
            else:
                at = end
    s = np.array(start, np.int64)
    d = np.array(doc, np.int64)
    e = np.append(s[1:], len(b))
    last = np.ones(len(s), bool)
    last[:-1] = d[1:] != d[:-1]
    e[last] = off[d[last] + 1]
    return s, e, d


def digests(batches):
    for batch in batches:
        for part in pieces_of(batch):
            col = lambda name: part.column(part.schema.get_field_index(name)).to_numpy()  # noqa: E731,B023
            b, off = text_bytes(part.column(part.schema.get_field_index("text")))
            s, e, d = chunks(b, off)
            raw = b.tobytes()
            both = np.frombuffer(b"".join([blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(s.tolist(), e.tolist())]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(col("doc_id")[d]), pa.array(col("rid")[d]), pa.array((s - off[d]).astype(np.int32)), pa.array((e - off[d]).astype(np.int32)),
                 pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "rid", "s", "e", "d1", "d2"])


def dedup_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes, valid UTF-8) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    found = named_rows(docs).where("doc_id is not null").mapInArrow(digests, "doc_id long, rid long, s int, e int, d1 long, d2 long")
    found = shared_table(found, "chunks")
    held = (found.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
            .where("first < last").select("d1", "d2", "first"))
    held = shared_table(held, "shared_chunks")
    release_shuffles(spark)
    spans = shared_table(found.join(held, ["d1", "d2"]).where("doc_id > first").select("rid", "s", "e"), "chunk_spans")
    release_shuffles(spark)
    return remove(docs, spans)
