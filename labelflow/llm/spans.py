"""Removing byte spans from texts, for the operators that find repeated passages."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import prepare, text_or_empty

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def named_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and rid, a name that equal rows share."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn(
        "rid", F.xxhash64("doc_id", "text"))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, end)."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return start[new], end[last]


def without(raw: bytes, spans) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal removed runs."""
    if not spans:
        return raw, 0
    s, e = merged(np.array([x["s"] for x in spans], np.int64), np.array([x["e"] for x in spans], np.int64))
    at, parts = 0, []
    for x, y in zip(s.tolist(), e.tolist()):
        parts.append(raw[at:x])
        at = y
    return b"".join([*parts, raw[at:]]), len(s)


def cut(batches):
    for batch in batches:
        col = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731,B023
        raw = [t.encode() for t in col("text").to_pylist()]
        got = [without(r, s) for r, s in zip(raw, col("spans").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [col("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([len(r) - len(k) for r, (k, _) in zip(raw, got)], pa.int64()),
             pa.array([n for _, n in got], pa.int64()), pa.array([k for k, _ in got], pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


@F.pandas_udf(StringType())
def kept_text(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The text without the spans; bytes of characters that a span cuts in two go with it."""
    return pd.Series([without(t.encode(), [] if s is None else list(s))[0].decode(errors="ignore") for t, s in zip(text, spans)], dtype=object)


def span_lists(spans: DataFrame) -> DataFrame:
    return spans.distinct().groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # at most a text's length


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of every row. ``spans``: rid, s, e, any
    number of them for a row, overlapping or not."""
    prepare(docs.sparkSession)
    return named_rows(docs).join(span_lists(spans), "rid", "left").select("doc_id", "text", "spans").mapInArrow(cut, SCHEMA)


def rewrite(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of ``text``; ``n_chars``, if there, follows."""
    prepare(docs.sparkSession)
    rid = F.xxhash64(F.col("doc_id").cast("long"), text_or_empty())
    out = docs.withColumn("_rid", rid).join(span_lists(spans).withColumnRenamed("rid", "_rid").withColumnRenamed("spans", "_spans"), "_rid", "left")
    out = out.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(kept_text(text_or_empty(), F.col("_spans"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
