"""Balanced shards by Karmarkar-Karp differencing of groups that must not be divided.

Method. Rows with equal texts are one group; its size is the sum of its rows' sizes. Every unit
starts as a partial partition (size, 0, ..., 0). The two partial partitions with the largest spread
are combined again and again, one in falling and the other in rising order, until one is left.
This runs in two steps that no input makes large: the groups above ``1 / BIG`` of a shard's share
(at most ``BIG * shards`` of them) are differenced together; all others are dealt by hash to
buckets of about ``BUCKET`` groups, and every bucket is differenced on its own, starting from a
partial partition that holds its part of the loads the large groups have left, so that each bucket
fills the shards up evenly. A group larger than a whole shard's share can't be balanced by any
partition; it is cut by a hash of doc_id into the fewest parts that fit.

Defined results: a null text has no bytes and equals the empty text; null doc_ids and repeated rows
are rows like any other; an empty table gives an empty result; other columns are ignored. Slots
are gapless from 0 in every shard that has rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, shared_table, text_or_empty

SHARDS = 40
ROW_BYTES = 16
BUCKET = 8192
BIG = 100
SLOT_ROWS = 512


def difference(sizes: np.ndarray, shards: int, loads: np.ndarray | None = None) -> np.ndarray:
    """Shard of every unit. ``loads``: a partial partition whose places keep their numbers."""
    starts = [(float(s), None) for s in sizes]
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.int64)
    nodes: list[tuple] = []  # per node: children and, for each, the place its places go to
    heap = []
    for i, (s, _) in enumerate(starts):
        v = np.zeros(shards)
        v[0] = s
        nodes.append(())
        heap.append((-s if shards > 1 else 0.0, i, v))
    if loads is not None:
        order = np.argsort(-loads, kind="stable")
        nodes.append(("loads", order))
        v = loads[order].astype(float)
        heap.append((-(v[0] - v[-1]), n, v))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        total = a + b[::-1]
        order = np.argsort(-total, kind="stable")
        place = np.empty(shards, np.int64)
        place[order] = np.arange(shards)
        nodes.append((i, j, place))
        total = total[order]
        heapq.heappush(heap, (-(total[0] - total[-1]), len(nodes) - 1, total))
    final: dict[int, np.ndarray] = {heap[0][1]: np.arange(shards)}
    out = np.zeros(n, np.int64)
    fixed = np.arange(shards)
    for k in range(len(nodes) - 1, -1, -1):
        own = final.pop(k)
        if k < n:
            out[k] = own[0]
        elif nodes[k][0] == "loads":
            fixed = np.empty(shards, np.int64)
            fixed[own] = nodes[k][1]  # the place that ends up at own[p] was place order[p] of loads
        else:
            i, j, place = nodes[k]
            final[i] = own[place]
            final[j] = own[place[::-1]]
    return fixed[out]


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    prepare(spark)
    text = text_or_empty()
    rows = shared_table(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(text, 256).alias("key")), "shard_rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    total, n_rows = (int(x or 0) for x in rows.agg(F.sum("size"), F.count(F.lit(1))).first())
    share = max(1.0, total / shards)
    # fewer than ``shards`` groups can be larger than a share, so this side is small by proof
    cut = groups.where(F.col("bytes") > share).select("key", F.ceil(F.col("bytes") / F.lit(share)).cast("long").alias("parts"))
    rows = rows.join(F.broadcast(cut), "key", "left").withColumn(
        "part", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.expr("pmod(xxhash64(doc_id), parts)"))).drop("parts")
    units = shared_table(rows.groupBy("key", "part").agg(F.sum("size").alias("size")), "shard_units")
    big = (F.col("size") > share / BIG)
    n_small, small_bytes = (int(x or 0) for x in units.where(~big).agg(F.count(F.lit(1)), F.sum("size")).first())
    schema = "key string, part long, size long, shard int"

    def place_big(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "part"], ascending=[False, True, True], ignore_index=True)
        return pdf.assign(shard=difference(pdf["size"].to_numpy(), shards).astype("int32"))[["key", "part", "size", "shard"]]

    placed_big = shared_table(units.where(big).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(place_big, schema), "shard_big")
    loads = np.zeros(shards)
    for r in placed_big.groupBy("shard").agg(F.sum("size").alias("s")).collect():  # at most ``shards`` rows
        loads[r["shard"]] = r["s"]

    def place_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "part"], ascending=[False, True, True], ignore_index=True)
        sizes = pdf["size"].to_numpy()
        own = difference(sizes, shards, loads * (sizes.sum() / max(1, small_bytes)))
        return pdf.assign(shard=own.astype("int32"))[["key", "part", "size", "shard"]]

    buckets = max(1, math.ceil(n_small / BUCKET))
    placed_small = (units.where(~big).withColumn("bucket", F.expr(f"pmod(xxhash64(key, part), {buckets})"))
                    .groupBy("bucket").applyInPandas(place_bucket, schema))
    placed = shared_table(placed_big.unionByName(placed_small), "shard_units_placed").select("key", "part", "shard")
    subs = max(1, math.ceil(n_rows / (shards * SLOT_ROWS)))
    out = shared_table(rows.join(placed, ["key", "part"]).withColumn("sub", F.expr(f"pmod(xxhash64(doc_id, 7), {subs})"))
                       .select("doc_id", "size", "text_crc32", "shard", "sub"), "shard_placed")
    counts = out.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "sub", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32"))
    return (out.withColumn("rank", slot).join(before, ["shard", "sub"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.coalesce("before", F.lit(0)) + F.col("rank") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
