"""Exact dedup with an extendible-hash index on shared files. DataFrame and SQL functions only.

Method. Every text gets a 64-bit hash; its entry is (hash, doc_id, bytes, digest). The directory comes
first, from a histogram of the hashes: a bucket of depth d is one value of the d leading hash bits, a
bucket with more than ``capacity`` chains splits on one more bit, and all doublings come from one
histogram of fine cells (``SPLIT_BITS`` bits below the starting depth). It has at most 2 ** ``MAX_BITS``
rows, whatever the table: above that, and where a bucket is still overfull at the last bit, buckets hold
more chains, so no entry is ever turned away. Every row looks up its bucket there; the directory is
broadcast for it. Consecutive buckets with about ``OWNER_BYTES`` of text are a key range, and one owner
task inserts its entries: chains are told apart by their whole texts, so a collision never joins two
texts, and the task writes the range's buckets as index files. Each row's result is what its entry finds
in those files. A chain with more than a thousandth of all rows (there are less than a thousand of
them) shrinks to a row per map task before it is sent to its owner.

Defined results: a null text equals the empty text; null doc_ids stay only where a group has no
other id; repeated rows (same id and text) each give a row, count in ``group_size`` and are all
marked as kept if theirs is the largest id; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, shared_table, text_or_empty

CAPACITY = 4096
SPLIT_BITS = 6
MAX_BITS = 20
OWNER_BYTES = 32 << 20
HOT_SHARE = 1000


def leading_bits(h: str, depth: int):
    """The ``depth`` leading bits of the 64-bit hash column as a number."""
    return F.shiftrightunsigned(F.col(h), 64 - depth) if depth else F.lit(0).cast("long")


def directory(chains: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(cell, depth, bucket) for every fine cell in use, and the bits of a cell. ``chains`` has one
    row per distinct hash ``h``."""
    total = chains.count()
    start = min(max(0, math.ceil(math.log2(max(1, total / capacity)))), MAX_BITS - SPLIT_BITS)
    bits = start + SPLIT_BITS
    cells = chains.groupBy(leading_bits("h", bits).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    depth = F.lit(bits)
    for d in range(bits, start - 1, -1):  # the least depth that fits wins
        prefix = F.shiftrightunsigned("cell", bits - d)
        load = F.sum("n").over(Window.partitionBy(prefix))  # at most 2 ** SPLIT_BITS cells
        cells = cells.withColumn(f"load_{d}", load)
        depth = F.when(F.col(f"load_{d}") <= capacity, F.lit(d)).otherwise(depth)
    cells = cells.withColumn("depth", depth)
    return cells.select("cell", "depth", F.expr(f"shiftrightunsigned(cell, {bits} - depth)").alias("bucket")), bits


def owners(chains: DataFrame, cells: DataFrame, bits: int) -> DataFrame:
    """``cells`` with the owner of each cell's bucket: buckets in order of their keys, about
    OWNER_BYTES of ``chains.bytes`` each."""
    load = chains.groupBy(leading_bits("h", bits).alias("cell")).agg(F.sum("bytes").alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("cell")) - F.col("bytes")  # at most 2 ** MAX_BITS cells
    first = F.min("before").over(Window.partitionBy("depth", "bucket"))
    return (cells.join(load, "cell").withColumn("before", before)
            .select("cell", "depth", "bucket", F.floor(first / OWNER_BYTES).cast("int").alias("owner")))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and the entry's
    place in the index: bucket_depth, bucket."""
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"))
            .withColumn("h", F.xxhash64("t")))
    entries = shared_table(rows.select("h", "doc_id", F.octet_length("t").alias("n_bytes"),
                                       F.sha2("t", 256).alias("text_sha256")), "exact_entries")
    chains = shared_table(entries.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("longest"),
                                                   F.sum(F.col("n_bytes").cast("long")).alias("bytes")), "exact_chains")
    total = chains.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE > total
    hot = F.broadcast(chains.where(is_hot).select("h"))
    cells, bits = directory(chains, capacity)
    loads = chains.select("h", F.when(is_hot, F.col("longest")).otherwise(F.col("bytes")).alias("bytes"))
    table = shared_table(owners(loads, cells, bits), "exact_directory")
    parts = (table.agg(F.max("owner")).first()[0] or 0) + 1
    found = rows.withColumn("cell", leading_bits("h", bits)).join(F.broadcast(table), "cell")
    place = ["owner", "depth", "bucket", "h", "t"]
    shrunk = found.join(hot, "h", "left_semi").groupBy(*place).agg(F.max("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    sent = found.join(hot, "h", "left_anti").select(*place, F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("n"))
    index = (sent.unionByName(shrunk).repartitionById(parts, "owner").groupBy(*place)
             .agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
             .select("h", F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size",
                     F.col("depth").alias("bucket_depth"), "bucket"))
    index = shared_table(index.sortWithinPartitions("bucket", "h"), "exact_index")
    drop_table(chains)
    drop_table(table)
    return (entries.join(index, ["h", "text_sha256"])
            .select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256",
                    "n_bytes", "bucket_depth", "bucket"))
