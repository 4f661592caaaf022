"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find grouping.

Method. A document's set holds the hashes of its distinct word shingles. Every element draws a
random permutation of the signature's places, step by step (Fisher-Yates), and a random fraction
per step; at step j it offers j + fraction to the place it draws, and every place keeps the least
offer. A document stops as soon as all its places hold less than the next step can offer, so long
documents stop after one or two steps. Places are cut into bands; rows per band and bands follow
from the threshold so that a true link shares no band with a probability below ``MISS``.

Documents with equal sets are one class. First every member of a bucket is compared with the
bucket's first class: pairs whose signatures agree far too seldom for the threshold (six standard
deviations) are left out, the others are confirmed on the full sets. That settles pairs and tight
groups. Buckets of three or more that still hold several components are joined to clusters, and a
cluster is settled exactly: all members outside its largest component are compared with all
members, block by block. A task gets two blocks of at most about ``BLOCK`` sets each, counts all
intersections as one matrix product over the shingles that occur twice, and returns a spanning
forest of the links. So no pair of members ever becomes a row, no task holds a whole group, near
copies of one text cost their number and not its square, and no link that a bucket offers is lost.

Defined results: documents without words have an empty set, are linked with nothing and stay; null
ids count as larger than any other and stay only alone; repeated rows are copies of one class; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (U, components, drop_table, mix, pieces_of, prepare, shared_table, shingle_sets,
                     text_bytes)
from .spans import named_rows

MISS = 1e-7
MAX_PLACES = 224
BLOCK = 256
BROADCAST_IDS = 1_000_000  # eight bytes each
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def plan(threshold: float) -> tuple[int, int]:
    """(rows per band, bands): the most rows for which the bands fit."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-threshold ** rows))
        if rows * bands <= MAX_PLACES:
            return rows, bands
    return 1, MAX_PLACES


def signatures(h: np.ndarray, doc: np.ndarray, n: int, m: int) -> np.ndarray:
    """(n x m) least offers; ``h``: distinct elements, ``doc``: their sorted document numbers."""
    sig = np.full(n * m, np.inf)
    place: np.ndarray | None = None
    own = np.arange(len(h))
    e, d = h, doc
    for j in range(m):
        if not len(e):
            break
        r = mix(e + U((2 * j + 1) * _STEP & _MASK))
        k = j + ((mix(e + U((2 * j + 2) * _STEP & _MASK)) >> U(11)).astype(np.float64) * (2.0 ** -53) * (m - j)).astype(np.int64)
        if place is None:
            slot = k
        else:
            rows = own
            slot = place[rows, k].astype(np.int64)
            place[rows, k] = place[rows, j]
        np.minimum.at(sig, d * m + slot, j + (r >> U(11)).astype(np.float64) * 2.0 ** -53)
        docs = np.unique(d) if j < 3 or j % 4 == 0 else None
        if docs is not None:
            done = np.zeros(n, bool)
            done[docs] = sig.reshape(n, m)[docs].max(1) < j + 1
            on = ~done[d]
            if place is None:
                e, d, k = e[on], d[on], k[on]
                place = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
                place[np.arange(len(e)), k] = 0
                own = np.arange(len(e))
            elif not on.all():
                e, d, own = e[on], d[on], own[on]
    return sig.reshape(n, m)


def class_of(s: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes and a 63-bit name of every set."""
    count = np.bincount(d, minlength=n)
    name = np.zeros(n, np.uint64)
    has = np.flatnonzero(count)
    if len(has):
        first = np.concatenate([[0], np.cumsum(count)[:-1]])[has]
        name[has] = mix(np.add.reduceat(mix(s + U(77)), first) + mix(np.bitwise_xor.reduceat(s, first)) + count[has].astype(np.uint64))
    return count, (name >> U(1)).astype(np.int64)


def sketch(k: int, rows: int, bands: int):
    m = rows * bands

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, 1 << 18):
                b, off = text_bytes(part.column(part.schema.get_field_index("text")))
                n = part.num_rows
                s, d = shingle_sets(b, off, k)
                count, name = class_of(s, d, n)
                sig = signatures(s, d, n, m).view(np.uint64)
                key = np.repeat(mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :], n, 0)
                for i in range(rows):
                    key = mix(key * U(0xD1342543DE82EF95) + sig[:, i::rows][:, :bands])
                small = mix(sig).astype(np.uint8)
                has = count > 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("rid")),
                     pa.array(count.astype(np.int64)), pa.array(name, mask=~has),
                     pa.array([small[i].tobytes() if has[i] else None for i in range(n)], pa.binary()),
                     pa.array([key[i].view(np.int64) if has[i] else [] for i in range(n)], pa.list_(pa.int64()))],
                    ["doc_id", "rid", "n_shingles", "cls", "sig", "bands"])

    return run


def full_sets(k: int):
    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, 1 << 18):
                b, off = text_bytes(part.column(part.schema.get_field_index("text")))
                s, d = shingle_sets(b, off, k)
                count, name = class_of(s, d, part.num_rows)
                cut = np.concatenate([[0], np.cumsum(count)])
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[at]), pa.array([s[cut[i]:cut[i + 1]].tobytes() for i in at], pa.binary())], ["cls", "elements"])

    return run


def confirmed(num: int, den: int):
    """Pairs with den * intersection >= num * union, from the two sorted sets."""

    def run(batches):
        for batch in batches:
            sa, sb = batch.column(batch.schema.get_field_index("sa")), batch.column(batch.schema.get_field_index("sb"))
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(sa[i].as_buffer(), np.uint64), np.frombuffer(sb[i].as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok[i] = den * both >= num * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def agreeing(least: int):
    """Pairs whose signatures agree in at least ``least`` places."""

    def run(batches):
        for batch in batches:
            ga, gb = batch.column(batch.schema.get_field_index("ga")), batch.column(batch.schema.get_field_index("gb"))
            x = np.frombuffer(b"".join(ga.to_pylist()), np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.uint8)
            y = np.frombuffer(b"".join(gb.to_pylist()), np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else x
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return run


def block_links(num: int, den: int):
    """Spanning forest of the links between two blocks of sets."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        cls = table.column("cls").to_numpy()
        raw = table.column("elements").to_pylist()
        m = len(raw)
        size = np.array([len(x) // 8 for x in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint64)
        owner = np.repeat(np.arange(m), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        at = np.cumsum(new) - 1
        twice = np.bincount(at) > 1
        keep = twice[at]
        owner, at = owner[keep], (np.cumsum(twice) - 1)[at[keep]]
        both = np.zeros((m, m), np.float32)
        width = 4096
        for s in range(0, int(twice.sum()), width):
            lo, hi = np.searchsorted(at, [s, s + width])
            x = np.zeros((m, width), np.float32)
            x[owner[lo:hi], at[lo:hi] - s] = 1
            both += x @ x.T
        both = both.astype(np.int64)
        link = den * both >= num * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(link, True)
        label = np.arange(m)
        while True:
            least = np.where(link, label[None, :], m).min(1)
            least = np.minimum(least, least[least])
            if (least == label).all():
                break
            label = least
        a = np.flatnonzero(label != np.arange(m))
        return pa.table({"a": pa.array(cls[a], pa.int64()), "b": pa.array(cls[label[a]], pa.int64())})

    return run


def settle_clusters(rest: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) inside clusters of open buckets. ``rest``: key, b (the bucket's first class), cls,
    comp."""
    cluster = components(rest.select(F.col("cls").alias("a"), "b").distinct())
    member = rest.select("cls", "comp").distinct().join(cluster.toDF("cls", "cluster"), "cls")
    member = shared_table(member, "cluster_members")
    by_comp = member.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    most = by_comp.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("big"), F.max("n").alias("n_big"), F.sum("n").alias("n_all"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    most = shared_table(most.select("cluster", "big", blocks(F.col("n_all") - F.col("n_big")).alias("n_out"), blocks(F.col("n_big")).alias("n_in")), "cluster_sizes")
    m = member.join(most, "cluster").withColumn("outside", F.col("comp") != F.col("big"))
    own = F.pmod(F.xxhash64("cls"), F.when(F.col("outside"), F.col("n_out")).otherwise(F.col("n_in"))).cast("int")
    # blocks 0 .. n_out - 1 are outside the largest component, the others inside; a pair of blocks has
    # at least one outside
    m = m.withColumn("own", own)
    others = F.when(F.col("outside"), F.sequence(F.lit(0), F.col("n_out") + F.col("n_in") - 1)).otherwise(F.sequence(F.lit(0), F.col("n_out") - 1))
    block = F.when(F.col("outside"), F.col("own")).otherwise(F.col("n_out") + F.col("own"))
    m = m.select("cls", "cluster", block.alias("block"), F.explode(others).alias("other"))
    m = m.select("cls", "cluster", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    dealt = m.join(sets, "cls").select("cluster", "p", "q", "cls", "elements")
    return dealt.groupBy("cluster", "p", "q").applyInArrow(block_links(num, den), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, and rid (a name that
    equal rows share, as in ``spans.named_rows``). Documents are linked if
    den * intersection >= num * union of their shingle sets."""
    spark = docs.sparkSession
    prepare(spark)
    t = num / den
    rows, bands = plan(t)
    m = rows * bands
    base = named_rows(docs)
    feats = shared_table(base.mapInArrow(sketch(shingle, rows, bands), "doc_id long, rid long, n_shingles long, cls long, sig binary, bands array<long>"), "sketches")
    exploded = feats.where("cls is not null").select("cls", F.explode("bands").alias("key"))
    keys = shared_table(exploded.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key"), "shared_keys")
    members = shared_table(exploded.join(keys, "key").distinct(), "bucket_members")
    inside = members.select("cls").distinct()
    about = shared_table(feats.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")).join(inside, "cls", "left_semi"), "class_sketches")
    reps = about.select(F.col("rep").alias("doc_id")).distinct()
    if about.count() <= BROADCAST_IDS:  # else the texts move to the ids
        reps = F.broadcast(reps)
    wanted = base.alias("d").join(reps.alias("r"), F.expr("d.doc_id <=> r.doc_id"), "left_semi")
    sets = wanted.mapInArrow(full_sets(shingle), "cls long, elements binary").dropDuplicates(["cls"])
    sets = shared_table(sets, "class_sets")

    spread = math.sqrt(t * (1 - t) / m)
    least = max(0, math.floor(m * (t - 6 * spread)))
    light = about.select("cls", "n", "sig")
    # 1. every member against the first class of its bucket
    lead = members.groupBy("key").agg(F.min("cls").alias("b"), F.count(F.lit(1)).alias("size"))
    lead = shared_table(lead, "bucket_leads")
    pairs = members.join(lead, "key").where("cls > b").select(F.col("cls").alias("a"), "b").distinct()
    one, two = light.toDF("a", "na", "ga"), light.toDF("b", "nb", "gb")
    near = (pairs.join(one, "a").join(two, "b")
            .where((F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb")))
            .select("a", "b", "ga", "gb").mapInArrow(agreeing(least), "a long, b long"))
    near = shared_table(near, "pairs")
    links = (near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
             .select("a", "b", "sa", "sb").mapInArrow(confirmed(num, den), "a long, b long"))
    links = shared_table(links, "links")
    roots = shared_table(components(links), "roots")
    # 2. larger buckets that still hold several components
    large = members.join(lead.where("size > 2").select("key", "b"), "key")
    named = shared_table(large.join(roots, large["cls"] == roots["node"], "left")
                         .select("key", "b", "cls", F.coalesce("root", "cls").alias("comp")), "members_named")
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rest = shared_table(named.join(mixed, "key", "left_semi"), "members_open")
    if not rest.isEmpty():
        links = links.unionByName(shared_table(settle_clusters(rest, sets, num, den), "cluster_links"))
        roots = shared_table(components(links), "all_roots")
    named = feats.select("doc_id", "rid", "n_shingles", "cls")
    least_id = about.select("cls", "rep")
    byroot = roots.join(least_id, roots["node"] == least_id["cls"]).groupBy("root").agg(F.min("rep").alias("component"))
    byroot = shared_table(byroot, "component_ids")
    linked = shared_table(roots.join(byroot, "root").select(F.col("node").alias("cls"), "component"), "linked")
    classes = shared_table(named.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("own"))
                           .join(linked, "cls", "left").select("cls", F.coalesce("component", "own").alias("component")), "class_components")
    out = (named.join(classes, "cls", "left")
           .withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))))
    drop_table(sets)
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"), "rid")
