"""Drift of many batches in one job (J2 per batch, L2 per closed window) and the log of results.

The reference monitors batch after batch with one fitted detector. Here the current rows carry a
batch id, every statistic is keyed by it and the fitted reference is joined once:

* domain classifier: one row per term holds the document counts of the reference and a list of those
  of the batches; a block of the reference's held-out documents (``term_blocks``) meets the rows of its
  terms once and gives one score per document and batch;
* mean vectors and kernel features: sums keyed by batch, one join with the reference's means;
* ratio: the reference's running counts and all batches of one value range meet in one task, so the
  reference is not repeated per batch.

The ids of the batches of one call pass through the driver (one string each); a null id is
``unknown``. A batch gives the same row as a run of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import drift as DR
from . import drift_embed as DE
from . import drift_text as DT
from . import term_blocks as TB
from .auc import auc_from_counts
from .curate import require_columns


# ------------------------------------------------------------------ ECDF distance to one reference

def ecdf_to_reference(reference: DataFrame, current: DataFrame, dim_col: str | None = None) -> DataFrame:
    """Wasserstein-1 distance of every batch to one reference: ``(batch, dim, wasserstein, n_ref, n_cur)``.

    ``reference``: (dim, value, w); ``current``: (batch, dim, value, w), counts of distinct values,
    batch and dim integers. A task gets one range of values with the reference's counts once."""
    from ..session import write_table
    both = reference.select(F.lit(None).cast("int").alias("batch"), F.col("dim").cast("int").alias("dim"), F.col("value").cast("double").alias("value"), F.col("w").cast("long").alias("w")) \
        .unionByName(current.select(F.col("batch").cast("int").alias("batch"), F.col("dim").cast("int").alias("dim"), F.col("value").cast("double").alias("value"), F.col("w").cast("long").alias("w")))
    both = both.where(F.col("value").isNotNull() & ~F.isnan("value"))
    rows = write_table(DE.ranged(write_table(both, "ecdf_values")), "ecdf_ranges")
    totals = rows.groupBy("dim", "rng", "batch").agg(F.sum("w").alias("w"), F.min("value").alias("low"))

    def in_front(t: pa.Table) -> pa.Table:
        """For every range and batch of a dimension: what lies in front, the whole, the range's ends."""
        rng, batch = t.column("rng").to_numpy(), t.column("batch").to_pylist()
        w, low = t.column("w").to_numpy(), t.column("low").to_numpy()
        ranges, at = np.unique(rng, return_inverse=True)
        names = [None, *sorted({b for b in batch if b is not None})]
        place = {b: i for i, b in enumerate(names)}
        n = np.zeros((len(ranges), len(names)), np.int64)
        np.add.at(n, (at, [place[b] for b in batch]), w)
        start = np.full(len(ranges), np.inf)
        np.minimum.at(start, at, low)
        front = np.cumsum(n, axis=0) - n
        size, dim = len(names), t.column("dim")[0].as_py()
        after = [*start[1:].tolist(), None]
        return pa.table({"dim": pa.array([dim] * n.size, pa.int32()), "rng": pa.array(np.repeat(ranges, size), pa.int32()),
                         "batch": pa.array(names * len(ranges), pa.int32()), "front": pa.array(front.ravel()), "whole": pa.array(np.tile(n.sum(axis=0), len(ranges))),
                         "start": pa.array(np.repeat(start, size)), "after": pa.array([a for a in after for _ in range(size)], pa.float64())})

    def area(t: pa.Table, at: pa.Table) -> pa.Table:
        batch = np.array([-1 if b is None else b for b in t.column("batch").to_pylist()], np.int64)
        value, w = t.column("value").to_numpy(), t.column("w").to_numpy()
        order = np.lexsort((value, batch))
        batch, value, w = batch[order], value[order], w[order]

        def steps(key: int, front: int, whole: int):
            lo, hi = np.searchsorted(batch, [key, key + 1])
            x, c = value[lo:hi], front + np.concatenate([[0], np.cumsum(w[lo:hi])])
            return x, lambda u: c[np.searchsorted(x, u, side="right")] / max(whole, 1)

        offsets = {(-1 if b is None else b): (f, n) for b, f, n in zip(*(at.column(c).to_pylist() for c in ("batch", "front", "whole")))}
        start, after = at.column("start")[0].as_py(), at.column("after")[0].as_py()
        ref, ref_share = steps(-1, *offsets.get(-1, (0, 0)))
        out = []
        for b, (front, whole) in offsets.items():
            if b < 0:
                continue
            cur, cur_share = steps(b, front, whole)
            u = np.unique(np.concatenate([[start], ref, cur]))
            gap = np.diff(u, append=u[-1] if after is None else after)
            out.append((b, float(np.abs(ref_share(u) - cur_share(u)) @ gap), offsets.get(-1, (0, 0))[1], whole))
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.table({"batch": pa.array(cols[0], pa.int32()), "dim": pa.array([t.column("dim")[0].as_py()] * len(out), pa.int32()),
                         "area": pa.array(cols[1], pa.float64()), "n_ref": pa.array(cols[2], pa.int64()), "n_cur": pa.array(cols[3], pa.int64())})

    offsets = totals.groupBy("dim").applyInArrow(in_front, "dim int, rng int, batch int, front long, whole long, start double, after double")
    got = rows.groupBy("dim", "rng").cogroup(write_table(offsets, "ecdf_offsets").groupBy("dim", "rng")).applyInArrow(
        area, "batch int, dim int, area double, n_ref long, n_cur long")
    return got.groupBy("batch", "dim").agg(F.sum("area").alias("wasserstein"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"))


# ------------------------------------------------------------------ vectors

def embedding_batches(fit: DE.EmbeddingFit, vectors: DataFrame, emb_col: str = "embedding") -> DataFrame:
    """``(batch, drift_score, threshold, drift_detected)`` of every batch of ``vectors`` (batch int)."""
    cur = vectors.filter(F.col(emb_col).isNotNull())
    if fit.method == "ratio":
        counts = cur.select("batch", F.posexplode(emb_col).alias("dim", "_v")).groupBy("batch", "dim", F.col("_v").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("w"))
        per = ecdf_to_reference(fit.stats, counts).join(DE._weighted_std(fit.stats, ["dim"]), "dim")
        d = F.when(F.col("ref_std") > 0, F.col("wasserstein") / F.col("ref_std")).otherwise(F.col("wasserstein"))
        score = per.groupBy("batch").agg(F.avg((d >= DE.RATIO_COMPONENT_THRESHOLD).cast("double")).alias("distance"))
        hit = F.col("distance") >= F.lit(fit.threshold)
    else:
        sums = DE.keyed_sums(cur, fit.like, "batch", emb_col)
        ref = fit.stats.select("dim", F.col("mean").alias("_r"))
        j = sums.select("batch", "dim", (F.col("s") / F.col("n")).alias("_c")).join(ref, "dim").groupBy("batch")
        square = F.sum((F.col("_r") - F.col("_c")) ** 2)
        if fit.method == "cosine":
            den = F.sqrt(F.sum(F.col("_r") ** 2)) * F.sqrt(F.sum(F.col("_c") ** 2))
            score = j.agg(F.when(den > 0, F.lit(1.0) - F.sum(F.col("_r") * F.col("_c")) / den).alias("distance"))
        else:
            score = j.agg((square if fit.method == "mmd" else F.sqrt(square)).alias("distance"))
        hit = F.col("distance") > F.lit(fit.threshold)
    return score.select("batch", F.col("distance").alias("drift_score"), F.lit(fit.threshold).alias("threshold"), F.coalesce(hit, F.lit(False)).alias("drift_detected"))


# ------------------------------------------------------------------ domain classifier

def _batch_counts(t) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with the lists ``b``, ``bd``, ``bt``: row, batch, documents, train documents of every entry."""
    lists = [x.combine_chunks() if isinstance(x := t.column(c), pa.ChunkedArray) else x for c in ("b", "bd", "bt")]
    lens = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lens)), lens), *(x.flatten().to_numpy() for x in lists)


def domain_classifier_batches(reference: TB.TermBlocks, current: DataFrame, n_batches: int, id_col: str = "doc_id",
                              seed: int = 42, max_df: float = 0.5) -> DataFrame:
    """``(batch, roc_auc, threshold, drift_detected, n_ref_test, n_cur_test)``: the domain classifier of
    every batch of ``current`` (id, text, batch int from 0) against one reference in blocks.

    A block of the reference gets the counts of its terms in all batches once; its held-out documents
    are scored for one batch after the other as products of the block's matrix."""
    from ..session import prepare_udfs, write_table
    prepare_udfs(current.sparkSession)
    cur = TB.term_blocks(current.withColumn("side", F.col("batch").cast("string")), id_col, seed=seed)
    cur_docs, batch_of = cur.docs.withColumn("batch", F.col("side").cast("int")), F.col("side").cast("int").alias("b")
    n_docs = np.full(n_batches, float(reference.docs.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]))
    for r in cur_docs.groupBy("batch").agg(F.sum("copies").alias("n")).collect():  # a row a batch
        n_docs[r["batch"]] += r["n"]

    rows = reference.stats().select("term", F.lit(-1).alias("b"), "df", (F.col("tr") + F.col("tz")).alias("tr")).unionByName(
        cur.stats().select("term", batch_of, "df", (F.col("tr") + F.col("tz")).alias("tr")))
    in_ref = lambda c: F.coalesce(F.sum(F.when(F.col("b") < 0, F.col(c))), F.lit(0)).cast("int").alias(c)
    entry = F.struct("b", F.col("df").cast("int").alias("df"), F.col("tr").cast("int").alias("tr"))
    lists = rows.groupBy("term").agg(in_ref("df"), in_ref("tr"), F.collect_list(F.when(F.col("b") >= 0, entry)).alias("x"))  # at most n_batches
    terms = write_table(lists.select("term", "df", "tr", F.col("x.b").alias("b"), F.col("x.df").alias("bd"), F.col("x.tr").alias("bt")), "batch_vocabulary", "zstd")

    def heavy_of(batches):
        for batch in batches:
            row, b, d, _ = _batch_counts(batch)
            pooled = np.repeat(batch.column(1).to_numpy().astype(float)[:, None], n_batches, axis=1)
            pooled[row, b] += d
            i, b = np.nonzero(pooled > max_df * n_docs)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(b, pa.int32())], ["term", "batch"])

    # documents whose terms are all too frequent in a batch's pooled corpus do not count as trained on;
    # frequent terms are few: at most (distinct terms of a mean document) / max_df a batch
    heavy = write_table(terms.select("term", "df", "b", "bd", "bt").mapInArrow(heavy_of, "term string, batch int"), "batch_heavy")
    trained, known = F.col("train") & (F.size("codes") > 0), F.col("id").isNotNull()
    sizes = np.zeros((2, n_batches))
    sizes[0] = reference.docs.where(trained).count()
    for r in cur_docs.where(trained).groupBy("batch").count().collect():
        sizes[1, r["batch"]] = r["count"]
    for r in TB.heavy_counts(reference.docs.where(trained & known), reference, heavy, ["batch"]).groupBy("batch").count().collect():
        sizes[0, r["batch"]] -= r["count"]
    for r in TB.heavy_counts(cur.docs.where(trained & known), cur, heavy, ["batch"]).where(F.col("side").cast("int") == F.col("batch")).groupBy("batch").count().collect():
        sizes[1, r["batch"]] -= r["count"]

    def weigh(pooled, train_cur, train_ref, b):
        """Inverse document frequency (0 where too frequent) and log-odds (0 where untrained)."""
        idf = np.where(pooled > max_df * n_docs[b], 0.0, np.log((n_docs[b] + 1) / (pooled + 1)) + 1)
        odds = np.log((train_cur + 1) / (sizes[1][b] + 2)) - np.log((train_ref + 1) / (sizes[0][b] + 2))
        return idf, np.where(train_cur + train_ref == 0, 0.0, odds)

    def scored(s, q, batch, copies) -> pa.Table:
        score = np.where(q > 0, s / np.sqrt(np.where(q > 0, q, 1.0)), 0.0)
        return pa.table({"batch": pa.array(batch, pa.int32()), "score": pa.array(score), "copies": pa.array(copies, pa.int64())})

    def reference_scores(t: pa.Table, at: pa.Table) -> pa.Table:
        m = TB.matrix(t)
        size = TB.width(m, at)
        df, tr = TB.dense(at, "df", size), TB.dense(at, "tr", size)
        row, b, d, trained = _batch_counts(at)
        code, order = TB.numbers(at, "code")[row], np.argsort(b, kind="stable")
        ends = np.searchsorted(b[order], np.arange(n_batches + 1))
        weight, square, out = m.log_tf, m.log_tf ** 2, []
        for i in range(n_batches):
            own = order[ends[i]:ends[i + 1]]
            pooled, train_cur = df.copy(), np.zeros(size)
            pooled[code[own]] += d[own]
            train_cur[code[own]] = trained[own]
            idf, odds = weigh(pooled, train_cur, tr, i)
            out.append(scored(m.total(weight * (idf * odds)[m.code]), m.total(square * (idf * idf)[m.code]), np.full(m.n, i), TB.numbers(t, "copies")))
        return pa.concat_tables(out)

    def current_scores(t: pa.Table, at: pa.Table) -> pa.Table:
        m = TB.matrix(t)
        size = TB.width(m, at)
        row, b, d, trained = _batch_counts(at)
        key, batch = TB.numbers(at, "code")[row].astype(np.int64) * n_batches + b, TB.numbers(t, "batch")
        order = np.argsort(key)
        own = batch[m.doc]
        found = order[np.searchsorted(key, m.code.astype(np.int64) * n_batches + own, sorter=order)]  # the document itself counts there
        idf, odds = weigh(TB.dense(at, "df", size)[m.code] + d[found], trained[found], TB.dense(at, "tr", size)[m.code], own)
        a = m.log_tf * idf
        return scored(m.total(a * odds), m.total(a * a), batch, TB.numbers(t, "copies"))

    ref_docs, cur_docs = reference.docs.where(~F.col("train")), cur_docs.where(~F.col("train"))
    local = lambda blocks: blocks.local(terms, "held").groupBy("block")
    kind, none = "batch int, score double, copies long", F.lit(0.0).alias("score")
    neg = ref_docs.where(known).select("block", "copies", "codes", "tf").groupBy("block").cogroup(local(reference)).applyInArrow(reference_scores, kind)
    neg = neg.unionByName(ref_docs.where(~known).select(F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))).alias("batch"), none, "copies"))
    pos = cur_docs.where(known).select("block", "batch", "copies", "codes", "tf").groupBy("block").cogroup(local(cur)).applyInArrow(current_scores, kind)
    pos = pos.unionByName(cur_docs.where(~known).select("batch", none, "copies"))
    both = pos.withColumn("p", F.lit(1)).unionByName(neg.withColumn("p", F.lit(0)))
    counts = write_table(both.groupBy("batch", F.round("score", 12).alias("score")).agg(
        F.sum(F.col("copies") * F.col("p")).alias("pos"), F.sum(F.col("copies") * (1 - F.col("p"))).alias("neg")), "batch_scores")
    auc = auc_from_counts(counts, ["batch"])
    thr = DT.random_auc_threshold(F.col("n_pos").cast("double"), F.col("n_neg").cast("double"))
    return auc.select("batch", F.col("auc").alias("roc_auc"), F.when(F.col("n_pos") * F.col("n_neg") > 0, thr).alias("threshold"),
                      F.coalesce(F.col("auc") > thr, F.lit(False)).alias("drift_detected"), F.col("n_neg").alias("n_ref_test"), F.col("n_pos").alias("n_cur_test"))


# ------------------------------------------------------------------ all methods

def drift_detect_batches(current: DataFrame, fit: DR.DriftFit, batch_col: str, embed=None) -> DataFrame:
    """J2 + J3 for every batch: ``batch_id`` and the columns of ``drift.aggregate_methods``."""
    c = fit.config
    require_columns(current, c.text_column, c.id_column, batch_col)
    cur = current.select(c.id_column, F.col(c.text_column).alias("text"), F.coalesce(F.col(batch_col).cast("string"), F.lit("unknown")).alias("batch_id"))
    ids = sorted(r.batch_id for r in cur.select("batch_id").distinct().collect())  # one string a batch
    spark = current.sparkSession
    names = spark.createDataFrame(list(enumerate(ids)), "batch int, batch_id string")
    cur = cur.join(F.broadcast(names), "batch_id").select(c.id_column, "text", "batch")
    rows = None
    for method in c.methods if ids else ():
        if method == "domain_classifier":
            got = domain_classifier_batches(fit.terms, cur, len(ids), c.id_column, c.seed)
            details = {"roc_auc": F.col("roc_auc"), "threshold": F.col("threshold")}
        elif method == "embedding":
            got = embedding_batches(fit.embedding, DR.written_vectors(cur, "batch", embed))
            details = {"drift_score": F.col("drift_score"), "threshold": F.col("threshold")}
        else:
            continue
        part = names.join(got, "batch", "left").select("batch_id", *DR.method_result(method, F.col("drift_detected"), details))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = spark.createDataFrame([], "batch_id string, method string, drift_detected boolean, details map<string,double>")
    return DR.aggregate_methods(rows, ["batch_id"])


# ------------------------------------------------------------------ log of results

def append_results(results: DataFrame, path: str) -> None:
    """Add results (``batch_id`` and any other columns) to a log partitioned by batch: only the
    batches at hand are replaced, so a rerun of a batch leaves one result and others stay."""
    require_columns(results, "batch_id")
    (results.withColumn("logged_at", F.current_timestamp()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def latest_results(spark: SparkSession, path: str) -> DataFrame:
    """The log, one row per batch (the last one written)."""
    log = spark.read.option("mergeSchema", "true").parquet(path)
    rest = [c for c in log.columns if c not in ("batch_id", "logged_at")]
    last = log.groupBy(F.col("batch_id").cast("string").alias("batch_id")).agg(F.max_by(F.struct(*rest), "logged_at").alias("_last"))
    return last.select("batch_id", *[F.col(f"_last.{c}").alias(c) for c in rest])
