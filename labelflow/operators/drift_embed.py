"""Embedding drift.

Vectors are ``array<float|double>`` columns, one per text, tagged ``side``.

* mean-vector distances (J12 euclidean, J13 cosine): one aggregation per (side, dimension)
  after ``posexplode`` (partial aggregation right after the generator, so only
  sides x dimensions partial sums leave each task);
* MMD (J14): squared maximum mean discrepancy with a Gaussian kernel. ``block_mmd``: the exact kernel
  sums inside hash blocks of a bounded number of rows, averaged over the blocks, with a standard
  error; linear in the rows. ``drift_mmd``: estimated with random
  Fourier features (Rahimi & Recht 2007): the mean feature vector per side is one more
  aggregation, O(n). The bandwidth is the square root of the mean squared distance between
  two random reference vectors, 2 * sum of per-dimension variances, itself an O(n) aggregate.
  No pair of rows is ever formed. Features are computed with one matrix product per Arrow
  batch inside ``mapInPandas``, which also emits per-partition partial sums;
* ratio (J15): share of dimensions whose Wasserstein distance (normalised by the reference
  standard deviation) reaches 0.1; drift when the share reaches 0.2;
* tests by name (M2): ``fit_embedding`` keeps statistics of the reference and the threshold, static
  (J17) or by bootstrap (J16); ``detect_embedding`` compares a batch with them. Random features
  come from md5, so they are the same in every engine;
* bootstrap (J16): the signs of all halvings of a row are one packed value; a task multiplies its
  sign matrix with its vectors, so only halvings x features sums leave it. The ratio test takes one
  sorted pass over the values with the running counts of all halvings as a vector.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hash_key
from .kernels import ecdf_distance, exact_percentile

STATIC_THRESHOLDS = {"mmd": 0.015, "euclidean": 0.2, "cosine": 0.2}  # fixed values
RATIO_COMPONENT_THRESHOLD = 0.1
RATIO_SHARE_THRESHOLD = 0.2
N_FEATURES = 256


def embedding_long(df: DataFrame, id_col: str = "vec_id", emb_col: str = "embedding",
                   keep: list[str] | None = None) -> DataFrame:
    """``(id, [keep...], dim, value double)`` — long form instead of one column per dim."""
    k = list(keep or [])
    return df.select(id_col, *k, F.posexplode(emb_col).alias("dim", "_v")) \
             .select(id_col, *k, "dim", F.col("_v").cast("double").alias("value"))


def side_means(corpus: DataFrame, emb_col: str = "embedding") -> DataFrame:
    """``(side, dim, mean, n)``."""
    lng = corpus.select("side", F.posexplode(emb_col).alias("dim", "_v"))
    return lng.groupBy("side", "dim").agg(F.avg(F.col("_v").cast("double")).alias("mean"),
                                          F.count(F.lit(1)).alias("n"))


def mean_distance(means: DataFrame, metric: str = "euclidean", group_cols: list[str] | None = None) -> DataFrame:
    """J12 / J13 from per-side mean vectors: one row (per group) ``distance``."""
    g = list(group_cols or [])
    r = means.filter(F.col("side") == "ref").select(*g, "dim", F.col("mean").alias("_r"))
    c = means.filter(F.col("side") == "cur").select(*g, "dim", F.col("mean").alias("_c"))
    j = r.join(c, [*g, "dim"])
    if metric == "euclidean":
        return j.groupBy(*g).agg(F.sqrt(F.sum((F.col("_r") - F.col("_c")) ** 2)).alias("distance"))
    if metric == "cosine":
        a = j.groupBy(*g).agg(F.sum(F.col("_r") * F.col("_c")).alias("_dot"),
                              F.sqrt(F.sum(F.col("_r") ** 2)).alias("_nr"),
                              F.sqrt(F.sum(F.col("_c") ** 2)).alias("_nc"))
        den = F.col("_nr") * F.col("_nc")
        return a.select(*g, F.when(den > 0, F.lit(1.0) - F.col("_dot") / den).alias("distance"))
    raise ValueError("metric must be 'euclidean' or 'cosine'")


def drift_distance(corpus: DataFrame, metric: str = "euclidean", emb_col: str = "embedding") -> DataFrame:
    return mean_distance(side_means(corpus, emb_col), metric)


# ------------------------------------------------------------------ MMD with random features

def rff_bandwidth(corpus: DataFrame, emb_col: str = "embedding") -> DataFrame:
    """One row ``sigma``: sqrt(2 * sum of per-dimension population variances)."""
    lng = corpus.select(F.posexplode(emb_col).alias("dim", "_v"))
    var = lng.groupBy("dim").agg(F.var_pop(F.col("_v").cast("double")).alias("_var"))
    return var.agg(F.sqrt(2 * F.sum("_var")).alias("sigma"))


def _unit(text: str, part: int) -> float:
    """A number in [0, 1) from eight hex digits of an md5 (the same in every engine)."""
    return int(hashlib.md5(text.encode()).hexdigest()[8 * part:8 * part + 8], 16) / 2.0 ** 32


def rff_params(dim: int, n_features: int, sigma: float, seed: int):
    """Frequencies (standard normal / sigma, by Box-Muller) and phases of the random features."""
    def normal(j: int, d: int) -> float:
        key = f"{seed}:rff:{j}:{d}"
        return math.sqrt(-2.0 * math.log(1.0 - _unit(key, 0))) * math.cos(2 * math.pi * _unit(key, 1))

    w = np.array([[normal(j, d) for d in range(dim)] for j in range(n_features)]) / max(sigma, 1e-12)
    return w, np.array([2 * math.pi * _unit(f"{seed}:rffb:{j}", 0) for j in range(n_features)])


KEYS_IN_TASK = 1024  # partial sums a task holds before it passes them on


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Vectors as rows of a matrix and, where one is shorter or holds a null, which entries count."""
    flat = col.flatten()
    if len(flat) == len(col) * dim and not flat.null_count and not col.null_count:
        sizes = np.diff(col.offsets.to_numpy())
        if (sizes == dim).all():
            return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim), None
    x = np.full((len(col), dim), np.nan)
    known = np.zeros((len(col), dim), bool)
    for i, v in enumerate(col.to_pylist()):
        for d, c in enumerate((v or [])[:dim]):
            if c is not None:
                x[i, d], known[i, d] = c, True
    return np.where(known, x, 0.0), known


def _feature_map(like):
    """Vectors of a batch as (values, which entries count): themselves, or their random features."""
    method, dim, sigma, seed, n_features = like
    if method != "mmd":
        return lambda col: _matrix(col, dim)
    w, b = rff_params(dim, n_features, sigma, seed)

    def features(col):
        x, known = _matrix(col, dim)
        if known is not None and not known.all():
            raise ValueError(f"MMD needs vectors of {dim} numbers")
        return math.sqrt(2.0 / n_features) * np.cos(x @ w.T + b), None
    return features


def keyed_sums(df: DataFrame, like, key_col: str, emb_col: str = "embedding") -> DataFrame:
    """(key_col, dim, s, n): sums of vectors, or of their random features, per key. One matrix per
    Arrow batch, rows of a key added up in the task; at most ``KEYS_IN_TASK`` keys wait there."""
    schema = T.StructType([df.schema[key_col], T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("n", T.ArrayType(T.LongType()))])

    def run(batches):
        features = _feature_map(like)
        held: dict = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), key_type), pa.array([s for s, _ in held.values()], pa.list_(pa.float64())),
                                              pa.array([n for _, n in held.values()], pa.list_(pa.int64()))], [key_col, "s", "n"])
            held.clear()
            return out
        for batch in batches:
            if not batch.num_rows:
                continue
            key_type = batch.column(0).type
            x, known = features(batch.column(1))
            enc = batch.column(0).dictionary_encode(null_encoding="encode")
            code = enc.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            sums = np.add.reduceat(x[order], first, axis=0)
            count = np.add.reduceat((np.ones(x.shape, np.int64) if known is None else known.astype(np.int64))[order], first, axis=0)
            names = enc.dictionary.to_pylist()
            for i, c in enumerate(code[order][first].tolist()):
                s, n = held.get(names[c], (0.0, 0))
                held[names[c]] = (s + sums[i], n + count[i])
            if len(held) > KEYS_IN_TASK:
                yield flush()
        if held:
            yield flush()

    part = df.select(key_col, emb_col).mapInArrow(run, schema)
    flat = part.select(key_col, F.posexplode(F.arrays_zip("s", "n")).alias("dim", "p"))
    return flat.groupBy(key_col, "dim").agg(F.sum("p.s").alias("s"), F.sum("p.n").alias("n"))


# ------------------------------------------------------------------ halvings

def with_signs(ref: DataFrame, id_col: str, emb_col: str, n_boot: int, seed: int, hexes: int) -> DataFrame:
    """(signs, emb_col): for every row one bit a halving, 1 in the first half. Rows with the same
    ``hexes`` first digits of their hash go together; there are as many such names as rows."""
    schema = T.StructType([T.StructField("signs", T.BinaryType()), ref.schema[emb_col]])

    def run(batches):
        for batch in batches:
            bits = np.array([[hashlib.md5(f"{seed}:half:{b}:{k}".encode()).digest()[0] < 128 for b in range(n_boot)]
                             for k in batch.column(0).to_pylist()], np.uint8).reshape(-1, n_boot)
            packed = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed], pa.binary()), batch.column(1)], ["signs", emb_col])

    name = F.substring(hash_key(seed, "bootstrap", id_col), 1, hexes).alias("name")
    return ref.select(name, emb_col).mapInArrow(run, schema)


def _signs(col: pa.Array, n_boot: int) -> np.ndarray:
    """Packed signs as a matrix of 0 and 1, rows x halvings."""
    raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)
    return np.unpackbits(raw, axis=1, count=n_boot)


def halving_sums(signed: DataFrame, like, n_boot: int, emb_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts (n_boot + 1) x features: of the first half of every halving, then of all rows.
    The sign matrix times the vectors of each Arrow batch; only the product leaves the task."""
    def run(batches):
        features = _feature_map(like)
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, known = features(batch.column(1))
            signs = np.vstack([_signs(batch.column(0), n_boot).T, np.ones((1, len(x)), np.uint8)]).astype(float)
            count = signs @ known if known is not None else np.repeat(signs.sum(axis=1, keepdims=True), x.shape[1], axis=1)
            part = np.hstack([signs @ x, count])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(n_boot + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["b", "v"])

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    part = signed.select("signs", emb_col).mapInArrow(run, "b int, v array<double>")
    rows = part.groupBy("b").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("v")))).alias("v")).collect()  # n_boot + 1 rows
    both = np.array([r.v for r in sorted(rows, key=lambda r: r.b)])
    width = both.shape[1] // 2
    return both[:, :width], both[:, width:]


def halving_distances(sums: np.ndarray, counts: np.ndarray, method: str) -> np.ndarray:
    """The statistic between the two halves of every halving in which both have rows."""
    s1, n1 = sums[:-1], counts[:-1]
    s2, n2 = sums[-1] - s1, counts[-1] - n1
    both = ((n1 > 0) & (n2 > 0)).all(axis=1)
    m1, m2 = s1[both] / n1[both], s2[both] / n2[both]
    if method == "cosine":
        size = np.linalg.norm(m1, axis=1) * np.linalg.norm(m2, axis=1)
        keep = size > 0
        return 1.0 - (m1 * m2).sum(axis=1)[keep] / size[keep]
    square = ((m1 - m2) ** 2).sum(axis=1)
    return square if method == "mmd" else np.sqrt(square)


RANGE_ROWS = 200_000  # values that one task sorts
HOT_ROWS = 50_000     # a value held by more rows than that is added up before it is sorted


def ranged(rows: DataFrame, value_col: str = "value") -> DataFrame:
    """``rng``: the range of each row's value, so that a (dim, rng) has about RANGE_ROWS rows."""
    per = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = math.ceil(per / RANGE_ROWS)
    if parts <= 1:
        return rows.withColumn("rng", F.lit(0))
    at = [i / parts for i in range(1, parts)]
    cuts = rows.groupBy("dim").agg(F.percentile_approx(value_col, at, 10 * parts).alias("cuts"))
    return rows.join(F.broadcast(cuts), "dim").withColumn("rng", F.size(F.filter("cuts", lambda c: c < F.col(value_col)))).drop("cuts")  # a row a dimension


def halving_shares(signed: DataFrame, n_boot: int, emb_col: str, component_threshold: float) -> np.ndarray:
    """J15 bootstrapped: for every halving the share of dimensions whose ECDF distance between the
    halves, over the first half's deviation, reaches the threshold.

    Values move once, each with the packed signs of its row, whatever the number of halvings. A task
    sorts one range of one dimension and takes running counts of all halvings at once; what lies in
    front of the range comes from the ranges' totals. A value that many rows share is summed to one
    row of counts in the tasks that read it."""
    from ..session import write_table
    long = signed.select("signs", F.posexplode(emb_col).alias("dim", "_v")).select("dim", F.col("_v").cast("double").alias("value"), "signs")
    long = write_table(long.where(F.col("value").isNotNull() & ~F.isnan("value")), "halving_values")
    hot = write_table(long.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") > HOT_ROWS).select("dim", "value"), "halving_hot")
    rows = long.withColumn("w", F.lit(1).cast("long")).withColumn("first", F.lit(None).cast("array<long>"))
    if not hot.isEmpty():
        salt = F.pmod(F.xxhash64("signs"), F.lit(16)).cast("int")
        many = hot.withColumn("hot", F.lit(True)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        marked = long.withColumn("salt", salt).join(many, ["dim", "value", "salt"], "left")
        counts = (marked.where("hot").select("dim", "value", "signs").mapInArrow(_count_signs(n_boot), "dim int, value double, b int, n long")
                  .groupBy("dim", "value", "b").agg(F.sum("n").alias("n")))
        one = counts.groupBy("dim", "value").agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("p"))  # n_boot + 1 entries
        one = one.select("dim", "value", F.lit(None).cast("binary").alias("signs"), F.element_at("p", -1)["n"].alias("w"),
                         F.slice(F.transform("p", lambda x: x["n"]), 1, n_boot).alias("first"))
        cold = marked.where("hot IS NULL").select("dim", "value", "signs", F.lit(1).cast("long").alias("w"), F.lit(None).cast("array<long>").alias("first"))
        rows = cold.unionByName(one)
    rows = write_table(ranged(rows), "halving_ranges")
    totals = write_table(rows.groupBy("dim", "rng").applyInArrow(_range_totals(n_boot), "dim int, rng int, low double, v array<double>"), "halving_totals")
    got = (rows.groupBy("dim", "rng").cogroup(_in_front(totals, n_boot).groupBy("dim", "rng"))
           .applyInArrow(_range_distance(n_boot), "dim int, v array<double>"))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    area = got.groupBy("dim").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("v")))).alias("area"))
    each = totals.groupBy("dim").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("v")))).alias("sums")).join(area, "dim")
    hits, seen = np.zeros(n_boot), np.zeros(n_boot)
    for r in each.collect():  # a row a dimension
        n1, s1, q1, n = np.split(np.array(r.sums)[:3 * n_boot], 3) + [r.sums[3 * n_boot]]
        both = (n1 > 0) & (n1 < n)
        mean = s1 / np.maximum(n1, 1)
        std = np.sqrt(np.maximum(q1 / np.maximum(n1, 1) - mean ** 2, 0.0))
        std[std <= 1e-9 * np.abs(mean)] = 0.0
        dist = np.where(std > 0, np.array(r.area) / np.where(std > 0, std, 1.0), r.area)
        hits += both & (dist >= component_threshold)
        seen += both
    return hits[seen > 0] / seen[seen > 0]


def _count_signs(n_boot: int):
    def run(batches):
        held: dict = {}
        for batch in batches:
            signs = _signs(batch.column(2), n_boot) if batch.num_rows else None
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for k in set(keys):
                at = [i for i, x in enumerate(keys) if x == k]
                held[k] = held.get(k, 0) + np.append(signs[at].sum(axis=0, dtype=np.int64), len(at))
        for (d, v), n in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(n), pa.int32()), pa.array([v] * len(n), pa.float64()),
                                              pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64())], ["dim", "value", "b", "n"])
    return run


def _sorted_counts(t: pa.Table, n_boot: int):
    """Distinct values of a range in order, rows of each in total and in every first half."""
    value, w = t.column("value").to_numpy(), t.column("w").to_numpy()
    first = np.zeros((len(value), n_boot), np.int64)
    signs = t.column("signs").to_pylist()
    plain = np.array([s is not None for s in signs], bool)
    if plain.any():
        raw = np.frombuffer(b"".join([s for s in signs if s is not None]), np.uint8).reshape(int(plain.sum()), -1)
        first[plain] = np.unpackbits(raw, axis=1, count=n_boot)
    for i in np.flatnonzero(~plain).tolist():
        first[i] = t.column("first")[i].as_py()
    order = np.argsort(value, kind="stable")
    new = np.flatnonzero(np.append(True, np.diff(value[order]) != 0)) if len(value) else np.zeros(0, np.int64)
    return value[order][new], np.add.reduceat(w[order], new), np.add.reduceat(first[order], new, axis=0)


def _range_totals(n_boot: int):
    def run(t: pa.Table) -> pa.Table:
        value, w, first = _sorted_counts(t, n_boot)
        v = np.concatenate([first.sum(axis=0), value @ first, (value * value) @ first, [w.sum()]]).astype(float)
        return pa.table({"dim": t.column("dim").slice(0, 1), "rng": t.column("rng").slice(0, 1), "low": pa.array([value[0]]), "v": pa.array([v.tolist()])})
    return run


def _in_front(totals: DataFrame, n_boot: int) -> DataFrame:
    """For every range: rows and first halves in front of it, those of the whole dimension, the
    next range's least value. One row a (dimension, range)."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rng")
        v = np.array(t.column("v").to_pylist())
        n = np.hstack([v[:, :n_boot], v[:, -1:]])
        front = np.cumsum(n, axis=0) - n
        low = t.column("low").to_pylist()
        return pa.table({"dim": t.column("dim"), "rng": t.column("rng"), "front": pa.array(front.tolist(), pa.list_(pa.float64())),
                         "all": pa.array([n.sum(axis=0).tolist()] * len(low), pa.list_(pa.float64())), "next": pa.array([*low[1:], None], pa.float64())})
    return totals.groupBy("dim").applyInArrow(run, "dim int, rng int, front array<double>, all array<double>, next double")


def _range_distance(n_boot: int):
    def run(t: pa.Table, at: pa.Table) -> pa.Table:
        value, w, first = _sorted_counts(t, n_boot)
        front, whole = np.array(at.column("front")[0].as_py()), np.array(at.column("all")[0].as_py())
        after = at.column("next")[0].as_py()
        gap = np.diff(value, append=value[-1] if after is None else after)
        area = np.zeros(n_boot)
        n1, n2 = np.maximum(whole[:-1], 1), np.maximum(whole[-1] - whole[:-1], 1)
        for lo in range(0, len(value), 8192):
            part = slice(lo, lo + 8192)
            c1 = front[:-1] + np.cumsum(first[part], axis=0)
            c = front[-1] + np.cumsum(w[part])
            area += gap[part] @ np.abs(c1 / n1 - (c[:, None] - c1) / n2)
            front = np.append(c1[-1], c[-1])
        return pa.table({"dim": t.column("dim").slice(0, 1), "v": pa.array([area.tolist()], pa.list_(pa.float64()))})
    return run


def drift_mmd(corpus: DataFrame, emb_col: str = "embedding", n_features: int = N_FEATURES, seed: int = 42,
              dim: int | None = None, sigma: float | None = None) -> DataFrame:
    """One row ``mmd2`` (RFF estimate of the squared MMD, Gaussian kernel) and ``sigma`` (from the
    reference unless given). Needs no id column."""
    ref, cur = (corpus.filter(F.col("side") == x) for x in ("ref", "cur"))
    fit = fit_embedding(ref, "mmd", False, emb_col=emb_col, seed=seed, n_features=n_features, sigma=sigma)
    return detect_embedding(fit, cur, emb_col).select(F.col("drift_score").alias("mmd2"), F.lit(fit.sigma).alias("sigma"))


BLOCK_ROWS = 256


def block_mmd(corpus: DataFrame, id_col: str = "vec_id", emb_col: str = "embedding", sigma: float | None = None,
              n_blocks: int | None = None, seed: int = 42) -> DataFrame:
    """One row ``mmd2, standard_error, n_blocks, sigma``: the squared MMD with exact Gaussian
    kernel sums inside hash blocks of both sides, averaged over the blocks (weight: the number of
    pairs of the two sides), and the standard error of that average.

    With one block this is the exact (biased) statistic. By default a block has about BLOCK_ROWS
    rows, so kernel sums and memory grow with the rows, not with their pairs; a block's rows are
    bounded by the even spread of md5. Rows of equal id are one block's rows: ids should be unique.
    Blocks with one side only are left out; without any common block the result is null."""
    from ..session import prepare_udfs
    prepare_udfs(corpus.sparkSession)
    rows = corpus.filter(F.col(emb_col).isNotNull())
    if sigma is None:
        sigma = round(float(rff_bandwidth(rows.filter(F.col("side") == "ref"), emb_col).first()["sigma"] or 1.0), 9)
    if n_blocks is None:
        n_blocks = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    scale = 2.0 * max(sigma, 1e-12) ** 2
    named = rows.select((F.conv(F.substring(hash_key(seed, "mmd", id_col), 1, 12), 16, 10).cast("long") % n_blocks).alias("block"), "side", emb_col)

    def mean_kernel(a: np.ndarray, c: np.ndarray) -> float:
        total = 0.0
        for lo in range(0, len(a), 512):  # never more than 512 rows of the kernel matrix at once
            x = a[lo:lo + 512]
            d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2.0 * (x @ c.T)
            total += np.exp(-np.maximum(d, 0.0) / scale).sum()
        return total / (len(a) * len(c))

    def run(t: pa.Table) -> pa.Table:
        side = np.array(t.column("side").to_pylist())
        x = np.array(t.column(emb_col).to_pylist(), float)
        r, c = x[side == "ref"], x[side == "cur"]
        if not len(r) or not len(c):
            return pa.table({"w": pa.array([], pa.float64()), "v": pa.array([], pa.float64())})
        return pa.table({"w": pa.array([float(len(r) * len(c))]), "v": pa.array([mean_kernel(r, r) + mean_kernel(c, c) - 2 * mean_kernel(r, c)])})

    per = named.groupBy("block").applyInArrow(run, "w double, v double")
    w, v = F.col("w"), F.col("v")
    got = per.agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(w).alias("_w"), F.sum(w * v).alias("_s"), F.sum(w * w).alias("_w2"),
                  F.sum(w * w * v).alias("_w2v"), F.sum(w * w * v * v).alias("_w2v2"))
    mean = F.col("_s") / F.col("_w")
    spread = F.greatest(F.col("_w2v2") - 2 * mean * F.col("_w2v") + mean * mean * F.col("_w2"), F.lit(0.0))
    return got.select(mean.alias("mmd2"), F.when(F.col("n_blocks") > 1, F.sqrt(spread) / F.col("_w")).alias("standard_error"), "n_blocks", F.lit(sigma).alias("sigma"))


def exact_mmd2_numpy(x: np.ndarray, y: np.ndarray, sigma: float) -> float:
    """Brute-force biased MMD^2 with the same kernel, for tests on small fixtures only."""
    def k(a, c):
        d = ((a[:, None, :] - c[None, :, :]) ** 2).sum(-1)
        return np.exp(-d / (2 * sigma ** 2))
    return float(k(x, x).mean() + k(y, y).mean() - 2 * k(x, y).mean())


# ------------------------------------------------------------------ ratio

def drift_ratio(corpus: DataFrame, id_col: str = "vec_id", emb_col: str = "embedding",
                component_threshold: float = RATIO_COMPONENT_THRESHOLD,
                share_threshold: float = RATIO_SHARE_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Per-dimension normalised Wasserstein distance; one row with the drifted share."""
    lng = embedding_long(corpus, id_col, emb_col, ["side"])
    wd = ecdf_distance(lng, ["dim"], "value")
    sd = lng.filter(F.col("side") == "ref").groupBy("dim").agg(F.stddev_pop("value").alias("ref_std"))
    per = wd.join(sd, "dim").withColumn(
        "distance", F.when(F.col("ref_std") > 0, F.col("wasserstein") / F.col("ref_std")).otherwise(F.col("wasserstein")))
    per = per.withColumn("drifted", F.col("distance") >= F.lit(component_threshold))
    share = per.agg(F.avg(F.col("drifted").cast("double")).alias("drift_share"),
                    F.count(F.lit(1)).alias("dims"))
    share = share.withColumn("drift_detected", F.col("drift_share") >= F.lit(share_threshold))
    return per.select("dim", "wasserstein", "ref_std", "distance", "drifted"), share


# ------------------------------------------------------------------ fitted tests by name

METHOD_LABELS = {"mmd": "MMD (Maximum Mean Discrepancy)", "euclidean": "Distance-based (euclidean)",
                 "cosine": "Distance-based (cosine)", "ratio": "Ratio-based"}


def resolve_method(name: str) -> tuple[str, str]:
    """(method, label) by case-insensitive name; an unknown name means MMD."""
    key = name.lower()
    return (key, METHOD_LABELS[key]) if key in METHOD_LABELS else ("mmd", METHOD_LABELS["mmd"] + " [default]")


def static_threshold(method: str) -> float:
    """The fixed thresholds of the non-bootstrap mode."""
    method = resolve_method(method)[0]
    return RATIO_SHARE_THRESHOLD if method == "ratio" else STATIC_THRESHOLDS[method]


@dataclass
class EmbeddingFit:
    """What a fitted test keeps of the reference: written statistics, never its rows."""
    method: str
    label: str
    threshold: float
    n: int
    dim: int
    sigma: float | None
    seed: int
    n_features: int
    stats: DataFrame  # mmd and distances: (dim, mean); ratio: (dim, value, w)
    totals: DataFrame | None = None  # mmd and distances: (dim, s, n), what ``stats`` is made of
    use_bootstrap: bool = False
    quantile_probability: float = 0.05
    name_digits: int | None = None
    halvings: tuple | None = None  # sums and counts of the halvings, n_boot + 1 x features

    @property
    def like(self) -> tuple:
        return self.method, self.dim, self.sigma, self.seed, self.n_features


def _name_digits(n: int) -> int:
    """Hex digits that give the rows of a reference at least as many names as there are rows."""
    return max(1, math.ceil(math.log(max(n, 2), 16)))


def _mean_statistic(means: DataFrame, method: str, group_cols: list[str] | None = None) -> DataFrame:
    if method == "mmd":  # the squared distance of the mean feature vectors
        d = mean_distance(means, "euclidean", group_cols)
        return d.withColumn("distance", F.col("distance") * F.col("distance"))
    return mean_distance(means, method, group_cols)


def _ratio_share(lng: DataFrame, ref_std: DataFrame, group_cols: list[str], component_threshold: float) -> DataFrame:
    wd = ecdf_distance(lng, [*group_cols, "dim"], "value", weight_col="w")
    per = wd.join(ref_std, [*group_cols, "dim"]).withColumn(
        "_d", F.when(F.col("ref_std") > 0, F.col("wasserstein") / F.col("ref_std")).otherwise(F.col("wasserstein")))
    return per.groupBy(*group_cols).agg(F.avg((F.col("_d") >= F.lit(component_threshold)).cast("double")).alias("distance"))


def fit_embedding(reference: DataFrame, method: str = "mmd", use_bootstrap: bool = True, quantile_probability: float = 0.05,
                  id_col: str = "vec_id", emb_col: str = "embedding", n_boot: int = 100, seed: int = 42,
                  n_features: int = N_FEATURES, sigma: float | None = None, name_digits: int | None = None) -> EmbeddingFit:
    """J1 + J16 + J17: statistics of the reference and the threshold.

    Bootstrap: the statistic between two random halves of the reference's rows, ``n_boot`` times;
    the threshold is its (1 - q) quantile. ``id_col`` is read for the bootstrap only. Fits that are to be
    merged need one ``sigma`` (mmd) and, with a bootstrap, one ``name_digits`` (16 ** digits names of
    rows; by default as many as the reference has rows, which differs between parts)."""
    from ..session import prepare_udfs, write_table
    prepare_udfs(reference.sparkSession)
    method, label = resolve_method(method)
    ref = reference.filter(F.col(emb_col).isNotNull())
    size = ref.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(emb_col)).alias("dim")).first()
    if not size["n"]:
        raise ValueError("the reference has no vectors")
    n, dim = size["n"], size["dim"]
    if method == "mmd" and sigma is None:
        sigma = round(float(rff_bandwidth(ref, emb_col).first()["sigma"] or 1.0), 9)
    like = (method, dim, sigma, seed, n_features)
    spark, found = reference.sparkSession, None
    digits, totals, halvings = name_digits or _name_digits(n), None, None
    signed = with_signs(ref, id_col, emb_col, n_boot, seed, digits) if use_bootstrap else None
    if method == "ratio":
        values = ref.select(F.posexplode(emb_col).alias("dim", "_v")).groupBy("dim", F.col("_v").cast("double").alias("value"))
        stats = write_table(values.agg(F.count(F.lit(1)).alias("w")), "drift_reference")
        if use_bootstrap:
            found = halving_shares(write_table(signed, "drift_signs"), n_boot, emb_col, RATIO_COMPONENT_THRESHOLD)
    elif use_bootstrap:
        sums, counts = halving_sums(signed, like, n_boot, emb_col)
        found = halving_distances(sums, counts, method)
        halvings = sums, counts
        sure = np.flatnonzero(counts[-1])
        sure = pa.table({"dim": pa.array(sure, pa.int32()), "s": pa.array(sums[-1][sure]), "n": pa.array(counts[-1][sure].astype(np.int64))})
        totals = write_table(spark.createDataFrame(sure), "drift_reference")
    else:
        sums = keyed_sums(ref.withColumn("_all", F.lit(0)), like, "_all", emb_col)
        totals = write_table(sums.select("dim", "s", F.col("n").cast("long").alias("n")), "drift_reference")
    if totals is not None:
        stats = totals.select("dim", (F.col("s") / F.col("n")).alias("mean"))
    threshold = static_threshold(method) if found is None else _halving_threshold(found, quantile_probability)
    return EmbeddingFit(method, label, threshold, n, dim, sigma, seed, n_features, stats, totals, use_bootstrap,
                        quantile_probability, digits if use_bootstrap else None, halvings)


def _halving_threshold(found: np.ndarray, quantile_probability: float) -> float:
    return float(np.quantile(found, 1 - quantile_probability)) if len(found) else float("inf")  # one block: nothing to compare


def merge_embedding(a: EmbeddingFit, b: EmbeddingFit) -> EmbeddingFit:
    """The fit of two disjoint references from their fits, no row read again; equal to the fit of
    their union. Sums, counts and value counts add up, the sums of the halvings too, so the bootstrap's
    threshold is that of the union. Fits of other settings (test, seed, dimension, bandwidth, names of
    rows) are refused, and so is the ratio test's bootstrap, which needs the values of each row."""
    from ..session import write_table
    for name in ("method", "dim", "sigma", "seed", "n_features", "use_bootstrap", "quantile_probability", "name_digits"):
        if getattr(a, name) != getattr(b, name):
            raise ValueError(f"fits differ in {name}: {getattr(a, name)!r} and {getattr(b, name)!r}")
    if a.method == "ratio" and a.use_bootstrap:
        raise ValueError("the ratio test's bootstrap needs the rows: fit the union, or use the fixed threshold")
    threshold, totals, halvings = a.threshold, None, None
    if a.method == "ratio":
        stats = write_table(a.stats.unionByName(b.stats).groupBy("dim", "value").agg(F.sum("w").alias("w")), "drift_reference")
    else:
        both = a.totals.unionByName(b.totals).groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        totals = write_table(both, "drift_reference")
        stats = totals.select("dim", (F.col("s") / F.col("n")).alias("mean"))
    if a.halvings is not None:
        if a.halvings[0].shape != b.halvings[0].shape:
            raise ValueError("fits differ in the number of halvings")
        halvings = a.halvings[0] + b.halvings[0], a.halvings[1] + b.halvings[1]
        threshold = _halving_threshold(halving_distances(*halvings, a.method), a.quantile_probability)
    return replace(a, threshold=threshold, n=a.n + b.n, stats=stats, totals=totals, halvings=halvings)


def _weighted_std(df: DataFrame, keys: list[str]) -> DataFrame:
    v, w = F.col("value"), F.col("w")
    m = df.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(v * w).alias("_s"))
    c = df.join(m, keys).groupBy(*keys).agg(F.sum(w * (v - F.col("_s") / F.col("_w")) ** 2).alias("_q"), F.first("_w").alias("_w"))
    return c.select(*keys, F.sqrt(F.col("_q") / F.col("_w")).alias("ref_std"))


def detect_embedding(fit: EmbeddingFit, current: DataFrame, emb_col: str = "embedding") -> DataFrame:
    """One row ``drift_score, threshold, drift_detected``: the current batch against the fitted
    statistics; the reference is not read again. An empty batch has no score and no drift."""
    cur = current.filter(F.col(emb_col).isNotNull())
    if fit.method == "ratio":
        lng = cur.select(F.posexplode(emb_col).alias("dim", "_v")).groupBy("dim", F.col("_v").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("w"))
        both = fit.stats.withColumn("side", F.lit("ref")).unionByName(lng.withColumn("side", F.lit("cur")))
        score = _ratio_share(both, _weighted_std(fit.stats, ["dim"]), [], RATIO_COMPONENT_THRESHOLD)
        hit = F.col("distance") >= F.lit(fit.threshold)
    else:
        sums = keyed_sums(cur.withColumn("_all", F.lit(0)), fit.like, "_all", emb_col)
        means = fit.stats.select(F.lit("ref").alias("side"), "dim", "mean").unionByName(
            sums.select(F.lit("cur").alias("side"), "dim", (F.col("s") / F.col("n")).alias("mean")))
        score = _mean_statistic(means, fit.method)
        hit = F.col("distance") > F.lit(fit.threshold)
    return score.select(F.col("distance").alias("drift_score"), F.lit(fit.threshold).alias("threshold"), F.coalesce(hit, F.lit(False)).alias("drift_detected"))


def bootstrap_threshold(corpus: DataFrame, metric: str = "euclidean", id_col: str = "vec_id",
                        emb_col: str = "embedding", n_boot: int = 100, quantile_probability: float = 0.05,
                        seed: int = 42) -> float:
    """The bootstrap threshold of one test."""
    ref = corpus.filter(F.col("side") == "ref")
    return fit_embedding(ref, metric, True, quantile_probability, id_col, emb_col, n_boot, seed).threshold


def embed_letter_profile(df: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """J10 (re-aimed): a text -> vector encoder that needs no pretrained model: the letter
    frequency profile of the whole text (counts of each ALPHABET letter / letters)."""
    from .scoring import letter_counts_udf
    from ..session import prepare_udfs
    prepare_udfs(df.sparkSession)
    cnt = letter_counts_udf(F.col(text_col))
    d = df.withColumn("_cnt", cnt)
    tot = F.greatest(F.aggregate("_cnt", F.lit(0).cast("long"), lambda a, b: a + b), F.lit(1)).cast("double")
    return d.withColumn(out, F.transform("_cnt", lambda c: c / tot)).drop("_cnt")
