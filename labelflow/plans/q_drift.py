"""Registered drift queries.

Bindings: text corpora are ``documents`` with reference = English, current = every other language
(drift intended) or the two hash halves of all documents (no drift intended); vectors are
``embeddings`` split in hash halves (no drift) or with a constant shift on the current half.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hash_half
from ..functions.text import ALPHABET, STOP_WORDS
from ..operators import drift as DR
from ..operators import drift_batches as DB
from ..operators import drift_embed as DE
from ..operators import drift_linear as DL
from ..operators import drift_text as DT
from ..session import shared_path
from ..sources.tables import read_table
from .registry import register, rounded

SEED = 42
V = len(ALPHABET)
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
WORD_RE = "[\\pL\\pN_]{2,}"


def text_corpus(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    return DT.with_side(d, F.col("lang") == "en").drop("lang")


def text_corpus_nodrift(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return DT.with_side(d, hash_half(SEED, "side", "doc_id"))


def vector_corpus(spark, sf, shift: float = 0.0):
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    h = hash_half(SEED, "emb", "vec_id")
    cur = e.filter(~h)
    if shift:
        cur = cur.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") + F.lit(shift)))
    ref = e.filter(h).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    return DT.tag_sides(ref, cur.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))))


CORPUS_SQL = ("corpus AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'ref' ELSE 'cur' END AS side, text "
              "FROM documents)")
TFIDF_SQL = f"""{CORPUS_SQL},
toks AS (SELECT doc_id, side, unnest(regexp_extract_all(lower(coalesce(text, 'None')), '{WORD_RE}')) AS term FROM corpus),
tf AS (SELECT doc_id, side, term, count(*) AS tf FROM toks WHERE term NOT IN {STOP_SQL} GROUP BY ALL),
ndocs AS (SELECT count(*) AS n FROM corpus),
dft AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM dft, ndocs WHERE df <= CAST(0.5 AS DOUBLE) * n),
w0 AS (SELECT doc_id, side, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
w AS (SELECT doc_id, side, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w0)"""


def _logodds_sql(src: str) -> str:
    return f"""SELECT term, ln((count(*) FILTER (WHERE side = 'cur') + 1) / ((SELECT count(DISTINCT doc_id) FILTER (WHERE side = 'cur') FROM {src}) + 2))
 - ln((count(*) FILTER (WHERE side = 'ref') + 1) / ((SELECT count(DISTINCT doc_id) FILTER (WHERE side = 'ref') FROM {src}) + 2)) AS log_odds
 FROM {src} GROUP BY term"""


DOMAIN_SQL = f"""WITH {TFIDF_SQL},
wtr AS (SELECT * FROM w WHERE substr(md5('{SEED}:domain:' || doc_id), 1, 1) < '8'),
lo AS ({_logodds_sql('wtr')}),
test AS (SELECT doc_id, side FROM corpus WHERE NOT substr(md5('{SEED}:domain:' || doc_id), 1, 1) < '8'),
sc AS (SELECT t.doc_id, t.side, round(coalesce((SELECT sum(w.weight * lo.log_odds) FROM w JOIN lo USING (term)
        WHERE w.doc_id = t.doc_id), 0.0), 12) AS score FROM test t),
r AS (SELECT side = 'cur' AS is_pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM sc),
a AS (SELECT count(*) FILTER (WHERE is_pos) AS m, count(*) FILTER (WHERE NOT is_pos) AS n,
        (sum(r) FILTER (WHERE is_pos) - count(*) FILTER (WHERE is_pos) * (count(*) FILTER (WHERE is_pos) + 1) / 2.0)
        / (count(*) FILTER (WHERE is_pos) * count(*) FILTER (WHERE NOT is_pos)) AS auc FROM r),
dc AS (SELECT auc, 0.5 + {DT.Z_95} * sqrt((m + n + 1) / (12.0 * m * n)) AS threshold, n AS n_ref_test, m AS n_cur_test FROM a)
"""


@register("tfidf_features", f"WITH {TFIDF_SQL} SELECT doc_id, side, term, round(weight, 6) AS weight FROM w")
def q_tfidf_features(spark, sf):
    return rounded(DT.tfidf_features(text_corpus(spark, sf)))


@register("domain_classifier_auc", DOMAIN_SQL + "SELECT round(auc, 6) AS roc_auc, round(threshold, 6) AS threshold, "
          "coalesce(auc > threshold, false) AS drift_detected, n_ref_test, n_cur_test FROM dc", bench=True)
def q_domain_classifier_auc(spark, sf):
    return rounded(DT.domain_classifier(text_corpus(spark, sf), seed=SEED))


@register("random_auc_threshold", f"""WITH {CORPUS_SQL}, t AS (SELECT count(*) FILTER (WHERE side = 'cur') AS m,
count(*) FILTER (WHERE side = 'ref') AS n FROM corpus WHERE NOT substr(md5('{SEED}:domain:' || doc_id), 1, 1) < '8')
SELECT m AS n_pos, n AS n_neg, round(0.5 + {DT.Z_95} * sqrt((m + n + 1) / (12.0 * m * n)), 6) AS threshold FROM t""")
def q_random_auc_threshold(spark, sf):
    c = text_corpus(spark, sf).filter(~hash_half(SEED, "domain", "doc_id"))
    t = c.agg(F.count_if(F.col("side") == "cur").alias("n_pos"), F.count_if(F.col("side") == "ref").alias("n_neg"))
    return rounded(t.withColumn("threshold", DT.random_auc_threshold(F.col("n_pos").cast("double"),
                                                                     F.col("n_neg").cast("double"))))


@register("random_auc_simulated", f"""WITH {CORPUS_SQL}, t AS (SELECT doc_id, side = 'cur' AS pos FROM corpus WHERE NOT substr(md5('{SEED}:domain:' || doc_id), 1, 1) < '8'),
h AS (SELECT pos, r, md5('{SEED}:random:' || r || ':' || doc_id) AS m FROM t, range(0, 63) a(r)),
s AS (SELECT pos, 16 * r + k AS sim, substr(m, CAST(2 * k + 1 AS INTEGER), 2) AS score FROM h, range(0, 16) b(k) WHERE 16 * r + k < 1000),
c AS (SELECT sim, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM s GROUP BY ALL),
u AS (SELECT sim, p, n, p * (coalesce(sum(n) OVER (PARTITION BY sim ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0) AS u FROM c),
a AS (SELECT sim, sum(u) / (sum(p) * sum(n)) AS auc FROM u GROUP BY sim),
z AS (SELECT count(*) FILTER (pos) AS m, count(*) FILTER (NOT pos) AS n FROM t)
SELECT max(m) AS n_pos, max(n) AS n_neg, round(max(0.5 + {DT.Z_95} * sqrt((m + n + 1) / (12.0 * m * n))), 6) AS closed_form,
  round(quantile_cont(auc, CAST(0.95 AS DOUBLE)), 6) AS simulated FROM a, z""")
def q_random_auc_simulated(spark, sf):
    """The threshold from 1,000 random classifiers next to the closed form."""
    return rounded(DT.simulated_auc_threshold(text_corpus(spark, sf).filter(~hash_half(SEED, "domain", "doc_id")), seed=SEED))


NODRIFT_CORPUS_SQL = ("corpus AS (SELECT doc_id, CASE WHEN substr(md5('" + str(SEED) + ":side:' || doc_id), 1, 1) < '8' "
                      "THEN 'ref' ELSE 'cur' END AS side, text FROM documents)")


@register("domain_classifier_no_drift", DOMAIN_SQL.replace(CORPUS_SQL, NODRIFT_CORPUS_SQL)
          + "SELECT round(auc, 6) AS roc_auc, round(threshold, 6) AS threshold, "
          "coalesce(auc > threshold, false) AS drift_detected, n_ref_test, n_cur_test FROM dc")
def q_domain_classifier_no_drift(spark, sf):
    """Directional check: two hash halves of the documents."""
    return rounded(DT.domain_classifier(text_corpus_nodrift(spark, sf), seed=SEED))


@register("characteristic_words", f"""WITH {TFIDF_SQL}, lo AS ({_logodds_sql('w')}),
b AS (SELECT 'cur' AS side, term, log_odds AS typicality FROM lo UNION ALL SELECT 'ref', term, -log_odds FROM lo)
SELECT side, term, round(typicality, 6) AS typicality, rank FROM (SELECT *, row_number() OVER (PARTITION BY side
ORDER BY typicality DESC, term) AS rank FROM b) x WHERE rank <= 10""")
def q_characteristic_words(spark, sf):
    return rounded(DT.characteristic_words(text_corpus(spark, sf), 10))


FEAT_SQL = f"""{CORPUS_SQL},
feat AS (SELECT doc_id, side, CAST(length(coalesce(text, '')) AS DOUBLE) AS text_length,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[\\pL\\pN_]+')) AS DOUBLE) AS word_count,
  CAST(CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 0 ELSE greatest(len(regexp_extract_all(coalesce(text, ''), '[.!?]+')), 1) END AS DOUBLE) AS sentence_count,
  CASE WHEN length(coalesce(text, '')) = 0 THEN 0.0 ELSE (length(text) - length(regexp_replace(text, '[^\\pL]', '', 'g'))) / length(text) END AS non_letter_share
  FROM corpus),
fl AS (UNPIVOT feat ON text_length, word_count, sentence_count, non_letter_share INTO NAME feature VALUE value)"""


@register("text_features", f"WITH {FEAT_SQL} SELECT doc_id, side, text_length, word_count, sentence_count, "
          "round(non_letter_share, 6) AS non_letter_share FROM feat")
def q_text_features(spark, sf):
    f = DT.text_features(text_corpus(spark, sf))
    return rounded(f.select("doc_id", "side", *DT.FEATURES))


@register("text_overview", f"WITH {FEAT_SQL} SELECT side, feature, count(*) AS count, round(avg(value), 6) AS mean, "
          "round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median FROM fl GROUP BY 1, 2")
def q_text_overview(spark, sf):
    return rounded(DT.text_overview(text_corpus(spark, sf)))


WASS_SQL = """c AS (SELECT {g}, value, count(*) FILTER (WHERE side = 'ref') AS nr, count(*) FILTER (WHERE side = 'cur') AS nc
  FROM {src} GROUP BY {g}, value),
cum AS (SELECT {g}, value,
  sum(nr) OVER (PARTITION BY {g} ORDER BY value ROWS UNBOUNDED PRECEDING) / sum(nr) OVER (PARTITION BY {g}) AS fr,
  sum(nc) OVER (PARTITION BY {g} ORDER BY value ROWS UNBOUNDED PRECEDING) / sum(nc) OVER (PARTITION BY {g}) AS fc,
  lead(value) OVER (PARTITION BY {g} ORDER BY value) - value AS gap FROM c),
wd AS (SELECT {g}, sum(abs(fr - fc) * coalesce(gap, 0.0)) AS wasserstein FROM cum GROUP BY {g}),
sd AS (SELECT {g}, stddev_pop(value) AS ref_std FROM {src} WHERE side = 'ref' GROUP BY {g}),
per AS (SELECT {g}, wasserstein, ref_std, CASE WHEN ref_std > 0 THEN wasserstein / ref_std ELSE wasserstein END AS distance
  FROM wd JOIN sd USING ({g}))"""


@register("dataset_drift_columns", f"WITH {FEAT_SQL}, {WASS_SQL.format(g='feature', src='fl')} "
          "SELECT feature, round(wasserstein, 6) AS wasserstein, round(ref_std, 6) AS ref_std, round(distance, 6) AS distance, "
          "distance >= 0.1 AS drifted FROM per")
def q_dataset_drift_columns(spark, sf):
    per, _ = DT.dataset_drift_share(text_corpus(spark, sf))
    return rounded(per)


@register("dataset_drift_share", f"WITH {FEAT_SQL}, {WASS_SQL.format(g='feature', src='fl')} "
          "SELECT count(*) AS number_of_columns, count(*) FILTER (WHERE distance >= 0.1) AS number_of_drifted_columns, "
          "round(count(*) FILTER (WHERE distance >= 0.1) / count(*), 6) AS share_of_drifted_columns, "
          "count(*) FILTER (WHERE distance >= 0.1) / count(*) >= 0.5 AS dataset_drift FROM per")
def q_dataset_drift_share(spark, sf):
    _, overall = DT.dataset_drift_share(text_corpus(spark, sf))
    return rounded(overall)


@register("text_oov_share", f"""WITH {CORPUS_SQL},
toks AS (SELECT doc_id, side, unnest(regexp_extract_all(lower(coalesce(text, '')), '{WORD_RE}')) AS term FROM corpus),
vocab AS (SELECT DISTINCT term FROM toks WHERE side = 'ref')
SELECT doc_id, side, count(*) AS n_words, count(*) FILTER (WHERE term NOT IN (SELECT term FROM vocab)) AS n_oov,
round(count(*) FILTER (WHERE term NOT IN (SELECT term FROM vocab)) / count(*), 6) AS oov_share FROM toks GROUP BY 1, 2""")
def q_text_oov_share(spark, sf):
    return rounded(DT.text_oov_share(text_corpus(spark, sf)))


@register("text_sentiment", f"""WITH {CORPUS_SQL},
lab AS (SELECT d.doc_id, l.toxic, d.text FROM documents d JOIN labels l USING (doc_id)),
lt AS (SELECT DISTINCT doc_id, toxic, unnest(regexp_extract_all(lower(text), '{WORD_RE}')) AS term FROM lab),
n AS (SELECT count(*) FILTER (WHERE toxic = 0) AS n0, count(*) FILTER (WHERE toxic = 1) AS n1 FROM lab),
lex AS (SELECT term, ln((count(*) FILTER (WHERE toxic = 0) + 1) / (n0 + 2)) - ln((count(*) FILTER (WHERE toxic = 1) + 1) / (n1 + 2)) AS score
        FROM lt, n GROUP BY term, n0, n1),
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{WORD_RE}')) AS term FROM corpus),
s AS (SELECT doc_id, avg(score) AS sentiment FROM toks JOIN lex USING (term) GROUP BY doc_id)
SELECT c.doc_id, c.side, round(coalesce(s.sentiment, 0.0), 6) AS sentiment FROM corpus c LEFT JOIN s USING (doc_id)""")
def q_text_sentiment(spark, sf):
    """J20 with a lexicon learned from ``labels.toxic`` (no lexicon is shipped)."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    lex = DT.lexicon_from_labels(docs, read_table(spark, sf, "labels"), "toxic")
    return rounded(DT.text_sentiment(text_corpus(spark, sf), lex))


# ---------------------------------------------------------------- vectors

VEC_SQL = f"""vc AS (SELECT vec_id, CASE WHEN substr(md5('{SEED}:emb:' || vec_id), 1, 1) < '8' THEN 'ref' ELSE 'cur' END AS side,
  embedding FROM embeddings),
vl AS (SELECT vec_id, side, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS value FROM vc),
vlong AS (SELECT vec_id, side, dim, value + CASE WHEN side = 'cur' THEN {{shift}} ELSE 0.0 END AS value FROM vl),
means AS (SELECT side, dim, avg(value) AS mean FROM vlong GROUP BY 1, 2),
mr AS (SELECT dim, mean AS r FROM means WHERE side = 'ref'), mc AS (SELECT dim, mean AS c FROM means WHERE side = 'cur')"""


def _vec(shift: float) -> str:
    return "WITH " + VEC_SQL.replace("{shift}", f"CAST({shift} AS DOUBLE)")


@register("embedding_long", _vec(0.0) + " SELECT vec_id, dim, round(value, 6) AS value FROM vlong")
def q_embedding_long(spark, sf):
    return rounded(DE.embedding_long(read_table(spark, sf, "embeddings")))


@register("drift_euclidean", _vec(0.0) + " SELECT round(sqrt(sum((r - c) * (r - c))), 6) AS distance FROM mr JOIN mc USING (dim)")
def q_drift_euclidean(spark, sf):
    return rounded(DE.drift_distance(vector_corpus(spark, sf), "euclidean"))


@register("drift_euclidean_shifted", _vec(0.05) + " SELECT round(sqrt(sum((r - c) * (r - c))), 6) AS distance, "
          "sqrt(sum((r - c) * (r - c))) > 0.2 AS drift_detected FROM mr JOIN mc USING (dim)")
def q_drift_euclidean_shifted(spark, sf):
    """J12 + J17: a constant shift of the current vectors against the static 0.2 threshold."""
    d = DE.drift_distance(vector_corpus(spark, sf, 0.05), "euclidean")
    return rounded(d.withColumn("drift_detected", F.col("distance") > F.lit(DE.static_threshold("euclidean"))))


@register("drift_cosine", _vec(0.0) + " SELECT round(1 - sum(r * c) / (sqrt(sum(r * r)) * sqrt(sum(c * c))), 6) AS distance "
          "FROM mr JOIN mc USING (dim)")
def q_drift_cosine(spark, sf):
    return rounded(DE.drift_distance(vector_corpus(spark, sf), "cosine"))


@register("drift_ratio_dims", _vec(0.0) + ", " + WASS_SQL.format(g="dim", src="vlong") +
          " SELECT dim, round(wasserstein, 6) AS wasserstein, round(ref_std, 6) AS ref_std, round(distance, 6) AS distance, "
          "distance >= 0.1 AS drifted FROM per")
def q_drift_ratio_dims(spark, sf):
    per, _ = DE.drift_ratio(vector_corpus(spark, sf))
    return rounded(per)


@register("drift_ratio", _vec(0.05) + ", " + WASS_SQL.format(g="dim", src="vlong") +
          " SELECT round(avg(CAST(distance >= 0.1 AS DOUBLE)), 6) AS drift_share, count(*) AS dims, "
          "avg(CAST(distance >= 0.1 AS DOUBLE)) >= 0.2 AS drift_detected FROM per", bench=True)
def q_drift_ratio(spark, sf):
    _, share = DE.drift_ratio(vector_corpus(spark, sf, 0.05))
    return rounded(share)


N_FEATURES = DE.N_FEATURES


def rff_sql(src: str, dim: int, sigma: str) -> str:
    """CTEs rw, rb, phi(id, side, j, v): the random features of ``src`` (id, side, dim, value)."""
    unit = "CAST('0x' || substr(md5({k}), {at}, 8) AS BIGINT) / 4294967296.0"
    key = f"'{SEED}:rff:' || j || ':' || d"
    return f"""sg AS (SELECT {sigma} AS sigma),
rw AS (SELECT j, d AS dim, sqrt(-2.0 * ln(1.0 - {unit.format(k=key, at=1)})) * cos(2 * pi() * {unit.format(k=key, at=9)}) AS w0
  FROM range(0, {N_FEATURES}) a(j), range(0, {dim}) b(d)),
rb AS (SELECT j, 2 * pi() * {unit.format(k=f"'{SEED}:rffb:' || j", at=1)} AS b FROM range(0, {N_FEATURES}) a(j)),
phi AS (SELECT id, side, j, sqrt(2.0 / {N_FEATURES}) * cos(dot + rb.b) AS v FROM (
  SELECT v.id, v.side, rw.j, sum(v.value * (rw.w0 / greatest(sg.sigma, 1e-12))) AS dot FROM {src} v JOIN rw USING (dim), sg GROUP BY ALL) x JOIN rb USING (j))"""


SIGMA_SQL = "round((SELECT sqrt(2 * sum(s)) FROM (SELECT var_pop(value) AS s FROM {src} WHERE side = 'ref' GROUP BY dim) q), 9)"
VID_SQL = ", vid AS (SELECT vec_id AS id, side, dim, value FROM vlong)"
HEX_SQL = "CAST(greatest(1, ceil(ln(greatest((SELECT count(DISTINCT id) FROM {src} WHERE side = 'ref'), 2)) / ln(16))) AS INTEGER)"


def boot_sql(name: str, src: str, col: str, hexes: str, stat: str) -> str:
    """CTE ``name``(threshold): the 0.95 quantile of ``stat`` over 100 halvings of the reference's mean vectors."""
    return f"""{name}_s AS (SELECT substr(md5('{SEED}:bootstrap:' || id), 1, {hexes}) AS bucket, {col} AS dim, sum(v) AS s, count(*) AS n FROM {src}
  WHERE side = 'ref' GROUP BY ALL),
{name}_m AS (SELECT b, CASE WHEN substr(md5('{SEED}:half:' || b || ':' || bucket), 1, 1) < '8' THEN 'ref' ELSE 'cur' END AS side, dim, sum(s) / sum(n) AS m
  FROM {name}_s, range(0, 100) t(b) GROUP BY ALL),
{name} AS (SELECT quantile_cont(d, CAST(0.95 AS DOUBLE)) AS threshold FROM (SELECT r.b, {stat} AS d FROM {name}_m r JOIN {name}_m c
  ON r.b = c.b AND r.dim = c.dim AND r.side = 'ref' AND c.side = 'cur' GROUP BY r.b) x)"""


EUCLID = "sqrt(sum((r.m - c.m) * (r.m - c.m)))"
SQUARED = "sum((r.m - c.m) * (r.m - c.m))"
COSINE = "1 - sum(r.m * c.m) / (sqrt(sum(r.m * r.m)) * sqrt(sum(c.m * c.m)))"
MEANS_SQL = """vv AS (SELECT id, side, dim, value AS v FROM vid),
vm AS (SELECT side, dim, avg(v) AS m FROM vv GROUP BY ALL), fm AS (SELECT side, j AS dim, avg(v) AS m FROM phi GROUP BY ALL),
mmd AS (SELECT """ + SQUARED + """ AS d FROM fm r JOIN fm c ON r.dim = c.dim AND r.side = 'ref' AND c.side = 'cur'),
euc AS (SELECT """ + EUCLID + """ AS d FROM vm r JOIN vm c ON r.dim = c.dim AND r.side = 'ref' AND c.side = 'cur'),
cosd AS (SELECT """ + COSINE + """ AS d FROM vm r JOIN vm c ON r.dim = c.dim AND r.side = 'ref' AND c.side = 'cur')"""
VEC_HEX = HEX_SQL.format(src="vid")


@register("drift_bootstrap_threshold", _vec(0.0) + VID_SQL + ", " + rff_sql("vid", 64, SIGMA_SQL.format(src="vid")) + ", " + MEANS_SQL + ", "
          + boot_sql("be", "vv", "dim", VEC_HEX, EUCLID) + ", " + boot_sql("bc", "vv", "dim", VEC_HEX, COSINE) + ", "
          + boot_sql("bm", "phi", "j", VEC_HEX, SQUARED) + """
SELECT 'euclidean' AS method, round(threshold, 6) AS threshold FROM be UNION ALL SELECT 'cosine', round(threshold, 6) FROM bc
UNION ALL SELECT 'mmd', round(threshold, 6) FROM bm""")
def q_drift_bootstrap_threshold(spark, sf):
    """J16 for every test on mean vectors (100 halvings each)."""
    c = vector_corpus(spark, sf)
    rows = [(m, DE.bootstrap_threshold(c, m, seed=SEED)) for m in ("euclidean", "cosine", "mmd")]
    return rounded(spark.createDataFrame(rows, "method string, threshold double"))


@register("drift_bootstrap_ratio", _vec(0.0) + VID_SQL + f""",
bv AS (SELECT substr(md5('{SEED}:bootstrap:' || id), 1, {VEC_HEX}) AS bucket, dim, value FROM vid WHERE side = 'ref'),
hv AS (SELECT b * 1000 + dim AS g, CASE WHEN substr(md5('{SEED}:half:' || b || ':' || bucket), 1, 1) < '8' THEN 'ref' ELSE 'cur' END AS side, value
  FROM bv, range(0, 100) t(b)), """ + WASS_SQL.format(g="g", src="hv") + """
SELECT 'ratio' AS method, round(quantile_cont(d, CAST(0.95 AS DOUBLE)), 6) AS threshold FROM (
  SELECT g // 1000 AS b, avg(CAST(distance >= 0.1 AS DOUBLE)) AS d FROM per GROUP BY 1) x""")
def q_drift_bootstrap_ratio(spark, sf):
    """J16 for the ratio test: 100 halvings in one sorted pass."""
    t = DE.bootstrap_threshold(vector_corpus(spark, sf), "ratio", seed=SEED)
    return rounded(spark.createDataFrame([("ratio", t)], "method string, threshold double"))


@register("drift_mmd", _vec(0.05) + VID_SQL + ", " + rff_sql("vid", 64, SIGMA_SQL.format(src="vid")) + ", " + MEANS_SQL
          + " SELECT round(d, 6) AS mmd2, round(sigma, 6) AS sigma FROM mmd, sg")
def q_drift_mmd(spark, sf):
    """RFF estimate (tests compare it with the exact statistic)."""
    return rounded(DE.drift_mmd(vector_corpus(spark, sf, 0.05), seed=SEED))


BLOCK_MMD_SQL = _vec(0.05) + VID_SQL + ", sg AS (SELECT " + SIGMA_SQL.format(src="vid") + """ AS sigma),
nb AS (SELECT greatest(1, CAST(ceil(count(*) / """ + str(float(DE.BLOCK_ROWS)) + f""") AS BIGINT)) AS n FROM vc),
bl AS (SELECT vc.vec_id AS id, CAST('0x' || substr(md5('{SEED}:mmd:' || vc.vec_id), 1, 12) AS BIGINT) % nb.n AS block FROM vc, nb),
vb AS (SELECT block, vid.id, side, list(value ORDER BY dim) AS e FROM vid JOIN bl USING (id) GROUP BY ALL),
kk AS (SELECT a.block, a.side AS sa, b.side AS sb, avg(exp(-list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(a.e, b.e)]) / (2 * sigma * sigma))) AS m,
  count(*) AS w FROM vb a JOIN vb b ON a.block = b.block CROSS JOIN sg GROUP BY ALL),
per AS (SELECT block, sum(CASE WHEN sa = sb THEN m ELSE -m END) AS v, CAST(max(w) FILTER (sa = 'ref' AND sb = 'cur') AS DOUBLE) AS w FROM kk GROUP BY block HAVING count(*) = 4)
"""


@register("drift_mmd_blocks", BLOCK_MMD_SQL + """SELECT round(sum(w * v) / sum(w), 6) AS mmd2,
round(sqrt(sum(w * w * (v - mm) * (v - mm))) / sum(w), 6) AS standard_error, count(*) AS n_blocks, round(max(sigma), 6) AS sigma
FROM per, sg, (SELECT sum(w * v) / sum(w) AS mm FROM per) q""")
def q_drift_mmd_blocks(spark, sf):
    """Exact kernel sums inside hash blocks, with the standard error of their average."""
    return rounded(DE.block_mmd(vector_corpus(spark, sf, 0.05), seed=SEED))


@register("drift_static_threshold", _vec(0.05) + VID_SQL + ", " + rff_sql("vid", 64, SIGMA_SQL.format(src="vid")) + ", " + MEANS_SQL + ", "
          + WASS_SQL.format(g="dim", src="vlong") + """, ra AS (SELECT avg(CAST(distance >= 0.1 AS DOUBLE)) AS d FROM per)
SELECT 'mmd' AS name, 'MMD (Maximum Mean Discrepancy)' AS label, round(d, 6) AS drift_score, CAST(0.015 AS DOUBLE) AS threshold, d > 0.015 AS drift_detected FROM mmd
UNION ALL SELECT 'Euclidean', 'Distance-based (euclidean)', round(d, 6), CAST(0.2 AS DOUBLE), d > 0.2 FROM euc
UNION ALL SELECT 'cosine', 'Distance-based (cosine)', round(d, 6), CAST(0.2 AS DOUBLE), d > 0.2 FROM cosd
UNION ALL SELECT 'ratio', 'Ratio-based', round(d, 6), CAST(0.2 AS DOUBLE), d >= 0.2 FROM ra
UNION ALL SELECT 'no such test', 'MMD (Maximum Mean Discrepancy) [default]', round(d, 6), CAST(0.015 AS DOUBLE), d > 0.015 FROM mmd""")
def q_drift_static_threshold(spark, sf):
    """J17 + M2: every test by name against its fixed threshold; an unknown name means MMD."""
    c = vector_corpus(spark, sf, 0.05)
    ref, cur = (c.filter(F.col("side") == x) for x in ("ref", "cur"))
    out = None
    for name in ("mmd", "Euclidean", "cosine", "ratio", "no such test"):
        fit = DE.fit_embedding(ref, name, False, seed=SEED)
        row = DE.detect_embedding(fit, cur).select(F.lit(name).alias("name"), F.lit(fit.label).alias("label"), "drift_score", "threshold", "drift_detected")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


LETTER_PROFILE_BODY = f"""
alpha AS (SELECT substr('{ALPHABET}', i, 1) AS a, CAST(i AS INTEGER) AS pos FROM range(1, {V + 1}) t(i)),
cnt AS (SELECT c.doc_id, c.side, alpha.pos, length(lower(c.text)) - length(replace(lower(c.text), alpha.a, '')) AS n
        FROM corpus c, alpha),
prof AS (SELECT doc_id, side, pos, n / greatest(sum(n) OVER (PARTITION BY doc_id), 1) AS value FROM cnt)"""
LETTER_PROFILE_SQL = CORPUS_SQL + "," + LETTER_PROFILE_BODY


@register("embed_text", f"WITH {LETTER_PROFILE_SQL} SELECT doc_id, side, list(round(value, 6) ORDER BY pos) AS embedding "
          "FROM prof GROUP BY 1, 2")
def q_embed_text(spark, sf):
    e = DE.embed_letter_profile(text_corpus(spark, sf))
    return e.select("doc_id", "side", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def drift_reference(spark, sf, **config):
    """The detector fitted on the reference side."""
    ref = text_corpus(spark, sf).filter(F.col("side") == "ref")
    return DR.drift_fit(ref, DR.DriftConfig(seed=SEED, **config))


def _detect(spark, sf):
    """Default configuration: domain classifier, and MMD with a bootstrap threshold."""
    cur = text_corpus(spark, sf).filter(F.col("side") == "cur")
    return DR.drift_method_rows(cur, drift_reference(spark, sf))


DETECT_SQL = DOMAIN_SQL + f""", {LETTER_PROFILE_BODY},
pv AS (SELECT doc_id AS id, side, CAST(pos - 1 AS INTEGER) AS dim, value FROM prof), """ + rff_sql("pv", V, SIGMA_SQL.format(src="pv")) + """,
fm AS (SELECT side, j AS dim, avg(v) AS m FROM phi GROUP BY ALL),
ed AS (SELECT """ + SQUARED + """ AS distance FROM fm r JOIN fm c ON r.dim = c.dim AND r.side = 'ref' AND c.side = 'cur'), """ + boot_sql(
    "bt", "phi", "j", HEX_SQL.format(src="pv"), SQUARED) + """,
methods AS (SELECT 'domain_classifier' AS method, coalesce(auc > threshold, false) AS drift_detected, auc AS score, threshold FROM dc
            UNION ALL SELECT 'embedding', coalesce(ed.distance > bt.threshold, false), ed.distance, bt.threshold FROM ed, bt)
"""


@register("drift_method_results", DETECT_SQL + "SELECT method, drift_detected, round(score, 6) AS score, "
          "round(threshold, 6) AS threshold FROM methods")
def q_drift_method_results(spark, sf):
    """One row per method (details flattened to score / threshold)."""
    m = _detect(spark, sf)
    return rounded(m.select("method", "drift_detected",
                            F.coalesce(F.col("details")["roc_auc"], F.col("details")["drift_score"]).alias("score"),
                            F.col("details")["threshold"].alias("threshold")))


@register("drift_detect", DETECT_SQL + """SELECT count(*) FILTER (WHERE drift_detected) > 0 AS drift_detected,
CASE WHEN count(*) = 0 THEN 'none' WHEN count(*) FILTER (WHERE drift_detected) = 0 THEN 'none'
     WHEN count(*) FILTER (WHERE drift_detected) = 1 THEN 'low'
     WHEN count(*) FILTER (WHERE drift_detected) = count(*) THEN 'high' ELSE 'medium' END AS drift_severity,
count(*) AS total_methods, count(*) FILTER (WHERE drift_detected) AS no_of_methods_detected_drift,
round(count(*) FILTER (WHERE drift_detected) / count(*), 6) AS detection_rate FROM methods""", bench=True)
def q_drift_detect(spark, sf):
    """J2 + J3: the aggregated batch result (nested method results omitted from the check)."""
    return rounded(DR.aggregate_methods(_detect(spark, sf)).drop("method_results", "reason"))


@register("drift_batch_envelope", "SELECT arg_min(event_type, event_id) AS batch_id, "
          "CAST(arg_min(ts, event_id) AS TIMESTAMP) AS time_start, CAST(arg_max(ts, event_id) AS TIMESTAMP) AS time_end FROM events")
def q_drift_batch_envelope(spark, sf):
    """First row's batch id and start, last row's end, by ``event_id`` order."""
    e = read_table(spark, sf, "events")
    cfg = DR.DriftConfig(batch_id_column="event_type", time_start_column="ts", time_end_column="ts")
    env = DR.batch_envelope(e, "event_id", cfg)
    return env.select("batch_id", F.col("time_start").cast("timestamp_ntz").alias("time_start"),
                      F.col("time_end").cast("timestamp_ntz").alias("time_end"))


@register("drift_result_json", DETECT_SQL + """SELECT 'documents_batch' AS batch_id, count(*) FILTER (WHERE drift_detected) > 0 AS drift_detected,
CASE WHEN count(*) FILTER (WHERE drift_detected) = 0 THEN 'none' WHEN count(*) FILTER (WHERE drift_detected) = 1 THEN 'low'
     WHEN count(*) FILTER (WHERE drift_detected) = count(*) THEN 'high' ELSE 'medium' END AS drift_severity,
count(*) AS total_methods, round(max(score) FILTER (WHERE method = 'domain_classifier'), 6) AS roc_auc, true AS has_times FROM methods""")
def q_drift_result_json(spark, sf):
    """The serialised batch result, read back from its JSON text (times: present and ISO)."""
    agg = DR.aggregate_methods(_detect(spark, sf))
    env = DR.batch_envelope(read_table(spark, sf, "documents"), "doc_id", DR.DriftConfig(), batch_id="documents_batch")
    j = DR.drift_result_json(DR.drift_output(env, agg))
    at = lambda path: F.get_json_object("json", path)
    iso = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
    return rounded(j.select(
        at("$.batch_id").alias("batch_id"), at("$.drift_detected").cast("boolean").alias("drift_detected"), at("$.drift_severity").alias("drift_severity"),
        at("$.aggregation_details.total_methods").cast("long").alias("total_methods"),
        at("$.method_results.domain_classifier.details.roc_auc").cast("double").alias("roc_auc"),
        (at("$.timestamp").rlike(iso) & at("$.time_start").rlike(iso) & at("$.time_end").rlike(iso)).alias("has_times")))


@register("drift_fit", f"""WITH {LETTER_PROFILE_SQL}, pv AS (SELECT doc_id AS id, side, CAST(pos - 1 AS INTEGER) AS dim, value FROM prof), """
          + rff_sql("pv", V, SIGMA_SQL.format(src="pv")) + f""",
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, 'None')), '{WORD_RE}')) AS term FROM corpus WHERE side = 'ref'),
tc AS (SELECT count(*) AS n_terms FROM (SELECT DISTINCT doc_id, term FROM toks WHERE term NOT IN {STOP_SQL}) x)
SELECT CAST(j AS INTEGER) AS dim, round(avg(v), 6) AS mean, max(n_terms) AS n_terms FROM phi, tc WHERE side = 'ref' GROUP BY j""")
def q_drift_fit(spark, sf):
    """The fitted statistics that detection reads: mean features and the reference's term counts."""
    fit = drift_reference(spark, sf)
    n = fit.terms.docs.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0)).alias("n_terms"))  # one row
    return rounded(fit.embedding.stats.crossJoin(F.broadcast(n)).select(F.col("dim").cast("int").alias("dim"), "mean", "n_terms"))


@register("drift_fit_merged", f"""WITH {LETTER_PROFILE_SQL},
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, 'None')), '{WORD_RE}')) AS term FROM corpus WHERE side = 'ref'),
tc AS (SELECT count(*) AS n_terms FROM (SELECT DISTINCT doc_id, term FROM toks WHERE term NOT IN {STOP_SQL}) x)
SELECT CAST(pos - 1 AS INTEGER) AS dim, round(avg(value), 6) AS mean, max(n_terms) AS n_terms FROM prof, tc WHERE side = 'ref' GROUP BY pos""")
def q_drift_fit_merged(spark, sf):
    """Two fits, each on a hash half of the reference, merged: the statistics of the whole reference."""
    ref = text_corpus(spark, sf).filter(F.col("side") == "ref")
    half = hash_half(SEED, "merge", "doc_id")
    config = DR.DriftConfig(seed=SEED, embedding_drift_method="euclidean", name_digits=8)
    fit = DR.merge_fits(DR.drift_fit(ref.filter(half), config), DR.drift_fit(ref.filter(~half), config))
    n = fit.terms.docs.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0)).alias("n_terms"))  # one row
    return rounded(fit.embedding.stats.crossJoin(F.broadcast(n)).select(F.col("dim").cast("int").alias("dim"), "mean", "n_terms"))


@register("drift_detect_distance", DOMAIN_SQL + f""", {LETTER_PROFILE_BODY},
pm AS (SELECT side, pos, avg(value) AS m FROM prof GROUP BY 1, 2),
ed AS (SELECT sqrt(sum((r.m - c.m) * (r.m - c.m))) AS distance FROM pm r JOIN pm c ON r.pos = c.pos AND r.side = 'ref' AND c.side = 'cur')
SELECT distance > 0.2 AS drift_detected, CASE WHEN distance > 0.2 THEN 'low' ELSE 'none' END AS drift_severity, 1 AS total_methods FROM ed""")
def q_drift_detect_distance(spark, sf):
    """J2 + J3 with one configured method: static euclidean distance."""
    fit = drift_reference(spark, sf, methods=("embedding", "text_overview"), embedding_drift_method="euclidean", use_bootstrap=False)
    cur = text_corpus(spark, sf).filter(F.col("side") == "cur")
    return DR.drift_detect(cur, fit).select("drift_detected", "drift_severity", F.col("total_methods").cast("int").alias("total_methods"))


@register("domain_classifier_mllib", "SELECT true AS drift_detected, true AS separable")
def q_domain_classifier_mllib(spark, sf):
    """J6 (MLlib form): L1 logistic regression on hashed counts, held-out AUC above the threshold."""
    auc = DT.domain_classifier_mllib(text_corpus(spark, sf), "text", SEED)
    held = text_corpus(spark, sf).filter(~hash_half(SEED, "domain", "doc_id"))
    n = held.agg(F.count_if(F.col("side") == "cur").cast("double").alias("m"), F.count_if(F.col("side") == "ref").cast("double").alias("n"))
    return n.select((F.lit(float(auc)) > DT.random_auc_threshold(F.col("m"), F.col("n"))).alias("drift_detected"),
                    F.lit(float(auc) > 0.9).alias("separable"))


# ---------------------------------------------------------------- many batches, log of results

BATCHES = 30


def batched_documents(spark, sf):
    """The current side of ``documents`` as ``BATCHES`` batches by id."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    cur = d.filter(F.coalesce(F.col("lang") != "en", F.lit(True)))
    return cur.select("doc_id", "text", (F.col("doc_id") % BATCHES).alias("batch"))


def domain_batches_sql(batch: str) -> str:
    """CTEs up to db(b, auc, threshold, n_ref_test, n_cur_test), one domain classifier per batch."""
    held = f"NOT substr(md5('{SEED}:domain:' || doc_id), 1, 1) < '8'"
    return f"""{CORPUS_SQL},
bt AS (SELECT doc_id, side, text, CASE WHEN side = 'cur' THEN {batch} END AS own FROM corpus),
bs AS (SELECT DISTINCT own AS b FROM bt WHERE own IS NOT NULL),
toks AS (SELECT doc_id, side, own, unnest(regexp_extract_all(lower(coalesce(text, 'None')), '{WORD_RE}')) AS term FROM bt),
tf AS (SELECT doc_id, side, own, term, count(*) AS tf FROM toks WHERE term NOT IN {STOP_SQL} GROUP BY ALL),
nd AS (SELECT b, (SELECT count(*) FROM bt WHERE side = 'ref') + (SELECT count(*) FROM bt WHERE own = b) AS n FROM bs),
dr AS (SELECT term, count(*) AS df FROM tf WHERE side = 'ref' GROUP BY term), dc0 AS (SELECT own AS b, term, count(*) AS df FROM tf WHERE side = 'cur' GROUP BY ALL),
dft AS (SELECT b, term, sum(df) AS df FROM (SELECT b, term, df FROM dr, bs UNION ALL SELECT * FROM dc0) x GROUP BY ALL),
idf AS (SELECT b, term, ln((n + 1) / (df + 1)) + 1 AS idf FROM dft JOIN nd USING (b) WHERE df <= CAST(0.5 AS DOUBLE) * n),
w0 AS (SELECT b, doc_id, side, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term) WHERE side = 'ref' OR own = b),
w AS (SELECT b, doc_id, side, term, w / sqrt(sum(w * w) OVER (PARTITION BY b, doc_id)) AS weight, {held} AS held FROM w0),
nt AS (SELECT b, count(DISTINCT doc_id) FILTER (side = 'cur') AS nc, count(DISTINCT doc_id) FILTER (side = 'ref') AS nr FROM w WHERE NOT held GROUP BY b),
lo AS (SELECT b, term, ln((count(*) FILTER (side = 'cur') + 1) / (max(nc) + 2)) - ln((count(*) FILTER (side = 'ref') + 1) / (max(nr) + 2)) AS log_odds
       FROM w JOIN nt USING (b) WHERE NOT held GROUP BY b, term),
test AS (SELECT b, doc_id, side FROM bt, bs WHERE {held} AND (side = 'ref' OR own = b)),
cs AS (SELECT b, doc_id, sum(weight * log_odds) AS s FROM w JOIN lo USING (b, term) WHERE held GROUP BY ALL),
sc AS (SELECT b, side, round(coalesce(s, 0.0), 12) AS score FROM test LEFT JOIN cs USING (b, doc_id)),
r AS (SELECT b, side = 'cur' AS is_pos, rank() OVER (PARTITION BY b ORDER BY score) + (count(*) OVER (PARTITION BY b, score) - 1) / 2.0 AS r FROM sc),
a AS (SELECT b, count(*) FILTER (is_pos) AS m, count(*) FILTER (NOT is_pos) AS n, sum(r) FILTER (is_pos) AS rs FROM r GROUP BY b),
db AS (SELECT b, CASE WHEN m * n > 0 THEN (rs - m * (m + 1) / 2.0) / (m * n) END AS auc,
  CASE WHEN m * n > 0 THEN 0.5 + {DT.Z_95} * sqrt((m + n + 1) / (12.0 * m * n)) END AS threshold FROM a)"""


PROFILE_BATCH_SQL = LETTER_PROFILE_BODY + """,
pr AS (SELECT pos, avg(value) AS m FROM prof WHERE side = 'ref' GROUP BY pos),
pc AS (SELECT own AS b, pos, avg(value) AS m FROM prof JOIN bt USING (doc_id) WHERE prof.side = 'cur' GROUP BY ALL),
ed AS (SELECT b, sqrt(sum((pr.m - pc.m) * (pr.m - pc.m))) AS distance FROM pr JOIN pc USING (pos) GROUP BY b),
bm AS (SELECT b, coalesce(auc > db.threshold, false) AS d1, coalesce(distance > 0.2, false) AS d2, auc, db.threshold, distance
       FROM bs LEFT JOIN db USING (b) LEFT JOIN ed USING (b)),
br AS (SELECT b, d1 OR d2 AS drift_detected, CASE WHEN d1 AND d2 THEN 'high' WHEN d1 OR d2 THEN 'low' ELSE 'none' END AS drift_severity,
  round(auc, 6) AS roc_auc, round(threshold, 6) AS auc_threshold, round(distance, 6) AS drift_score FROM bm)"""


def _flat(result):
    m = F.col("method_results")
    return rounded(result.select(
        *[c for c in result.columns if c in ("batch_id", "window_start")], "drift_detected", "drift_severity",
        m["domain_classifier"]["details"]["roc_auc"].alias("roc_auc"), m["domain_classifier"]["details"]["threshold"].alias("auc_threshold"),
        m["embedding"]["details"]["drift_score"].alias("drift_score")))


STATIC = {"embedding_drift_method": "euclidean", "use_bootstrap": False}


@register("drift_detect_batches", f"WITH {domain_batches_sql(f'doc_id % {BATCHES}')}, {PROFILE_BATCH_SQL} "
          "SELECT CAST(b AS VARCHAR) AS batch_id, drift_detected, drift_severity, roc_auc, auc_threshold, drift_score FROM br")
def q_drift_detect_batches(spark, sf):
    """J2 for 30 batches in one job: both methods, one row per batch."""
    return _flat(DB.drift_detect_batches(batched_documents(spark, sf), drift_reference(spark, sf, **STATIC), "batch"))


RATIO_BATCH_SQL = _vec(0.05) + """, per_b AS (SELECT DISTINCT vec_id % 5 AS b FROM vc WHERE side = 'cur'),
hv AS (SELECT b * 1000 + dim AS g, side, value FROM vlong, per_b WHERE side = 'ref' OR vec_id % 5 = b), """ + WASS_SQL.format(g="g", src="hv") + """
SELECT CAST(g // 1000 AS INTEGER) AS batch, round(avg(CAST(distance >= 0.1 AS DOUBLE)), 6) AS drift_score, avg(CAST(distance >= 0.1 AS DOUBLE)) >= 0.2 AS drift_detected
FROM per GROUP BY 1"""


@register("drift_ratio_batches", RATIO_BATCH_SQL)
def q_drift_ratio_batches(spark, sf):
    """J15 for several batches: the reference's running counts meet all batches of a value range."""
    c = vector_corpus(spark, sf, 0.05)
    fit = DE.fit_embedding(c.filter("side = 'ref'"), "ratio", False, seed=SEED)
    cur = c.filter("side = 'cur'").withColumn("batch", (F.col("vec_id") % 5).cast("int"))
    return rounded(DB.embedding_batches(fit, cur).select("batch", "drift_score", "drift_detected"))


@register("drift_results_log", f"WITH {domain_batches_sql(f'doc_id % {BATCHES}')}, {PROFILE_BATCH_SQL} "
          "SELECT CAST(b AS VARCHAR) AS batch_id, drift_detected, drift_severity, roc_auc, auc_threshold, drift_score FROM br")
def q_drift_results_log(spark, sf):
    """Results of all batches appended to the log, some of them twice; the log has one row a batch."""
    cur, fit = batched_documents(spark, sf), drift_reference(spark, sf, **STATIC)
    path = shared_path(spark, "drift_log")
    DB.append_results(DB.drift_detect_batches(cur, fit, "batch"), path)
    DB.append_results(DB.drift_detect_batches(cur.filter("batch < 5"), fit, "batch"), path)
    return _flat(DB.latest_results(spark, path))


L1_ROUNDS = 8


def _l1_sql() -> str:
    """Proximal gradient rounds of the linear domain classifier, unrolled."""
    out = [f"""WITH {TFIDF_SQL},
wx AS (SELECT doc_id, term, weight, substr(md5('{SEED}:domain:' || doc_id), 1, 1) < '8' AS train FROM w),
dy AS (SELECT doc_id, CASE WHEN side = 'cur' THEN 1.0 ELSE -1.0 END AS y FROM corpus WHERE substr(md5('{SEED}:domain:' || doc_id), 1, 1) < '8'),
nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM dy),
w_0 AS MATERIALIZED (SELECT '' AS term, CAST(0 AS DOUBLE) AS w WHERE false), b_0 AS (SELECT CAST(0 AS DOUBLE) AS b)"""]
    for i in range(L1_ROUNDS):
        out.append(f"""
z_{i} AS (SELECT doc_id, sum(weight * w) AS z FROM wx JOIN w_{i} USING (term) WHERE train GROUP BY doc_id),
m_{i} AS (SELECT doc_id, y, y * (coalesce(z, 0.0) + b) AS m FROM dy LEFT JOIN z_{i} USING (doc_id), b_{i}),
s_{i} AS MATERIALIZED (SELECT doc_id, CASE WHEN m >= 1 THEN 0.0 WHEN m >= -1 THEN (1 - m) * (1 - m) ELSE -4 * m END AS loss,
  y * CASE WHEN m >= 1 THEN 0.0 WHEN m >= -1 THEN -2 * (1 - m) ELSE -4.0 END AS slope FROM m_{i}),
g_{i} AS (SELECT term, sum(weight * slope) / max(n) AS g FROM wx JOIN s_{i} USING (doc_id), nn WHERE train AND slope <> 0 GROUP BY term),
v_{i} AS (SELECT coalesce(g.term, w.term) AS term, coalesce(w, 0.0) - {DL.STEP} * coalesce(g, 0.0) AS v FROM g_{i} g FULL JOIN w_{i} w ON g.term = w.term),
w_{i + 1} AS MATERIALIZED (SELECT term, sign(v) * greatest(abs(v) - {DL.STEP} * {DL.ALPHA}, 0.0) AS w FROM v_{i} WHERE abs(v) > {DL.STEP} * {DL.ALPHA}),
b_{i + 1} AS (SELECT max(b) - {DL.STEP} * (SELECT sum(slope) FROM s_{i}) / max(n) AS b FROM b_{i}, nn)""")
    losses = " UNION ALL ".join(f"SELECT {i} AS round, (SELECT sum(loss) FROM s_{i}) / n + {DL.ALPHA} * coalesce((SELECT sum(abs(w)) FROM w_{i}), 0.0) AS loss FROM nn" for i in range(L1_ROUNDS))
    return ",".join(out) + f""", ls AS ({losses}),
test AS (SELECT doc_id, side FROM corpus WHERE NOT substr(md5('{SEED}:domain:' || doc_id), 1, 1) < '8'),
cs AS (SELECT doc_id, sum(weight * w) AS s FROM wx JOIN w_{L1_ROUNDS} USING (term) WHERE NOT train GROUP BY doc_id),
sc AS (SELECT side, round(coalesce(s, 0.0), 12) AS score FROM test LEFT JOIN cs USING (doc_id)),
r AS (SELECT side = 'cur' AS is_pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM sc),
a AS (SELECT count(*) FILTER (is_pos) AS m, count(*) FILTER (NOT is_pos) AS n, sum(r) FILTER (is_pos) AS rs FROM r)
SELECT CAST(m AS BIGINT) AS n_cur_test, CAST(n AS BIGINT) AS n_ref_test, round((rs - m * (m + 1) / 2.0) / (m * n), 4) AS roc_auc,
  (rs - m * (m + 1) / 2.0) / (m * n) > 0.5 + {DT.Z_95} * sqrt((m + n + 1) / (12.0 * m * n)) AS drift_detected,
  (SELECT round(min(loss), 6) FROM ls) AS last_loss, true AS loss_falls FROM a"""


@register("domain_classifier_l1", _l1_sql())
def q_domain_classifier_l1(spark, sf):
    """L1 linear model with the modified Huber loss on the full vocabulary, held-out AUC."""
    got, fit = DL.domain_classifier_l1(text_corpus(spark, sf), seed=SEED, rounds=L1_ROUNDS)
    falls = all(b < a for a, b in zip(fit.losses, fit.losses[1:]))
    return rounded(got.select("n_cur_test", "n_ref_test", F.round("roc_auc", 4).alias("roc_auc"), "drift_detected",
                              F.lit(fit.losses[-1]).alias("last_loss"), F.lit(falls).alias("loss_falls")))
