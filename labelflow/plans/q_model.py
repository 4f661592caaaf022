"""Registered scoring, evaluation and OOD queries.

Binding: the true label is ``documents.lang``. The letter model is trained on the documents
whose hash half is 'train'; scoring queries score every document, evaluation queries use the other half. The
DuckDB twin below re-derives the same model and scores in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hash_half, prob_column_name
from ..functions.text import ALPHABET
from ..operators import metrics as M
from ..operators import ood as O
from ..operators import scoring as S
from ..session import materialise
from ..sources.tables import read_table, table_state
from .registry import register, rounded

SEED = 42
ALPHA = 0.05
V = len(ALPHABET)

# ---------------------------------------------------------------- Spark side


def split_docs(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    is_train = hash_half(SEED, "train", "doc_id")
    return d.filter(is_train), d.filter(~is_train)


_MODELS: dict = {}


def letter_model(spark, sf):
    """Fitted once per application and state of the table (the fit is eager and its result is tiny)."""
    k = (spark.sparkContext.applicationId, table_state(spark, sf, "documents"))
    if k not in _MODELS:
        train, _ = split_docs(spark, sf)
        _MODELS[k] = S.fit_letter_nb(train, "text", "lang")
    return _MODELS[k]


def documents_key(spark, sf):
    return abs(hash(table_state(spark, sf, "documents")))


def scored_all(spark, sf, keep_text=False):
    """Every document: doc_id, lang, [text], predicted_label_id, predicted_label, confidence,
    probs, prob_labels. Scored once and written to the shared folder: every branch reads that
    table instead of re-running the model."""
    def build():
        d = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
        return S.LetterScorer(letter_model(spark, sf)).transform(d)
    out = materialise(spark, f"scored_docs_{documents_key(spark, sf)}", build)
    return out if keep_text else out.drop("text")


def scored_docs(spark, sf, keep_text=False):
    """The held-out half of ``scored_all``, on which the model is evaluated."""
    return scored_all(spark, sf, keep_text).filter(~hash_half(SEED, "train", "doc_id"))


def scored_long(spark, sf):
    """(id, true_label, label, prob) with the probability rounded to 12 places so that the
    two engines order tied scores identically."""
    lp = S.probabilities_long(scored_docs(spark, sf).withColumnRenamed("lang", "true_label"),
                              "doc_id", "true_label")
    return lp.select(F.col("doc_id").alias("id"), "true_label", "label",
                     F.round("prob", 12).alias("prob"))


def confusion(spark, sf):
    """k*k confusion counts, written once as a small table: every metric branch reads it
    instead of re-aggregating the scores."""
    return materialise(spark, f"confusion_{documents_key(spark, sf)}",
                       lambda: M.confusion_counts(scored_docs(spark, sf), "lang", "predicted_label"))


def true_labels(spark, sf):
    return scored_docs(spark, sf).select(F.col("lang").alias("label")).filter(
        F.col("label").isNotNull()).distinct()


def evaluation_row(spark, sf):
    conf = confusion(spark, sf)
    overall = M.overall_metrics(conf)
    auc = M.roc_auc(scored_long(spark, sf), conf, true_labels(spark, sf), row_check=M.probability_row_check(scored_docs(spark, sf)))
    return overall.crossJoin(auc)


def ood_reference_and_batch(spark, sf):
    """Reference = the scored rows in one hash half, current batch = the other half."""
    s = scored_docs(spark, sf, keep_text=True)
    ref = hash_half(SEED, "ood", "doc_id")
    return s.filter(ref), s.filter(~ref)


# ---------------------------------------------------------------- DuckDB twin

def scorer_cte(score_all: bool = False) -> str:
    where = "TRUE" if score_all else "NOT c.is_train"
    return f"""
alpha AS (SELECT substr('{ALPHABET}', i, 1) AS a, CAST(i AS INTEGER) AS pos FROM range(1, {V + 1}) t(i)),
d AS (SELECT doc_id, lang, lower(text) AS t, substr(md5('{SEED}:train:' || doc_id), 1, 1) < '8' AS is_train
      FROM documents WHERE text IS NOT NULL),
cnt AS (SELECT d.doc_id, d.lang, d.is_train, alpha.pos,
               length(d.t) - length(replace(d.t, alpha.a, '')) AS n FROM d, alpha),
tr AS (SELECT lang, pos, sum(n) AS n FROM cnt WHERE is_train AND lang IS NOT NULL GROUP BY lang, pos),
tot AS (SELECT lang, sum(n) AS tot FROM tr GROUP BY lang),
pri AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM d WHERE is_train AND lang IS NOT NULL)) AS lp
        FROM d WHERE is_train AND lang IS NOT NULL GROUP BY lang),
lab AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_id FROM pri),
ll AS (SELECT tr.lang, tr.pos, ln((tr.n + 1) / (tot.tot + {V})) AS ll FROM tr JOIN tot USING (lang)),
sc AS (SELECT c.doc_id, l.lang AS label, sum(c.n * l.ll) AS dot, sum(c.n) AS letters
       FROM cnt c JOIN ll l ON c.pos = l.pos WHERE {where} GROUP BY c.doc_id, l.lang),
s2 AS (SELECT sc.doc_id, sc.label, lab.label_id,
              pri.lp + CAST(3.0 AS DOUBLE) * sc.dot / greatest(sc.letters, 1) AS s
       FROM sc JOIN pri ON sc.label = pri.lang JOIN lab ON lab.lang = sc.label),
p0 AS (SELECT *, exp(s - max(s) OVER (PARTITION BY doc_id)) AS e FROM s2),
p AS (SELECT doc_id, label, label_id, e / sum(e) OVER (PARTITION BY doc_id) AS prob FROM p0),
best AS (SELECT doc_id, label AS predicted_label, label_id AS predicted_label_id, prob AS confidence
         FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, label_id) AS rk FROM p) r
         WHERE rk = 1),
scored AS (SELECT d0.doc_id, d0.lang, best.predicted_label_id, best.predicted_label, best.confidence, d0.text
           FROM documents d0 JOIN best USING (doc_id)),
lp AS (SELECT p.doc_id AS id, s.lang AS true_label, p.label, round(p.prob, 12) AS prob
       FROM p JOIN scored s USING (doc_id)),
conf AS (SELECT lang AS true_label, predicted_label AS pred_label, count(*) AS n FROM scored
         WHERE lang IS NOT NULL GROUP BY 1, 2),
labels_all AS (SELECT true_label AS label FROM conf UNION SELECT pred_label FROM conf),
pc AS (SELECT l.label,
              coalesce((SELECT sum(n) FROM conf WHERE true_label = l.label), 0) AS support,
              coalesce((SELECT sum(n) FROM conf WHERE pred_label = l.label), 0) AS predicted,
              coalesce((SELECT sum(n) FROM conf WHERE true_label = l.label AND pred_label = l.label), 0) AS tp
       FROM labels_all l),
pcm AS (SELECT label, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
               CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1_score,
               CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp
        FROM pc),
sums AS (SELECT CAST(sum(support) AS DOUBLE) AS n, CAST(sum(tp) AS DOUBLE) AS tp, count(*) AS k,
                avg(precision) AS pm, avg(recall) AS rm, avg(f1_score) AS fm,
                avg(CASE WHEN support > 0 THEN recall END) AS bal,
                sum(precision * support) AS pw, sum(recall * support) AS rw, sum(f1_score * support) AS fw,
                sum(CAST(predicted AS DOUBLE) * support) AS pt, sum(CAST(predicted AS DOUBLE) * predicted) AS pp,
                sum(CAST(support AS DOUBLE) * support) AS tt FROM pcm),
overall AS (SELECT tp / n AS accuracy, coalesce(bal, 0.0) AS balanced_accuracy,
                   pm AS precision_macro, tp / n AS precision_micro, pw / n AS precision_weighted,
                   rm AS recall_macro, tp / n AS recall_micro, rw / n AS recall_weighted,
                   fm AS f1_macro, tp / n AS f1_micro, fw / n AS f1_weighted,
                   CASE WHEN (n * n - pp) * (n * n - tt) = 0 THEN 0.0
                        ELSE (tp * n - pt) / sqrt((n * n - tt) * (n * n - pp)) END AS matthews_corrcoef,
                   CASE WHEN (n * n - pt) / n = 0 THEN CAST('nan' AS DOUBLE)
                        ELSE 1 - (n - tp) / ((n * n - pt) / n) END AS cohen_kappa,
                   CAST(n AS BIGINT) AS num_samples, CAST(k AS BIGINT) AS num_classes FROM sums),
mr AS (SELECT label, true_label = label AS is_pos,
              rank() OVER (PARTITION BY label ORDER BY prob)
              + (count(*) OVER (PARTITION BY label, prob) - 1) / 2.0 AS r FROM lp),
ovr_c AS (SELECT label, (sum(r) FILTER (WHERE is_pos) - count(*) FILTER (WHERE is_pos)
                         * (count(*) FILTER (WHERE is_pos) + 1) / 2.0)
                        / (count(*) FILTER (WHERE is_pos) * count(*) FILTER (WHERE NOT is_pos)) AS auc
          FROM mr GROUP BY label),
pairs AS (SELECT a.label AS a, b.label AS b FROM (SELECT DISTINCT true_label AS label FROM lp) a,
          (SELECT DISTINCT true_label AS label FROM lp) b WHERE a.label <> b.label),
dmr AS (SELECT pairs.a, pairs.b, lp.true_label = pairs.a AS is_pos,
               rank() OVER (PARTITION BY pairs.a, pairs.b ORDER BY lp.prob)
               + (count(*) OVER (PARTITION BY pairs.a, pairs.b, lp.prob) - 1) / 2.0 AS r
        FROM lp JOIN pairs ON lp.label = pairs.a AND lp.true_label IN (pairs.a, pairs.b)),
ovo_d AS (SELECT a, b, (sum(r) FILTER (WHERE is_pos) - count(*) FILTER (WHERE is_pos)
                        * (count(*) FILTER (WHERE is_pos) + 1) / 2.0)
                       / (count(*) FILTER (WHERE is_pos) * count(*) FILTER (WHERE NOT is_pos)) AS auc
          FROM dmr GROUP BY a, b),
ovo_p AS (SELECT least(a, b) AS label_a, greatest(a, b) AS label_b, avg(auc) AS auc FROM ovo_d GROUP BY 1, 2),
auc AS (SELECT CASE WHEN (SELECT count(*) FROM labels_all) = (SELECT count(DISTINCT true_label) FROM lp)
                         AND (SELECT count(DISTINCT true_label) FROM lp) > 2
                    THEN (SELECT avg(auc) FROM ovr_c) END AS roc_auc_ovr,
               CASE WHEN (SELECT count(*) FROM labels_all) = (SELECT count(DISTINCT true_label) FROM lp)
                         AND (SELECT count(DISTINCT true_label) FROM lp) > 2
                    THEN (SELECT avg(auc) FROM ovo_p) END AS roc_auc_ovo)
"""


SCORER_CTE = scorer_cte(False)


def with_scorer(body: str) -> str:
    return "WITH " + SCORER_CTE.strip() + "\n" + body


def with_scorer_all(body: str) -> str:
    return "WITH " + scorer_cte(True).strip() + "\n" + body


def _r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name}"


OVERALL_NUM = ["accuracy", "balanced_accuracy", "precision_macro", "precision_micro", "precision_weighted",
               "recall_macro", "recall_micro", "recall_weighted", "f1_macro", "f1_micro", "f1_weighted",
               "matthews_corrcoef", "cohen_kappa"]

# OOD twin: reference = hash half of the scored rows, current = the other half
OOD_CTE = f""",
sd AS (SELECT *, substr(md5('{SEED}:ood:' || doc_id), 1, 1) < '8' AS is_ref FROM scored),
fit AS (SELECT CASE WHEN bool_or(isnan(confidence)) THEN CAST('nan' AS DOUBLE)
                    ELSE quantile_cont(confidence, CAST({ALPHA} AS DOUBLE)) END AS threshold,
               count(*) AS reference_samples, avg(confidence) AS mean_confidence,
               stddev_pop(confidence) AS std_confidence, min(confidence) AS min_confidence,
               max(confidence) AS max_confidence FROM sd WHERE is_ref),
cur AS (SELECT sd.*, fit.threshold, (NOT isnan(fit.threshold) AND sd.confidence < fit.threshold) AS is_ood
        FROM sd, fit WHERE NOT sd.is_ref),
st AS (SELECT count(*) AS total_samples, count(*) FILTER (WHERE is_ood) AS ood_count,
              CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE is_ood) / count(*) ELSE 0.0 END AS ood_ratio,
              CASE WHEN count(*) = 0 OR count(*) FILTER (WHERE is_ood) = 0 THEN 'none'
                   WHEN count(*) FILTER (WHERE is_ood) * 10 < count(*) THEN 'low'
                   WHEN count(*) FILTER (WHERE is_ood) * 10 < count(*) * 3 THEN 'medium'
                   ELSE 'high' END AS ood_severity,
              coalesce(avg(confidence), 0.0) AS mean_confidence, coalesce(min(confidence), 0.0) AS min_confidence,
              coalesce(max(confidence), 0.0) AS max_confidence FROM cur)
"""


def _ood_sets(spark, sf):
    ref, cur = ood_reference_and_batch(spark, sf)
    fit = O.ood_fit(ref)
    return ref, cur, fit


# ---------------------------------------------------------------- scoring queries

@register("predict", with_scorer_all("SELECT doc_id, lang, predicted_label_id, predicted_label, "
                                 + _r("confidence", "confidence") + " FROM scored"), bench=True)
def q_predict(spark, sf):
    return rounded(scored_all(spark, sf).drop("probs", "prob_labels"))


@register("softmax_confidence", with_scorer_all("SELECT doc_id, " + _r("max(prob)", "confidence") + ", "
                                            + _r("sum(prob)", "prob_sum") + " FROM p GROUP BY doc_id"))
def q_softmax_confidence(spark, sf):
    s = scored_all(spark, sf)
    return rounded(s.select("doc_id", "confidence",
                            F.aggregate("probs", F.lit(0.0), lambda a, b: a + b).alias("prob_sum")))


@register("predict_probabilities_wide", with_scorer_all(
    "SELECT doc_id, " + ", ".join(
        _r(f"max(prob) FILTER (WHERE label = '{lab}')", prob_column_name(lab)) for lab in ("de", "en", "es", "fr"))
    + " FROM p GROUP BY doc_id"))
def q_predict_probabilities_wide(spark, sf):
    labels = S.model_labels(letter_model(spark, sf))
    w = S.probabilities_wide(scored_all(spark, sf), labels)
    return rounded(w.select("doc_id", *[prob_column_name(x) for x in labels]))


@register("predict_probability_map", with_scorer_all(
    "SELECT doc_id, predicted_label, map_from_entries(list(struct_pack(k := label, v := round(prob, 6)) "
    "ORDER BY label)) AS probabilities FROM p JOIN best USING (doc_id) GROUP BY doc_id, predicted_label"))
def q_predict_probability_map(spark, sf):
    s = scored_all(spark, sf)
    s = s.withColumn("probs", F.transform("probs", lambda x: F.round(x, 6)))
    return S.probability_map(s).select("doc_id", "predicted_label", "probabilities")


@register("argmax_label", with_scorer_all(
    "SELECT doc_id, label FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id "
    "ORDER BY prob DESC, label) AS rk FROM p) r WHERE rk = 1"))
def q_argmax_label(spark, sf):
    """E6 inside the row: no explode, no shuffle."""
    return scored_all(spark, sf).select("doc_id", F.element_at("prob_labels", S.argmax_index(F.col("probs")) + 1).alias("label"))


@register("mark_correct", with_scorer_all("SELECT doc_id, coalesce(lang = predicted_label, false) AS correct FROM scored"))
def q_mark_correct(spark, sf):
    from ..operators.curate import mark_correct
    return mark_correct(scored_all(spark, sf), "lang", "predicted_label").select("doc_id", "correct")


@register("attach_predictions", with_scorer_all(
    "SELECT d.doc_id, d.source, d.n_chars, b.predicted_label FROM documents d JOIN best b USING (doc_id)"))
def q_attach_predictions(spark, sf):
    preds = scored_all(spark, sf).select("doc_id", "predicted_label")
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return docs.join(preds, "doc_id")


@register("label_union", with_scorer("SELECT label FROM labels_all"))
def q_label_union(spark, sf):
    return M.label_set(confusion(spark, sf))


@register("batched_scoring", with_scorer_all("SELECT doc_id, lang, predicted_label_id, predicted_label, "
                                         + _r("confidence", "confidence") + " FROM scored"))
def q_batched_scoring(spark, sf):
    """The same model applied per Arrow batch of 16 rows (rows-only check)."""
    model = letter_model(spark, sf).first().asDict()
    test = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    return rounded(S.score_in_batches(test, model, "text", 16).drop("text"))


@register("tokenize_truncate", "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]{2,}') AS tok "
          "FROM documents) SELECT doc_id, len(tok) AS n_tokens, least(len(tok), 512) AS n_input_tokens, "
          "len(tok) > 512 AS truncated FROM t")
def q_tokenize_truncate(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    t = S.tokenize_truncate(d, "text", 512)
    return t.select("doc_id", "n_tokens", F.size("input_tokens").alias("n_input_tokens"), "truncated")


# ---------------------------------------------------------------- evaluation queries

@register("confusion_counts", with_scorer("SELECT true_label, pred_label, n FROM conf"))
def q_confusion_counts(spark, sf):
    return confusion(spark, sf)


@register("confusion_matrix_dense", with_scorer(
    "SELECT a.label AS true_label, b.label AS pred_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n "
    "FROM labels_all a CROSS JOIN labels_all b LEFT JOIN conf c ON c.true_label = a.label AND c.pred_label = b.label"))
def q_confusion_matrix_dense(spark, sf):
    return M.confusion_matrix_dense(confusion(spark, sf))


@register("per_class_metrics", with_scorer(
    "SELECT label, " + ", ".join(_r(c, c) for c in ("precision", "recall", "f1_score"))
    + ", support, predicted, tp FROM pcm"))
def q_per_class_metrics(spark, sf):
    return rounded(M.per_class_metrics(confusion(spark, sf)))


def _overall_sql(cols):
    return with_scorer("SELECT " + ", ".join(_r(c, c) if c in OVERALL_NUM else c for c in cols) + " FROM overall")


def _overall_query(cols):
    def build(spark, sf):
        return rounded(M.overall_metrics(confusion(spark, sf)).select(*cols))
    return build


for _name, _cols in {
    "accuracy": ["accuracy"],
    "balanced_accuracy": ["balanced_accuracy"],
    "prf_macro": ["precision_macro", "recall_macro", "f1_macro"],
    "prf_micro": ["precision_micro", "recall_micro", "f1_micro"],
    "prf_weighted": ["precision_weighted", "recall_weighted", "f1_weighted"],
    "matthews_corrcoef": ["matthews_corrcoef"],
    "cohen_kappa": ["cohen_kappa"],
    "eval_weighted_summary": ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted"],
}.items():
    register(_name, _overall_sql(_cols))(_overall_query(_cols))


@register("class_distribution", with_scorer(
    "SELECT true_label AS label, CAST(sum(n) AS BIGINT) AS count, (SELECT num_samples FROM overall) AS num_samples, "
    "(SELECT num_classes FROM overall) AS num_classes FROM conf GROUP BY true_label"))
def q_class_distribution(spark, sf):
    conf = confusion(spark, sf)
    o = M.overall_metrics(conf).select("num_samples", "num_classes")
    return M.class_distribution(conf).crossJoin(o)


@register("classification_report", with_scorer(
    "SELECT label, round_even(precision, 4) AS precision, round_even(recall, 4) AS recall, "
    "round_even(f1_score, 4) AS f1_score, support FROM pcm UNION ALL "
    "SELECT 'accuracy', NULL, NULL, round_even(accuracy, 4), num_samples FROM overall UNION ALL "
    "SELECT 'macro avg', round_even(precision_macro, 4), round_even(recall_macro, 4), round_even(f1_macro, 4), "
    "num_samples FROM overall UNION ALL SELECT 'weighted avg', round_even(precision_weighted, 4), "
    "round_even(recall_weighted, 4), round_even(f1_weighted, 4), num_samples FROM overall"))
def q_classification_report(spark, sf):
    return M.classification_report(confusion(spark, sf), digits=4)


@register("metrics_long", with_scorer(
    "SELECT metric, averaging, round(value, 6) AS value FROM (UNPIVOT (SELECT " + ", ".join(OVERALL_NUM)
    + " FROM overall) ON " + ", ".join(OVERALL_NUM) + " INTO NAME name VALUE value) u "
    "JOIN (VALUES " + ", ".join(
        f"('{c}', '{c.rpartition('_')[0] if c.rpartition('_')[2] in ('macro', 'micro', 'weighted') else c}', "
        f"'{c.rpartition('_')[2] if c.rpartition('_')[2] in ('macro', 'micro', 'weighted') else 'none'}')"
        for c in OVERALL_NUM) + ") m(name, metric, averaging) USING (name) "
    "UNION ALL SELECT 'roc_auc', 'ovr', round(roc_auc_ovr, 6) FROM auc WHERE roc_auc_ovr IS NOT NULL "
    "UNION ALL SELECT 'roc_auc', 'ovo', round(roc_auc_ovo, 6) FROM auc WHERE roc_auc_ovo IS NOT NULL"))
def q_metrics_long(spark, sf):
    auc = M.roc_auc(scored_long(spark, sf), confusion(spark, sf), true_labels(spark, sf), row_check=M.probability_row_check(scored_docs(spark, sf)))
    return rounded(M.metrics_long(M.overall_metrics(confusion(spark, sf)), auc))


@register("roc_auc_ovr_per_class", with_scorer("SELECT label, " + _r("auc", "auc") + " FROM ovr_c"))
def q_roc_auc_ovr_per_class(spark, sf):
    from ..operators.auc import ovr_auc
    return rounded(ovr_auc(scored_long(spark, sf), "true_label").select("label", "auc"))


@register("roc_auc_ovr_macro", with_scorer("SELECT " + _r("roc_auc_ovr", "roc_auc_ovr") + " FROM auc"))
def q_roc_auc_ovr_macro(spark, sf):
    return rounded(M.roc_auc(scored_long(spark, sf), confusion(spark, sf), true_labels(spark, sf), row_check=M.probability_row_check(scored_docs(spark, sf)))
                   .select("roc_auc_ovr"))


@register("roc_auc_ovo_pairs", with_scorer("SELECT label_a, label_b, " + _r("auc", "auc") + " FROM ovo_p"))
def q_roc_auc_ovo_pairs(spark, sf):
    from ..operators.auc import ovo_auc
    return rounded(ovo_auc(scored_long(spark, sf), true_labels(spark, sf), "true_label"))


@register("roc_auc_ovo_macro", with_scorer("SELECT " + _r("roc_auc_ovo", "roc_auc_ovo") + " FROM auc"))
def q_roc_auc_ovo_macro(spark, sf):
    return rounded(M.roc_auc(scored_long(spark, sf), confusion(spark, sf), true_labels(spark, sf), row_check=M.probability_row_check(scored_docs(spark, sf)))
                   .select("roc_auc_ovo"))


@register("roc_auc_binary", "WITH j AS (SELECT l.quality = 1 AS is_pos, CAST(d.n_chars AS DOUBLE) AS s "
          "FROM labels l JOIN documents d USING (doc_id)), r AS (SELECT is_pos, rank() OVER (ORDER BY s) + "
          "(count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM j) SELECT round((sum(r) FILTER (WHERE is_pos) - "
          "count(*) FILTER (WHERE is_pos) * (count(*) FILTER (WHERE is_pos) + 1) / 2.0) / "
          "(count(*) FILTER (WHERE is_pos) * count(*) FILTER (WHERE NOT is_pos)), 6) AS auc, "
          "count(*) FILTER (WHERE is_pos) AS n_pos, count(*) FILTER (WHERE NOT is_pos) AS n_neg FROM r")
def q_roc_auc_binary(spark, sf):
    """H15 on the binary fixture: labels.quality (positive = 1, the second sorted label),
    score = documents.n_chars."""
    from ..operators.auc import binary_auc
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    d = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    return rounded(binary_auc(lab.join(d, "doc_id"), "quality", "n_chars", 1))


@register("evaluate", with_scorer("SELECT " + ", ".join(_r(c, c) for c in OVERALL_NUM)
                                  + ", num_samples, num_classes, " + _r("roc_auc_ovr", "roc_auc_ovr") + ", "
                                  + _r("roc_auc_ovo", "roc_auc_ovo") + " FROM overall, auc"), bench=True)
def q_evaluate(spark, sf):
    return rounded(evaluation_row(spark, sf))


@register("misclassified", with_scorer(
    "SELECT doc_id, lang, predicted_label, " + _r("confidence", "confidence")
    + " FROM scored WHERE lang IS DISTINCT FROM predicted_label OR lang IS NULL"))
def q_misclassified(spark, sf):
    return rounded(M.misclassified(scored_docs(spark, sf), "lang", order_key="doc_id"))


@register("top_n_misclassified", with_scorer(
    "SELECT doc_id, lang, predicted_label, " + _r("confidence", "confidence")
    + " FROM scored WHERE lang IS DISTINCT FROM predicted_label OR lang IS NULL "
    "ORDER BY confidence DESC, doc_id LIMIT 5"))
def q_top_n_misclassified(spark, sf):
    return rounded(M.misclassified(scored_docs(spark, sf), "lang", order_key="doc_id", top_n=5))


@register("confidence_calibration", with_scorer("""
, mm AS (SELECT min(confidence) AS mn, max(confidence) AS mx FROM scored WHERE NOT isnan(confidence)),
lim AS (SELECT CASE WHEN mn = mx THEN mn - (CASE WHEN mn <> 0 THEN abs(mn) * 0.001 ELSE 0.001 END) ELSE mn END AS lo,
               CASE WHEN mn = mx THEN mx + (CASE WHEN mx <> 0 THEN abs(mx) * 0.001 ELSE 0.001 END) ELSE mx END AS hi,
               mn = mx AS same FROM mm),
edges AS (SELECT i, CASE WHEN i = 10 THEN hi WHEN i = 0 AND NOT same THEN lo - (hi - lo) * 0.001
                         ELSE CAST(i AS DOUBLE) * ((hi - lo) / 10) + lo END AS e FROM lim, range(0, 11) t(i)),
binned AS (SELECT s.confidence AS x, CAST(coalesce(s.lang = s.predicted_label, false) AS INTEGER) AS ok,
                  (SELECT count(*) FROM edges WHERE e < s.confidence) - 1 AS b FROM scored s
           WHERE s.confidence IS NOT NULL AND NOT isnan(s.confidence))
SELECT CAST(b AS INTEGER) AS confidence_bin, round((SELECT e FROM edges WHERE i = b), 6) AS bin_lower,
       round((SELECT e FROM edges WHERE i = b + 1), 6) AS bin_upper, count(*) AS total_samples,
       CAST(sum(ok) AS BIGINT) AS correct_predictions, round_even(avg(ok), 4) AS accuracy,
       round_even(avg(x), 4) AS avg_confidence FROM binned GROUP BY b"""))
def q_confidence_calibration(spark, sf):
    return rounded(M.confidence_calibration(scored_docs(spark, sf), "lang"))


# ---------------------------------------------------------------- OOD queries

@register("confidence_profile", with_scorer("SELECT count(confidence) AS count, " + _r("coalesce(avg(confidence), 0.0)", "mean_confidence")
                                            + ", " + _r("stddev_pop(confidence)", "std_confidence") + ", "
                                            + _r("coalesce(min(confidence), 0.0)", "min_confidence") + ", "
                                            + _r("coalesce(max(confidence), 0.0)", "max_confidence") + " FROM scored"))
def q_confidence_profile(spark, sf):
    return rounded(O.confidence_profile(scored_docs(spark, sf)))


@register("percentile_threshold", with_scorer(
    "SELECT count(confidence) AS count, " + _r(f"quantile_cont(confidence, CAST({ALPHA} AS DOUBLE))", "percentile")
    + ", bool_or(isnan(confidence)) AS has_nan FROM scored"))
def q_percentile_threshold(spark, sf):
    from ..operators.kernels import exact_percentile
    return rounded(exact_percentile(scored_docs(spark, sf), "confidence", ALPHA))


@register("ood_fit", "WITH " + SCORER_CTE.strip() + OOD_CTE + "SELECT " + ", ".join(
              [_r("threshold", "threshold"), f"CAST({ALPHA} AS DOUBLE) AS alpha", "reference_samples"]
              + [_r(c, c) for c in ("mean_confidence", "std_confidence", "min_confidence", "max_confidence")])
          + " FROM fit")
def q_ood_fit(spark, sf):
    _, _, fit = _ood_sets(spark, sf)
    return rounded(fit)


N_BATCHES = 30
OOD_BATCH_SQL = f"CAST('0x' || substr(md5('{SEED}:ood_batch:' || doc_id), 1, 8) AS BIGINT) % {N_BATCHES}"


def _ood_batches(spark, sf):
    """All scored rows dealt to 30 batches, and their states, saved."""
    from ..session import write_table
    key = F.md5(F.concat_ws(":", F.lit(str(SEED)), F.lit("ood_batch"), F.col("doc_id").cast("string")))
    rows = scored_docs(spark, sf).withColumn("batch", F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(N_BATCHES)))
    return rows, write_table(O.ood_states(rows, O.OODConfig(alpha=ALPHA), ["batch"]), "ood_states")


_FIT_SQL = (f"quantile_cont(confidence, CAST({ALPHA} AS DOUBLE))", "threshold"), ("avg(confidence)", "mean_confidence"), \
    ("stddev_pop(confidence)", "std_confidence"), ("min(confidence)", "min_confidence"), ("max(confidence)", "max_confidence")
_FIT_SQL = f"CAST({ALPHA} AS DOUBLE) AS alpha, count(confidence) AS reference_samples, " + ", ".join(_r(e, n) for e, n in _FIT_SQL)


@register("ood_fit_by_batch", with_scorer(f"SELECT {OOD_BATCH_SQL} AS batch, {_FIT_SQL} FROM scored GROUP BY 1"))
def q_ood_fit_by_batch(spark, sf):
    """I1 for 30 batches in one job, from saved states."""
    rows, states = _ood_batches(spark, sf)
    return rounded(O.ood_fit_from_states(states, rows, O.OODConfig(alpha=ALPHA), ["batch"]))


@register("ood_fit_merged", with_scorer(f"SELECT {_FIT_SQL} FROM scored"))
def q_ood_fit_merged(spark, sf):
    """I1 of the union of 30 batches: their saved states merged, one scan for the exact threshold."""
    rows, states = _ood_batches(spark, sf)
    return rounded(O.ood_fit_from_states(states, rows, O.OODConfig(alpha=ALPHA)))


@register("ood_detect", "WITH " + SCORER_CTE.strip() + OOD_CTE +
          "SELECT cur.doc_id, cur.lang, cur.predicted_label_id, cur.predicted_label, "
          + _r("cur.confidence", "confidence") + ", 'batch_current' AS batch_id, "
          + _r("cur.confidence", "ood_confidence") + ", " + _r("cur.threshold", "threshold")
          + ", st.ood_severity FROM cur, st WHERE cur.is_ood", bench=True)
def q_ood_detect(spark, sf):
    _, cur, fit = _ood_sets(spark, sf)
    flagged, _ = O.ood_detect(cur.drop("probs", "prob_labels"), fit, batch_id="batch_current")
    return rounded(flagged.drop("text", "timestamp"))


@register("ood_stats", "WITH " + SCORER_CTE.strip() + OOD_CTE +
          "SELECT total_samples, ood_count, " + _r("ood_ratio", "ood_ratio") + ", ood_severity, "
          + _r("(SELECT threshold FROM fit)", "threshold") + f", CAST({ALPHA} AS DOUBLE) AS alpha, "
          + ", ".join(_r(c, c) for c in ("mean_confidence", "min_confidence", "max_confidence")) + " FROM st")
def q_ood_stats(spark, sf):
    _, cur, fit = _ood_sets(spark, sf)
    return rounded(O.ood_stats(cur, fit).drop("timestamp"))


@register("ood_severity", "WITH " + SCORER_CTE.strip() + OOD_CTE + "SELECT ood_severity, total_samples, ood_count FROM st")
def q_ood_severity(spark, sf):
    _, cur, fit = _ood_sets(spark, sf)
    return O.ood_stats(cur, fit).select("ood_severity", "total_samples", "ood_count")


@register("ood_batch_ids", "WITH " + SCORER_CTE.strip() + OOD_CTE +
          "SELECT cur.doc_id, cur.predicted_label AS batch_id FROM cur WHERE cur.is_ood")
def q_ood_batch_ids(spark, sf):
    """The batch id comes from a configured column (here the predicted label)."""
    _, cur, fit = _ood_sets(spark, sf)
    cfg = O.OODConfig(batch_id_column="predicted_label")
    flagged, _ = O.ood_detect(cur.drop("probs", "prob_labels"), fit, cfg)
    return flagged.select("doc_id", "batch_id")


@register("ood_by_batch", "WITH " + SCORER_CTE.strip() + OOD_CTE +
          """SELECT predicted_label AS batch_id, count(*) AS total_samples, count(*) FILTER (WHERE is_ood) AS ood_count,
          round(count(*) FILTER (WHERE is_ood) / count(*), 6) AS ood_ratio,
          CASE WHEN count(*) FILTER (WHERE is_ood) = 0 THEN 'none'
               WHEN count(*) FILTER (WHERE is_ood) * 10 < count(*) THEN 'low'
               WHEN count(*) FILTER (WHERE is_ood) * 10 < count(*) * 3 THEN 'medium' ELSE 'high' END AS ood_severity
          FROM cur GROUP BY predicted_label""")
def q_ood_by_batch(spark, sf):
    """Severity per batch (batches = predicted label groups)."""
    _, cur, fit = _ood_sets(spark, sf)
    cfg = O.OODConfig(batch_id_column="predicted_label")
    _, stats = O.ood_detect(cur.drop("probs", "prob_labels"), fit, cfg, scope="batch")
    return rounded(stats.select("batch_id", "total_samples", "ood_count", "ood_ratio", "ood_severity"))


@register("ood_empty_result", with_scorer(
    "SELECT doc_id, lang, text, predicted_label_id, predicted_label, confidence, 'batch_current' AS batch_id, "
    "confidence AS ood_confidence, CAST(0.0 AS DOUBLE) AS threshold, 'none' AS ood_severity FROM scored WHERE false"))
def q_ood_empty_result(spark, sf):
    """A reference equal to the batch at alpha=0 flags nothing -> empty frame, same schema."""
    _, cur, _ = _ood_sets(spark, sf)
    cur = cur.drop("probs", "prob_labels")
    fit = O.ood_fit(cur, O.OODConfig(alpha=0.0))
    flagged, _ = O.ood_detect(cur, fit, batch_id="batch_current")
    return flagged.drop("timestamp")


@register("align_probabilities", with_scorer_all(
    "SELECT doc_id AS id, s.lang AS true_label, p.label, round(p.prob, 6) AS prob FROM p JOIN scored s USING (doc_id)"))
def q_align_probabilities(spark, sf):
    """``prob_<label>`` columns matched to the sorted true labels and unpivoted to long
    form (None when a label has no column: the AUC is then skipped)."""
    labels = sorted(S.model_labels(letter_model(spark, sf)))
    wide = S.probabilities_wide(scored_all(spark, sf), S.model_labels(letter_model(spark, sf)))
    lng = S.probabilities_from_wide(wide, "doc_id", labels, "lang")
    return rounded(lng.select(F.col("doc_id").alias("id"), F.col("lang").alias("true_label"), "label", "prob"))
