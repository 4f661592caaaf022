"""Training and scoring as Spark jobs.

The built-in scorer is a length-normalised letter naive Bayes over the WHOLE text: per
document, the counts of each ALPHABET letter; per class, Laplace-smoothed letter
log-likelihoods learned by one aggregation. A document's class score is
``log prior + evidence_scale * (sum_a count_a * loglik[class][a]) / letters``; probabilities
are the softmax of the scores. ``evidence_scale`` sets how sharp the probabilities are.

Scale: the model is a one-row aggregate (classes x letters numbers) attached to every row
with a broadcast of exactly one row; scoring is then a pure projection (no shuffle), the
per-class loop runs inside higher-order functions on the JVM.

Other scorers plug in through the same output contract (``Scorer`` protocol):
MLlib pipelines (``fit_mllib_text_classifier``) and Python models applied per Arrow batch
(``score_in_batches``).
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import prob_column_name
from ..functions.text import ALPHABET, WORD_PATTERN
from ..session import prepare_udfs
from .curate import drop_null_text

DEFAULT_EVIDENCE_SCALE = 3.0
PRED_COLS = ("predicted_label_id", "predicted_label", "confidence")


class Scorer(Protocol):
    """M1: anything that adds ``predicted_label_id``, ``predicted_label``, ``confidence``."""

    def transform(self, df: DataFrame) -> DataFrame: ...


# ------------------------------------------------------------------ letter naive Bayes

def fit_letter_nb(train: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """G6 (built-in scorer): fit eagerly (like an MLlib ``fit``) and return the one-row model
    ``nb_labels, nb_log_prior, nb_loglik`` as a local DataFrame.

    Work: one pass over the training texts with partial aggregation per class; the fitted model is
    classes x letters numbers (its size depends on the label set alone), so every later plan embeds
    it instead of re-training.
    """
    prepare_udfs(train.sparkSession)
    plan = _letter_nb_plan(train, text_col, label_col)
    row = plan.first()
    if row is None or row["nb_labels"] is None:
        raise ValueError("no labelled training rows")
    return train.sparkSession.createDataFrame([row], plan.schema)


def _letter_nb_plan(train: DataFrame, text_col: str, label_col: str) -> DataFrame:
    v = len(ALPHABET)
    base = train.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    per_doc = base.select(F.col(label_col).cast("string").alias("_label"),
                          letter_counts_udf(F.col(text_col)).alias("_cnt"))
    # one scan, one partial aggregation of all letters: nothing is exploded
    per_class = per_doc.groupBy("_label").agg(
        F.count(F.lit(1)).alias("_docs"), F.array(*[F.sum(F.col("_cnt")[i]) for i in range(v)]).alias("_counts"))
    per_class = per_class.select(
        "_label", "_docs",
        F.transform("_counts", lambda n: F.log((n + F.lit(1)).cast("double") /
                                              (F.aggregate("_counts", F.lit(0).cast("long"),
                                                           lambda a, b: a + b) + F.lit(v))))
        .alias("_ll"))
    model = per_class.agg(F.array_sort(F.collect_list(F.struct("_label", "_docs", "_ll"))).alias("_m"),
                          F.sum("_docs").alias("_total"))
    return model.select(
        F.transform("_m", lambda s: s["_label"]).alias("nb_labels"),
        F.transform("_m", lambda s: F.log(s["_docs"] / F.col("_total"))).alias("nb_log_prior"),
        F.transform("_m", lambda s: s["_ll"]).alias("nb_loglik"))


_LETTER_OF = np.full(max(map(ord, ALPHABET)) + 2, -1, np.int64)  # the last entry: any other character
for _i, _a in enumerate(ALPHABET):
    _LETTER_OF[ord(_a)] = _i


PIECE_CHARS = 1 << 18  # characters that the arrays of one step cover


def _count_matrix(texts: pd.Series) -> np.ndarray:
    """rows x letters counts over whole lower-cased texts: one table lookup per character and one
    ``bincount`` per piece of at most PIECE_CHARS characters (a longer text takes several), so the
    arrays stay small whatever the batch holds."""
    counts = np.zeros((len(texts), len(ALPHABET)), np.int64)
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        low = text.lower()
        for at in range(0, len(low), PIECE_CHARS):
            part = low[at:at + PIECE_CHARS]
            if size + len(part) > PIECE_CHARS:
                counts[rows] += _count_piece(parts)
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        counts[rows] += _count_piece(parts)
    return counts


def _count_piece(parts: list[str]) -> np.ndarray:
    chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER_OF[np.minimum(chars, len(_LETTER_OF) - 1)]
    row = np.repeat(np.arange(len(parts)), [len(t) for t in parts])
    known = letter >= 0
    v = len(ALPHABET)
    return np.bincount(row[known] * v + letter[known], minlength=len(parts) * v).reshape(len(parts), v)


@F.pandas_udf(T.ArrayType(T.LongType()))
def letter_counts_udf(texts: pd.Series) -> pd.Series:
    """Per-document letter counts (feature extraction of the letter model), Arrow-batched.

    Measured: 49 JVM ``replace`` passes ran at ~11 M chars/s per core on these texts; one
    vectorised batch pass here is several times faster."""
    m = _count_matrix(texts.fillna(""))
    return pd.Series(list(m))


def nb_probabilities(counts: np.ndarray, log_prior: np.ndarray, loglik: np.ndarray,
                     evidence_scale: float) -> np.ndarray:
    """Softmax of ``log prior + scale * counts . loglik / letters`` for a batch."""
    letters = np.maximum(counts.sum(axis=1), 1).astype(float)
    scores = log_prior[None, :] + evidence_scale * (counts @ loglik.T) / letters[:, None]
    scores -= scores.max(axis=1, keepdims=True)
    probs = np.exp(scores)
    return probs / probs.sum(axis=1, keepdims=True)


def nb_scoring_udf(model_row: dict, evidence_scale: float):
    """Scalar pandas UDF text -> struct(predicted_label_id, confidence, probs).

    The fitted model (classes x letters numbers) travels in the
    closure; each Arrow batch is one matrix product."""
    prior = np.asarray(model_row["nb_log_prior"], dtype=float)
    loglik = np.asarray(model_row["nb_loglik"], dtype=float)
    out_type = T.StructType([T.StructField("pid", T.IntegerType()),
                             T.StructField("confidence", T.DoubleType()),
                             T.StructField("probs", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(out_type)
    def score(texts: pd.Series) -> pd.DataFrame:
        probs = nb_probabilities(_count_matrix(texts.fillna("")), prior, loglik, evidence_scale)
        pid = probs.argmax(axis=1)  # first maximum on ties
        return pd.DataFrame({"pid": pid.astype("int32"), "confidence": probs.max(axis=1),
                             "probs": list(probs)})

    return score


def argmax_index(values: Column) -> Column:
    """0-based index of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def predict(df: DataFrame, model: DataFrame, text_col: str = "text",
            evidence_scale: float = DEFAULT_EVIDENCE_SCALE, keep_probs: bool = True) -> DataFrame:
    """G1: input columns + ``predicted_label_id``, ``predicted_label``, ``confidence`` and the
    aligned ``probs`` array / ``prob_labels`` (canonical inner form). Null texts are dropped
    first (rule N6). A pure projection: no shuffle."""
    prepare_udfs(df.sparkSession)
    base = drop_null_text(df, text_col)
    cols = base.columns
    row = model.first().asDict()
    labels = list(row["nb_labels"])
    udf = nb_scoring_udf(row, evidence_scale)
    lab_arr = F.array(*[F.lit(x) for x in labels])
    j = base.withColumn("_r", udf(F.col(text_col)))
    out = j.select(*cols,
                   F.col("_r.pid").alias("predicted_label_id"),
                   F.element_at(lab_arr, F.col("_r.pid") + 1).alias("predicted_label"),
                   F.col("_r.confidence").alias("confidence"),
                   F.col("_r.probs").alias("probs"),
                   lab_arr.alias("prob_labels"))
    return out if keep_probs else out.drop("probs", "prob_labels")


class LetterScorer:
    """M1: the built-in scorer behind the common contract."""

    def __init__(self, model: DataFrame, text_col: str = "text", evidence_scale: float = DEFAULT_EVIDENCE_SCALE):
        self.model, self.text_col, self.evidence_scale = model, text_col, evidence_scale

    def transform(self, df: DataFrame) -> DataFrame:
        return predict(df, self.model, self.text_col, self.evidence_scale)


class PipelineScorer:
    """M1: a fitted MLlib pipeline, or a folder it was saved to, behind the same contract."""

    def __init__(self, model: PipelineModel | str, text_col: str = "text"):
        self.model, self.text_col = load_model(model) if isinstance(model, str) else model, text_col

    def transform(self, df: DataFrame) -> DataFrame:
        return mllib_predict(self.model, df, self.text_col)


def model_labels(model: DataFrame) -> list[str]:
    """The (bounded) class list of a fitted model, for column naming on the driver."""
    return list(model.select("nb_labels").first()[0])


def probabilities_wide(scored: DataFrame, labels: list[str]) -> DataFrame:
    """One ``prob_<label>`` column per class (names per B12)."""
    return scored.select(*[c for c in scored.columns if c not in ("probs", "prob_labels")],
                         *[F.col("probs")[i].alias(prob_column_name(lab)) for i, lab in enumerate(labels)])


def probability_map(scored: DataFrame) -> DataFrame:
    """``{label: probability}`` next to the prediction."""
    return scored.withColumn("probabilities", F.map_from_arrays("prob_labels", "probs")) \
                 .drop("probs", "prob_labels")


def probabilities_long(scored: DataFrame, id_col: str, true_col: str | None = None) -> DataFrame:
    """Long form ``(id, [true], label, prob)`` — the shape the AUC kernels consume."""
    keep = [id_col] + ([true_col] if true_col else [])
    z = scored.select(*keep, F.explode(F.arrays_zip(F.col("prob_labels").alias("label"),
                                                    F.col("probs").alias("prob"))).alias("_z"))
    return z.select(*keep, F.col("_z.label").alias("label"), F.col("_z.prob").alias("prob"))


def probabilities_from_wide(df: DataFrame, id_col: str, labels: list[str],
                            true_col: str | None = None) -> DataFrame:
    """Unpivot ``prob_<label>`` columns (matched to sorted labels) to long form.

    Returns None when a label has no column (the reference then skips the AUC)."""
    cols = {lab: prob_column_name(lab) for lab in labels}
    if any(c not in df.columns for c in cols.values()):
        return None
    keep = [id_col] + ([true_col] if true_col else [])
    stacked = df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(lab).alias("label"), F.col(c).cast("double").alias("prob"))
        for lab, c in cols.items()])).alias("_s"))
    return stacked.select(*keep, "_s.label", "_s.prob")


# ------------------------------------------------------------------ Python scorers per batch

def score_in_batches(df: DataFrame, model_row: dict, text_col: str = "text",
                     batch_size: int = 16, evidence_scale: float = DEFAULT_EVIDENCE_SCALE) -> DataFrame:
    """The same scorer applied in fixed-size batches inside ``mapInPandas`` (Arrow).

    This is the adapter shape for any per-batch Python model (M1); Spark partitions the work,
    numpy does one matrix product per batch. ``model_row`` is the collected one-row model.
    """
    labels = list(model_row["nb_labels"])
    prior = np.asarray(model_row["nb_log_prior"], dtype=float)
    loglik = np.asarray(model_row["nb_loglik"], dtype=float)  # classes x letters
    prepare_udfs(df.sparkSession)
    base = drop_null_text(df, text_col)
    schema = T.StructType(base.schema.fields + [
        T.StructField("predicted_label_id", T.IntegerType()),
        T.StructField("predicted_label", T.StringType()),
        T.StructField("confidence", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size].copy()
                probs = nb_probabilities(_count_matrix(part[text_col]), prior, loglik, evidence_scale)
                pid = probs.argmax(axis=1)
                part["predicted_label_id"] = pid.astype("int32")
                part["predicted_label"] = [labels[i] for i in pid]
                part["confidence"] = probs.max(axis=1)
                yield part

    return base.mapInPandas(run, schema)


# ------------------------------------------------------------------ MLlib pipelines

def fit_mllib_text_classifier(train: DataFrame, text_col: str = "text", label_col: str = "category",
                              weight_col: str | None = None, num_features: int = 1 << 18,
                              max_iter: int = 50) -> PipelineModel:
    """Tokenizer -> hashed TF -> IDF -> multinomial logistic regression.

    ``weight_col`` carries the balanced class weights of C7 (weighted loss)."""
    base = train.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    # labels are indexed outside the pipeline: rows without a known label are scored like any other
    indexer = StringIndexer(inputCol=label_col, outputCol="_label_idx", stringOrderType="alphabetAsc").fit(base)
    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=WORD_PATTERN, gaps=False,
                       toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label_idx", family="multinomial",
                           maxIter=max_iter, probabilityCol="_probability",
                           predictionCol="_prediction", rawPredictionCol="_raw",
                           **({"weightCol": weight_col} if weight_col else {})),
    ]
    fitted = Pipeline(stages=stages).fit(indexer.transform(base))
    names = IndexToString(inputCol="_prediction", outputCol="_predicted", labels=indexer.labels)
    return PipelineModel([*fitted.stages, names])


def mllib_predict(model: PipelineModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    """Scorer adapter for a fitted pipeline: the standard prediction columns, a row for every row
    with a text."""
    base = drop_null_text(df, text_col)
    probs = vector_to_array("_probability")
    return model.transform(base).select(*base.columns, F.col("_prediction").cast("int").alias("predicted_label_id"),
                                        F.col("_predicted").alias("predicted_label"), F.array_max(probs).alias("confidence"))


def save_model(model: PipelineModel, path: str) -> str:
    """Persist a fitted pipeline (overwrite)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """A11."""
    return PipelineModel.load(path)


def tokenize_truncate(df: DataFrame, text_col: str = "text", max_length: int = 512) -> DataFrame:
    """Word tokens of the whole text, plus the model-input window of ``max_length`` tokens
    (truncation is the feature: a fixed-size model input); ``n_tokens`` counts them all."""
    toks = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD_PATTERN), 0)
    return df.withColumn("_tok", toks).withColumns({
        "n_tokens": F.size("_tok"),
        "input_tokens": F.slice("_tok", 1, max_length),
        "truncated": F.size("_tok") > max_length}).drop("_tok")
