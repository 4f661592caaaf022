"""Text drift between a reference corpus and a current batch.

Corpora are one DataFrame tagged ``side`` in {'ref', 'cur'} with a document id and the text.

* TF-IDF (J5): word tokens of the whole text, English stop words removed, terms in more than
  half of the documents dropped, sublinear tf ``1 + ln tf``, smoothed idf
  ``ln((1 + n) / (1 + df)) + 1``, L2-normalised per document (the published vectoriser rules).
* Domain classifier (J6, J7, J8): documents are split into train and held-out halves by hash;
  the classifier is a smoothed per-term log-odds of document frequency (current vs reference)
  learned on the train half; a held-out document's score is its TF-IDF-weighted log-odds sum;
  the drift score is the held-out ROC-AUC, compared with the 95th percentile of the AUC of a
  random scorer, in closed form from the Mann-Whitney null: 0.5 + z * sqrt((m+n+1) / (12 m n)).
  The 1,000 simulated random scorers are ``simulated_auc_threshold``, the L1 linear model on the
  full vocabulary is ``drift_linear.py``; an MLlib variant is ``domain_classifier_mllib``.
* Text features (J18-J21) and the per-feature drift share (J22) use the ECDF distance kernel.

All heavy steps are explode + aggregate (partial aggregation map-side) and equi joins on the
term; skewed terms are the stop words and the >50% terms, which are removed first.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_half, safe_div
from ..functions.text import STOP_WORDS, WORD_PATTERN, non_letter_share, sentence_count
from . import term_blocks as TB
from .auc import auc_from_counts
from .kernels import ecdf_distance, exact_percentile

Z_95 = 1.6448536269514722  # fixed value: standard normal 95th percentile


def tag_sides(reference: DataFrame, current: DataFrame) -> DataFrame:
    """One pooled corpus, ``side`` = 'ref' | 'cur' (``unionByName``)."""
    return reference.withColumn("side", F.lit("ref")).unionByName(current.withColumn("side", F.lit("cur")))


def with_side(df: DataFrame, is_reference) -> DataFrame:
    """A10 in one scan: ``side`` = 'ref' where the condition holds, else 'cur' (null counts as false)."""
    return df.withColumn("side", F.when(is_reference, F.lit("ref")).otherwise(F.lit("cur")))


def doc_terms(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              stop_words: list[str] | None = None) -> DataFrame:
    """``(id, side, term, tf)`` over whole texts, stop words removed."""
    sw = STOP_WORDS if stop_words is None else stop_words
    toks = corpus.select(id_col, "side", F.explode(F.regexp_extract_all(
        F.lower(F.coalesce(F.col(text_col), F.lit("None"))), F.lit(WORD_PATTERN), 0)).alias("term"))
    toks = toks.filter(~F.col("term").isin(sw)) if sw else toks
    return toks.groupBy(id_col, "side", "term").agg(F.count(F.lit(1)).alias("tf"))


def _reliable(df: DataFrame, name: str = "terms") -> DataFrame:
    """Materialise a table consumed by several branches as Parquet in the shared folder
    (reliable storage; cuts the lineage so the tokenisation is not redone per branch)."""
    from ..session import write_table
    return write_table(df, name)


SALTS = 16
HOT_SHARE = 1000  # a key with more than a thousandth of the rows is hot, so there are fewer than that


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys that hold more than 1 / HOT_SHARE of ``rows`` (a written table): at most HOT_SHARE."""
    counts = _reliable(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "key_counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return _reliable(counts.where(F.col("_n") * HOT_SHARE > total).select(key), "hot_keys")


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, spread_by: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Join on ``key`` when few keys hold many of ``rows``: the rows of each hot key (``hot_keys`` of
    ``rows`` unless given) are spread over ``SALTS`` tasks by ``spread_by`` and its one row of
    ``keyed`` is repeated for each; all other keys join as they are."""
    hot = F.broadcast((hot_keys(rows, key) if hot is None else hot).withColumn("_hot", F.lit(True)))  # at most HOT_SHARE rows
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, key, "left").withColumn("_salt", spread).drop("_hot")
    right = keyed.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def doc_words(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, side, term, n)``: words of each text with counts, before anything is joined."""
    return corpus.select(id_col, "side", F.explode(F.regexp_extract_all(
        F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD_PATTERN), 0)).alias("term")) \
        .groupBy(id_col, "side", "term").agg(F.count(F.lit(1)).alias("n"))


def tfidf_features(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_df: float = 0.5, stop_words: list[str] | None = None, terms: DataFrame | None = None) -> DataFrame:
    """``(id, side, term, weight)``; weights L2-normalised per document. ``terms``: the written
    ``doc_terms`` of the corpus, if there are some already (a fitted reference)."""
    terms = _reliable(doc_terms(corpus, id_col, text_col, stop_words), "doc_terms") if terms is None else terms
    n_docs = corpus.agg(F.count(F.lit(1)).alias("_n"))
    df_t = terms.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).crossJoin(F.broadcast(n_docs))
    heavy = F.col("_df") > F.lit(max_df) * F.col("_n")
    # at most (distinct terms of a mean document) / max_df terms are that frequent: a short list by
    # proof; their rows go before anything is shuffled by term
    terms = terms.join(F.broadcast(df_t.filter(heavy).select("term")), "term", "left_anti")
    idf = df_t.filter(~heavy).select("term", (F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1).alias("_idf"))
    w = salted_join(terms, idf, "term", id_col).select(id_col, "side", "term",
                                       ((1 + F.log(F.col("tf").cast("double"))) * F.col("_idf")).alias("_w"))
    norm = w.groupBy(id_col, "side").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return w.join(norm, [id_col, "side"]).select(id_col, "side", "term", (F.col("_w") / F.col("_norm")).alias("weight"))


def random_auc_threshold(n_pos, n_neg, z: float = Z_95):
    """95th percentile of the AUC of a random scorer with m positives and n negatives."""
    if isinstance(n_pos, (int, float)):
        return 0.5 + z * math.sqrt((n_pos + n_neg + 1) / (12.0 * n_pos * n_neg))
    return F.lit(0.5) + F.lit(z) * F.sqrt((n_pos + n_neg + 1) / (F.lit(12.0) * n_pos * n_neg))


def random_auc_simulation(test_docs: DataFrame, id_col: str = "doc_id", n_sim: int = 1000, seed: int = 42, positive: str = "cur") -> DataFrame:
    """J8 simulated: ``(sim, auc)`` of ``n_sim`` classifiers that score held-out documents at random.

    A document's score in a simulation is one byte of an md5, so every md5 serves 16 simulations; a
    task adds up positives and negatives per (simulation, byte) and these counts are all that leaves
    it. Ties count one half. No sort, and the work grows with documents x simulations only."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    from ..session import prepare_udfs
    prepare_udfs(test_docs.sparkSession)
    rounds = -(-n_sim // 16)

    def run(batches):
        counts = np.zeros((2, n_sim, 256), np.int64)
        column = 256 * np.arange(n_sim)
        for batch in batches:
            for name, pos in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = b"".join([hashlib.md5(f"{seed}:random:{r}:{name}".encode()).digest() for r in range(rounds)])
                counts[int(pos)].reshape(-1)[column + np.frombuffer(raw, np.uint8)[:n_sim]] += 1
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(n_sim), pa.int32()), *(pa.array(list(c), pa.list_(pa.int64())) for c in counts[::-1])],
                                             ["sim", "pos", "neg"])

    part = test_docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), (F.col("side") == positive).alias("p")).mapInArrow(
        run, "sim int, pos array<long>, neg array<long>")
    per = part.select("sim", F.posexplode(F.arrays_zip("pos", "neg")).alias("byte", "c")).groupBy("sim", "byte").agg(
        F.sum("c.pos").alias("pos"), F.sum("c.neg").alias("neg"))
    from pyspark.sql import Window
    below = F.sum("neg").over(Window.partitionBy("sim").orderBy("byte").rowsBetween(Window.unboundedPreceding, -1))  # 256 rows a simulation
    u = per.withColumn("u", F.col("pos") * (F.coalesce(below, F.lit(0)) + F.col("neg") / 2))
    both = F.sum("pos").cast("double") * F.sum("neg")
    return u.groupBy("sim").agg(F.when(both > 0, F.sum("u") / both).alias("auc"))


def simulated_auc_threshold(test_docs: DataFrame, id_col: str = "doc_id", n_sim: int = 1000, seed: int = 42, q: float = 0.95) -> DataFrame:
    """One row ``n_pos, n_neg, closed_form, simulated``: both forms of the random-AUC threshold."""
    sims = random_auc_simulation(test_docs, id_col, n_sim, seed).agg(F.percentile("auc", q).alias("simulated"))  # n_sim numbers
    n = test_docs.agg(F.count_if(F.col("side") == "cur").alias("n_pos"), F.count_if(F.col("side") == "ref").alias("n_neg"))
    closed = F.when(F.col("n_pos") * F.col("n_neg") > 0, random_auc_threshold(F.col("n_pos").cast("double"), F.col("n_neg").cast("double")))
    return n.crossJoin(sims).select("n_pos", "n_neg", closed.alias("closed_form"), "simulated")


def term_log_odds(weights: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Smoothed log-odds of a term's document frequency, current vs reference."""
    docs = weights.select(id_col, "side").distinct().groupBy("side").agg(F.count(F.lit(1)).alias("_n"))
    n = docs.agg(F.sum(F.when(F.col("side") == "cur", F.col("_n"))).alias("_ncur"),
                 F.sum(F.when(F.col("side") == "ref", F.col("_n"))).alias("_nref"))
    dft = weights.groupBy("term").agg(F.count_if(F.col("side") == "cur").alias("_dcur"),
                                      F.count_if(F.col("side") == "ref").alias("_dref"))
    lo = F.log((F.col("_dcur") + 1) / (F.coalesce(F.col("_ncur"), F.lit(0)) + 2)) - \
        F.log((F.col("_dref") + 1) / (F.coalesce(F.col("_nref"), F.lit(0)) + 2))
    return dft.crossJoin(F.broadcast(n)).select("term", lo.alias("log_odds"), F.col("_dcur").alias("df_cur"),
                                                F.col("_dref").alias("df_ref"))


def held_out_auc(scored: DataFrame) -> DataFrame:
    """One row ``roc_auc, threshold, drift_detected, n_ref_test, n_cur_test`` from (side, score, copies)
    of the held-out documents; empty if there are none."""
    # scores rounded to 12 places: sums of the same terms in another order must tie, not flip
    is_pos = F.col("side") == F.lit("cur")
    counts = scored.groupBy(F.round("score", 12).alias("score")).agg(
        F.sum(F.when(is_pos, F.col("copies")).otherwise(0)).alias("pos"), F.sum(F.when(is_pos, 0).otherwise(F.col("copies"))).alias("neg"))
    auc = auc_from_counts(_reliable(counts.withColumn("_g", F.lit(0)), "held_out_scores"), ["_g"])
    thr = random_auc_threshold(F.col("n_pos").cast("double"), F.col("n_neg").cast("double"))
    return auc.select(F.col("auc").alias("roc_auc"), thr.alias("threshold"),
                      F.coalesce(F.col("auc") > thr, F.lit(False)).alias("drift_detected"),
                      F.col("n_neg").alias("n_ref_test"), F.col("n_pos").alias("n_cur_test"))


def domain_classifier(corpus: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", seed: int = 42,
                      max_df: float = 0.5, blocks: TB.TermBlocks | None = None) -> DataFrame:
    """J6 + J7 + J8: one row ``roc_auc, threshold, drift_detected, n_ref_test, n_cur_test``.

    The features are those of ``tfidf_features``, the model that of ``term_log_odds``; documents stay in
    the blocks of ``term_blocks`` and only statistics of terms move. ``blocks``: the blocks of the corpus,
    if there are some already (a fitted reference). Empty held-out sides give a null AUC and no drift."""
    blocks = TB.term_blocks(corpus, id_col, text_col, seed) if blocks is None else blocks
    n_docs = blocks.docs.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    idf, heavy = TB.idf_table(blocks, n_docs, max_df)
    known = F.col("id").isNotNull()  # a document without an id has no features, but its terms count
    trained = blocks.docs.where(F.col("train") & known)
    n = {r["side"]: r["count"] for r in trained.where(F.size("codes") > 0).groupBy("side").count().collect()}
    for r in TB.heavy_counts(trained, blocks, heavy, []).groupBy("side").count().collect():
        n[r["side"]] -= r["count"]
    odds = F.log((F.col("tr_cur") + 1) / F.lit(n.get("cur", 0) + 2)) - F.log((F.col("tr_ref") + 1) / F.lit(n.get("ref", 0) + 2))
    x = F.when(F.col("tr_cur") + F.col("tr_ref") > 0, odds)
    values = blocks.local(idf.select("term", "idf", x.alias("x")), "held")
    held = blocks.docs.where(~F.col("train"))
    scored = TB.tfidf_scores(held.where(known), values)
    return held_out_auc(scored.unionByName(held.where(~known).select("side", F.lit(0.0).alias("score"), "copies")))


def characteristic_words(corpus: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                         max_df: float = 0.5) -> DataFrame:
    """The k terms most typical of each side (highest / lowest log-odds)."""
    from pyspark.sql import Window
    w = tfidf_features(corpus, id_col, text_col, max_df)
    lo = term_log_odds(w, id_col)
    both = lo.select(F.lit("cur").alias("side"), "term", F.col("log_odds").alias("typicality")).unionByName(
        lo.select(F.lit("ref").alias("side"), "term", (-F.col("log_odds")).alias("typicality")))
    win = Window.partitionBy("side").orderBy(F.desc("typicality"), F.asc("term"))
    return both.withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= k)


def domain_classifier_mllib(corpus: DataFrame, text_col: str = "text", seed: int = 42, num_features: int = 1 << 18):
    """J6 (MLlib form): stop words, hashed term counts (every term lands in one of ``num_features``
    slots, none is dropped), IDF, L2 normaliser and an
    L1-penalised logistic regression trained on the hash-train half; returns the held-out
    AUC from ``BinaryClassificationEvaluator``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer, StopWordsRemover
    data = corpus.withColumn("_y", (F.col("side") == "cur").cast("double"))
    is_train = hash_half(seed, "domain", "doc_id")
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=WORD_PATTERN, gaps=False),
        StopWordsRemover(inputCol="_tok", outputCol="_tok2", stopWords=STOP_WORDS),
        HashingTF(inputCol="_tok2", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", elasticNetParam=1.0, regParam=1e-4, maxIter=50)])
    model = pipe.fit(data.filter(is_train))
    pred = model.transform(data.filter(~is_train))
    auc = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="_y").evaluate(pred)
    return auc


# ------------------------------------------------------------------ text features

FEATURES = ["text_length", "word_count", "sentence_count", "non_letter_share"]


def text_features(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """Per-text length, word count, sentence count, non-letter share (whole texts)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return corpus.select("*", F.length(t).cast("double").alias("text_length"),
                         F.size(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+"), 0)).cast("double").alias("word_count"),
                         sentence_count(t).cast("double").alias("sentence_count"),
                         non_letter_share(t).alias("non_letter_share"))


def features_long(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    f = text_features(corpus, text_col)
    arr = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in FEATURES])
    return f.select(id_col, "side", F.explode(arr).alias("_f")).select(id_col, "side", "_f.feature", "_f.value")


def text_oov_share(corpus: DataFrame, vocabulary: DataFrame | None = None, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per document, share of word tokens outside the vocabulary (default: the words of
    the reference side). Anti/left join on the term (a shuffle join; no size assumption)."""
    toks = _reliable(doc_words(corpus, id_col, text_col), "doc_words")
    vocab = vocabulary if vocabulary is not None else toks.filter(F.col("side") == "ref").select("term")
    j = salted_join(toks, vocab.select("term").distinct().withColumn("_in", F.lit(1)), "term", id_col, "left")
    return j.groupBy(id_col, "side").agg(F.sum("n").alias("n_words"),
                                         F.coalesce(F.sum(F.when(F.col("_in").isNull(), F.col("n"))), F.lit(0)).alias("n_oov")) \
        .withColumn("oov_share", safe_div("n_oov", "n_words"))


def text_sentiment(corpus: DataFrame, lexicon: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Mean lexicon score of a document's words found in ``lexicon(term, score)``;
    documents without a lexicon word get 0."""
    words = _reliable(doc_words(corpus, id_col, text_col), "doc_words")
    j = salted_join(words, lexicon.select("term", "score"), "term", id_col)
    s = j.groupBy(id_col).agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("sentiment"))
    return corpus.select(id_col, "side").join(s, id_col, "left").fillna(0.0, ["sentiment"])


def lexicon_from_labels(docs: DataFrame, labels: DataFrame, label_col: str = "toxic",
                        id_col: str = "doc_id", min_df: int = 1) -> DataFrame:
    """A lexicon learned from labelled documents: per term, smoothed log-odds of appearing in
    label-0 vs label-1 documents (positive = associated with label 0)."""
    j = docs.join(labels.select(id_col, label_col), id_col)
    terms = j.select(id_col, label_col, F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower(F.col("text")), F.lit(WORD_PATTERN), 0))).alias("term"))
    n = j.agg(F.count_if(F.col(label_col) == 0).alias("_n0"), F.count_if(F.col(label_col) == 1).alias("_n1"))
    d = terms.groupBy("term").agg(F.count_if(F.col(label_col) == 0).alias("_d0"),
                                  F.count_if(F.col(label_col) == 1).alias("_d1"))
    d = d.filter(F.col("_d0") + F.col("_d1") >= min_df).crossJoin(F.broadcast(n))
    return d.select("term", (F.log((F.col("_d0") + 1) / (F.col("_n0") + 2))
                             - F.log((F.col("_d1") + 1) / (F.col("_n1") + 2))).alias("score"))


def text_overview(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per side and feature: count, mean, population std, median (exploratory only)."""
    f = features_long(corpus, id_col, text_col)
    stats = f.groupBy("side", "feature").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
                                             F.stddev_pop("value").alias("std"))
    med = exact_percentile(f, "value", 0.5, ["side", "feature"]).select("side", "feature", F.col("percentile").alias("median"))
    return stats.join(med, ["side", "feature"])


def dataset_drift_share(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        threshold: float = 0.1, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Per feature, Wasserstein distance normalised by the reference std (drifted when
    >= threshold); returns (per-feature rows, one row with the drifted share and the dataset
    flag = share >= 0.5). Stored as details only; never votes."""
    f = features_long(corpus, id_col, text_col)
    wd = ecdf_distance(f, ["feature"], "value")
    sd = f.filter(F.col("side") == "ref").groupBy("feature").agg(F.stddev_pop("value").alias("ref_std"))
    per = wd.join(sd, "feature").withColumn(
        "distance", F.when(F.col("ref_std") > 0, F.col("wasserstein") / F.col("ref_std")).otherwise(F.col("wasserstein")))
    per = per.withColumn("drifted", F.col("distance") >= F.lit(threshold))
    overall = per.agg(F.count(F.lit(1)).alias("number_of_columns"),
                      F.count_if("drifted").alias("number_of_drifted_columns"))
    overall = overall.withColumn("share_of_drifted_columns",
                                 safe_div("number_of_drifted_columns", "number_of_columns")) \
        .withColumn("dataset_drift", F.col("share_of_drifted_columns") >= F.lit(share))
    return per.select("feature", "wasserstein", "ref_std", "distance", "drifted"), overall
