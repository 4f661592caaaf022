"""Memory of Python workers does not grow with the rows of a partition or the length of texts."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelflow.functions.text import ALPHABET
from labelflow.operators import drift as DR
from labelflow.operators import drift_batches as DB
from labelflow.operators import drift_embed as DE
from labelflow.operators import scoring as S
from labelflow.session import BATCH_BYTES


def test_letter_counts_take_little_memory():
    texts = pd.Series(["Zwölf Boxkämpfer " * 120] * 3000)  # 6 million characters
    want = [texts[0].lower().count(a) for a in ALPHABET]
    tracemalloc.start()
    got = S._count_matrix(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == np.array(want)).all()
    assert peak < 60e6


@pytest.mark.parametrize("size", [S.PIECE_CHARS - 1, S.PIECE_CHARS, 3 * S.PIECE_CHARS + 7])
def test_letter_counts_across_pieces(size):
    long = ("aé\U0001f600ñZ" * (size // 5 + 1))[:size]
    texts = ["", "abc", long, long[::-1], "\ud800x", "", "é"]
    got = S._count_matrix(pd.Series(texts, dtype=object))
    assert got.tolist() == [[t.lower().count(a) for a in ALPHABET] for t in texts]
    assert S._count_matrix(pd.Series([], dtype=object)).shape == (0, len(ALPHABET))


def test_batches_of_long_texts_are_cut(spark):
    rows = spark.range(0, 600, 1, 1).select("id", F.repeat(F.lit("word and more "), 2000).alias("text"))
    model = S.fit_letter_nb(rows.withColumn("label", (F.col("id") % 2).cast("string")))

    @F.pandas_udf("int")
    def batch_rows(t: pd.Series) -> pd.Series:
        return pd.Series([len(t)] * len(t))

    S.predict(rows, model)  # prepares the session
    most = rows.select(batch_rows("text").alias("n")).agg(F.max("n")).first()[0]
    assert most * 28000 <= BATCH_BYTES + 28000


def test_drift_jobs_encode_a_text_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        calls.add(len(texts))
        return texts.map(lambda t: None if t is None else [float(len(t)), float(t.count("a"))])

    texts = spark.range(0, 60, 1, 3).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, F.repeat(F.lit("ab"), F.col("id").cast("int"))).alias("text"))
    embed = lambda df: df.withColumn("embedding", encode("text"))
    fit = DR.drift_fit(texts, DR.DriftConfig(methods=("embedding",), n_boot=4), embed)
    assert fit.embedding.n == 54 and calls.value == 60
    one = DR.drift_method_rows(texts, fit, embed).first()
    assert one.details["drift_score"] == pytest.approx(0.0, abs=1e-12) and calls.value == 120
    many = DB.drift_detect_batches(texts.withColumn("day", F.lit(1)), fit, "day", embed).first()
    assert many.method_results["embedding"].details == pytest.approx(one.details, abs=1e-12) and calls.value == 180


def test_totals_of_a_fit_without_numbers(spark):
    rows = spark.createDataFrame([(1, [None, None]), (2, [None, None])], "vec_id long, embedding array<double>")
    assert DE.fit_embedding(rows, "euclidean", True, n_boot=4).stats.count() == 0
