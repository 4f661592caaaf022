"""Parquet sources and the bindings of the reference's data shapes to the test tables.

* labelled articles (category, date, year, ...)  -> ``orders``: ``o_orderpriority`` is the
  category (exactly five values), ``o_orderdate`` the publication date;
* headline / description text                    -> ``documents.text``: first line / rest;
* true label of the text classifier              -> ``documents.lang``.

Only the columns a query needs are selected, so the Parquet scan prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    return spark.read.parquet(table_path(sf_dir, name))


def table_state(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Modification time, bytes and number of files of a table: what is kept of a table (scores, models,
    logs) carries this state in its key, so a rewritten table is never answered from the old one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(path)
    return sf_dir, fs.getFileStatus(path).getModificationTime(), summary.getLength(), summary.getFileCount()


def scan_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the labelled article table (full ``train`` split of the reference's dataset).

    ``article_id`` is the natural key, kept so every later step can be re-run and re-joined.
    """
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("article_id"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderdate").alias("date"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("amount"),
    )


def scan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents shaped as headline / short_description / category (= language)."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id"),
        F.col("lang").alias("category"),
        F.substring_index("text", "\n", 1).alias("headline"),
        F.when(F.instr("text", "\n") > 0,
               F.expr("substring(text, instr(text, '\n') + 1)")).alias("short_description"),
        F.col("text"),
        F.col("source"),
        F.col("n_chars"),
    )
