"""Label dimension: label <-> id lookups.

The dimension is a small DataFrame ``(label_id int, label string)``. Joins to it are left
joins (an unknown category keeps a null id) and are left to the planner: the dimension is an
aggregate whose size AQE measures at run time before choosing a broadcast.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def label_dimension_from_list(spark: SparkSession, labels: list[str]) -> DataFrame:
    """Ids by list position, like ``{label: idx for idx, label in enumerate(labels)}``."""
    rows = [(i, lab) for i, lab in enumerate(labels)]
    return spark.createDataFrame(rows, "label_id int, label string")


def label_dimension_from_data(df: DataFrame, col: str) -> DataFrame:
    """Ids by sorted distinct value (the order a fitted label indexer would use)."""
    d = df.select(F.col(col).alias("label")).filter(F.col("label").isNotNull()).distinct()
    return d.select((F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("label_id"),
                    "label")


def encode_label(df: DataFrame, dim: DataFrame, col: str = "category", out: str = "label") -> DataFrame:
    """Category -> id; unknown or null category -> null id."""
    d = dim.select(F.col("label").alias("_lbl"), F.col("label_id").alias(out))
    return df.join(d, df[col] == d["_lbl"], "left").drop("_lbl")


def decode_label(df: DataFrame, dim: DataFrame, col: str = "predicted_label_id",
                 out: str = "predicted_category") -> DataFrame:
    """Id -> label."""
    d = dim.select(F.col("label_id").alias("_lid"), F.col("label").alias(out))
    return df.join(d, df[col] == d["_lid"], "left").drop("_lid")


def label_mappings_json(dim: DataFrame) -> DataFrame:
    """One row ``{label2id, id2label, labels}`` as JSON text (ids are JSON keys -> strings)."""
    arr = F.array_sort(F.collect_list(F.struct("label_id", "label")))
    return dim.agg(arr.alias("_a")).select(F.to_json(F.struct(
        F.map_from_entries(F.transform("_a", lambda x: F.struct(x["label"], x["label_id"]))).alias("label2id"),
        F.map_from_entries(F.transform("_a", lambda x: F.struct(x["label_id"].cast("string"), x["label"]))).alias("id2label"),
        F.transform("_a", lambda x: x["label"]).alias("labels"))).alias("label_mappings"))


def read_label_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Re-read a persisted mapping; string JSON keys are cast back to int ids."""
    raw = spark.read.text(path)
    parsed = raw.select(F.from_json("value", "id2label map<string,string>").alias("m"))
    return parsed.select(F.explode("m.id2label").alias("k", "label")).select(
        F.col("k").cast("int").alias("label_id"), "label")


def model_label_dimension(spark: SparkSession, path: str, model) -> DataFrame:
    """The mapping saved at ``path``; when nothing lies there, the labels the fitted pipeline itself
    carries (those of its label indexer or of the stage that names its predictions, ids by position). A mapping that is there and cannot
    be read stays an error, and so does a model without labels."""
    try:
        return read_label_mappings(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    for stage in getattr(model, "stages", [model]):
        if isinstance(stage, StringIndexerModel):
            return label_dimension_from_list(spark, list(stage.labels))
        if isinstance(stage, IndexToString):
            return label_dimension_from_list(spark, stage.getLabels())
    raise ValueError("no label mapping is saved and the model carries no labels")


def write_label_mappings(dim: DataFrame, path: str) -> str:
    label_mappings_json(dim).coalesce(1).write.mode("overwrite").text(path)
    return path
