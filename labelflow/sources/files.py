"""File sources and sinks (A2-A6): CSV with header and quoted multi-line fields, JSON lines.

Writers return the output folder; they never coalesce to one file (a single writer task would
bound the throughput of the whole job). Paths come from the caller (see
``session.shared_path`` for the shared folder used by the registered queries).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A2: CSV with a header row; quoted fields may span lines; declared schema (no inference)."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A3/A4/A5: header, no index column, quoted multi-line text."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One JSON document per line (nested arrays and maps kept)."""
    df.write.mode(mode).json(path)
    return path
