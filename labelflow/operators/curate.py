"""Curation of the labelled table: filters, derived columns, counts (B*, C1-C8, E8, E10, F*).

Every function is ``DataFrame -> DataFrame`` and lazy. Counts skip null keys (pandas
``value_counts``); ordered outputs carry a key tie-break so they are deterministic.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import prefix_totals


# ---------------------------------------------------------------- checks

def require_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Fail before any job with the missing and the available columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}. Available columns: {df.columns}")
    return df


def require_non_empty(df: DataFrame, what: str = "Reference DataFrame") -> DataFrame:
    """An empty input is an error (one cheap ``isEmpty`` job: stops at the first row)."""
    if df.isEmpty():
        raise ValueError(f"{what} cannot be empty")
    return df


# ---------------------------------------------------------------- filters and columns

def label_filter(df: DataFrame, labels: list[str], col: str = "category") -> DataFrame:
    """B1: keep rows whose category is in ``labels`` (reaches Parquet as ``In``)."""
    return df.filter(F.col(col).isin(list(labels)))


def parse_date(df: DataFrame, col: str = "date", fmt: str | None = None,
               lenient: bool = False, out: str | None = None) -> DataFrame:
    """B2: text -> timestamp. Strict by default (ANSI: bad input raises); ``lenient`` gives null."""
    c = F.col(col).cast("string")
    if lenient:
        parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    else:
        parsed = F.to_timestamp(c, fmt) if fmt else F.to_timestamp(c)
    return df.withColumn(out or col, parsed)


def extract_year(df: DataFrame, col: str = "date", out: str = "year") -> DataFrame:
    """B3."""
    return df.withColumn(out, F.year(col))


def year_filter(df: DataFrame, year: int | None, col: str = "date") -> DataFrame:
    """``year(col) == year`` written as a half-open range so Parquet can skip row groups."""
    if year is None:
        return df
    lo, hi = _dt.datetime(year, 1, 1), _dt.datetime(year + 1, 1, 1)
    dtype = dict(df.dtypes)[col]
    if dtype == "timestamp_ntz":
        lo_c = F.to_timestamp_ntz(F.lit(lo.isoformat(sep=" ")))
        hi_c = F.to_timestamp_ntz(F.lit(hi.isoformat(sep=" ")))
    elif dtype == "date":
        lo_c, hi_c = F.lit(lo.date()), F.lit(hi.date())
    else:
        lo_c, hi_c = F.lit(lo.isoformat(sep=" ")).cast(dtype), F.lit(hi.isoformat(sep=" ")).cast(dtype)
    return df.filter((F.col(col) >= lo_c) & (F.col(col) < hi_c))


def stable_row_id(df: DataFrame, key: str, out: str = "row_id") -> DataFrame:
    """Dense 0..n-1 numbering in ``key`` order (key must be unique and numeric).

    Built on the distributed prefix-count kernel, not a global window: re-runs give the same
    ids whatever the partitioning.
    """
    counted = df.withColumn("_one", F.lit(1))
    out_df = prefix_totals(counted, [], key, ["_one"])
    return out_df.withColumn(out, F.col("_one_before").cast("long")).drop("_one", "_one_before")


def compose_text(df: DataFrame, headline: str = "headline", description: str = "short_description",
                 out: str = "text") -> DataFrame:
    """Headline + ' ' + description; null headline -> null, null description -> ''."""
    return df.withColumn(out, F.concat(F.col(headline), F.lit(" "),
                                       F.coalesce(F.col(description), F.lit(""))))


def project_columns(df: DataFrame, cols: list[str], text_column: str | None = None) -> DataFrame:
    """Choose columns; an optional text column goes first when present."""
    chosen = list(cols)
    if text_column and text_column in df.columns and text_column not in chosen:
        chosen.insert(0, text_column)
    return df.select(*chosen)


def drop_null_text(df: DataFrame, text_column: str = "text") -> DataFrame:
    """Rows with null text are not scored."""
    return df.dropna(subset=[text_column])


def text_as_string(df: DataFrame, text_column: str = "text", out: str | None = None) -> DataFrame:
    """Drift keeps null text as the literal string 'None' (what ``astype(str)`` gives)."""
    return df.withColumn(out or text_column,
                         F.coalesce(F.col(text_column).cast("string"), F.lit("None")))


def mark_correct(df: DataFrame, true_col: str, pred_col: str, out: str = "correct") -> DataFrame:
    """Equality where null compares false."""
    return df.withColumn(out, F.coalesce(F.col(true_col) == F.col(pred_col), F.lit(False)))


def selection_state_init(df: DataFrame) -> DataFrame:
    """``selected = false``, ``iteration = -1``."""
    return df.withColumns({"selected": F.lit(False), "iteration": F.lit(-1)})


def default_description(df: DataFrame, col: str = "short_description", out: str = "description") -> DataFrame:
    """B17: '' only when the column is missing; null values stay null."""
    return df.withColumn(out, F.col(col) if col in df.columns else F.lit(""))


# ---------------------------------------------------------------- aggregations

def category_counts(df: DataFrame, col: str = "category") -> DataFrame:
    """Frequency per category, descending (null keys skipped)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc(col)))


def category_shares(df: DataFrame, col: str = "category", by: str = "year") -> DataFrame:
    """Normalised frequency within each ``by`` slice (nulls out of the denominator)."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(by, col).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(by))
    return counts.withColumn("share", F.col("count") / total)


def year_distribution(df: DataFrame, col: str = "year") -> DataFrame:
    """Counts per year, ordered by year."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(
        F.count(F.lit(1)).alias("count")).orderBy(col)


def category_by_year(df: DataFrame, col: str = "category", year_col: str = "year",
                     wide: bool = False) -> DataFrame:
    """C4: category counts per year; ``wide`` pivots categories into columns."""
    base = df.filter(F.col(col).isNotNull())
    if wide:
        return base.groupBy(year_col).pivot(col).agg(F.count(F.lit(1))).orderBy(year_col)
    return base.groupBy(year_col, col).agg(F.count(F.lit(1)).alias("count"))


def row_counts(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Sizes after each curation step, all in one pass (``count_if`` per step)."""
    return df.agg(F.count(F.lit(1)).alias("rows_in"),
                  *[F.count_if(cond).alias(name) for name, cond in steps.items()])


def min_samples_for_split(test_size: float = 0.2, val_size: float = 0.1) -> int:
    """Threshold used by C6: ``int(1/test) + int(1/val) + 1`` (16 for 0.2 / 0.1)."""
    return int(1 / test_size) + int(1 / val_size) + 1


def scarce_categories(df: DataFrame, col: str = "category", test_size: float = 0.2,
                      val_size: float = 0.1) -> DataFrame:
    """Categories with fewer rows than the stratified split needs (HAVING)."""
    n = min_samples_for_split(test_size, val_size)
    return category_counts(df, col).filter(F.col("count") < F.lit(n))


def class_weights(df: DataFrame, col: str = "label") -> DataFrame:
    """Balanced weights ``n / (k * count_c)`` over classes present (``compute_class_weight``).

    The global n and k come from a one-row aggregate joined to the per-class counts.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    tot = counts.agg(F.sum("count").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return counts.crossJoin(F.broadcast(tot)).select(
        col, "count", (F.col("_n") / (F.col("_k") * F.col("count"))).alias("weight"))


def split_distribution(df: DataFrame, col: str = "category", split_col: str = "split",
                       totals: bool = False) -> DataFrame:
    """Counts per split and category; ``totals`` adds rollup rows (null = all)."""
    base = df.filter(F.col(col).isNotNull())
    grouped = base.rollup(split_col, col) if totals else base.groupBy(split_col, col)
    return grouped.agg(F.count(F.lit(1)).alias("count"))


def top_categories(df: DataFrame, n: int = 10, col: str = "category") -> DataFrame:
    """The n most frequent categories (top-k: ``TakeOrderedAndProject``)."""
    return category_counts(df, col).limit(n)


def preview_rows(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """First n rows in key order."""
    return (df.orderBy(order_by) if order_by else df).limit(n)


def distinct_labels(df: DataFrame, *cols: str, out: str = "label") -> DataFrame:
    """Sorted distinct labels of one column or the union of several."""
    parts = [df.select(F.col(c).alias(out)) for c in cols]
    u = parts[0]
    for p in parts[1:]:
        u = u.union(p)
    return u.filter(F.col(out).isNotNull()).distinct().orderBy(out)


def missing_categories(df: DataFrame, expected: DataFrame, col: str = "category") -> DataFrame:
    """expected labels that do not occur in the data (anti join)."""
    present = df.select(col).filter(F.col(col).isNotNull()).distinct()
    return expected.join(present, expected[col] == present[col], "left_anti")

