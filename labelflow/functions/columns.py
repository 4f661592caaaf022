"""Column-level helpers (all built-in Spark expressions, no Python per row).

Randomness: every "random" choice in this package orders rows by
``md5(concat_ws(':', seed, tag, key))``. The order is independent of partitioning and of the
number of executors, is reproducible across re-runs after an executor loss, and is the same
in Spark and in DuckDB, which makes the results checkable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_key(seed: int, tag: str, *cols) -> Column:
    """Hex md5 of ``seed:tag:col1:col2...`` (lower case, 32 chars)."""
    parts = [F.lit(str(seed)), F.lit(tag)] + [_c(c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(key: Column, hex_digits: int) -> Column:
    """Integer made of the first ``hex_digits`` hex chars of a hash key (order preserving)."""
    return F.conv(F.substring(key, 1, hex_digits), 16, 10).cast("long")


def hash_half(seed: int, tag: str, *cols) -> Column:
    """True for (about) half of the keys: first hex digit below 8."""
    return F.substring(hash_key(seed, tag, *cols), 1, 1) < F.lit("8")


def prob_column_name(label: str) -> str:
    """``prob_<label>`` with blank -> ``_`` and ``&`` -> ``and`` (same on write and read).
    Fixed format: the column names must equal the reference's."""
    return "prob_" + label.replace(" ", "_").replace("&", "and")


def prob_column_expr(label: Column) -> Column:
    """B12 as a column expression, for long-form (row, label, prob) tables."""
    return F.concat(F.lit("prob_"), F.replace(F.replace(label, F.lit(" "), F.lit("_")),
                                              F.lit("&"), F.lit("and")))


def round4(c) -> Column:
    """Half-to-even rounding to 4 places (pandas ``DataFrame.round``)."""
    return F.bround(_c(c), 4)


def iso_timestamp(c) -> Column:
    """ISO-8601 text of a (UTC) timestamp, microsecond precision like ``isoformat``."""
    return F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def report_key(method, batch_id, ts) -> Column:
    """``<method>_<batch>_<yyyyMMdd_HHmmss>``."""
    return F.concat_ws("_", _c(method), _c(batch_id), F.date_format(_c(ts), "yyyyMMdd_HHmmss"))


def auto_batch_id(ts) -> Column:
    """Generated batch id ``batch_<yyyyMMdd_HHmmss>``."""
    return F.concat(F.lit("batch_"), F.date_format(_c(ts), "yyyyMMdd_HHmmss"))


def safe_div(num, den, zero=0.0) -> Column:
    """``num / den`` with ``zero`` when the denominator is 0 (``zero_division=0``)."""
    num, den = _c(num), _c(den)
    return F.when(den == 0, F.lit(zero)).otherwise(num.cast("double") / den.cast("double"))
