"""Text expressions shared by the scorer and the drift methods (JVM built-ins only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters the character scorer counts (a-z plus the accented letters of
# French, German and Spanish). Restricting to an explicit list keeps results independent of
# collation and locale.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûü"

# Word tokens: runs of two or more Unicode letters, digits or underscores (the usual
# ``\b\w\w+\b`` token rule with Unicode word characters), lower-cased.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Default English stop words removed before TF-IDF. A short function-word list;
# callers can pass their own (the large list of the reference's library is not shipped).
STOP_WORDS = (
    "a an and are as at be but by for from has have he her his i if in into is it its me my "
    "no not of on or our she so that the their them then there these they this to was we "
    "were what when which who will with you your"
).split()


def word_tokens(text: Column) -> Column:
    """``array<string>`` of lower-cased word tokens over the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)


def sentence_count(text: Column) -> Column:
    """Number of sentence ends (runs of ., ! or ?) — at least 1 for non-empty text."""
    n = F.regexp_count(text, F.lit(r"[.!?]+"))
    return F.when(F.length(F.trim(text)) == 0, F.lit(0)).otherwise(F.greatest(n, F.lit(1)))


def non_letter_share(text: Column) -> Column:
    """Share of characters that are not letters (0 for empty text)."""
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(n == 0, F.lit(0.0)).otherwise((n - letters).cast("double") / n)
