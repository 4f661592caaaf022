import pytest

CLASHES = "doc_id long, text string, lang string, source string, n_chars long, h long, t string, rid long, cls long, key string, spans string, bytes string, n long"


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", len(text or ""), 1, "t", 2, 3, "k", "sp", "b", 4)


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text[, lang]) with extra columns whose names the operators use inside."""
    def make(rows, partitions=3):
        df = spark.createDataFrame([row(*r) for r in rows], CLASHES)
        return df.repartition(partitions) if rows else df
    return make


PASSAGE = " ".join(f"pass{i}age" for i in range(60))
WORDS = " ".join(f"w{i}" for i in range(400))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies, a shared passage."""
    near = WORDS.replace("w200 ", "changed ")
    return [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one two"), (6, "ONE two"), (7, WORDS), (8, WORDS), (9, near),
            (10, near + " tail"), (11, "alpha " + PASSAGE + " omega"), (12, "Äöü ß " + PASSAGE + " end of it"), (13, PASSAGE),
            (14, "x" * 30000), (15, "ab " * 9000), (None, "no id"), (None, WORDS), (20, "twice here, the same row"),
            (20, "twice here, the same row"), (21, "twice here, the same row"), (22, "日本語 " * 40), (23, "日本語 " * 40 + "x"),
            (24, "!!! ??? 123"), (25, "\x00\x1c\x1d odd \x85 white space\r\n")]
