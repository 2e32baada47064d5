import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, h long, `bucket` string, copies long, n long, component string"


@pytest.fixture(scope="session")
def table(spark):
    """table(rows): documents from (doc_id, text[, lang[, source]]), with extra columns whose names operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "src0")), 0, -1, -1, "x", -1, -1, "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


LONG = "word " * 60_000 + "end"
#: Nulls in every column, empty and blank texts, ties, repeated rows, a very long text.
ODD = [(1, None), (2, ""), (2, ""), (3, " \n\t "), (None, "a b c d e f g h i j k l m n o p"), (None, None), (5, "a b c d e f g h i j k l m n o p"), (5, "a b c d e f g h i j k l m n o p"), (6, LONG), (7, LONG, None, None), (8, "é ü — 漢字 😀 x")]
