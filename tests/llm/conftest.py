import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, block long, id long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text[, source]) as documents, with extra columns whose names clash."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, 0.5, 1, 2) for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


#: Null and empty texts, a very long text, ties, repeated rows, a null id.
@pytest.fixture(scope="session")
def edge_rows():
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, long_text), (6, "a b c d e f g"), (6, "a b c d e f g"),
            (7, "a b c d e f g"), (None, "a b c d e f g h i j k"), (8, "x" * 300_000)]
