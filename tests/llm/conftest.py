import pytest

#: Rows that every operator must take: nulls, empty and blank texts, a very long one, ties and repeated rows.
LONG = " ".join(f"word{i % 701} wörter{i % 13}," for i in range(9000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, "The quick brown  fox\tjumps over the lazy dog."),
    (3, None), (4, ""), (5, " \n "), (6, LONG), (7, LONG), (None, "no id at all"), (None, None),
    (8, "tie"), (8, "tie"), (9, "TIE"), (10, "a <|endoftext|> b"), (11, "x" * 5000), (12, "é  è\r\nñ 中文 😀"),
    (13, "one two three four five six seven eight nine one two three four five six seven eight nine ten"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """``doc_id, text`` with columns whose names clash with results and with each other."""
    rows = [(i, t, 1.5, "x", "y", 7) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, C0 string, row_id string, fingerprint int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
