import pytest

CLASHES = "_id long, _text string, _sha string, key string, n long, score double, shard int, size long, length long, _bit long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named as operators name theirs."""
    words = " ".join(f"word{i % 977} tail{i % 13}" for i in range(20_000))
    texts = [
        (1, "one two three four five six seven eight nine ten"), (2, "one two  three\tfour five six seven eight nine ten"),
        (3, None), (4, ""), (5, "   \n\t "), (6, words), (7, words + " end"), (8, "x"), (8, "x"), (9, "x y"), (9, "z z z z"),
        (None, "one two three four five six seven eight nine ten"), (None, None), (10, "ÉÀ émile\nÉÀ Émile\n\n"), (11, "\n"),
    ]
    rows = [(i, t, "en", "s", None, None, "own", None, "k", 1, 0.5, 3, None, 7, 1) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
