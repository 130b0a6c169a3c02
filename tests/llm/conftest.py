import pytest

EDGES = [
    (1, None, "en", "a", None, 5),
    (2, "", "en", "a", 0, 5),
    (3, " \n\t ", "en", None, 4, 5),
    (None, "null id text here", "en", "b", 17, 5),
    (4, "same text twice", "de", "b", 15, 5),
    (4, "same text twice", "de", "b", 15, 5),
    (5, "word " * 30_000, "de", "a", 150_000, 5),
    (6, "one", "de", None, 3, 5),
    (7, "A\nB\nC\nA\nB\nC\nx", "en", "a", 13, 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {extra}"
#: Names that operators use for columns of their own.
CLASHES = ["size", "n_words", "score", "_k1", "kept", "h1", "spans", "line", "_text_hash", "rate", "words", "doc", "n", "_q", "_n_removed", "_bad", "bad", "copy", "row", "key", "kind", "slots", "length"]


@pytest.fixture
def edge_docs(spark):
    rows = [(*r, *([r[-1]] * (len(CLASHES) - 1))) for r in EDGES]
    return spark.createDataFrame(rows, SCHEMA.format(extra=", ".join(f"`{c}` long" for c in CLASHES)))


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.limit(0)
