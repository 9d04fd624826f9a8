import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as extra columns of the input.
CLASHES = (
    "n", "key", "rep", "set_id", "score", "bucket", "after", "code", "block", "place", "label", "gone",
    "quality_score", "language_id", "component_id", "one", "tie", "ids", "subject", "token", "best",
)


def text_of(k: int, words: int = 40) -> str:
    return " ".join(f"w{(k * 7919 + i * 104729) % 977}" for i in range(words)) + "."


def docs_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text."""
    base = text_of(1, 60)
    rows = [
        (1, base, "en", "a", 10), (2, base, "en", "a", 10), (3, base.replace("w", "W"), None, None, None),
        (4, base + " extra", "en", "b", 3), (5, None, "en", "a", 0), (6, "", "de", "a", 0), (7, " \n\t ", "de", "c", 3),
        (8, "one", "en", "a", 3), (9, "ONE", "fr", "a", 3), (10, text_of(2), "en", "a", 5),
        (10, text_of(2), "en", "a", 5), (10, text_of(3), "en", "a", 5), (None, base, "en", "a", 5),
        (None, None, None, None, None), (11, "été çà là où naïve 你好 世界 \U0001f600 ", "fr", "a", 9),
        (12, "123 456 !!", "en", "a", 9), (13, text_of(4, 20_000), "en", "a", 9),
        (14, "it's <|endoftext|> ' 's  x\r\n\n  y\x85z", "en", "a", 9), (15, "x" * 30_000, "en", "a", 9),
    ]
    return rows + [(100 + k, text_of(10 + k, 5 + k), "en", "s", k) for k in range(20)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(*r, *(f"clash{k}" for k in range(len(CLASHES)))) for r in docs_rows()]
    schema = DOCS + ", " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
