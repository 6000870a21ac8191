import pytest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "id", "row", "size", "hash", "fp", "score", "digest", "component", "length"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in COLUMNS[5:])

TEXTS = [
    "One two three four five six seven", "one two three four five six seven", "Alpha beta. Gamma\ndelta", None, "", "  \t ",
    "word " * 30_000, "one two three four five six seven", "été ÉTÉ ß 漢字 \U0001f600", "x",
]


def rows():
    made = [(i, t, "en", ["b", "a", None][i % 3], len(t or ""), *["clash"] * 9) for i, t in enumerate(TEXTS)]
    more = [made[2], made[2], (None, "no id", None, None, None, *[None] * 9), (None, None, None, "é", None, *[None] * 9)]
    return made + more


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns with clashing names."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
