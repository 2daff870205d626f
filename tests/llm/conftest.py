import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of texts, or of (id, text) pairs."""

    def make(texts):
        rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and other columns with clashing names."""
    long = " ".join(f"word{i % 977} tail{i}" for i in range(30_000))
    rows = [(None, None, None, None, None), (1, "", "en", "src1", 0), (2, "one two", "en", None, 7), (2, "one two", "en", None, 7), (3, long, None, "src1", len(long)), (3, long, None, "src1", len(long)), (None, "mail a.b@c.de now", "en", "src2", 17), (4, None, "fr", "src2", None), (5, "É A b   c", "fr", "src0", 9)]
    df = spark.createDataFrame(rows, DOCS)
    clash = ("rid", "n", "k1", "c", "x", "host", "path", "key", "sig", "total", "h", "kind", "words", "score", "times", "w")
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, None), (4, "?!"), (None, "no number here")], "item_id long, text string")
