import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts):
        """documents of {doc_id: text} or [(doc_id, text)]."""
        rows = [(d, t, "en", f"s{(d or 0) % 3}", len(t or "")) for d, t in (texts.items() if isinstance(texts, dict) else texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and very long texts, repeated rows, and extra columns with names that operators use."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, long), (5, long), (5, long), (6, "one two"), (7, "one two"), (None, "one two three"), (8, "é " * 300), (9, "x" * 5000)]
    df = docs_of(rows)
    for name in ("block", "key", "kept", "n_removed", "score", "digest", "payload", "hash", "shard", "bucket", "node", "_recurring_block"):
        df = df.withColumn(name, F.lit("own"))
    return df


@pytest.fixture(scope="session")
def nothing(docs_of):
    return docs_of({})
