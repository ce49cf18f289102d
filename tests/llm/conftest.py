import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows as a documents table."""

    def make(rows, extra=""):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = []
        for r in rows:
            r = tuple(r)
            doc_id, text = r[0], r[1]
            full.append((doc_id, text, r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if text is None else len(text)))
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four five six seven eight nine ten eleven"), (5, "another text under the same id, of some ten words or so"),
        (6, long), (7, long), (None, "no id at all but words enough to pass any base rule here"), (8, "same text twice " * 5), (8, "same text twice " * 5), (9, "Ünïcödé ÀÉ ß 漢字 \U0001f600 words", None, None), (10, "x" * 3000),
    ]
    df = documents(rows)
    clash = ["score", "fp", "kept", "key", "hash", "n_words", "component_id", "rank", "segment", "spans", "length", "held_out", "label", "place", "node", "root", "count", "item_id", "doc_words", "__gone"]
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
