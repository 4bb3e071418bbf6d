import pytest

LONG = "stone river garden " * 4000 + "END"


def odd_rows():
    """Rows with nulls, empty and long texts, repeated rows, ties, and texts of one word to many."""
    prose = "The quick fox of the north went over nine hills and came back with stories that nobody had heard before. " * 5
    texts = [None, "", " \t\n", "one", "one two three four", prose, prose, prose + " end", LONG, "ΑΣ İstanbul ½ 日本語 \x1c x\x85y", "a\n\n\na\nb b b b"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t) if t else None) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[1], (None, "no id here", None, None, None), (None, None, None, None, None)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """With extra columns named like what operators use inside."""
    names = ["size", "taken", "target", "kept", "key", "rep", "comp", "spans", "ids", "media", "n", "a", "b", "_id", "_text", "bands", "served", "copies", "_copy", "_row", "html"]
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(x) for x in names]).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
