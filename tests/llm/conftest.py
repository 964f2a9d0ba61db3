import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
#: Columns whose names are those that operators use inside or return.
CLASH = ["id", "t", "h", "n", "key", "span", "score", "copies", "size", "component_id", "component", "__cell", "kept", "item_id"]


def make_docs(spark, rows, extra=()):
    """rows: (doc_id, text) or whole rows; extra: further string columns, all 'x'."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in extra])


LONG = " ".join(f"w{i}" for i in range(60_000))
EDGE = [(0, "Alpha beta gamma delta epsilon zeta", "en", "a", 3), (1, "alpha BETA gamma delta epsilon zeta", None, None, None),
        (2, None, "en", "a", 1), (3, "", "en", "b", 0), (4, "  \n\t ", "en", "b", 4), (5, LONG, "en", "b", len(LONG)),
        (None, "no id here at all", "en", "b", 1), (0, "Alpha beta gamma delta epsilon zeta", "en", "a", 3),
        (6, "one", "en", "c", 1), (7, "日本語 😀 text", "ja", "c", 1), (8, "one", "en", "c", None)]


@pytest.fixture()
def edge(spark):
    return make_docs(spark, EDGE, CLASH)


@pytest.fixture()
def empty(spark):
    return make_docs(spark, [], CLASH)


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 1), (6, 1, None), (None, 0, 1), (0, 1, 0)],
                                 "doc_id long, quality int, toxic int")
