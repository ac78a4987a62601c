import pytest
from pyspark.sql import types as T

COLUMNS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("score", T.StringType()), T.StructField("fp", T.StringType()),
])
LINE = "the quick brown fox jumps over the lazy dog near the river bank while seven old sailors sing of home "
#: Nulls, an empty text, ties, a repeated row, a long text, and columns whose names operators use themselves.
ROWS = [
    (1, LINE * 12, "en", "a", "x", "y"), (2, LINE * 12, "en", "a", None, "y"), (2, LINE * 12, "en", "a", None, "y"),
    (3, LINE * 12 + "and then they slept", "en", None, "x", None), (4, None, None, None, None, None),
    (5, "", "fr", "b", None, None), (None, "le chat est sur la table et il dort", "fr", "b", None, None),
    (7, "12 34 !!", None, "b", None, None), (8, "der hund läuft über die straße " * 2000, "de", "c", None, None),
    (9, "le chien mange dans la maison de la rue", "fr", "c", None, None),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
