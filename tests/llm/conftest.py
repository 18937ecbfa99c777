import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows(sf_docs):
    """Nulls in every column, empty and white texts, a very long text, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    text = sf_docs[0]["text"]
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n\x0b\f\r ", "en", None, 7)]
    rows += [(4, text, "en", "b", len(text)), (4, text, "en", "b", len(text)), (5, text, "en", "c", len(text)), (None, text, "en", "c", len(text))]
    rows += [(6, long, "de", "b", len(long)), (7, "x", "fr", "a", 1), (4, "other text with the id of another row " * 12, "en", "b", 1)]
    rows += [(8, "Ünï ÉCOLE \U0001f600 a@b.co +1 (582) 555-5777 1.2.3.4 4111 1111 1111 1111\n" * 3, "xx", "z", 1), (9, "\x00 \x01\x02 ퟿", "en", "z", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """odd_rows with extra columns whose names clash with those used inside."""
    df = spark.createDataFrame(odd_rows, SCHEMA)
    for name in ("row", "text_key", "k_id", "k_text", "fp", "size", "words", "h", "host", "key", "item", "base"):
        df = df.withColumn(name, F.lit("extra"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
