import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("n_words", T.StringType()),
    T.StructField("_t", T.StringType()), T.StructField("shard", T.StringType())])

PROSE = ("The quick brown fox jumps over the lazy dog near the quiet river bank. "
         "Später kam der Regen, und die Straßen wurden naß und glänzend. "
         "Où est la bibliothèque, demanda-t-il avec un sourire étonné? ")


def rows():
    """Nulls, empty and blank texts, a very long text, ties, repeated rows."""
    texts = [
        (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (3, None), (4, ""), (5, "  \t \n \n"),
        (6, "one"), (7, PROSE.replace("river", "water")), (8, "a\n\nb\na\n  \nb"),
        (9, " ".join(f"w{i % 977}x{i}" for i in range(40_000))), (10, "x" * 30_000), (None, PROSE), (None, None),
        (11, "emoji 🙂🙃 and accents éè ﬁ ſ K İ\r\nsecond line here\x0b\x0cthird\x85fourth fifth"),
        (12, "no digits here 123 456 ... --- !!!"), (13, "١٢٣ 漢字 かな 한국어 русский текст"), (14, "\x00\x01 null byte"),
    ]
    return [(k, t, "en" if i % 2 else None, f"s{i}", len(t or ""), "clash", "mine", "other")
            for i, (k, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")
