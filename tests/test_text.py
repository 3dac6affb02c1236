"""Golden rows for the text functions."""
import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as tx


def one(spark, expr, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("src,want", [
    ("a-b-c", "a b c"),
    ("é-è", "é è"),
    ("x -- y", "x y"),
    ("wait… what", "wait what"),
    ("a@b#c^d&e*f)g(h:i|j/k>l<m}n{o", "a b c d e f g h i j k l m n o"),
    ("Read More about it", " about it"),
    ("see Sources here", "see Sources here"),
    ("Source: x", " x"),
    ("no break  space", "no break space"),
])
def test_clean_text(spark, src, want):
    assert one(spark, tx.clean_text("t"), src) == want


def test_split_sentences_and_intro(spark):
    text = "First one. Second!  Third? fourth.\n Fifth"
    assert one(spark, tx.split_sentences("t"), text) == [
        "First one.", "Second!", "Third?", "fourth.", "Fifth"]
    assert one(spark, tx.split_sentences("t", 2), text) == ["First one.", "Second!"]
    df = spark.createDataFrame([("Title", text)], "title string, a string")
    got = df.select(tx.intro("title", "a", 3).alias("r")).first()["r"]
    assert got == "Title. First one. Second! Third?"


def test_remove_words(spark):
    got = one(spark, tx.remove_words("t", ["the", "of", "a"]), "the end of a theory the")
    assert got == " end theory "


def test_remove_entities(spark):
    df = spark.createDataFrame(
        [("New York Times and New York.", ["New York", "New York Times"]),
         ("keep me", []), ("a+b (c) x", ["a+b", "(c)"]), ("nothing", None)],
        "t string, e array<string>")
    got = [r["r"] for r in df.select(tx.remove_entities("t", "e").alias("r")).collect()]
    assert got[0] == " and  ."
    assert got[1] == "keep me"
    assert got[2] == "  x"
    assert got[3] == "nothing"


@pytest.mark.parametrize("a,want", [
    (0.0, "Negative"), (0.399, "Negative"), (0.4, "Neutral"), (0.5, "Neutral"),
    (0.6, "Neutral"), (0.601, "Positive"), (1.0, "Positive"), (None, None)])
def test_sentiment_bucket(spark, a, want):
    assert one(spark, tx.sentiment_bucket("t"), a, "t double") == want


@pytest.mark.parametrize("a,b,want", [
    ("flew to Paris", "Paris France", "Paris"),
    ("a b c d", "x b c y b c d", "b c d"),
    ("a b", "c d", ""),
    ("is in the city", "the city", "the city"),
    ("x y x y", "x y", "x y"),
])
def test_lcs_words(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(tx.lcs_words("a", "b").alias("r")).first()["r"] == want


def test_split_keywords(spark):
    assert one(spark, tx.split_keywords("t"), ["new_york", "city"], "t array<string>") == [
        "new", "york", "city"]
