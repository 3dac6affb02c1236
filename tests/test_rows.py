"""Annotations and triples on one row per sentence against their table forms."""
import random

from pyspark.sql import functions as F

from storyloom.functions.text import SPACE, SPACES, capital_runs, letter_words, split_sentences, squeeze_space, strip_space
from storyloom.operators import entities as ent
from storyloom.operators import tokens as tk
from storyloom.operators import triples as tr
from storyloom.operators.entities import decode_bilou, strip_entities
from storyloom.plans import pipelines as pl
from storyloom.sources import annotations as ann

WORDS = ("Anna Bob Paris moving walked quickly by to not the The had firms stations shares a I Ünal été 42 x9 selling "
         "says Sold of").split()


def random_texts(spark, n=80, seed=3):
    rnd = random.Random(seed)
    rows = [(2020, "en", 0, 0, i, " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ".", "!", " -- "])
                                           for _ in range(rnd.randint(0, 40)))) for i in range(n)]
    rows += [(2020, None, 0, 0, n, None), (2020, "en", 0, 0, n + 1, "... !"), (2020, "en", 0, 0, n + 2, "Paris")]
    return spark.createDataFrame(rows, "year int, category string, cluster int, topic int, id long, text string")


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    assert key(a) == key(b)
    return len(key(a))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_records_equal_the_tables(spark):
    texts = random_texts(spark)
    tok, ents, chunks, tags = pl.triple_annotations(texts, materialize=False)
    rows, S = pl.triple_records(texts), [*pl.TRIPLE_KEYS, "sent_id"]
    flat = lambda c: rows.select(*S, F.inline_outer(c))
    assert same(tok, flat("tokens").where("tok_id is not null")) > 500
    same(tags, rows.select(*S, F.posexplode("tags").alias("tok_id", "_t")).select(*S, "tok_id", "_t.word", "_t.tag"))
    assert same(chunks, flat("chunks").where("start is not null")) > 50
    assert same(ents, rows.select(*S, F.explode("entities").alias("entity"))) > 50
    assert same(tr.longest_phrase(tr.verb_phrases(tok, pl.TRIPLE_KEYS), pl.TRIPLE_KEYS),
                tr.phrases_of_records(rows, pl.TRIPLE_KEYS)) > 50


def test_triples_equal_the_tables(spark):
    texts = random_texts(spark, 150, 8)
    for extract in (pl.extract_triplets, pl.extract_entity_triples, pl.extract_svo):
        by_row = extract(texts)
        assert same(extract(texts, pl.triple_annotations), by_row) > 5
        assert shuffles(by_row) == 0


def test_intro_terms_without_a_shuffle(spark):
    texts = random_texts(spark).withColumnRenamed("text", "clean").select(*pl.DOC, "clean")
    stop = pl.stop_list(spark)
    flat = pl.intro_tags(texts).withColumn("tok_id", F.col("sent_id") * F.lit(1 << 20) + F.col("tok_id"))
    want = strip_entities(texts, decode_bilou(flat, pl.DOC), pl.DOC, "clean", "text")
    same(want, pl.stripped(texts))
    sents = ann.sentences(want, pl.DOC, "text")
    table = tk.with_positions(tk.token_filter(ann.tokens(sents, pl.DOC, stop, None, with_deps=False), stop), pl.DOC)
    rows = pl.doc_terms(spark, pl.stripped(texts))
    assert same(table, rows) > 200
    assert shuffles(rows) == 0


def test_runs_of_capitals_are_the_default_entities(spark):
    rows = [("He met Anna Bob in Paris. Then A B! İz Ünal\nÉté. \u3000 ?! Bob-Anna Ox9Paris x. \u00a0\U00010400a B",), ("",), ("Bob Anna",), (None,),
            ("-- Anna. 42 Bob Paris 7 Ünal Anna Bob",), ("a. Bob. Anna Bob Bob.Anna Paris\x0bBob",)]
    texts = spark.createDataFrame(rows, "t string").unionByName(random_texts(spark, 120, 5).select(F.col("text").alias("t")))
    tagged = F.flatten(F.transform(split_sentences("t"), lambda s: ann.capital_tag_array(letter_words(s))))
    runs = capital_runs("t")
    both = texts.select(F.array_sort(ent.bilou_entities(tagged)).alias("want"), F.array_sort(F.array_distinct(runs)).alias("got"))
    assert both.where("not want <=> got").count() == 0 and both.where("size(got) > 0").count() > 100
    # an intro's entities are read off its text, not token by token
    plan = pl.stripped(texts.withColumnRenamed("t", "clean"))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring_index" not in plan


def test_spaces_are_the_space_class(spark):
    every = spark.range(1, 0xFFFF).where("id < 55296 or id > 57343")
    c = every.select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    assert c.where(F.col("c").rlike(f"^{SPACE}$") != (F.instr(F.lit(SPACES), F.col("c")) > 0)).count() == 0
    assert c.where(F.col("c").rlike(f"^{SPACE}$")).count() == len(SPACES)
    rows = [(" \u00a0\na b \u3000\r\n",), ("\x0b",), (None,), ("a  b\tc \n d\u00a0 e f",), ("  ",)]
    got = spark.createDataFrame(rows, "t string").select(strip_space("t"), squeeze_space("t"),
                                                         F.regexp_replace("t", f"{SPACE}+", " ")).collect()
    assert [r[0] for r in got] == ["a b", "", None, "a  b\tc \n d\u00a0 e f", ""]
    assert [r[1] for r in got] == [r[2] for r in got]
