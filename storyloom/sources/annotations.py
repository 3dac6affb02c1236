"""Linguistic annotations as tables.

The reference gets tokens, lemmas, POS tags, dependencies, noun chunks and
entity tags from neural models.  Here they are tables that the operators join
against; a user with a real tagger/parser passes their own tables with the
same schema.  The default producers below are simple rules written as Spark
expressions and windows (regex tokens, a suffix lexicon, a capitalisation
entity tagger, noun-run chunks); they are much weaker than a trained parser.

Schemas (``K`` = the caller's text key columns, e.g. year, category, id):

* sentences: ``K, sent_id, sentence``
* tokens:    ``K, sent_id, tok_id, word, lemma, pos, dep, head``
* tags:      ``K, sent_id, tok_id, word, tag``  (BILOU, ``O`` outside)
* chunks:    ``K, sent_id, start, end, text``   (token offsets, end exclusive)
* word_vectors: ``word, vec array<float>``
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions.arrays import bind
from storyloom.functions.text import letter_words, split_sentences

# ---------------------------------------------------------------------------
# Fixed values.
# Words the reference adds to its stop list (pipeline and pool variant).
ADDED_STOPWORDS = frozenset({
    "airline", "flight", "from", "subject", "re", "say", "said", "would",
    "also", "says"})
POOL_EXTRA_STOPWORDS = frozenset({"read"})
# Words the reference takes out of the stop list for triple extraction.
TRIPLE_KEEP = frozenset({"by", "for", "n't", "n’t", "to", "not"})
# Our own base stop list of common English function words (the reference
# uses its NLP library's list, which is not available here).
BASE_STOPWORDS = frozenset("""
a about after all also an and any are as at be been before being between both
but by can could did do does during each for from had has have he her here
him his how i if in into is it its just may me more most my no nor not now of
on once only or other our out over own same she should so some such than that
the their them then there these they this those through to too under until
up very was we were what when where which while who whom why will with would
you your
""".split())
# Parts of speech of function words; all of them are in the base stop list.
FUNCTION_POS = {
    "AUX": "are be been being can could did do does had has have is may should was were will would".split(),
    "PART": "not to".split(),
    "ADP": ("about after at before between by during for from in into of on out over through under until "
            "up with").split(),
}
# ---------------------------------------------------------------------------


def stopwords_df(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")


def stopword_set(spark: SparkSession, base: Iterable[str] = BASE_STOPWORDS,
                 added: Iterable[str] = ADDED_STOPWORDS) -> DataFrame:
    """Base list ∪ added words (distinct)."""
    return stopwords_df(spark, base).union(stopwords_df(spark, added)).distinct()


def triple_stopword_set(stop: DataFrame, keep: Iterable[str] = TRIPLE_KEEP) -> DataFrame:
    """The triple stop list = pipeline list minus ``keep``."""
    spark = stop.sparkSession
    return stop.join(stopwords_df(spark, keep), "word", "left_anti")


def sentences(df: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """M1 as a table: one row per sentence with its 0-based ``sent_id``."""
    return df.select(*keys, F.posexplode(split_sentences(text_col))
                     .alias("sent_id", "sentence"))


def lexicon_pos(word_lower, stop_flag):
    """Lexicon: function words by ``FUNCTION_POS``, other stop words → DET,
    -ing/-ed → VERB, -ly → ADV, else NOUN."""
    w = word_lower
    known = F
    for pos, words in FUNCTION_POS.items():
        known = known.when(w.isin(words), pos)
    return (known.when(stop_flag, "DET")
            .when(w.endswith("ing") | w.endswith("ed"), "VERB")
            .when(w.endswith("ly"), "ADV").otherwise("NOUN"))


def lexicon_lemma(word_lower):
    """Lemma rule: drop one final ``s`` when the word is longer than 3."""
    return F.when((F.length(word_lower) > 3) & word_lower.endswith("s"),
                  F.substring(word_lower, F.lit(1), F.length(word_lower) - 1)).otherwise(word_lower)


def stop_words(stop: DataFrame) -> list[str]:
    """The words of a stop list, a short list by its nature, for ``isin``."""
    return sorted({r["word"] for r in stop.select("word").distinct().collect()})


def tokens(sent: DataFrame, keys: Sequence[str], stop: DataFrame,
           lexicon: DataFrame | None = None, with_deps: bool = True) -> DataFrame:
    """Token table from a sentence table.

    ``lexicon(word, lemma, pos)`` keyed by lower-case word overrides the suffix
    rules.  Dependencies (``with_deps``): the first VERB is the ROOT, the last
    NOUN before it ``nsubj``, the first NOUN after it ``dobj``, an ADP right
    after it ``agent`` (``by``) or ``prep``; everything else ``dep``; heads point
    at the root.
    """
    keys = list(keys)
    tok = (sent.select(*keys, "sent_id",
                       F.posexplode(letter_words("sentence")).alias("tok_id", "word"))
           .withColumn("_lw", F.lower("word")))
    stop_flag = stop.select(F.col("word").alias("_lw")).distinct().withColumn("_stop", F.lit(True))
    tok = tok.join(stop_flag, "_lw", "left")
    tok = (tok.withColumn("lemma", lexicon_lemma(F.col("_lw")))
           .withColumn("pos", lexicon_pos(F.col("_lw"), F.col("_stop").isNotNull())))
    if lexicon is not None:
        lx = lexicon.select(F.col("word").alias("_lw"), F.col("lemma").alias("_lx_lemma"),
                            F.col("pos").alias("_lx_pos"))
        tok = (tok.join(lx, "_lw", "left")
               .withColumn("lemma", F.coalesce("_lx_lemma", "lemma"))
               .withColumn("pos", F.coalesce("_lx_pos", "pos"))
               .drop("_lx_lemma", "_lx_pos"))
    tok = tok.drop("_lw", "_stop")
    if not with_deps:
        return tok
    w = Window.partitionBy(*keys, "sent_id")
    root = F.min(F.when(F.col("pos") == "VERB", F.col("tok_id"))).over(w)
    tok = tok.withColumn("_root", root)
    subj = F.max(F.when((F.col("pos") == "NOUN") & (F.col("tok_id") < F.col("_root")),
                        F.col("tok_id"))).over(w)
    first_obj = F.min(F.when((F.col("pos") == "NOUN") & (F.col("tok_id") > F.col("_root")),
                             F.col("tok_id"))).over(w)
    tok = tok.withColumn("_obj0", first_obj)
    # the object is the head (last noun) of the noun run that starts there
    run_end = F.min(F.when((F.col("pos") != "NOUN") & (F.col("tok_id") > F.col("_obj0")),
                           F.col("tok_id"))).over(w)
    last = F.max("tok_id").over(w)
    obj = F.when(F.col("_obj0").isNull(), F.lit(None)).otherwise(
        F.coalesce(run_end - 1, last))
    tok = tok.withColumn("_subj", subj).withColumn("_obj", obj).drop("_obj0")
    dep = (F.when(F.col("tok_id") == F.col("_root"), "ROOT")
           .when(F.col("tok_id") == F.col("_subj"), "nsubj")
           .when(F.col("tok_id") == F.col("_obj"), "dobj")
           .when((F.col("tok_id") == F.col("_root") + 1) & (F.col("pos") == "ADP"),
                 F.when(F.lower("word") == "by", "agent").otherwise("prep"))
           .otherwise("dep"))
    return (tok.withColumn("dep", dep)
            .withColumn("head", F.coalesce("_root", "tok_id"))
            .drop("_root", "_subj", "_obj"))


def capital_tags(tok: DataFrame, keys: Sequence[str], ent_type: str = "MISC") -> DataFrame:
    """Default entity tagger: runs of capitalised words that do not open the
    sentence, tagged in BILOU (``U`` single word, ``B I* L`` longer runs)."""
    keys = list(keys)
    cap = (F.col("tok_id") > 0) & F.col("word").rlike(r"^\p{Lu}")
    t = tok.select(*keys, "sent_id", "tok_id", "word").withColumn("_cap", cap)
    w_sent = Window.partitionBy(*keys, "sent_id").orderBy("tok_id")
    t = t.withColumn("_prev", F.lag("_cap", 1, False).over(w_sent))
    t = t.withColumn("_next", F.lead("_cap", 1, False).over(w_sent))
    tag = (F.when(~F.col("_cap"), F.lit("O"))
           .when(~F.col("_prev") & ~F.col("_next"), F.lit("U-" + ent_type))
           .when(~F.col("_prev"), F.lit("B-" + ent_type))
           .when(~F.col("_next"), F.lit("L-" + ent_type))
           .otherwise(F.lit("I-" + ent_type)))
    return t.select(*keys, "sent_id", "tok_id", "word", tag.alias("tag"))


def capital_tag_array(words, ent_type: str = "MISC"):
    """``capital_tags`` of one sentence: its words (array) with their tags, as
    ``array<struct<word, tag>>``."""
    cap = F.transform(words, lambda w, i: F.struct(w.alias("word"), ((i > 0) & w.rlike(r"^\p{Lu}")).alias("cap")))
    at = lambda c, i: F.coalesce(F.get(c, i)["cap"], F.lit(False))
    tag = lambda c, t, i: (F.when(~t["cap"], F.lit("O"))
                           .when(at(c, i - 1) & at(c, i + 1), F.lit("I-" + ent_type))
                           .when(at(c, i - 1), F.lit("L-" + ent_type))
                           .when(at(c, i + 1), F.lit("B-" + ent_type)).otherwise(F.lit("U-" + ent_type)))
    return bind(cap, lambda c: F.transform(c, lambda t, i: F.struct(t["word"].alias("word"), tag(c, t, i).alias("tag"))))


def token_array(words, stop: Sequence[str]):
    """``tokens`` of one sentence: its words (array) as ``array<struct<tok_id, word,
    lemma, pos, dep, head>>`` by the default rules and dependencies.

    The dependencies are read off a string of one letter per token."""
    stop = list(stop)
    lower = F.transform(words, lambda w: F.struct(w.alias("word"), F.lower(w).alias("lw")))
    typed = F.transform(lower, lambda t: F.struct(
        t["word"].alias("word"), lexicon_lemma(t["lw"]).alias("lemma"),
        lexicon_pos(t["lw"], t["lw"].isin(stop)).alias("pos")))

    def places(p):
        root = F.when(F.instr(p, "V") > 0, F.instr(p, "V") - 1)
        before, after = F.reverse(F.substring(p, F.lit(1), root)), F.substring(p, root + 2, F.length(p))
        first = F.instr(after, "N")
        run = F.length(F.regexp_extract(F.substring(after, first, F.length(after)), "^N+", 0))
        return F.struct(root.alias("root"), F.when(F.instr(before, "N") > 0, root - F.instr(before, "N")).alias("subj"),
                        F.when(first > 0, root + first + run - 1).alias("obj"))

    def with_deps(t, r):
        dep = lambda x, i: (F.when(i == r["root"], "ROOT").when(i == r["subj"], "nsubj")
                            .when(i == r["obj"], "dobj").when((i == r["root"] + 1) & (x["pos"] == "ADP"), F.when(
                                F.lower(x["word"]) == "by", "agent").otherwise("prep")).otherwise("dep"))
        return F.transform(t, lambda x, i: F.struct(
            i.alias("tok_id"), x["word"].alias("word"), x["lemma"].alias("lemma"), x["pos"].alias("pos"),
            dep(x, i).alias("dep"), F.coalesce(r["root"], i).alias("head")))

    letters = lambda t: F.array_join(F.transform(t, lambda x: F.when(x["pos"] == "VERB", "V").when(
        x["pos"] == "NOUN", "N").otherwise("x")), "")
    return bind(typed, lambda t: bind(bind(letters(t), places), lambda r: with_deps(t, r)))


def _runs(n, first, last):
    """Spans from every place where ``first`` holds to the next where ``last`` does."""
    ids = F.sequence(F.lit(0), n - 1)
    return F.zip_with(F.filter(ids, first), F.filter(ids, last),
                      lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))


def tag_spans(tags):
    """Token spans of a sentence's default tags (``capital_tag_array``)."""
    kind = lambda i: F.substring(F.get(tags, i)["tag"], 1, 1)
    return _runs(F.size(tags), lambda i: kind(i).isin("U", "B"), lambda i: kind(i).isin("U", "L"))


def chunk_array(tokens):
    """``noun_chunks`` of one sentence's tokens (array): ``array<struct<start, end, text>>``."""
    pos = lambda i: F.coalesce(F.get(tokens, i)["pos"], F.lit(""))
    first = lambda i: F.when(pos(i) == "DET", pos(i + 1) == "NOUN").otherwise(
        (pos(i) == "NOUN") & ~pos(i - 1).isin("NOUN", "DET"))
    spans = _runs(F.size(tokens), first, lambda i: (pos(i) == "NOUN") & (pos(i + 1) != "NOUN"))
    return F.transform(spans, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.array_join(
        F.transform(F.slice(tokens, p["start"] + 1, p["end"] - p["start"]), lambda t: t["word"]), " ").alias("text")))


def sentence_rows(texts: DataFrame, keys: Sequence[str], text_col: str, stop: Iterable[str]) -> DataFrame:
    """The default annotations on one row per sentence, made without a shuffle:
    ``K, sent_id, tokens, tags`` (arrays; the fields of the tables, tokens with
    ``ent_type``).  Sentences without a word have empty arrays.

    A column that a lambda uses is named more than once in the projection above
    it, so the two stay apart and it is computed once a row."""
    keys = list(keys)
    sents = texts.select(*keys, F.posexplode_outer(split_sentences(text_col)).alias("sent_id", "sentence"))
    words = sents.where(F.col("sent_id").isNotNull()).select(*keys, "sent_id", letter_words("sentence").alias("words"))
    made = words.select(*keys, "sent_id", token_array(F.col("words"), sorted(set(stop))).alias("tokens"),
                        capital_tag_array(F.col("words")).alias("tags"))
    typ = lambda tag: F.when(tag == "O", "").otherwise(F.substring_index(tag, "-", -1))
    return made.select(*keys, "sent_id", "tags", F.zip_with("tokens", "tags", lambda t, g: F.struct(
        *[t[c].alias(c) for c in ("tok_id", "word", "lemma", "pos", "dep", "head")],
        typ(g["tag"]).alias("ent_type"))).alias("tokens"))


def noun_chunks(tok: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Default chunker: ``DET? NOUN+`` runs (token offsets, end exclusive)."""
    keys = list(keys)
    w = Window.partitionBy(*keys, "sent_id").orderBy("tok_id")
    t = tok.select(*keys, "sent_id", "tok_id", "word", "pos")
    noun = F.col("pos") == "NOUN"
    t = t.withColumn("_in", noun | ((F.col("pos") == "DET")
                                    & (F.lead("pos", 1).over(w) == "NOUN")))
    t = t.withColumn("_start", F.col("_in") & (
        (F.col("pos") == "DET") | ~F.lag("_in", 1, False).over(w)))
    t = t.withColumn("_run", F.sum(F.col("_start").cast("int")).over(w))
    runs = t.where("_in").groupBy(*keys, "sent_id", "_run").agg(
        F.min("tok_id").alias("start"), (F.max("tok_id") + 1).alias("end"),
        F.sort_array(F.collect_list(F.struct("tok_id", "word"))).alias("_w"))
    return runs.select(*keys, "sent_id", "start", "end",
                       F.array_join(F.transform("_w", lambda s: s["word"]), " ").alias("text"))


def word_vectors_from_embeddings(words: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Fixture word vectors: ``vec_id = hex(md5(word))[0:7] % (n * 6 // 5)`` joined
    to the ``n`` rows of ``embeddings``: every vector is used and one word in six
    has none (FIXTURES §3)."""
    n_ids = max(1, embeddings.count() * 6 // 5)
    vid = (F.conv(F.substring(F.md5("word"), 1, 7), 16, 10).cast("bigint") % n_ids)
    w = words.select("word").distinct().withColumn("vec_id", vid)
    return (w.join(embeddings.select("vec_id", F.col("embedding").alias("vec")), "vec_id")
            .select("word", "vec"))

