"""Token filtering (F6, F7, F9) and per-document term lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.sources import annotations as ann

# Fixed value: the part of speech the pipeline keeps.
ALLOWED_POS = ("NOUN",)


def token_filter(tokens: DataFrame, stop: DataFrame,
                 allowed_pos: Sequence[str] = ALLOWED_POS) -> DataFrame:
    """keep NOUN tokens longer than one character whose lemma is not a stop
    word and whose surface is not all digits; ``term`` = the lemma."""
    kept = tokens.where(F.col("pos").isin(list(allowed_pos))
                        & (F.length("word") > 1)
                        & ~F.col("word").rlike(r"^\p{Nd}+$"))
    return kept.join(stop.select(F.col("word").alias("lemma")), "lemma", "left_anti").withColumn("term", F.col("lemma"))


def doc_tokens(texts: DataFrame, keys: Sequence[str], text_col: str,
               stop: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """sentences → tokens → F6, in text order.

    Output ``(keys…, pos, term)`` with ``pos`` the 0-based position of the
    term in the document's filtered list (long form, one row per term).  The
    default rules work on a document's row, without a shuffle; a ``lexicon``
    is joined to the tokens.
    """
    keys = list(keys)
    if lexicon is None:
        return texts.select(*keys, F.posexplode_outer(filtered_terms(text_col, ann.stop_words(stop))).alias("pos", "term")
                            ).where(F.col("pos").isNotNull())
    sents = ann.sentences(texts, keys, text_col)
    tok = ann.tokens(sents, keys, stop, lexicon, with_deps=False)
    kept = token_filter(tok, stop)
    return with_positions(kept, keys)


def filtered_terms(text_col: str, stop: Sequence[str], allowed_pos: Sequence[str] = ALLOWED_POS):
    """F6/F7 on one text: the array of its filtered lemmas.  A sentence ends at
    whitespace, so the words of the text are the words of its sentences.  Words
    are runs of letters, so none is all digits; they are put in lower case in one
    string, one a line."""
    stop = list(stop)
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"(\p{L}{2,})"), 1)
    lower = F.filter(F.split(F.lower(F.array_join(words, "\n")), "\n"), lambda w: w != "")
    kept = F.filter(lower, lambda w: ann.lexicon_pos(w, w.isin(stop)).isin(list(allowed_pos)))
    return F.filter(F.transform(kept, ann.lexicon_lemma), lambda t: ~t.isin(stop))


def with_positions(kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number the kept terms of each document in ``(sent_id, tok_id)`` order."""
    keys = list(keys)
    per_doc = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct("sent_id", "tok_id", "term"))).alias("_t"))
    return per_doc.select(*keys, F.posexplode(F.transform("_t", lambda s: s["term"]))
                          .alias("pos", "term"))


def keyword_valid(words: DataFrame, word_col: str, stop: DataFrame,
                  vocabulary: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """keep keywords whose first token is a NOUN, whose lemma is not a stop
    word and (when ``vocabulary`` is given) whose lemma has a word vector.
    ``lexicon(word, lemma, pos)`` overrides the suffix rules, as in F7."""
    first = F.lower(F.regexp_extract(F.col(word_col), r"(\p{L}+)", 1))
    w = words.withColumn("_lw", first)
    stop_flag = stop.select(F.col("word").alias("_lw")).distinct().withColumn("_stop", F.lit(True))
    w = w.join(stop_flag, "_lw", "left")
    w = (w.withColumn("_pos", ann.lexicon_pos(F.col("_lw"), F.col("_stop").isNotNull()))
         .withColumn("_lemma", ann.lexicon_lemma(F.col("_lw"))))
    if lexicon is not None:
        own = lexicon.select(F.col("word").alias("_lw"), F.col("lemma").alias("_own_lemma"), F.col("pos").alias("_own_pos"))
        w = (w.join(own, "_lw", "left").withColumn("_lemma", F.coalesce("_own_lemma", "_lemma"))
             .withColumn("_pos", F.coalesce("_own_pos", "_pos")).drop("_own_lemma", "_own_pos"))
    w = w.where((F.col("_lw") != "") & (F.col("_pos") == "NOUN"))
    w = w.join(stop.select(F.col("word").alias("_lemma")), "_lemma", "left_anti")
    if vocabulary is not None:
        w = w.join(vocabulary.select(F.col("word").alias("_lemma")), "_lemma", "left_semi")
    return w.drop("_lw", "_stop", "_pos", "_lemma")
