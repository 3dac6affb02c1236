"""Entity spans: BILOU decoding (E1), entity pairs (E2), mention resolution
and entity removal from text (M5 at table level)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.arrays import greedy_spans
from storyloom.functions.text import remove_entities

# Fixed value: entity types the triple extractor ignores.
TRIPLE_IGNORED_TYPES = ("DATE", "MONEY", "TIME", "CARDINAL", "PERCENT", "QUANTITY")


def decode_bilou(tags: DataFrame, scope: Sequence[str],
                 ignore_types: Iterable[str] = ()) -> DataFrame:
    """``tags(scope…, tok_id, word, tag)`` → distinct ``(scope…, entity)``.

    ``U`` gives a one-word entity.  Inside a scope, every ``B`` starts a span;
    ``I`` and ``L`` extend the current span (``O``, ``U`` and ignored tags do
    not break it) and every ``L`` emits the words from its ``B`` up to itself,
    so ``B L L`` emits two entities.  ``I``/``L`` before any ``B`` emit nothing.
    """
    scope = list(scope)
    ignore = list(ignore_types)
    pos = F.substring_index("tag", "-", 1)
    typ = F.expr("substring(tag, instr(tag, '-') + 1)")
    t = (tags.where(F.col("tag") != "O")
         .withColumn("_pos", pos).withColumn("_type", typ))
    if ignore:
        t = t.where(~F.col("_type").isin(ignore))
    single = t.where(F.col("_pos") == "U").select(*scope, F.col("word").alias("entity"))
    spans = t.where(F.col("_pos").isin("B", "I", "L"))
    w = Window.partitionBy(*scope).orderBy("tok_id")
    spans = spans.withColumn("_span", F.sum((F.col("_pos") == "B").cast("int")).over(w))
    spans = spans.where(F.col("_span") > 0)
    w_span = (Window.partitionBy(*scope, "_span").orderBy("tok_id")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = spans.withColumn("_words", F.collect_list("word").over(w_span))
    multi = spans.where(F.col("_pos") == "L").select(
        *scope, F.array_join("_words", " ").alias("entity"))
    return single.unionByName(multi).distinct()


def bilou_entities(tagged, ignore_types: Iterable[str] = ()):
    """E1 on one text's ``array<struct<word, tag>>`` (words without blanks): its
    distinct entities as an array, by the rules of ``decode_bilou``.

    The tokens of long entities become one string that is cut before every ``B``;
    what precedes the first ``B`` goes."""
    kind = lambda t: F.substring(t["tag"], 1, 1)
    own = F.filter(tagged, lambda t: (t["tag"] != "O") & ~F.substring_index(t["tag"], "-", -1).isin(list(ignore_types)))
    single = F.transform(F.filter(own, lambda t: kind(t) == "U"), lambda t: t["word"])
    line = F.array_join(F.transform(F.filter(own, lambda t: kind(t) != "U"), lambda t: F.concat(
        F.when(kind(t) == "B", F.lit("\n")).otherwise(F.lit("")), kind(t), t["word"])), " ")
    spans = F.slice(F.split(line, " ?\n"), 2, 1 << 30)
    ends = lambda span: F.filter(F.transform(F.split(span, " "), lambda p, i: F.when(
        F.startswith(p, F.lit("L")),
        F.array_join(F.transform(F.slice(F.split(span, " "), F.lit(1), i + 1), lambda q: F.substring(q, F.lit(2), F.length(q))), " "))),
        lambda e: e.isNotNull())
    return F.array_distinct(F.concat(single, F.flatten(F.transform(spans, ends))))


def entity_spans(tags: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Token spans of the tagged entities, ``scope…, start, end, ent_type`` (end
    exclusive): a ``U`` alone, a ``B`` up to the first ``L`` after it."""
    scope = list(scope)
    pos = F.substring_index("tag", "-", 1)
    typ = F.expr("substring(tag, instr(tag, '-') + 1)")
    t = tags.where(F.col("tag") != "O").select(*scope, "tok_id", pos.alias("_pos"), typ.alias("ent_type"))
    single = t.where(F.col("_pos") == "U").select(
        *scope, F.col("tok_id").alias("start"), (F.col("tok_id") + 1).alias("end"), "ent_type")
    w = Window.partitionBy(*scope).orderBy("tok_id")
    runs = (t.where(F.col("_pos") != "U")
            .withColumn("_span", F.sum((F.col("_pos") == "B").cast("int")).over(w)).where("_span > 0"))
    long = (runs.groupBy(*scope, "_span")
            .agg(F.min("tok_id").alias("start"), (F.min(F.when(F.col("_pos") == "L", F.col("tok_id"))) + 1).alias("end"),
                 F.min_by("ent_type", "tok_id").alias("ent_type"))
            .where(F.col("end").isNotNull()).drop("_span"))
    return single.unionByName(long)


def with_entity_types(tokens: DataFrame, tags: DataFrame, scope: Sequence[str]) -> DataFrame:
    """``tokens`` with ``ent_type`` of the entity that holds each token (``""`` outside)."""
    scope = list(scope)
    typed = entity_spans(tags, scope).select(
        *scope, F.explode(F.sequence("start", F.col("end") - 1)).alias("tok_id"), "ent_type")
    return (tokens.join(typed, [*scope, "tok_id"], "left")
            .withColumn("ent_type", F.coalesce("ent_type", F.lit(""))))


def entity_arrays(entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct entities per text as a sorted array (small per text)."""
    return entities.groupBy(*keys).agg(F.array_sort(F.collect_set("entity")).alias("entities"))


def strip_entities(texts: DataFrame, entities: DataFrame, keys: Sequence[str],
                   text_col: str, out: str) -> DataFrame:
    """M5: remove each text's entities (whole words) from ``text_col``."""
    ents = entity_arrays(entities, keys)
    return (texts.join(ents, list(keys), "left")
            .withColumn(out, remove_entities(text_col, "entities"))
            .drop("entities"))


def entity_pairs(tags: DataFrame, tokens: DataFrame, keys: Sequence[str],
                 min_tokens: int = 3) -> DataFrame:
    """Sentences of at least ``min_tokens`` tokens with exactly two distinct
    entities → ``(keys…, sent_id, a, b)``, a before b in text order."""
    scope = [*keys, "sent_id"]
    ents = decode_bilou(tags, scope)
    first_at = (tags.select(*scope, "tok_id", "word"))
    # text position of an entity: first token where its first word appears
    pos = ents.withColumn("_w0", F.substring_index("entity", " ", 1)).join(
        first_at.withColumnRenamed("word", "_w0"), [*scope, "_w0"], "left"
    ).groupBy(*scope, "entity").agg(F.min("tok_id").alias("_at"))
    sizes = tokens.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
    two = (pos.groupBy(*scope)
           .agg(F.count(F.lit(1)).alias("_k"),
                F.sort_array(F.collect_list(F.struct(
                    F.coalesce("_at", F.lit(1 << 30)).alias("at"), "entity"))).alias("_e"))
           .where(F.col("_k") == 2))
    return (two.join(sizes, scope).where(F.col("_n") >= min_tokens)
            .select(*scope, F.col("_e")[0]["entity"].alias("a"),
                    F.col("_e")[1]["entity"].alias("b")))


def resolve_mentions(texts: DataFrame, mentions: DataFrame, keys: Sequence[str],
                     text_col: str, out: str) -> DataFrame:
    """Replace each mention ``[start, end)`` (0-based characters) by its
    replacement.  Overlaps: the longest mention wins, then the leftmost.

    The text is cut into kept and replaced pieces ordered by position and glued
    back with ``concat_ws``; texts without mentions pass through unchanged.
    """
    keys = list(keys)
    spans = F.struct("start", "end", "replacement")
    per_text = (mentions.groupBy(*keys).agg(F.collect_list(spans).alias("_m"))
                .withColumn("_m", greedy_spans("_m")))
    t = texts.join(per_text, keys, "left")
    txt = F.col(text_col)
    # piece i: text between mention i-1 and mention i, then mention i's replacement
    prev_end = lambda arr, i: F.when(i == 0, F.lit(0)).otherwise(arr[i - 1]["end"])
    pieces = F.transform(F.col("_m"), lambda s, i: F.concat(
        F.substring(txt, prev_end(F.col("_m"), i) + 1, s["start"] - prev_end(F.col("_m"), i)),
        s["replacement"]))
    tail = F.expr(f"substring(`{text_col}`, element_at(_m, -1).end + 1)")
    glued = F.concat(F.array_join(pieces, ""), tail)
    return t.withColumn(out, F.when(F.col("_m").isNull() | (F.size("_m") == 0), txt)
                        .otherwise(glued)).drop("_m")


#: A name: up to six capitalised words, one blank apart.  A longer run of them is
#: several names.
NAME_PATTERN = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+){0,5}"
NAME_WORDS = 6


def names_in_order(texts: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """``keys…, i, start, name``: the names of each text, counted from 0, with
    their place in characters."""
    keys = list(keys)
    found = F.regexp_extract_all(F.col(text_col), F.lit(NAME_PATTERN), F.lit(0))
    gaps = F.transform(F.split(F.col(text_col), NAME_PATTERN, -1), lambda g: F.length(g))
    rows = texts.select(*keys, F.posexplode(F.arrays_zip(found.alias("name"), gaps.alias("gap"))).alias("i", "_n"))
    rows = rows.where(F.col("_n.name").isNotNull()).select(*keys, "i", F.col("_n.name").alias("name"),
                                                           F.col("_n.gap").alias("_gap"))
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("_gap") + F.length("name")).over(w)
    return rows.select(*keys, "i", (end - F.length("name")).cast("int").alias("start"), "name")


def link_mentions(texts: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """Mentions for J7 out of the text itself: a name that is the end of a longer
    name seen earlier in the same text ("Smith" after "Anna Smith") stands for it.
    Of several, the one of most words counts, then the last seen; as the end of an
    end is an end, no chain of links is left.  ``keys…, start, end, replacement``.

    A name offers each of its proper ends under that end; a running maximum in
    order of the text finds the best offer before every name.  One shuffle of
    names, none of texts; a task orders one text's names of one spelling.
    """
    keys = list(keys)
    names = names_in_order(texts, keys, text_col)
    words = names.withColumn("_w", F.split("name", " "))
    n = F.size("_w")
    ends = F.transform(F.sequence(F.lit(2), n), lambda a: F.array_join(F.slice("_w", a, F.lit(NAME_WORDS)), " "))
    offered = words.where(n > 1).select(*keys, "i", F.explode(ends).alias("key"),
                                        F.struct(n.alias("n"), "i", "name").alias("offer"), F.lit(None).cast("int").alias("start"))
    asked = names.select(*keys, "i", F.col("name").alias("key"),
                         F.lit(None).cast("struct<n:int,i:int,name:string>").alias("offer"), "start")
    before = Window.partitionBy(*keys, "key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    linked = offered.unionByName(asked).withColumn("_best", F.max("offer").over(before))
    return (linked.where(F.col("start").isNotNull() & F.col("_best").isNotNull())
            .select(*keys, "start", (F.col("start") + F.length("key")).alias("end"),
                    F.col("_best.name").alias("replacement")))
