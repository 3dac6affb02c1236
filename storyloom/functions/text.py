"""Column-level text functions (all JVM-side regex / higher-order functions).

Every function takes and returns a ``Column`` so it stays inside whole-stage
codegen.  Character classes are spelled out instead of ``\\w`` / ``\\s`` /
``\\b`` so that the same rule means the same thing in Java regex (Spark) and in
RE2 (the DuckDB oracle), and so that accented letters and no-break spaces
count as word / space characters.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.arrays import bind

# Character classes shared with the SQL oracle.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = (r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
#: The characters of ``SPACE``.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"

# ---------------------------------------------------------------------------
# These must equal the reference for equal results.
# ---------------------------------------------------------------------------
ELLIPSIS = "…"
CLEAN_SYMBOLS = "@#^&*)(:|/><}{"
UNWANTED_PHRASES = ("Read More", "Source")
SENTIMENT_NEUTRAL_LOW = 0.4
SENTIMENT_NEUTRAL_HIGH = 0.6
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze_space(c) -> Column:
    """Every run of whitespace as one blank; a blank that stands alone is no match."""
    return F.regexp_replace(_col(c), rf" {SPACE}+|(?! ){SPACE}{SPACE}*", " ")


def strip_space(c) -> Column:
    """Trim every kind of whitespace at both ends (Python ``str.strip``)."""
    return F.btrim(_col(c), F.lit(SPACES))


def split_sentences(c, limit: int | None = None) -> Column:
    """M1: split after ``.``, ``!`` or ``?`` followed by whitespace.

    Pieces are trimmed and blank pieces dropped.  ``limit`` = keep at most that
    many sentences; the split then stops early instead of cutting the whole
    text (only the tail piece may be blank, so the result is the same).
    """
    pattern = rf"(?<=[.!?]){SPACE}+"
    if limit is None:
        pieces = F.split(_col(c), pattern)
    else:
        pieces = F.slice(F.split(_col(c), pattern, limit + 1), 1, limit)
    return F.filter(F.transform(pieces, strip_space), lambda s: s != F.lit(""))


def intro(title, article, n_sentences: int = 8) -> Column:
    """``title + '.'`` then the first ``n`` sentences, joined by a space."""
    head = F.concat(F.coalesce(_col(title), F.lit("")), F.lit("."))
    return F.array_join(
        F.concat(F.array(head), split_sentences(article, n_sentences)), " ")


def clean_text(c) -> Column:
    """M2: the five cleaning rules, in the reference order.  A pattern begins with
    its rarest character, what precedes that is looked up where it occurs."""
    t = F.replace(_col(c), F.lit(ELLIPSIS), F.lit(""))
    t = F.regexp_replace(t, rf"-(?<={WORD}-)(?={WORD})| --", " ")
    t = F.regexp_replace(t, "[" + _escape_class(CLEAN_SYMBOLS) + "]", " ")
    t = squeeze_space(t)
    t = F.regexp_replace(t, whole_words_pattern(UNWANTED_PHRASES), " ")
    return t


def _escape_class(chars: str) -> str:
    return "".join("\\" + ch if ch in "^[]\\-&" else ch for ch in chars)


def quote_regex(word: str) -> str:
    """Quote a literal for Java regex (``\\Q…\\E`` safe for any text)."""
    return r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E"


def whole_words_pattern(words: Iterable[str]) -> str:
    """Whole-word alternation plus the whitespace after it (longest first)."""
    alts = sorted({w for w in words if w}, key=lambda w: (-len(w), w))
    body = "|".join(quote_regex(w) for w in alts)
    return rf"(?<!{WORD})(?:{body})(?!{WORD}){SPACE}*"


def capital_runs(c) -> Column:
    """Runs of capitalised words that do not open a sentence, each joined by
    blanks, in order (``array<string>``): the entities of the default tagger, read
    off the whole text.  Sentences become lines and words one blank apart."""
    lines = F.regexp_replace(F.replace(_col(c), F.lit("\n"), F.lit(" ")), rf"(?<=[.!?]){SPACE}+", "\n")
    words = F.regexp_replace(lines, r" [^\p{L}\n]+|[^\p{L}\n ][^\p{L}\n]*", " ")
    return F.regexp_extract_all(words, F.lit(r"(?<=\p{L} )\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*"), F.lit(0))


def remove_words(c, words: Iterable[str]) -> Column:
    """M3: drop listed words (case sensitive, whole words), squeeze spaces."""
    words = list(words)
    t = _col(c)
    if words:
        t = F.regexp_replace(t, whole_words_pattern(words), " ")
    return squeeze_space(t)


def remove_entities(text, entities) -> Column:
    """M5: remove every entity of the row (array column) as a whole word.

    The pattern is built per row from the quoted entity array, longest first;
    an empty or null array leaves the text unchanged.
    """
    ents = F.array_sort(
        F.filter(F.array_distinct(_col(entities)), lambda e: F.length(e) > 0),
        lambda a, b: F.when(F.length(a) > F.length(b), -1)
        .when(F.length(a) < F.length(b), 1)
        .when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = F.transform(ents, lambda e: F.concat(
        F.lit(r"\Q"), F.replace(e, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.concat(F.lit(rf"(?<!{WORD})(?:"), F.array_join(quoted, "|"),
                       F.lit(rf")(?!{WORD}){SPACE}*"))
    return F.when(F.coalesce(F.size(ents), F.lit(0)) <= 0, _col(text)).otherwise(
        F.regexp_replace(_col(text), pattern, F.lit(" ")))


def sentiment_bucket(c) -> Column:
    """M4: mean 0/1 label → Neutral / Positive / Negative (null stays null)."""
    a = _col(c)
    return (F.when(a.isNull(), F.lit(None).cast("string"))
            .when((a >= SENTIMENT_NEUTRAL_LOW) & (a <= SENTIMENT_NEUTRAL_HIGH), "Neutral")
            .when(a > SENTIMENT_NEUTRAL_HIGH, "Positive")
            .otherwise("Negative"))


def lcs_words(first, second) -> Column:
    """M7: longest run of whole words of ``first`` that also occurs in ``second``.

    Words are split on a single space; the earliest run wins ties; no common
    word → empty string.  Dynamic programme over the two word arrays folded
    with ``aggregate``: for each word of ``first`` the lengths of the common
    runs ending there against every word of ``second`` (O(n·m) per row).
    """
    def longest(a, b):
        init = F.struct(F.transform(b, lambda _: F.lit(0)).alias("prev"),
                        F.lit(0).alias("best"), F.lit(-1).alias("end"))

        def step(acc, i):
            word = F.element_at(a, i + 1)
            row = F.transform(b, lambda w, j: F.when(
                w == word, F.when(j == 0, F.lit(1)).otherwise(F.element_at(acc["prev"], j) + 1)
            ).otherwise(F.lit(0)))

            def scored(cur):
                top = F.coalesce(F.array_max(cur), F.lit(0))
                better = top > acc["best"]
                return F.struct(cur.alias("prev"),
                                F.when(better, top).otherwise(acc["best"]).alias("best"),
                                F.when(better, i).otherwise(acc["end"]).alias("end"))
            return bind(row, scored)

        return F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), init, step, lambda res: F.when(
            res["best"] > 0, F.array_join(F.slice(a, res["end"] - res["best"] + 2, res["best"]), " ")).otherwise(F.lit("")))

    return bind(F.split(_col(first), " "), lambda a: bind(F.split(_col(second), " "), lambda b: longest(a, b)))


def split_keywords(c) -> Column:
    """M9: bigram keywords ``a_b`` → words, flattened in order."""
    return F.flatten(F.transform(_col(c), lambda k: F.split(k, "_")))


def letter_words(c) -> Column:
    """Default tokenizer: runs of letters, in order (``array<string>``)."""
    return F.regexp_extract_all(_col(c), F.lit(r"(\p{L}+)"), 1)
