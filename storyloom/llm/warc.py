"""WARC derivatives: linked metadata and plain-text conversion records.

A response record becomes two records that refer to it: ``metadata`` with the
facts of the exchange (status, source headers, title, language, links) and
``conversion`` with the text of the page.  Both keep the response's target
address and date, name it in ``WARC-Refers-To`` and carry its payload digest,
so a record can be traced to its source without the source file.

Record ids are name-based: the same response always yields the same
derivatives, so a task that runs again writes the same records.

Everything is a projection followed by a two-way explode: no shuffle, no
Python, one pass over the pages.  Every pattern matches up to the end of the
page where its closing part is missing, so its cost follows the page's length.

Defined results: a response without an empty line has headers only and an
empty payload; null blocks count as empty; pages without markup convert to
themselves; comments, hidden elements and tags that never close reach to the
end of the page; character references (decimal, hexadecimal, named) become
their character, white space and the no-break space a blank, code points that
are none U+FFFD, unknown names stay as written; repeated responses give repeated records; extra columns stay.
"""

from __future__ import annotations

from functools import reduce
from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is not text.
HIDDEN = ("script", "style", "noscript", "template")
#: Tags that end a line.
BREAKS = ("p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|header|footer|nav|main|aside|"
          "title|head|body|pre|blockquote|form|figure")
#: Named character references of HTML 4 and their code points in HTML 5, as the
#: standard library lists them.
REFERENCES = {name: ord(html5[f"{name};"]) for name in [*name2codepoint, "apos"]}
#: A reference without its ampersand.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
#: Code points that become a blank.
BLANK_CODES = (9, 10, 11, 12, 13, 160)
NO_CHARACTER = 0xFFFD
CRLF = "\r\n"
#: Comments and hidden elements, in one pass.
UNSEEN = r"(?is)<(?:!--.*?(?:-->|\z)|" + "|".join(rf"{name}\b.*?(?:</{name}\s*>|\z)" for name in HIDDEN) + ")"
#: Tags that end a line, and all tags.
BREAK_TAG = rf"(?i)</?(?:{BREAKS})\b[^>]*(?:>|\z)"
TAG = r"<[/!?a-zA-Z][^>]*(?:>|\z)"
#: White space that becomes a blank.
BLANKS = "\t\r\n\f\x0b"


def record_id(kind: str, *parts: Column) -> Column:
    """Name-based identifier of a record."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)),
                    F.lit(">"))


def digest(block: Column) -> Column:
    """Labelled digest of a block's UTF-8 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses_from_pages(pages: DataFrame, warc_date: str, key_col: str = "page_id", url_col: str = "url",
                         html_col: str = "html") -> DataFrame:
    """Response records of raw pages: (key, record_id, target_uri, warc_date, block)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length(html).cast("string"), F.lit(CRLF + CRLF))
    return pages.select(
        key_col, record_id("response", F.col(key_col), F.col(url_col), html).alias("record_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("target_uri"), F.lit(warc_date).alias("warc_date"),
        F.concat(head, html).alias("block"))


def with_characters(x: Column) -> Column:
    """``x`` with its character references replaced, each once."""
    names = F.create_map(*[F.lit(v) for name, code in REFERENCES.items() for v in (name, code)])

    def code_of(r: Column) -> Column:
        ref = r["ref"]
        number = (F.when(F.lower(F.substring(ref, 1, 2)) == "#x", F.conv(F.substring(ref, 3, 6), 16, 10).try_cast("int"))
                  .when(F.startswith(ref, F.lit("#")), F.substring(ref, 2, 7).try_cast("int"))
                  .when(ref != "", F.try_element_at(names, ref)))
        return F.struct(r["p"].alias("p"), r["n"].alias("n"), number.alias("code"))

    def character(code: Column) -> Column:
        none = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        valid = F.when(none, F.lit(NO_CHARACTER)).when(code.isin(*BLANK_CODES), F.lit(32)).otherwise(code)
        return F.decode(F.unhex(F.lpad(F.hex(valid), 8, "0")), "UTF-32")

    def after(p: Column) -> Column:
        return F.substring(p, F.instr(p, ";") + 1, F.length(p))

    found = F.transform(F.split(x, "&"), lambda p, i: F.struct(
        p.alias("p"), i.alias("n"), F.when(i == 0, "").otherwise(F.regexp_extract(p, REFERENCE, 1)).alias("ref")))
    coded = F.transform(found, code_of)
    return F.array_join(F.transform(coded, lambda r: F.when(r["n"] == 0, r["p"])
                                    .when(r["code"].isNull(), F.concat(F.lit("&"), r["p"]))
                                    .otherwise(F.concat(character(r["code"]), after(r["p"])))), "")


def plain_text(html: Column) -> Column:
    """Text of a page, one line per block element."""
    x = F.regexp_replace(html, UNSEEN, "")
    x = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), BLANKS, x)
    x = F.regexp_replace(x, BREAK_TAG, "\n")
    x = with_characters(F.regexp_replace(x, TAG, ""))
    x = F.regexp_replace(x, r"  +", " ")
    x = F.replace(F.replace(x, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    x = F.regexp_replace(x, r"\n\n+", "\n")
    return F.btrim(x, F.lit(" \n"))


def source_header(head: Column, name: str) -> Column:
    """Value of an HTTP header, empty if missing."""
    return F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows per response record: ``metadata`` and ``conversion``.

    Input columns ``record_id``, ``target_uri``, ``warc_date`` and ``block``
    (the HTTP message); other columns stay unless a result has their name."""
    own = ["record_id", "target_uri", "warc_date", "block"]
    made = ["record_type", "refers_to", "content_type", "content_length", "block_digest", "source_digest",
            "source_headers"]
    extra = [c for c in responses.columns if c not in own + made]
    block = F.coalesce(F.col("block"), F.lit(""))
    at = F.instr(block, CRLF + CRLF)
    packed = F.struct(*[F.col(f"`{c}`") for c in extra]) if extra else F.lit(None)
    parted = responses.select(
        packed.alias("_own"), *own[:3],
        F.when(at > 0, F.substring(block, F.lit(1), at - 1)).otherwise(block).alias("_head"),
        F.when(at > 0, F.substring(block, at + 4, F.length(block))).otherwise("").alias("_html"))
    html, head = F.col("_html"), F.col("_head")
    facts = parted.select("*", digest(html).alias("source_digest"), plain_text(html).alias("_text"))
    title = F.btrim(F.regexp_replace(F.regexp_extract(html, r"(?i)<title[^<>]*>([^<]*)", 1), r"[ \t\r\n\f\x0B]+", " "))
    fields = [
        ("source-status", F.regexp_extract(head, r"^HTTP/[0-9.]+ ([0-9]+)", 1)),
        ("source-content-type", source_header(head, "content-type")),
        ("source-content-length", F.octet_length(html).cast("string")),
        ("title", title),
        ("language", F.lower(F.regexp_extract(html, r"""(?i)<html[^<>]*\blang=["']?([a-zA-Z-]+)""", 1))),
        ("outlinks", F.regexp_count(html, F.lit(r"(?i)<a\s[^<>]*href=")).cast("string")),
        ("text-length", F.length("_text").cast("string")),
    ]
    metadata = F.concat(*[x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit(CRLF))])
    both = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"),
                 metadata.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"),
                 F.col("_text").alias("block")))
    rows = facts.withColumn("_r", F.explode(both))
    return rows.select(
        *[F.col("_own")[c].alias(c) for c in extra], "_r.record_type",
        F.when(F.col("_r.record_type") == "metadata", record_id("metadata", F.col("record_id")))
        .otherwise(record_id("conversion", F.col("record_id"))).alias("record_id"),
        F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "_r.content_type",
        F.octet_length("_r.block").cast("long").alias("content_length"), "_r.block",
        digest(F.col("_r.block")).alias("block_digest"), "source_digest", head.alias("source_headers"))


def record_text(records: DataFrame) -> DataFrame:
    """Each record in WARC/1.1 form, without the two line ends that close it."""
    lines = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
             ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"),
             ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type")]
    head = [x for name, c in lines for x in (F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit("")), F.lit(CRLF))]
    return records.select(F.concat(
        F.lit(f"WARC/1.1{CRLF}"), *head, F.lit("Content-Length: "), F.col("content_length").cast("string"),
        F.lit(CRLF + CRLF), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC files, one per partition, closed by two line ends each."""
    (record_text(records).write.mode("overwrite").option("lineSep", CRLF + CRLF)
     .option("compression", compression).text(path))
