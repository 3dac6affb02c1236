"""Secret scans through an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text.  The
ledger holds one row per scanned (blob, rule version): a run scans the pairs
that the ledger does not hold, however many paths or versions share a blob,
and findings are joined back to all of them.  A changed rule gets a new
version and is scanned alone; the other rules' pairs stand.

Rows of the ledger: ``blob``, ``kind``, ``rule_version`` and ``hits``: per
match, in order, the characters before it since the last match, the
characters of the match and of the part that must be long enough.  Positions
are running sums of these, so no text is needed to report them.

Scale: texts are combined per blob in the map tasks before the one shuffle
that carries them, so a blob with a third of all rows arrives as one row per
task; everything else moves 32-byte addresses.

Defined results: a null text is the empty blob; a blob without findings has
zero counts and empty lists; repeated rows are reported each; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """One kind of secret.  ``pattern`` is matched leftmost and without
    overlaps; a match counts when its ``group`` has ``min_chars`` characters.
    ``hint`` must occur in any text with a match; it saves the search."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    min_chars: int = 1
    hint: str = ""


#: The base kinds, in their order.
BASE = ("assign", "access", "hex")
#: The patterns of the base kinds.  For access and hex the
#: least length is part of the pattern: a run that is too short cannot hold a
#: later match, so this finds the same matches as dropping short ones does.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, "eyJ"),
)

HITS = "array<struct<gap:int,chars:int,part:int>>"


def address(text: Column) -> Column:
    """Content address: the 32 bytes of the text's SHA-256."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def rule_hits(text: Column, rule: Rule) -> Column:
    """Lengths of gaps, matches and counted parts, in order."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    hits = F.transform(
        F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), 1, F.size(found)).alias("gap"),
                     found.alias("chars"), parts.alias("part")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["chars"]).alias("chars"),
                           F.length(x["part"]).alias("part")))
    there = text.rlike(rule.pattern)
    if rule.hint:
        there = F.contains(text, F.lit(rule.hint)) & there
    return F.when(there, hits).otherwise(F.array().cast(HITS)).cast(HITS)


def pending_pairs(blobs: DataFrame, rules: Sequence[Rule], ledger: DataFrame) -> DataFrame:
    """Per blob the rules (kind:version) that the ledger has not seen on it."""
    wanted = F.explode(F.array(*[
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules]))
    pairs = blobs.select("blob", wanted.alias("_r")).select("blob", "_r.*")
    unseen = pairs.join(ledger.select("blob", "kind", "rule_version"),
                        ["blob", "kind", "rule_version"], "left_anti")
    return unseen.groupBy("blob").agg(
        F.collect_set(F.concat_ws(":", "kind", F.col("rule_version").cast("string"))).alias("_pending"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    """A stored ledger without rows."""
    return cut_lineage(spark.range(0).select(
        F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("int").alias("rule_version"), F.lit(None).cast(HITS).alias("hits")))


def scan_unseen(versions: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None,
                text_col: str = "text") -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of ``versions`` that
    ``ledger`` (none: an empty one) does not hold yet.  Append them to the stored
    ledger."""
    ledger = empty_ledger(versions.sparkSession) if ledger is None else ledger
    named = versions.select(address(F.col(text_col)).alias("blob"),
                            F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blobs = named.groupBy("blob").agg(F.first("text").alias("text"))
    todo = blobs.join(pending_pairs(blobs.select("blob"), rules, ledger), "blob")
    pairs = F.array(*[
        F.when(F.array_contains("_pending", f"{r.kind}:{r.version}"),
               F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"),
                        rule_hits(F.col("text"), r).alias("hits")))
        for r in rules])
    return todo.select("blob", F.inline(F.filter(pairs, lambda p: p.isNotNull())))


def findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, kind, start, end) of the current rules' matches that count;
    code points, end exclusive."""
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    hits = (ledger.where((F.size("hits") > 0) & F.array_contains(
                current, F.concat_ws(":", "kind", F.col("rule_version").cast("string"))))
            .select("blob", "kind", F.posexplode("hits").alias("at", "hit")))
    so_far = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.select("blob", "kind", "hit",
                         F.sum((F.col("hit.gap") + F.col("hit.chars")).cast("long")).over(so_far).alias("end"))
    least = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(r.min_chars)) for r in rules], F.lit(1))
    return (placed.where(F.col("hit.part") >= least)
            .select("blob", "kind", (F.col("end") - F.col("hit.chars")).alias("start"), "end"))


def blob_report(found: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[str] = BASE) -> DataFrame:
    """Per blob with findings: a count for each base kind and the spans, base
    and all, in order of start and then of the rules' order."""
    rank = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(i)) for i, r in enumerate(rules)])
    spans = found.groupBy("blob").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in base],
        F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans"))
    return spans.withColumns({
        "base_spans": joined(F.filter("spans", lambda s: s["kind"].isin(*base))),
        "spans": joined(F.col("spans"))})


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report_paths(versions: DataFrame, ledger: DataFrame, key_cols: Sequence[str] = ("doc_id",),
                 text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of the ledger joined back to every version of every path."""
    paths = versions.select(*key_cols, address(F.col(text_col)).alias("blob"))
    out = paths.join(blob_report(findings(ledger, rules), rules), "blob", "left")
    none = F.lit("")
    return out.select(
        *key_cols, *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base_spans", none).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", none).alias("spans"))
