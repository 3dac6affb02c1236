"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from storyloom.llm import secret_ledger, warc
from storyloom.llm.jaccard_join import THRESHOLD, WIDTH
from storyloom.llm.queries import WARC_DATE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: RE2 folds case beyond ASCII, so either case is written out.
_EITHER = {r"(?i:password|passwd|secret|token|api_?key)": "(?:%s)" % "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    for word in ("password", "passwd", "secret", "token", "api_?key"))}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secrets() -> str:
    """Matches of each rule with their places, from gaps and lengths."""
    kinds = []
    for rank, rule in enumerate(secret_ledger.RULES):
        pattern = rule.pattern
        for own, either in _EITHER.items():
            pattern = pattern.replace(own, either)
        p = _text(pattern)
        kinds.append(f"""
SELECT doc_id, {rank} AS rank, {_text(rule.kind)} AS kind, regexp_extract_all(t, {p}) AS found,
       regexp_extract_all(t, {p}, {rule.group}) AS part, regexp_split_to_array(t, {p}) AS gaps, {rule.min_chars} AS least
FROM d""")
    joined = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank)"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in secret_ledger.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(kinds)}),
i AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (
  SELECT doc_id, rank, kind, length(found[i]) AS n, least, length(part[i]) AS n_part,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start FROM i),
h AS (SELECT doc_id, rank, kind, CAST(start AS BIGINT) AS a, CAST(start + n AS BIGINT) AS b FROM s WHERE n_part >= least),
r AS (SELECT doc_id, {counts}, {joined} FILTER (rank < {len(secret_ledger.BASE)}) AS base, {joined} AS spans
      FROM h GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_ledger.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (doc_id)"""


def _warc() -> str:
    """The page's text by the same replacements, the records as two branches."""
    x = f"regexp_replace(html, {_text(warc.UNSEEN)}, '', 'g')"
    x = rf"regexp_replace({x}, '[ \t\r\n\f\x0B]+', ' ', 'g')"
    x = f"regexp_replace({x}, {_text(warc.BREAK_TAG)}, chr(10), 'g')"
    x = f"regexp_replace({x}, {_text(warc.TAG)}, '', 'g')"
    names = "[" + ", ".join(_text(n) for n in warc.REFERENCES) + "]"
    codes = "[" + ", ".join(str(c) for c in warc.REFERENCES.values()) + "]"
    digits = "'0123456789abcdef'"
    ref = f"regexp_extract(p, {_text(warc.REFERENCE)}, 1)"
    code = f"""CASE WHEN {ref} = '' THEN NULL
      WHEN starts_with(lower({ref}), '#x') THEN list_reduce(list_transform(string_split(substr(lower({ref}), 3), ''),
             lambda c: strpos({digits}, c) - 1), lambda a, d: 16 * a + d)
      WHEN starts_with({ref}, '#') THEN TRY_CAST(substr({ref}, 2) AS BIGINT)
      ELSE {codes}[list_position({names}, {ref})] END"""
    refs = f"""
m AS (SELECT page_id, target_uri, html, string_split({x}, '&') AS pieces FROM p),
e AS (SELECT row_number() OVER () AS rn, * FROM m),
u AS (SELECT rn, unnest(pieces[2:]) AS p, unnest(range(2, len(pieces) + 1)) AS i FROM e),
k AS (SELECT rn, i, p, {code} AS c FROM u),
t AS (SELECT rn, string_agg(CASE WHEN c IS NULL THEN '&' || p
         WHEN c = 0 OR c BETWEEN 55296 AND 57343 OR c > 1114111 THEN chr({warc.NO_CHARACTER}) || substr(p, strpos(p, ';') + 1)
         WHEN c IN {warc.BLANK_CODES} THEN ' ' || substr(p, strpos(p, ';') + 1)
         ELSE chr(CAST(c AS INTEGER)) || substr(p, strpos(p, ';') + 1) END, '' ORDER BY i) AS tail FROM k GROUP BY rn),
q AS (SELECT page_id, target_uri, html, pieces[1] || coalesce(tail, '') AS marked FROM e LEFT JOIN t USING (rn)),"""
    x = "marked"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, ' ?\n ?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n\n+', chr(10), 'g')"
    text = f"trim({x}, ' ' || chr(10))"
    def uuid(*parts: str) -> str:
        h = f"md5(concat_ws(chr(31), {', '.join(parts)}))"
        return (f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' "
                f"|| substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'")
    crlf = "chr(13) || chr(10)"
    title = r"trim(regexp_replace(regexp_extract(html, '(?i)<title[^<>]*>([^<]*)', 1), '[ \t\r\n\f\x0B]+', ' ', 'g'))"
    lang = r"""lower(regexp_extract(html, '(?i)<html[^<>]*\blang=["'']?([a-zA-Z-]+)', 1))"""
    links = r"len(regexp_extract_all(html, '(?i)<a\s[^<>]*href='))"
    return rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
{refs}
r AS (
  SELECT *, {uuid("'response'", "CAST(page_id AS VARCHAR)", "target_uri", "html")} AS rid, {text} AS body,
         'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf}
         || 'Content-Length: ' || strlen(html) AS head,
         'sha256:' || sha256(html) AS source_digest
  FROM q),
b AS (
  SELECT * EXCLUDE (marked), 'metadata' AS record_type, 'application/warc-fields' AS content_type,
         'source-status: 200' || {crlf} || 'source-content-type: text/html; charset=utf-8' || {crlf}
         || 'source-content-length: ' || strlen(html) || {crlf} || 'title: ' || {title} || {crlf}
         || 'language: ' || {lang} || {crlf} || 'outlinks: ' || {links} || {crlf}
         || 'text-length: ' || length(body) || {crlf} AS block FROM r
  UNION ALL
  SELECT * EXCLUDE (marked), 'conversion', 'text/plain; charset=utf-8', body FROM r)
SELECT page_id, record_type, {uuid("record_type", "rid")} AS record_id, rid AS refers_to, target_uri,
       '{WARC_DATE}' AS warc_date, content_type, CAST(strlen(block) AS BIGINT) AS content_length, block,
       'sha256:' || sha256(block) AS block_digest, source_digest, head AS source_headers
FROM b"""


def _words(c: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _links() -> str:
    """All pairs that share an n-gram, and the closure of the links."""
    return rf"""
WITH RECURSIVE dw AS (SELECT doc_id, {_words("text")} AS w FROM documents),
dp AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS p FROM dw WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + {WIDTH - 1}], ' ') AS g FROM dp),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (g)
       WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM pr JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
      WHERE c * 1000 >= (a.n + b.n - c) * {round(THRESHOLD * 1000)}),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x, min(y) AS class_id FROM r GROUP BY 1),
l AS (SELECT x, count(*) AS n FROM e GROUP BY 1)
SELECT k.x AS doc_id, class_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links FROM k LEFT JOIN l ON l.x = k.x"""


def _benchmark_hits() -> str:
    """Windows of either side joined as text."""
    return rf"""
WITH dw AS (SELECT doc_id, {_words("text")} AS w FROM documents),
iw AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
ip AS (SELECT item_id, w, least(10, len(w)) AS s, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p
       FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, s, array_to_string(w[p:p + s - 1], ' ') AS g FROM ip),
sizes AS (SELECT DISTINCT s FROM win),
dp AS (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS p FROM dw CROSS JOIN sizes WHERE len(w) >= s),
hit AS (SELECT doc_id, p, dp.s, item FROM dp JOIN win ON win.s = dp.s AND win.g = array_to_string(w[p:p + dp.s - 1], ' ')),
hw AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(p, p + s)) AS word FROM hit) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(hw.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""


def _merkle() -> str:
    """Both trees level by level; every leaf folded upwards over its siblings.
    The checksum runs bit by bit over the digits of the key."""
    def digest(low: bool) -> str:
        text = f"translate(text, '{_UPPER}', '{_LOWER}')" if low else "text"
        parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
                 for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    bits = "list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b))"
    crc = (f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), "
           f"lambda c, b: {bits}, 4294967295), 4294967295)")
    def siblings(tree: str) -> str:
        return f"""
SELECT a.g, a.lv, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
       coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
FROM {tree} a JOIN {tree} b ON a.g IS NOT DISTINCT FROM b.g AND a.lv = b.lv AND a.i // 16 = b.i // 16
WHERE a.n > 1 GROUP BY ALL"""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {digest(False)} AS leaf,
                            CASE WHEN {crc} % 5 = 0 THEN {digest(True)} END AS altered FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT source AS g, 0 AS lv, pos AS i, leaf AS h, n FROM o UNION ALL
      SELECT g, lv + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM t WHERE n > 1
      GROUP BY g, lv, i // 16, n),
s AS (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS place, count(*) OVER () AS n
      FROM t WHERE n = 1),
u AS (SELECT 0 AS g, 0 AS lv, place AS i, subroot AS h, n FROM s UNION ALL
      SELECT g, lv + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM u WHERE n > 1
      GROUP BY g, lv, i // 16, n),
ts AS ({siblings("t")}), us AS ({siblings("u")}),
f AS (SELECT doc_id, source, pos, 0 AS lv, pos AS i, coalesce(altered, leaf) AS h, '' AS p FROM o UNION ALL
      SELECT doc_id, source, pos, f.lv + 1, f.i // 16, sha256(l || h || r), p || l || r
      FROM f JOIN ts ON ts.g IS NOT DISTINCT FROM f.source AND ts.lv = f.lv AND ts.i = f.i),
ft AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source, pos ORDER BY lv DESC) = 1),
v AS (SELECT ft.source, pos, 0 AS lv, place AS i, h, p FROM ft JOIN s ON s.source IS NOT DISTINCT FROM ft.source UNION ALL
      SELECT source, pos, v.lv + 1, v.i // 16, sha256(l || h || r), p || l || r
      FROM v JOIN us ON us.lv = v.lv AND us.i = v.i),
vt AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY source, pos ORDER BY lv DESC) = 1),
top AS (SELECT h AS root FROM u WHERE n = 1)
SELECT o.doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, vt.h AS folded_root, vt.h = root AS verified
FROM o JOIN vt ON vt.source IS NOT DISTINCT FROM o.source AND vt.pos = o.pos
JOIN s ON s.source IS NOT DISTINCT FROM o.source CROSS JOIN top"""


def oracle_sql() -> dict[str, str]:
    sql = {"op2_jaccard_join": _links(), "op3_secret_ledger": _secrets(), "op8_warc_derivatives": _warc(), "op9_decontaminate": _benchmark_hits(),
           "op13_merkle_manifest": _merkle(),
           "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: text for name, text in sql.items() if text is not None}
