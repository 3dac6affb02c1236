"""DuckDB SQL forms of the registered queries (the correctness oracle).

Each query is written against the driver's raw views (``documents``,
``labels``, ``embeddings``, ``orders``) with the derived inputs of FIXTURES.md
as CTEs, so the oracle never shares code with the Spark side.  RE2 has no
look-around, so word-edge rules are written with capture groups.
"""

from __future__ import annotations

from storyloom.sources.annotations import ADDED_STOPWORDS, BASE_STOPWORDS, FUNCTION_POS, TRIPLE_KEEP

SPACE = (r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(words) -> str:
    return ", ".join(f"({_q(w)})" for w in sorted(set(words)))


ARTICLES = """
articles AS (
  SELECT doc_id AS seq, 'doc://' || doc_id AS url,
         CASE WHEN doc_id % 101 = 100 THEN NULL
              ELSE make_date(CASE WHEN doc_id % 40 = 39 THEN 2021
                                  WHEN doc_id % 3 = 0 THEN 2019 ELSE 2020 END,
                             CAST(1 + doc_id % 12 AS INTEGER),
                             CAST(1 + doc_id % 28 AS INTEGER)) END AS date,
         split_part(text, chr(10), 1) AS title,
         source AS author, nullif(lang, 'es') AS category, text AS article
  FROM documents)"""


def _grouped(mode: str = "std") -> str:
    thr = ("floor(abs(std_n - mean_n))" if mode == "std" else "floor(mean_n)")
    return ARTICLES + f""",
dated AS (
  SELECT seq, url, title, article, CAST(year(date) AS BIGINT) AS year,
         coalesce(category, 'Misc') AS category
  FROM articles WHERE date IS NOT NULL),
counts AS (SELECT year, category, count(*) AS n_rows FROM dated GROUP BY 1, 2),
stats AS (SELECT avg(n_rows) AS mean_n, stddev_samp(n_rows) AS std_n FROM counts),
kept AS (
  SELECT c.year, c.category, c.n_rows, CAST({thr} AS BIGINT) AS threshold
  FROM counts c, stats
  WHERE {thr} IS NULL OR c.n_rows > {thr}),
grouped AS (
  SELECT d.*, row_number() OVER (PARTITION BY d.year, d.category ORDER BY d.seq) - 1 AS id
  FROM dated d JOIN kept k USING (year, category))"""


def _stopwords_cte() -> str:
    return f"""
stopwords AS (SELECT * FROM (VALUES {_values(BASE_STOPWORDS | ADDED_STOPWORDS)}) t(word))"""


def sql_split_sentences(expr: str) -> str:
    """M1 in DuckDB: mark the split points with chr(1), split, trim, drop blanks."""
    marked = f"regexp_replace({expr}, '([.!?]){SPACE}+', '\\1' || chr(1), 'g')"
    trimmed = f"list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g'))"
    return f"list_filter({trimmed}, lambda s: s <> '')"


def sql_clean(expr: str) -> str:
    """M2 in DuckDB (hyphen rule applied twice for a-b-c; phrase rule twice)."""
    t = f"replace({expr}, '…', '')"
    hy = f"'({WORD})-({WORD})'"
    t = f"regexp_replace(regexp_replace({t}, {hy}, '\\1 \\2', 'g'), {hy}, '\\1 \\2', 'g')"
    t = f"replace({t}, ' --', ' ')"
    t = f"regexp_replace({t}, '[@#^&*)(:|/><}}{{]', ' ', 'g')"
    t = f"regexp_replace({t}, '{SPACE}+', ' ', 'g')"
    ph = f"'(^|{NOT_WORD})(?:Read More|Source)(?:{SPACE}+|$|({NOT_WORD}))'"
    t = f"regexp_replace(regexp_replace({t}, {ph}, '\\1 \\2', 'g'), {ph}, '\\1 \\2', 'g')"
    return t


def _prepared(n: int = 8, mode: str = "std") -> str:
    return _grouped(mode) + f""",
prep0 AS (
  SELECT year, category, id, seq, url, title,
         array_to_string(list_concat([coalesce(title, '') || '.'],
                                     list_slice({sql_split_sentences('article')}, 1, {n})), ' ') AS intro
  FROM grouped),
prep AS (SELECT *, intro AS coref, {sql_clean('intro')} AS clean FROM prep0)"""


def _tags() -> str:
    return f""",
isent AS (
  SELECT year, category, id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sent_id
  FROM (SELECT year, category, id, {sql_split_sentences('clean')} AS ss FROM prep)),
itok AS (
  SELECT year, category, id, sent_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS tok_id
  FROM (SELECT *, regexp_extract_all(sentence, '(\\p{{L}}+)', 1) AS ws FROM isent)),
icap AS (
  SELECT *, (tok_id > 0 AND regexp_matches(word, '^\\p{{Lu}}')) AS cap FROM itok),
inb AS (
  SELECT *, coalesce(lag(cap) OVER w, false) AS prv, coalesce(lead(cap) OVER w, false) AS nxt
  FROM icap WINDOW w AS (PARTITION BY year, category, id, sent_id ORDER BY tok_id)),
tags AS (
  SELECT year, category, id, sent_id, tok_id, word,
         CASE WHEN NOT cap THEN 'O' WHEN NOT prv AND NOT nxt THEN 'U-MISC'
              WHEN NOT prv THEN 'B-MISC' WHEN NOT nxt THEN 'L-MISC' ELSE 'I-MISC' END AS tag
  FROM inb)"""


def _entities() -> str:
    """E1 over a whole intro (tokens ordered by sentence, then token)."""
    return """,
etag AS (
  SELECT year, category, id, sent_id * 1048576 + tok_id AS k, word,
         split_part(tag, '-', 1) AS p
  FROM tags WHERE tag <> 'O'),
espan AS (
  SELECT *, sum(CASE WHEN p = 'B' THEN 1 ELSE 0 END)
              OVER (PARTITION BY year, category, id ORDER BY k) AS span
  FROM etag WHERE p IN ('B', 'I', 'L')),
ewords AS (
  SELECT *, list(word) OVER (PARTITION BY year, category, id, span ORDER BY k
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ws
  FROM espan WHERE span > 0),
ents AS (
  SELECT DISTINCT year, category, id, entity FROM (
    SELECT year, category, id, word AS entity FROM etag WHERE p = 'U'
    UNION ALL
    SELECT year, category, id, array_to_string(ws, ' ') FROM ewords WHERE p = 'L'))"""


def _stripped() -> str:
    """M5: per-row pattern of quoted entities, longest first (applied twice)."""
    return f""",
epat AS (
  SELECT year, category, id,
         '(^|{NOT_WORD})(?:' || string_agg('\\Q' || entity || '\\E', '|' ORDER BY length(entity) DESC, entity)
         || ')(?:{SPACE}+|$|({NOT_WORD}))' AS pat
  FROM ents GROUP BY ALL),
strip AS (
  SELECT p.*, CASE WHEN e.pat IS NULL THEN p.clean
                   ELSE regexp_replace(regexp_replace(p.clean, e.pat, '\\1 \\2', 'g'), e.pat, '\\1 \\2', 'g') END AS text
  FROM prep p LEFT JOIN epat e USING (year, category, id))"""


def _terms(text_table: str = "strip") -> str:
    return "," + _stopwords_cte() + f""",
tsent AS (
  SELECT year, category, id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sent_id
  FROM (SELECT year, category, id, {sql_split_sentences('text')} AS ss FROM {text_table})),
ttok AS (
  SELECT year, category, id, sent_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS tok_id
  FROM (SELECT *, regexp_extract_all(sentence, '(\\p{{L}}+)', 1) AS ws FROM tsent)),
tlex AS (
  SELECT t.*, lower(t.word) AS lw,
         CASE WHEN length(lower(t.word)) > 3 AND suffix(lower(t.word), 's')
              THEN substr(lower(t.word), 1, length(lower(t.word)) - 1) ELSE lower(t.word) END AS lemma,
         CASE WHEN s.word IS NOT NULL THEN 'DET'
              WHEN suffix(lower(t.word), 'ing') OR suffix(lower(t.word), 'ed') THEN 'VERB'
              WHEN suffix(lower(t.word), 'ly') THEN 'ADV' ELSE 'NOUN' END AS pos
  FROM ttok t LEFT JOIN stopwords s ON s.word = lower(t.word)),
terms AS (
  SELECT year, category, id,
         row_number() OVER (PARTITION BY year, category, id ORDER BY sent_id, tok_id) - 1 AS pos,
         lemma AS term
  FROM tlex
  WHERE pos = 'NOUN' AND length(word) > 1 AND NOT regexp_matches(word, '^\\p{{Nd}}+$')
    AND lemma NOT IN (SELECT word FROM stopwords))"""



def _weights() -> str:
    """A3-A5 over the intro terms (group scope)."""
    return """,
tc AS (SELECT year, category, id, term, count(*) AS n FROM terms GROUP BY ALL),
dfs AS (SELECT year, category, term, count(*) AS df FROM tc GROUP BY ALL),
nd AS (SELECT year, category, count(*) AS ndocs FROM grouped GROUP BY ALL),
rawt AS (
  SELECT tc.*, dfs.df, nd.ndocs, tc.n * log2(CAST(nd.ndocs AS DOUBLE) / dfs.df) AS raw
  FROM tc JOIN dfs USING (year, category, term) JOIN nd USING (year, category)),
tfidf AS (
  SELECT * FROM (
    SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY year, category, id)) AS weight
    FROM rawt WHERE raw <> 0)
  WHERE abs(weight) > 1e-12)"""


def _word_vectors() -> str:
    return """,
wv AS (
  SELECT w.word, e.embedding AS vec
  FROM (SELECT DISTINCT term AS word FROM terms) w
  CROSS JOIN (SELECT greatest(1, count(*) * 6 // 5) AS n_ids FROM embeddings) c
  JOIN embeddings e ON e.vec_id = ('0x' || substr(md5(w.word), 1, 7))::BIGINT % c.n_ids)"""


def _vec_summary(hit_sql: str) -> str:
    """Mean of (weighted) vectors per intro → vec_sum and unit_sum."""
    return f""",
hit AS ({hit_sql}),
dims AS (SELECT year, category, id, unnest(vec) AS v, generate_subscripts(vec, 1) AS d FROM hit),
dmean AS (SELECT year, category, id, d, avg(v) AS m FROM dims GROUP BY ALL),
dv AS (SELECT year, category, id, sum(m) AS vs, sqrt(sum(m * m)) AS nrm FROM dmean GROUP BY ALL)
SELECT g.year, g.category, CAST(g.id AS BIGINT) AS id,
       round(coalesce(dv.vs, 0), 6) AS vec_sum,
       round(coalesce(CASE WHEN dv.nrm > 0 THEN dv.vs / dv.nrm ELSE dv.vs END, 0), 6) AS unit_sum
FROM grouped g LEFT JOIN dv USING (year, category, id)"""


def _nchar_kmeans() -> str:
    """C2 in SQL: quantile start, then Lloyd steps of each model until its
    centroids stay (needs WITH RECURSIVE)."""
    parts = [""",
pts AS (SELECT g.year, g.category, g.id, CAST(d.n_chars AS DOUBLE) AS x
        FROM grouped g JOIN documents d ON d.doc_id = g.seq),
psize AS (SELECT year, category, count(*) AS n FROM pts GROUP BY ALL),
grid AS (SELECT year, category, n, unnest(range(2, CAST(floor(n / sqrt(n)) AS BIGINT))) AS k
         FROM psize WHERE floor(n / sqrt(n)) - 1 >= 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY year, category ORDER BY x, id) - 1 AS rk FROM pts),
picks AS (SELECT year, category, n, k, unnest(range(0, k)) AS j FROM grid),
c0 AS (
  SELECT p.year, p.category, p.k, list(r.x ORDER BY p.j) AS cents
  FROM picks p JOIN ranked r ON r.year = p.year AND r.category = p.category
   AND r.rk = CAST(floor((p.j + 0.5) * p.n / p.k) AS BIGINT)
  GROUP BY ALL)"""]
    parts.append("""
, it AS (
  SELECT year, category, k, cents, 0 AS step, true AS moved FROM c0
  UNION ALL
  SELECT year, category, k, fresh, step + 1, fresh <> cents FROM (
    SELECT year, category, k, cents, step,
           list_sort(list_transform(range(0, len(cents)), lambda j: coalesce(mm[j], cents[j + 1]))) AS fresh
    FROM (
      SELECT year, category, k, cents, step, map_from_entries(list(ROW(cluster, mu))) AS mm FROM (
        SELECT year, category, k, cents, step, cluster, avg(x) AS mu FROM (
          SELECT i.year, i.category, i.k, i.cents, i.step, p.x,
                 len(list_filter(list_transform(range(1, len(i.cents)),
                                                lambda t: (i.cents[t] + i.cents[t + 1]) / 2),
                                 lambda m: m < p.x)) AS cluster
          FROM it i JOIN pts p USING (year, category) WHERE i.moved)
        GROUP BY ALL)
      GROUP BY year, category, k, cents, step)))""")
    parts.append("""
, cents AS (SELECT year, category, k, arg_max(cents, step) AS cents FROM it GROUP BY ALL),
lab AS (
  SELECT c.year, c.category, c.k, p.id, p.x,
         len(list_filter(list_transform(range(1, len(c.cents)),
                                        lambda t: (c.cents[t] + c.cents[t + 1]) / 2),
                         lambda m: m < p.x)) AS cluster
  FROM cents c JOIN pts p USING (year, category)),
pairsil AS (
  SELECT a.year, a.category, a.k, a.id, a.cluster,
         avg(abs(a.x - b.x)) FILTER (WHERE a.cluster = b.cluster AND a.id <> b.id) AS ain,
         count(*) FILTER (WHERE a.cluster = b.cluster) AS m
  FROM lab a JOIN lab b USING (year, category, k) GROUP BY ALL),
pairout AS (
  SELECT a.year, a.category, a.k, a.id, b.cluster AS oc, avg(abs(a.x - b.x)) AS dout
  FROM lab a JOIN lab b USING (year, category, k) WHERE a.cluster <> b.cluster GROUP BY ALL),
pb AS (SELECT year, category, k, id, min(dout) AS bout FROM pairout GROUP BY ALL),
ncl AS (SELECT year, category, k, count(DISTINCT cluster) AS nc FROM lab GROUP BY ALL),
sil AS (
  SELECT s.year, s.category, s.k,
         CASE WHEN any_value(n.nc) >= 2 THEN avg(CASE WHEN s.m <= 1 THEN 0.0
              WHEN greatest(s.ain, b.bout) <= 0 THEN 0.0
              ELSE (b.bout - s.ain) / greatest(s.ain, b.bout) END) END AS score
  FROM pairsil s JOIN ncl n USING (year, category, k)
  LEFT JOIN pb b USING (year, category, k, id) GROUP BY s.year, s.category, s.k),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year, category ORDER BY score DESC, k) AS r
                 FROM sil WHERE score IS NOT NULL) WHERE r = 1)""")
    return "".join(parts)


def _word_probabilities(passes: int) -> str:
    return f"""
SELECT year, category, CAST(cluster AS BIGINT) AS cluster, term, CAST(t - 1 AS BIGINT) AS topic, round(ph, 6) AS prob
FROM ph{passes}"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # ---- step 0: groups --------------------------------------------------
    q["groups_kept"] = "WITH" + _grouped("std") + """
SELECT year, category, CAST(n_rows AS BIGINT) AS n_rows, threshold FROM kept"""
    q["groups_kept_mean"] = "WITH" + _grouped("mean") + """
SELECT year, category, CAST(n_rows AS BIGINT) AS n_rows, threshold FROM kept"""
    q["group_stats"] = "WITH" + _grouped("std") + """
SELECT CAST(count(*) AS BIGINT) AS n_groups, round(avg(n_rows), 6) AS mean_n,
       round(stddev_samp(n_rows), 6) AS std_n FROM counts"""
    q["categories_kept_mean"] = "WITH" + ARTICLES + """,
counts AS (SELECT category, count(*) AS n_rows FROM articles
           WHERE category IS NOT NULL GROUP BY 1),
thr AS (SELECT CAST(floor(avg(n_rows)) AS BIGINT) AS threshold FROM counts)
SELECT category, CAST(n_rows AS BIGINT) AS n_rows, threshold
FROM counts, thr WHERE n_rows > threshold"""
    q["orders_groups_kept"] = """
WITH g AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year,
                  coalesce(o_orderpriority, 'Misc') AS category
           FROM orders WHERE o_orderdate IS NOT NULL),
counts AS (SELECT year, category, count(*) AS n_rows FROM g GROUP BY 1, 2),
stats AS (SELECT avg(n_rows) AS mean_n, stddev_samp(n_rows) AS std_n FROM counts)
SELECT year, category, CAST(n_rows AS BIGINT) AS n_rows,
       CAST(floor(abs(std_n - mean_n)) AS BIGINT) AS threshold
FROM counts, stats WHERE n_rows > floor(abs(std_n - mean_n))"""
    q["articles_grouped"] = "WITH" + _grouped("std") + """
SELECT year, category, CAST(id AS BIGINT) AS id, seq, url, title,
       category || '-' || year AS label FROM grouped"""
    # ---- step 1: text preparation ---------------------------------------
    q["sentences"] = f"""
SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS sent_id, unnest(ss) AS sentence
FROM (SELECT doc_id, {sql_split_sentences('text')} AS ss FROM documents)"""
    q["clean_text"] = f"SELECT doc_id, {sql_clean('text')} AS clean FROM documents"
    q["intros"] = "WITH" + _prepared() + """
SELECT year, category, CAST(id AS BIGINT) AS id, intro, clean FROM prep"""
    q["intros_pool_variant"] = "WITH" + _prepared(5, "mean") + """
SELECT year, category, CAST(id AS BIGINT) AS id, intro FROM prep"""
    q["entity_tags"] = "WITH" + _prepared() + _tags() + """
SELECT year, category, CAST(id AS BIGINT) AS id, CAST(sent_id AS BIGINT) AS sent_id,
       CAST(tok_id AS BIGINT) AS tok_id, word, tag FROM tags"""
    q["intro_entities"] = "WITH" + _prepared() + _tags() + _entities() + """
SELECT year, category, CAST(id AS BIGINT) AS id, entity FROM ents"""
    name = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+){0,5}"
    q["mentions_resolved"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '{name}') AS f, regexp_split_to_array(text, '{name}') AS g FROM documents),
m AS (SELECT doc_id, f[i] AS name, g[i] AS gap, i FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM d)),
l AS (
  SELECT x.doc_id, x.i, arg_max(y.name, len(string_split(y.name, ' ')) * 1000000 + y.i) AS longer
  FROM m x JOIN (SELECT * FROM m WHERE contains(name, ' ')) y
    ON y.doc_id = x.doc_id AND y.i < x.i AND suffix(y.name, ' ' || x.name) GROUP BY ALL),
r AS (
  SELECT doc_id, string_agg(gap || coalesce(longer, name), '' ORDER BY i) AS head, count(longer) AS n
  FROM m LEFT JOIN l USING (doc_id, i) GROUP BY ALL)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, md5(coalesce(head, '') || g[len(g)]) AS text_md5
FROM d LEFT JOIN r USING (doc_id)"""
    q["strip_entities"] = "WITH" + _prepared() + _tags() + _entities() + _stripped() + """
SELECT year, category, CAST(id AS BIGINT) AS id, text FROM strip"""
    triple_words = (BASE_STOPWORDS | ADDED_STOPWORDS) - TRIPLE_KEEP
    q["stopword_sets"] = "WITH" + _stopwords_cte() + f""",
triple AS (SELECT * FROM (VALUES {_values(triple_words)}) t(word)),
lists AS (SELECT 'pipeline' AS list, word FROM stopwords
          UNION ALL SELECT 'triples', word FROM triple),
words AS (SELECT w AS word, count(*) AS n_occ
          FROM (SELECT unnest(regexp_extract_all(lower(text), '(\\p{{L}}+)', 1)) AS w FROM documents)
          GROUP BY 1)
SELECT l.list, l.word, CAST(coalesce(w.n_occ, 0) AS BIGINT) AS n_occ
FROM lists l LEFT JOIN words w USING (word)"""
    # word runs and non-word runs; a stop word run becomes a space, then the
    # whitespace collapse gives the same text as the whole-word regex
    stoplist = "[" + ", ".join(_q(w) for w in sorted(triple_words)) + "]"
    rm = (f"array_to_string(list_transform(regexp_extract_all(clean, '{WORD}+|{NOT_WORD}+'), "
          f"lambda t: CASE WHEN list_contains({stoplist}, t) THEN ' ' ELSE t END), '')")
    q["remove_stopwords"] = "WITH" + _prepared() + f"""
SELECT year, category, CAST(id AS BIGINT) AS id,
       regexp_replace({rm}, '{SPACE}+', ' ', 'g') AS text FROM prep"""
    q["doc_terms"] = "WITH" + _prepared() + _tags() + _entities() + _stripped() + _terms() + """
SELECT year, category, CAST(id AS BIGINT) AS id, CAST(pos AS BIGINT) AS pos, term FROM terms"""
    # ---- step 2: vectors -------------------------------------------------
    base = "WITH RECURSIVE" + _prepared() + _tags() + _entities() + _stripped() + _terms()
    q["term_counts"] = base + _weights() + """
SELECT year, category, CAST(id AS BIGINT) AS id, term, CAST(n AS BIGINT) AS n FROM tc"""
    q["doc_freq"] = base + _weights() + """
SELECT year, category, term, CAST(df AS BIGINT) AS df FROM dfs"""
    q["tfidf"] = base + _weights() + """
SELECT year, category, CAST(id AS BIGINT) AS id, term, round(weight, 6) AS weight FROM tfidf"""
    q["embed_lookup"] = base + _word_vectors() + """
SELECT t.year, t.category, CAST(t.id AS BIGINT) AS id, CAST(t.pos AS BIGINT) AS pos, t.term,
       round(sqrt(list_sum(list_transform(w.vec, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS vec_norm
FROM terms t JOIN wv w ON w.word = t.term"""
    q["doc_vectors_tfidf"] = base + _weights() + _word_vectors() + _vec_summary(
        "SELECT t.year, t.category, t.id, list_transform(w.vec, lambda x: CAST(x AS DOUBLE) * t.weight) AS vec "
        "FROM tfidf t JOIN wv w ON w.word = t.term")
    q["doc_vectors_mean"] = base + _word_vectors() + _vec_summary(
        "SELECT t.year, t.category, t.id, list_transform(w.vec, lambda x: CAST(x AS DOUBLE)) AS vec "
        "FROM (SELECT DISTINCT year, category, id, term FROM terms) t JOIN wv w ON w.word = t.term")
    q["doc_vectors_top10"] = base + _weights() + _word_vectors() + _vec_summary(
        "SELECT t.year, t.category, t.id, list_transform(w.vec, lambda x: CAST(x AS DOUBLE) * t.weight) AS vec "
        "FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year, category, id "
        "ORDER BY weight DESC, term) AS r FROM tfidf) WHERE r <= 10) t JOIN wv w ON w.word = t.term")

    # ---- step 3: clusters (1-D points = article length) --------------------
    km = "WITH RECURSIVE" + _grouped("std") + _nchar_kmeans()
    q["kmeans_centroids"] = km + """
SELECT year, category, CAST(k AS BIGINT) AS k, CAST(generate_subscripts(cents, 1) - 1 AS BIGINT) AS cluster,
       round(unnest(cents), 6) AS mu FROM cents"""
    q["silhouette"] = km + """
SELECT year, category, CAST(k AS BIGINT) AS k, round(score, 6) AS score FROM sil"""
    q["best_k"] = km + """
SELECT year, category, CAST(k AS BIGINT) AS k, round(score, 6) AS score FROM best"""
    q["representatives"] = km + """,
blab AS (SELECT l.* FROM lab l JOIN best b USING (year, category, k)),
bcent AS (SELECT c.year, c.category, unnest(c.cents) AS mu, generate_subscripts(c.cents, 1) - 1 AS cluster
          FROM cents c JOIN best b USING (year, category, k)),
sizes AS (SELECT year, category, cluster, count(*) AS size FROM blab GROUP BY ALL),
bounds AS (SELECT year, category, CAST(floor(avg(size) - coalesce(stddev_samp(size), 0)) AS BIGINT) AS n_min,
                  CAST(ceil(avg(size) + coalesce(stddev_samp(size), 0)) AS BIGINT) AS n_max
           FROM sizes GROUP BY ALL),
okc AS (SELECT s.*, b.n_max FROM sizes s JOIN bounds b USING (year, category)
        WHERE s.size >= greatest(3, b.n_min)),
ranked_r AS (
  SELECT l.year, l.category, l.cluster, l.id, o.n_max,
         row_number() OVER (PARTITION BY l.year, l.category, l.cluster ORDER BY abs(l.x - c.mu), l.id) - 1 AS rank
  FROM blab l JOIN okc o USING (year, category, cluster) JOIN bcent c USING (year, category, cluster))
SELECT year, category, CAST(cluster AS BIGINT) AS cluster, CAST(rank AS BIGINT) AS rank, CAST(id AS BIGINT) AS id
FROM ranked_r WHERE rank < n_max"""
    # ---- step 4: topics (cluster = best n_chars k-means cluster) -----------
    ncm = """,
ncm AS (SELECT l.year, l.category, l.id, l.cluster FROM lab l JOIN best b USING (year, category, k))"""
    bg = base + _nchar_kmeans() + ncm + """,
ct AS (SELECT t.*, n.cluster FROM terms t JOIN ncm n USING (year, category, id)),
nx AS (SELECT *, lead(term) OVER (PARTITION BY year, category, cluster, id ORDER BY pos) AS b FROM ct),
pairs AS (SELECT year, category, cluster, term AS a, b, count(*) AS n_ab FROM nx WHERE b IS NOT NULL GROUP BY ALL),
uni AS (SELECT year, category, cluster, term, count(*) AS n_a FROM ct GROUP BY ALL),
voc AS (
  SELECT u.year, u.category, u.cluster, u.nu + coalesce(p.np, 0) AS n_vocab
  FROM (SELECT year, category, cluster, count(*) AS nu FROM uni GROUP BY ALL) u
  LEFT JOIN (SELECT year, category, cluster, count(*) AS np FROM pairs GROUP BY ALL) p
  USING (year, category, cluster))"""
    q["bigram_counts"] = bg + """
SELECT p.year, p.category, CAST(p.cluster AS BIGINT) AS cluster, p.a, p.b,
       CAST(p.n_ab AS BIGINT) AS n_ab, CAST(v.n_vocab AS BIGINT) AS n_vocab
FROM pairs p JOIN voc v USING (year, category, cluster)"""
    q["bigram_phrases"] = bg + """,
sc AS (
  SELECT p.year, p.category, p.cluster, p.a, p.b,
         (p.n_ab - 3.0) / ua.n_a / ub.n_a * v.n_vocab AS score
  FROM pairs p
  JOIN uni ua ON ua.year = p.year AND ua.category = p.category AND ua.cluster = p.cluster AND ua.term = p.a
  JOIN uni ub ON ub.year = p.year AND ub.category = p.category AND ub.cluster = p.cluster AND ub.term = p.b
  JOIN voc v ON v.year = p.year AND v.category = p.category AND v.cluster = p.cluster),
acc AS (SELECT year, category, cluster, a, b FROM sc WHERE score > 4),
fl AS (
  SELECT n.*, (x.a IS NOT NULL) AS acc FROM nx n LEFT JOIN acc x
    ON x.year = n.year AND x.category = n.category AND x.cluster = n.cluster
   AND x.a = n.term AND x.b = n.b),
st AS (SELECT *, acc AND NOT coalesce(lag(acc) OVER (PARTITION BY year, category, cluster, id ORDER BY pos), false) AS st FROM fl),
r0 AS (SELECT *, max(CASE WHEN st THEN pos END) OVER (PARTITION BY year, category, cluster, id ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run0 FROM st),
tk AS (SELECT *, acc AND (pos - run0) % 2 = 0 AS take FROM r0),
ea AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY year, category, cluster, id ORDER BY pos), false) AS eaten FROM tk)
SELECT year, category, CAST(id AS BIGINT) AS id,
       CAST(row_number() OVER (PARTITION BY year, category, cluster, id ORDER BY pos) - 1 AS BIGINT) AS pos,
       CASE WHEN take THEN term || '_' || b ELSE term END AS term
FROM ea WHERE NOT eaten"""
    cl = "year, category, cluster"
    for name, per_topic in (("coherence", 5), ("coherence_top20", 20)):
        q[name] = bg + f""",
tw AS (
  SELECT {cl}, (r - 1) // {per_topic} AS topic, term FROM (
    SELECT *, row_number() OVER (PARTITION BY {cl} ORDER BY n_a DESC, term) AS r FROM uni) WHERE r <= {2 * per_topic}),
lens AS (SELECT {cl}, id, count(*) AS l FROM ct GROUP BY ALL),
hits AS (
  SELECT {cl}, id, pos, term, greatest(1, l - 109) AS nw FROM ct JOIN lens USING ({cl}, id)
  SEMI JOIN tw USING ({cl}, term)),
occ AS (SELECT DISTINCT {cl}, id, term, unnest(range(greatest(0, pos - 109), least(pos, nw - 1) + 1)) AS s FROM hits),
nwin AS (SELECT {cl}, sum(nw) AS n FROM (SELECT DISTINCT {cl}, id, nw FROM hits) GROUP BY ALL),
c1 AS (SELECT {cl}, term, count(*) AS c FROM occ GROUP BY ALL),
o AS (SELECT {cl}, topic, id, s, term FROM occ JOIN tw USING ({cl}, term)),
co AS (
  SELECT {cl}, topic, a.term AS w1, b.term AS w2, count(*) AS c12
  FROM o a JOIN o b USING ({cl}, topic, id, s) GROUP BY ALL),
pp AS (SELECT {cl}, topic, a.term AS w1, b.term AS w2 FROM tw a JOIN tw b USING ({cl}, topic)),
pv AS (
  SELECT {cl}, topic, w1, w2, coalesce(c12, 0) / n AS p12, x.c / n AS p1, y.c / n AS p2
  FROM pp LEFT JOIN co USING ({cl}, topic, w1, w2) JOIN nwin USING ({cl})
  JOIN (SELECT {cl}, term AS w1, c FROM c1) x USING ({cl}, w1)
  JOIN (SELECT {cl}, term AS w2, c FROM c1) y USING ({cl}, w2)),
nv AS (SELECT *, ln((p12 + 1e-12) / (p1 * p2)) / -ln(p12 + 1e-12) AS v FROM pv),
tot AS (SELECT {cl}, topic, w2, sum(v) AS t FROM nv GROUP BY ALL),
cs AS (
  SELECT {cl}, topic, w1, sum(v * t) / (sqrt(sum(v * v)) * sqrt(sum(t * t))) AS c
  FROM nv JOIN tot USING ({cl}, topic, w2) GROUP BY ALL),
tc AS (SELECT {cl}, topic, avg(c) AS c FROM cs GROUP BY ALL)
SELECT year, category, CAST(cluster AS BIGINT) AS cluster, round(avg(c), 6) AS coherence FROM tc GROUP BY ALL"""
    em = bg + f""",
wt AS (SELECT {cl}, id, term, CAST(count(*) AS DOUBLE) AS c FROM ct GROUP BY ALL),
ts AS (SELECT unnest(range(1, 4)) AS t),
al AS (SELECT t, (1 / (t - 1 + sqrt(3))) / sum(1 / (t - 1 + sqrt(3))) OVER () AS alpha FROM ts),
u0 AS (
  SELECT {cl}, term, t, ((a * t + (a % 997) * t * t + 7919 * 3 + 100) % 1000003) / 1000003 + 0.5 AS u FROM (
    SELECT {cl}, term, ('0x' || substr(md5(term), 1, 7))::BIGINT % 1000003 AS a FROM uni) CROSS JOIN ts),
ph0 AS (SELECT {cl}, term, t, u / sum(u) OVER (PARTITION BY {cl}, t) AS ph FROM u0),
th0 AS (SELECT DISTINCT {cl}, id, t, 1 / 3 AS th FROM wt CROSS JOIN ts)"""
    for i in range(20):
        if i == 2:
            q["lda_fixed_steps"] = em + _word_probabilities(2)
        em += f""",
r{i} AS (
  SELECT {cl}, id, term, t, c * th * ph / sum(th * ph) OVER (PARTITION BY {cl}, id, term) AS r
  FROM wt JOIN th{i} USING ({cl}, id) JOIN ph{i} USING ({cl}, term, t)),
nd{i} AS (SELECT {cl}, id, t, sum(r) + any_value(alpha) AS q FROM r{i} JOIN al USING (t) GROUP BY ALL),
th{i + 1} AS (SELECT {cl}, id, t, q / sum(q) OVER (PARTITION BY {cl}, id) AS th FROM nd{i}),
nw{i} AS (SELECT {cl}, term, t, sum(r) + 1 / 3 AS q FROM r{i} GROUP BY ALL),
ph{i + 1} AS (SELECT {cl}, term, t, q / sum(q) OVER (PARTITION BY {cl}, t) AS ph FROM nw{i})"""
    q["lda_passes"] = em + _word_probabilities(20)
    q["keyword_valid"] = base + _word_vectors() + """,
kf AS (SELECT word, lower(regexp_extract(word, '(\\p{L}+)', 1)) AS lw FROM (SELECT DISTINCT term AS word FROM terms)),
kl AS (
  SELECT k.word, k.lw,
         CASE WHEN length(k.lw) > 3 AND suffix(k.lw, 's') THEN substr(k.lw, 1, length(k.lw) - 1) ELSE k.lw END AS lemma,
         CASE WHEN s.word IS NOT NULL THEN 'DET' WHEN suffix(k.lw, 'ing') OR suffix(k.lw, 'ed') THEN 'VERB'
              WHEN suffix(k.lw, 'ly') THEN 'ADV' ELSE 'NOUN' END AS pos
  FROM kf k LEFT JOIN stopwords s ON s.word = k.lw)
SELECT word FROM kl
WHERE lw <> '' AND pos = 'NOUN' AND lemma NOT IN (SELECT word FROM stopwords)
  AND lemma IN (SELECT word FROM wv)"""
    q["cosmul_neighbours"] = base + _word_vectors() + """,
freq AS (SELECT t.year, t.category, t.term, count(*) AS n FROM terms t JOIN wv ON wv.word = t.term GROUP BY ALL),
qs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year, category ORDER BY n DESC, term) AS r FROM freq) WHERE r <= 3),
qv AS (SELECT q.year, q.category, q.term AS qw, CAST(w.vec AS DOUBLE[]) AS vec FROM qs q JOIN wv w ON w.word = q.term),
vw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) AS word FROM documents),
vv AS (
  SELECT v.word, CAST(e.embedding AS DOUBLE[]) AS vec FROM vw v
  CROSS JOIN (SELECT greatest(1, count(*) * 6 // 5) AS n_ids FROM embeddings) c
  JOIN embeddings e ON e.vec_id = ('0x' || substr(md5(v.word), 1, 7))::BIGINT % c.n_ids),
sc AS (
  SELECT q.year, q.category, v.word,
         product((1 + list_cosine_similarity(v.vec, q.vec)) / 2) / (1 + 1e-6) AS score
  FROM vv v JOIN qv q ON true
  WHERE NOT EXISTS (SELECT 1 FROM qv x WHERE x.year = q.year AND x.category = q.category AND x.qw = v.word)
  GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY year, category ORDER BY score DESC, word) - 1 AS rank FROM sc)
SELECT year, category, CAST(rank AS BIGINT) AS rank, word, round(score, 6) AS score FROM rk WHERE rank < 5"""
    q["topic_sentiment"] = "WITH RECURSIVE" + _grouped("std") + _nchar_kmeans() + ncm + """,
j AS (
  SELECT n.year, n.category, n.cluster, lb.quality AS label
  FROM ncm n JOIN grouped g USING (year, category, id) JOIN labels lb ON lb.doc_id = g.seq)
SELECT year, category, CAST(cluster AS BIGINT) AS cluster, round(avg(label), 6) AS mean_label,
       CASE WHEN avg(label) >= 0.4 AND avg(label) <= 0.6 THEN 'Neutral'
            WHEN avg(label) > 0.6 THEN 'Positive' ELSE 'Negative' END AS sentiment
FROM j GROUP BY ALL"""
    # ---- step 5: triple texts and their annotations ------------------------
    function_pos = " ".join(f"WHEN lower(t.word) IN ({', '.join(map(_q, words))}) THEN '{pos}'"
                            for pos, words in FUNCTION_POS.items())
    triple_list = "[" + ", ".join(_q(w) for w in sorted(triple_words)) + "]"
    base_stop = f"""
bstop AS (SELECT * FROM (VALUES {_values(BASE_STOPWORDS)}) t(word))"""
    tri = "WITH RECURSIVE" + _grouped("std") + _nchar_kmeans() + ncm + "," + base_stop + """,
prep0 AS (
  SELECT year, category, id, seq, url, title,
         array_to_string(list_concat([coalesce(title, '') || '.'],
                                     list_slice(""" + sql_split_sentences('article') + """, 1, 8)), ' ') AS intro
  FROM grouped),
prep AS (SELECT *, """ + sql_clean('intro') + """ AS clean FROM prep0),
ttx AS (
  SELECT p.year, p.category, p.id, n.cluster,
         regexp_replace(array_to_string(list_transform(
             regexp_extract_all(p.clean, '""" + WORD + "+|" + NOT_WORD + """+'),
             lambda t: CASE WHEN list_contains(""" + triple_list + """, t) THEN ' ' ELSE t END), ''),
           '""" + SPACE + """+', ' ', 'g') AS text
  FROM prep p JOIN ncm n USING (year, category, id)),
xs AS (
  SELECT year, category, id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sent_id
  FROM (SELECT year, category, id, """ + sql_split_sentences('text') + """ AS ss FROM ttx)),
xt AS (
  SELECT year, category, id, sent_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS tok_id
  FROM (SELECT *, regexp_extract_all(sentence, '(\\p{L}+)', 1) AS ws FROM xs)),
xl AS (
  SELECT t.*, CASE """ + function_pos + """ WHEN s.word IS NOT NULL THEN 'DET'
                   WHEN suffix(lower(t.word), 'ing') OR suffix(lower(t.word), 'ed') THEN 'VERB'
                   WHEN suffix(lower(t.word), 'ly') THEN 'ADV' ELSE 'NOUN' END AS pos
  FROM xt t LEFT JOIN bstop s ON s.word = lower(t.word))"""
    vp_ctes = """,
sa AS (
  SELECT year, category, id, sent_id,
         list(word ORDER BY tok_id) AS words, list(pos ORDER BY tok_id) AS poss,
         string_agg(CASE pos WHEN 'AUX' THEN 'A' WHEN 'PART' THEN 'P' WHEN 'VERB' THEN 'V'
                             WHEN 'ADP' THEN 'D' WHEN 'ADV' THEN 'R' ELSE 'x' END, '' ORDER BY tok_id) AS tags,
         min(CASE WHEN pos = 'VERB' THEN tok_id END) AS root
  FROM xl GROUP BY ALL),
sb AS (
  SELECT *, root - length(regexp_extract(substr(tags, 1, root), '[APVDR]*$')) AS lo,
            root + length(regexp_extract(substr(tags, root + 1), '^[APVDR]*')) AS hi
  FROM sa WHERE root IS NOT NULL),
ci AS (SELECT *, unnest(range(lo, root + 1)) AS i FROM sb),
cj AS (SELECT *, unnest(range(greatest(i + 1, root), hi + 1)) AS j FROM ci),
vp AS (
  SELECT *, row_number() OVER (PARTITION BY year, category, id, sent_id ORDER BY j - i DESC, i, j) AS r
  FROM cj WHERE j > i AND regexp_full_match(substr(tags, i + 1, j - i), '(A?P?V+D+|V?R*V+)'))"""
    q["verb_phrases"] = tri + vp_ctes + """
SELECT year, category, CAST(id AS BIGINT) AS id, CAST(sent_id AS BIGINT) AS sent_id,
       CAST(i AS BIGINT) AS start, CAST(j AS BIGINT) AS "end",
       array_to_string(list_slice(words, i + 1, j), ' ') AS text
FROM vp WHERE r = 1"""
    ch_ctes = """,
n1 AS (
  SELECT *, (pos = 'NOUN' OR (pos = 'DET' AND lead(pos) OVER w = 'NOUN')) AS inc
  FROM xl WINDOW w AS (PARTITION BY year, category, id, sent_id ORDER BY tok_id)),
n2 AS (
  SELECT *, inc AND (pos = 'DET' OR NOT coalesce(lag(inc) OVER w, false)) AS st
  FROM n1 WINDOW w AS (PARTITION BY year, category, id, sent_id ORDER BY tok_id)),
n3 AS (
  SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY year, category, id, sent_id ORDER BY tok_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM n2)"""
    q["noun_chunks"] = tri + ch_ctes + """
SELECT year, category, CAST(id AS BIGINT) AS id, CAST(sent_id AS BIGINT) AS sent_id,
       CAST(min(tok_id) AS BIGINT) AS start, CAST(max(tok_id) + 1 AS BIGINT) AS "end",
       string_agg(word, ' ' ORDER BY tok_id) AS text
FROM n3 WHERE inc GROUP BY year, category, id, sent_id, run"""
    trim_sp = lambda e: f"regexp_replace({e}, '^{SPACE}+|{SPACE}+$', '', 'g')"
    q["triples_raw"] = tri + vp_ctes + ch_ctes + """,
ch AS (
  SELECT year, category, id, sent_id, min(tok_id) AS cs, max(tok_id) + 1 AS ce,
         string_agg(word, ' ' ORDER BY tok_id) AS text
  FROM n3 WHERE inc GROUP BY year, category, id, sent_id, run),
e0 AS (SELECT *, (tok_id > 0 AND regexp_matches(word, '^\\p{Lu}')) AS cap FROM xl),
e1 AS (
  SELECT *, coalesce(lag(cap) OVER w, false) AS prv, coalesce(lead(cap) OVER w, false) AS nxt
  FROM e0 WINDOW w AS (PARTITION BY year, category, id, sent_id ORDER BY tok_id)),
e2 AS (
  SELECT *, CASE WHEN NOT cap THEN 'O' WHEN NOT prv AND NOT nxt THEN 'U' WHEN NOT prv THEN 'B'
                 WHEN NOT nxt THEN 'L' ELSE 'I' END AS p FROM e1),
e3 AS (
  SELECT *, sum(CASE WHEN p = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY year, category, id, sent_id ORDER BY tok_id) AS span
  FROM e2 WHERE p IN ('B', 'I', 'L')),
e4 AS (
  SELECT *, list(word) OVER (PARTITION BY year, category, id, sent_id, span ORDER BY tok_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ws
  FROM e3 WHERE span > 0),
sents AS (
  SELECT DISTINCT year, category, id, sent_id, entity FROM (
    SELECT year, category, id, sent_id, word AS entity FROM e2 WHERE p = 'U'
    UNION ALL
    SELECT year, category, id, sent_id, array_to_string(ws, ' ') FROM e4 WHERE p = 'L')),
vb AS (
  SELECT year, category, id, sent_id, i AS vs, array_to_string(list_slice(words, i + 1, j), ' ') AS vt
  FROM vp v WHERE r = 1
    AND EXISTS (SELECT 1 FROM sents e WHERE e.year = v.year AND e.category = v.category AND e.id = v.id AND e.sent_id = v.sent_id)
    AND EXISTS (SELECT 1 FROM ch c WHERE c.year = v.year AND c.category = v.category AND c.id = v.id AND c.sent_id = v.sent_id)),
sc AS (
  SELECT c.*, v.vt, e.entity, instr(c.text, e.entity) AS eat
  FROM ch c JOIN vb v USING (year, category, id, sent_id) JOIN sents e USING (year, category, id, sent_id)
  WHERE c.cs < v.vs AND instr(c.text, e.entity) > 0),
sf AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year, category, id, sent_id
                                               ORDER BY cs, ce, eat, length(entity) DESC, entity) AS rr FROM sc)
  WHERE rr = 1),
ob AS (
  SELECT * FROM (
    SELECT c.*, row_number() OVER (PARTITION BY c.year, c.category, c.id, c.sent_id ORDER BY c.cs, c.ce) AS rr
    FROM ch c JOIN vb v USING (year, category, id, sent_id) WHERE c.cs > v.vs)
  WHERE rr = 1)
SELECT v.year, v.category, CAST(v.id AS BIGINT) AS id, CAST(v.sent_id AS BIGINT) AS sent_id,
       f.entity AS subject,
       """ + trim_sp("substr(f.text, f.eat + length(f.entity))") + """ || ' ' || f.vt AS relation,
       """ + trim_sp("o.text") + """ AS object
FROM vb v
LEFT JOIN sf f ON f.year = v.year AND f.category = v.category AND f.id = v.id AND f.sent_id = v.sent_id
LEFT JOIN ob o ON o.year = v.year AND o.category = v.category AND o.id = v.id AND o.sent_id = v.sent_id"""

    raw_sql = q["triples_raw"]
    q["entity_triples"] = raw_sql.split(",\nvb AS (")[0] + """,
ep AS (
  SELECT e.year, e.category, e.id, e.sent_id, e.entity, min(x.tok_id) AS at_tok
  FROM sents e LEFT JOIN xl x ON x.year = e.year AND x.category = e.category AND x.id = e.id
   AND x.sent_id = e.sent_id AND x.word = split_part(e.entity, ' ', 1) GROUP BY ALL),
e2p AS (
  SELECT year, category, id, sent_id, list(entity ORDER BY at_tok, entity) AS es FROM ep GROUP BY ALL HAVING count(*) = 2)
SELECT year, category, CAST(id AS BIGINT) AS id, CAST(sent_id AS BIGINT) AS sent_id, es[1] AS source,
       words[root + 1] || CASE WHEN poss[root + 2] = 'ADP' THEN ' ' || words[root + 2] ELSE '' END AS relation,
       es[2] AS target
FROM e2p JOIN sb USING (year, category, id, sent_id)
WHERE len(words) >= 3
  AND words[root + 1] || CASE WHEN poss[root + 2] = 'ADP' THEN ' ' || words[root + 2] ELSE '' END
      NOT IN ('told', 'said', 'saying', 'tell', 'say')"""
    unwanted = " OR ".join(f"instr(rs, '{w}') > 0" for w in ("told", "said", "saying", "tell", "says", "say"))
    q["triples_filtered"] = raw_sql.replace("\nSELECT v.year, v.category, CAST(v.id AS BIGINT) AS id", ",\nraw AS (\nSELECT v.year, v.category, CAST(v.id AS BIGINT) AS id", 1) + """),
tf0 AS (
  SELECT *, """ + trim_sp("relation") + """ AS rs, row_number() OVER () AS tid FROM raw
  WHERE subject IS NOT NULL AND relation IS NOT NULL AND object IS NOT NULL
    AND subject <> '' AND relation <> '' AND object <> '' AND subject <> object),
tf1 AS (SELECT * FROM tf0 WHERE NOT (""" + unwanted + """)),
lw AS (
  SELECT tid, 'r' AS which, string_split(relation, ' ') AS a, string_split(object, ' ') AS b FROM tf1
  UNION ALL
  SELECT tid, 's', string_split(subject, ' '), string_split(object, ' ') FROM tf1),
li AS (SELECT *, unnest(range(0, len(a))) AS i FROM lw),
ln AS (SELECT *, unnest(range(1, len(a) - i + 1)) AS n FROM li),
lc AS (SELECT *, list_slice(a, i + 1, i + n) AS cand FROM ln),
lm AS (
  SELECT * FROM lc
  WHERE len(b) >= n
    AND len(list_filter(range(0, len(b) - n + 1), lambda k: list_slice(b, k + 1, k + n) = cand)) > 0),
lb AS (
  SELECT tid, which, array_to_string(cand, ' ') AS lcs FROM (
    SELECT *, row_number() OVER (PARTITION BY tid, which ORDER BY n DESC, i) AS r FROM lm) WHERE r = 1),
tf2 AS (
  SELECT t.*, coalesce(l1.lcs, '') AS l1, coalesce(l2.lcs, '') AS l2
  FROM tf1 t
  LEFT JOIN lb l1 ON l1.tid = t.tid AND l1.which = 'r'
  LEFT JOIN lb l2 ON l2.tid = t.tid AND l2.which = 's'),
tf3 AS (
  SELECT *, """ + trim_sp("CASE WHEN l1 = '' THEN object ELSE replace(object, l1, '') END") + """ AS o1 FROM tf2),
tf4 AS (
  SELECT *, """ + trim_sp("CASE WHEN l2 = '' THEN o1 ELSE replace(o1, l2, '') END") + """ AS o2 FROM tf3)
SELECT year, category, id, sent_id, subject, rs AS relation, o2 AS object FROM tf4 WHERE o2 <> ''"""
    return q
