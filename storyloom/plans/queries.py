"""Registered queries: one per operator of SURVEY §2 that has a query form.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names equal those of the matching SQL in ``storyloom.plans.oracle``.  Every
query reads the driver's tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.text import clean_text, remove_words, split_sentences
from storyloom.operators import groups as grp
from storyloom.plans import pipelines as pl
from storyloom.sources import annotations as ann
from storyloom.sources.articles import load_articles, load_table, orders_as_groups

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _r(c, places: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, places)


# ---- step 0: groups --------------------------------------------------------

def _dated(spark, sf_dir):
    return grp.group_key(grp.fill_category(load_articles(spark, sf_dir)))


@register("groups_kept")
def q_groups_kept(spark, sf_dir):
    """Kept (year, category) groups with size and threshold."""
    k = grp.kept_groups(_dated(spark, sf_dir), grp.GROUP, "std")
    return k.select(F.col("year").cast("bigint").alias("year"), "category",
                    F.col("n_rows").cast("bigint").alias("n_rows"), "threshold")


@register("groups_kept_mean")
def q_groups_kept_mean(spark, sf_dir):
    """same with threshold floor(mean)."""
    k = grp.kept_groups(_dated(spark, sf_dir), grp.GROUP, "mean")
    return k.select(F.col("year").cast("bigint").alias("year"), "category",
                    F.col("n_rows").cast("bigint").alias("n_rows"), "threshold")


@register("group_stats")
def q_group_stats(spark, sf_dir):
    """A1, A2: number of groups, mean and sample std of group sizes."""
    counts = grp.group_counts(_dated(spark, sf_dir))
    st = grp.count_stats(counts).crossJoin(
        counts.agg(F.count(F.lit(1)).alias("n_groups")))
    return st.select(F.col("n_groups").cast("bigint").alias("n_groups"),
                     _r("mean_n").alias("mean_n"), _r("std_n").alias("std_n"))


@register("categories_kept_mean")
def q_categories_kept_mean(spark, sf_dir):
    """categories over all years with more rows than floor(mean)."""
    a = load_articles(spark, sf_dir).where(F.col("category").isNotNull())
    k = grp.kept_groups(a, ["category"], "mean")
    return k.select("category", F.col("n_rows").cast("bigint").alias("n_rows"), "threshold")


@register("orders_groups_kept")
def q_orders_groups_kept(spark, sf_dir):
    """F3 on a second table: orders keyed by (order year, priority)."""
    o = grp.group_key(grp.fill_category(orders_as_groups(load_table(spark, sf_dir, "orders"))))
    k = grp.kept_groups(o, grp.GROUP, "std")
    return k.select(F.col("year").cast("bigint").alias("year"), "category",
                    F.col("n_rows").cast("bigint").alias("n_rows"), "threshold")


@register("articles_grouped")
def q_articles_grouped(spark, sf_dir):
    """F1-F3 + in-group position id (distributed rank) + F2 label."""
    g = pl.grouped(load_articles(spark, sf_dir))
    return g.select(F.col("year").cast("bigint").alias("year"), "category", "id", "seq",
                    "url", "title", grp.group_label().alias("label"))


# ---- step 1: text preparation -----------------------------------------------

@register("sentences")
def q_sentences(spark, sf_dir):
    """M1 over every document's whole text."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(split_sentences("text")).alias("sent_id", "sentence")) \
        .select("doc_id", F.col("sent_id").cast("bigint").alias("sent_id"), "sentence")


@register("clean_text")
def q_clean_text(spark, sf_dir):
    """M2 over every document's whole text."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", clean_text("text").alias("clean"))


def _doc_cols(df):
    return [F.col("year").cast("bigint").alias("year"), "category", "id"]


@register("intros")
def q_intros(spark, sf_dir):
    """W1 (n = 8) → M2 on the kept articles."""
    p = pl.load_prepared(spark, sf_dir)
    return p.select(*_doc_cols(p), "intro", "clean")


@register("intros_pool_variant")
def q_intros_pool(spark, sf_dir):
    """W1 with n = 5 on groups kept by F4 (the pool driver's settings)."""
    p = pl.load_prepared(spark, sf_dir, pl.PipelineConfig(n_sentences=5, group_filter="mean"))
    return p.select(*_doc_cols(p), "intro")


@register("entity_tags")
def q_entity_tags(spark, sf_dir):
    """Default BILOU tagger over the cleaned intros."""
    t = pl.intro_tags(pl.load_prepared(spark, sf_dir))
    return t.select(*_doc_cols(t), F.col("sent_id").cast("bigint").alias("sent_id"),
                    F.col("tok_id").cast("bigint").alias("tok_id"), "word", "tag")


@register("intro_entities")
def q_intro_entities(spark, sf_dir):
    """Distinct entities of each intro."""
    e = pl.intro_entities(pl.intro_tags(pl.load_prepared(spark, sf_dir)))
    return e.select(*_doc_cols(e), "entity")


@register("mentions_resolved")
def q_mentions_resolved(spark, sf_dir):
    """Whole documents with shorter names replaced by the longer ones they
    stand for."""
    from storyloom.operators.entities import link_mentions, resolve_mentions
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    links = link_mentions(docs, ["doc_id"], "text")
    n = links.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_links"))
    out = resolve_mentions(docs, links, ["doc_id"], "text", "resolved").join(n, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.md5(F.col("resolved").cast("binary")).alias("text_md5"))


@register("strip_entities")
def q_strip_entities(spark, sf_dir):
    """M5: cleaned intros without their entities."""
    s = pl.stripped(pl.load_prepared(spark, sf_dir))
    return s.select(*_doc_cols(s), "text")


@register("stopword_sets")
def q_stopword_sets(spark, sf_dir):
    """The pipeline stop list and the triple stop list.

    Each word is counted over the whole document corpus so the result grows
    with the input: how often each stop word occurs as a lower-case word.
    """
    stop = pl.stop_list(spark)
    triple = ann.triple_stopword_set(stop)
    words = (load_table(spark, sf_dir, "documents")
             .select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
                     .alias("word"))
             .join(stop, "word", "left_semi")
             .groupBy("word").agg(F.count(F.lit(1)).alias("n_occ")))
    lists = (stop.withColumn("list", F.lit("pipeline"))
             .unionByName(triple.withColumn("list", F.lit("triples"))))
    return (lists.join(words, "word", "left")
            .select("list", "word", F.coalesce("n_occ", F.lit(0)).cast("bigint").alias("n_occ")))


@register("remove_stopwords")
def q_remove_stopwords(spark, sf_dir):
    """M3 with the triple stop list on the cleaned intros (T7's first step)."""
    p = pl.load_prepared(spark, sf_dir)
    words = sorted((ann.BASE_STOPWORDS | ann.ADDED_STOPWORDS) - ann.TRIPLE_KEEP)
    return p.select(*_doc_cols(p), remove_words("clean", words).alias("text"))


@register("doc_terms")
def q_doc_terms(spark, sf_dir):
    """Filtered lemmas per stripped intro, in order."""
    terms = pl.doc_terms(spark, pl.stripped(pl.load_prepared(spark, sf_dir)))
    return terms.select(*_doc_cols(terms), F.col("pos").cast("bigint").alias("pos"), "term")


# ---- step 2: vectors ---------------------------------------------------------

def _terms_and_docs(spark, sf_dir, cfg=None):
    from storyloom.session import cut_lineage
    cfg = cfg or pl.PipelineConfig()
    prep = cut_lineage(pl.load_prepared(spark, sf_dir, cfg).select(*pl.DOC, "clean"))
    return cut_lineage(pl.doc_terms(spark, pl.stripped(prep), cfg)), prep.select(*pl.DOC)


def _vectors(spark, sf_dir, terms):
    return pl.vocabulary_vectors(spark, sf_dir, terms.select(F.col("term").alias("word")))


def _dim(spark, sf_dir):
    return len(load_table(spark, sf_dir, "embeddings").select("embedding").first()[0])


def _vec_summary(df):
    from storyloom.functions.arrays import l2_normalize
    total = lambda c: F.aggregate(c, F.lit(0.0).cast("double"), lambda a, b: a + b)
    return df.select(F.col("year").cast("bigint").alias("year"), "category", "id",
                     _r(total(F.col("vec"))).alias("vec_sum"),
                     _r(total(l2_normalize(F.col("vec")))).alias("unit_sum"))


@register("term_counts")
def q_term_counts(spark, sf_dir):
    """A3: bag of words per intro."""
    from storyloom.operators.vectors import term_counts
    terms, _ = _terms_and_docs(spark, sf_dir)
    c = term_counts(terms, pl.DOC)
    return c.select(*_doc_cols(c), "term", F.col("n").cast("bigint").alias("n"))


@register("doc_freq")
def q_doc_freq(spark, sf_dir):
    """A4: documents per term inside each group."""
    from storyloom.operators.vectors import doc_freq, term_counts
    terms, _ = _terms_and_docs(spark, sf_dir)
    d = doc_freq(term_counts(terms, pl.DOC), pl.G)
    return d.select(F.col("year").cast("bigint").alias("year"), "category", "term",
                    F.col("df").cast("bigint").alias("df"))


@register("tfidf")
def q_tfidf(spark, sf_dir):
    """A5: n * log2(N/df), unit length per intro, tiny weights dropped."""
    terms, docs = _terms_and_docs(spark, sf_dir)
    w = pl.doc_weights(terms, docs)
    return w.select(*_doc_cols(w), "term", _r("weight").alias("weight"))


@register("embed_lookup")
def q_embed_lookup(spark, sf_dir):
    """Each intro term with its word vector (vector length as a check value)."""
    from storyloom.operators.vectors import embed_lookup
    terms, _ = _terms_and_docs(spark, sf_dir)
    hit = embed_lookup(terms, _vectors(spark, sf_dir, terms))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0).cast("double"),
                              lambda a, x: a + x.cast("double") * x.cast("double")))
    return hit.select(*_doc_cols(hit), F.col("pos").cast("bigint").alias("pos"), "term",
                      _r(norm).alias("vec_norm"))


@register("doc_vectors_tfidf")
def q_doc_vectors_tfidf(spark, sf_dir):
    """A7 + M6: TF-IDF weighted mean word vector per intro, then unit length."""
    terms, docs = _terms_and_docs(spark, sf_dir)
    dv = pl.doc_vectors(terms, docs, _vectors(spark, sf_dir, terms), _dim(spark, sf_dir))
    return _vec_summary(dv)


@register("doc_vectors_mean")
def q_doc_vectors_mean(spark, sf_dir):
    """Mean vector over distinct in-vocabulary terms."""
    cfg = pl.PipelineConfig(vectorizer="mean")
    terms, docs = _terms_and_docs(spark, sf_dir, cfg)
    dv = pl.doc_vectors(terms, docs, _vectors(spark, sf_dir, terms), _dim(spark, sf_dir), cfg)
    return _vec_summary(dv)


@register("doc_vectors_top10")
def q_doc_vectors_top10(spark, sf_dir):
    """As A7 over the 10 highest-weight terms (ties by term)."""
    cfg = pl.PipelineConfig(vectorizer="top10")
    terms, docs = _terms_and_docs(spark, sf_dir, cfg)
    dv = pl.doc_vectors(terms, docs, _vectors(spark, sf_dir, terms), _dim(spark, sf_dir), cfg)
    return _vec_summary(dv)


# ---- step 3: clusters ----------------------------------------------------------

def _nchar_points(spark, sf_dir):
    """FIXTURES §3: the article length as a 1-D point per kept article."""
    g = pl.grouped(load_articles(spark, sf_dir))
    nc = load_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("n_chars").cast("double").alias("x"))
    return g.join(nc, "seq").select(*pl.DOC, "x")


def _nchar_models(spark, sf_dir):
    from storyloom.operators import clustering as cl
    from storyloom.session import cut_lineage
    pts = cut_lineage(_nchar_points(spark, sf_dir))
    return pts, cut_lineage(cl.kmeans_models(pts, pl.G, "x"))


@register("kmeans_centroids")
def q_kmeans_centroids(spark, sf_dir):
    """C2 (and C4's k grid): centroids at the fixed point, every group and k."""
    _, models = _nchar_models(spark, sf_dir)
    c = models.select(*pl.G, "k", F.posexplode("cents").alias("cluster", "mu"))
    return c.select(F.col("year").cast("bigint").alias("year"), "category",
                    F.col("k").cast("bigint").alias("k"),
                    F.col("cluster").cast("bigint").alias("cluster"), _r("mu").alias("mu"))


@register("silhouette")
def q_silhouette(spark, sf_dir):
    """Exact 1-D silhouette of every (group, k) model (oracle: all pairs)."""
    _, models = _nchar_models(spark, sf_dir)
    return models.select(F.col("year").cast("bigint").alias("year"), "category",
                         F.col("k").cast("bigint").alias("k"), _r("score").alias("score"))


@register("best_k")
def q_best_k(spark, sf_dir):
    """The k with the best silhouette per group (smallest k on ties)."""
    from storyloom.operators import clustering as cl
    _, models = _nchar_models(spark, sf_dir)
    b = cl.best_per_group(models, pl.G)
    return b.select(F.col("year").cast("bigint").alias("year"), "category",
                    F.col("k").cast("bigint").alias("k"), _r("score").alias("score"))


def _nchar_sweep(spark, sf_dir):
    from storyloom.operators import clustering as cl
    from storyloom.session import cut_lineage
    return cl.kmeans_sweep(cut_lineage(_nchar_points(spark, sf_dir)), pl.G, "x", "id")


@register("representatives")
def q_representatives(spark, sf_dir):
    """Nearest members of big-enough clusters of the best k."""
    from storyloom.operators import clustering as cl
    labels, best = _nchar_sweep(spark, sf_dir)
    reps = cl.top_representatives(labels, cl.centroid_table(best, pl.G), pl.G, "x", "id")
    return reps.select(F.col("year").cast("bigint").alias("year"), "category",
                       F.col("cluster").cast("bigint").alias("cluster"), "rank", "id")


@register("kmeans_restarts")
def q_kmeans_restarts(spark, sf_dir):
    """C2-C4 with 25 k-means++ starts a model: centroids and score of the start
    with the least inertia (rows-only: the draws have no SQL form)."""
    from storyloom.operators import clustering as cl
    from storyloom.session import cut_lineage
    models = cl.kmeans_models(cut_lineage(_nchar_points(spark, sf_dir)), pl.G, "x", 25)
    c = models.select(*pl.G, "k", "score", F.posexplode("cents").alias("cluster", "mu"))
    return c.select(F.col("year").cast("bigint").alias("year"), "category", F.col("k").cast("bigint").alias("k"),
                    F.col("cluster").cast("bigint").alias("cluster"), _r("mu").alias("mu"), _r("score").alias("score"))


@register("pca_projection")
def q_pca_projection(spark, sf_dir):
    """C1 + M6: unit document vectors projected on the group's first axis
    (rows-only: eigenvectors have no SQL form)."""
    from storyloom.operators import clustering as cl
    from storyloom.operators.vectors import normalize_rows
    from storyloom.session import cut_lineage
    terms, docs = _terms_and_docs(spark, sf_dir)
    dv = pl.doc_vectors(terms, docs, _vectors(spark, sf_dir, terms), _dim(spark, sf_dir))
    x = cl.pca_1d(normalize_rows(cut_lineage(dv)), pl.G, "id", "vec", "x")
    return x.select(*_doc_cols(x), _r("x").alias("x"))


@register("cluster_articles")
def q_cluster_articles(spark, sf_dir):
    """Q1 (S2 rows): representative articles with their sentiment bucket."""
    out = pl.cluster_pipeline(load_articles(spark, sf_dir), pl.fixture_resources(spark, sf_dir))["articles"]
    return out.select(F.col("Year").cast("bigint").alias("Year"), "Category", "id", "url",
                      "title", "sentiment")


# ---- step 4: topics ----------------------------------------------------------

def _nchar_clusters(spark, sf_dir):
    """Cluster members of the n_chars k-means (deterministic, SQL-checkable)."""
    labels, _ = _nchar_sweep(spark, sf_dir)
    return labels.select(*pl.DOC, "cluster")


def _cluster_terms(spark, sf_dir):
    from storyloom.operators.topics import terms_in_tasks
    terms, _ = _terms_and_docs(spark, sf_dir)
    return terms_in_tasks(terms, pl.G, "id", terms.count()).join(_nchar_clusters(spark, sf_dir), pl.DOC)


@register("bigram_counts")
def q_bigram_counts(spark, sf_dir):
    """Adjacent pair counts per cluster with the vocabulary size."""
    from storyloom.operators.topics import bigram_counts
    scope = [*pl.G, "cluster"]
    _, pairs, vocab = bigram_counts(_cluster_terms(spark, sf_dir), scope)
    out = pairs.join(vocab, scope)
    return out.select(F.col("year").cast("bigint").alias("year"), "category",
                      F.col("cluster").cast("bigint").alias("cluster"), "a", "b",
                      F.col("n_ab").cast("bigint").alias("n_ab"),
                      F.col("n_vocab").cast("bigint").alias("n_vocab"))


@register("bigram_phrases")
def q_bigram_phrases(spark, sf_dir):
    """Greedy bigram merging inside each cluster."""
    from storyloom.operators.topics import bigram_phrases
    m = bigram_phrases(_cluster_terms(spark, sf_dir), [*pl.G, "cluster"])
    return m.select(*_doc_cols(m), F.col("pos").cast("bigint").alias("pos"), "term")


@register("coherence")
def q_coherence(spark, sf_dir, per_topic=5):
    """P3 on fixed topics: each cluster's ten most frequent terms as two topics."""
    from pyspark.sql import Window
    from storyloom.operators.topics import coherence_cv
    scope = [*pl.G, "cluster"]
    from storyloom.session import cut_lineage
    ct = cut_lineage(_cluster_terms(spark, sf_dir))
    w = Window.partitionBy(*scope).orderBy(F.col("_n").desc(), "term")
    top = (ct.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("_n"))
           .withColumn("_r", F.row_number().over(w) - 1).where(F.col("_r") < 2 * per_topic)
           .select(*scope, F.lit(2).alias("k"), F.floor(F.col("_r") / per_topic).cast("int").alias("topic"), "term"))
    c = coherence_cv(ct, top, scope)
    return c.select(F.col("year").cast("bigint").alias("year"), "category",
                    F.col("cluster").cast("bigint").alias("cluster"), _r("coherence").alias("coherence"))


@register("coherence_top20")
def q_coherence_top20(spark, sf_dir):
    """P3 at its full 20 words a topic: the 40 most frequent terms as two topics."""
    return q_coherence(spark, sf_dir, per_topic=20)


@register("lda_fixed_steps")
def q_lda_fixed_steps(spark, sf_dir, passes=2):
    """Word probabilities of a three-topic model per cluster after two passes."""
    from storyloom.operators.topics import fit_topics
    from storyloom.operators.vectors import term_counts
    scope = [*pl.G, "cluster"]
    counts = term_counts(_cluster_terms(spark, sf_dir), [*scope, "id"]).withColumnRenamed("n", "weight")
    models = counts.select(*scope).distinct().withColumn("k", F.lit(3))
    _, phi = fit_topics(counts, models, scope, passes=passes)
    p = phi.select(*scope, "term", F.posexplode("ph").alias("topic", "prob"))
    return p.select(F.col("year").cast("bigint").alias("year"), "category",
                    F.col("cluster").cast("bigint").alias("cluster"), "term",
                    F.col("topic").cast("bigint").alias("topic"), _r("prob").alias("prob"))


@register("lda_passes")
def q_lda_passes(spark, sf_dir):
    """P2 at its full 20 passes."""
    return q_lda_fixed_steps(spark, sf_dir, passes=20)


@register("keyword_valid")
def q_keyword_valid(spark, sf_dir):
    """which distinct intro words pass the keyword check (with vocabulary)."""
    from storyloom.operators.tokens import keyword_valid
    terms, _ = _terms_and_docs(spark, sf_dir)
    words = terms.select(F.col("term").alias("word")).distinct()
    ok = keyword_valid(words, "word", pl.stop_list(spark), _vectors(spark, sf_dir, terms))
    return ok.select("word")


def _group_queries(spark, sf_dir):
    """Per group: its three most frequent intro terms that have a vector."""
    terms, _ = _terms_and_docs(spark, sf_dir)
    vec = _vectors(spark, sf_dir, terms)
    freq = terms.groupBy(*pl.G, "term").agg(F.count(F.lit(1)).alias("_n")).join(
        vec.withColumnRenamed("word", "term"), "term")
    from pyspark.sql import Window
    w = Window.partitionBy(*pl.G).orderBy(F.col("_n").desc(), "term")
    return freq.withColumn("_r", F.row_number().over(w)).where("_r <= 3") \
        .select(*pl.G, F.col("term").alias("word"), "vec")


@register("cosmul_neighbours")
def q_cosmul_neighbours(spark, sf_dir):
    """5 nearest vocabulary words (product of (1+cos)/2) per group query."""
    from storyloom.operators.topics import cosmul_neighbours
    vocab = pl.corpus_vocabulary(spark, sf_dir)
    n = cosmul_neighbours(_group_queries(spark, sf_dir), vocab, pl.G)
    return n.select(F.col("year").cast("bigint").alias("year"), "category",
                    F.col("rank").cast("bigint").alias("rank"), "word", _r("score").alias("score"))


@register("topic_sentiment")
def q_topic_sentiment(spark, sf_dir):
    """Mean quality label of each n_chars cluster → bucket."""
    from storyloom.operators.topics import topic_sentiment
    cl = _nchar_clusters(spark, sf_dir)
    g = pl.grouped(load_articles(spark, sf_dir)).select(*pl.DOC, "seq")
    lab = load_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"),
                                                     F.col("quality").alias("label"))
    labels = g.join(lab, "seq")
    s = topic_sentiment(cl, labels, [*pl.G, "cluster"], pl.DOC)
    return s.select(F.col("year").cast("bigint").alias("year"), "category",
                    F.col("cluster").cast("bigint").alias("cluster"),
                    _r("mean_label").alias("mean_label"), "sentiment")


@register("topics")
def q_topics(spark, sf_dir, cfg=pl.PipelineConfig()):
    """Q2 (S4 rows): topics per cluster with name, keywords, articles, sentiment."""
    res = pl.fixture_resources(spark, sf_dir)
    t = pl.topic_pipeline(pl.cluster_pipeline(load_articles(spark, sf_dir), res, cfg), res, cfg)["topics"]
    return t.select(F.col("Year").cast("bigint").alias("Year"), "Category",
                    F.col("ClusterId").cast("bigint").alias("ClusterId"),
                    F.col("TopicId").cast("bigint").alias("TopicId"),
                    F.array_join("Topic Name", "|").alias("Topic Name"),
                    F.array_join("Keywords", "|").alias("Keywords"),
                    F.array_join(F.col("Articles").cast("array<string>"), "|").alias("Articles"),
                    "Sentiment")


# ---- step 5: triples -----------------------------------------------------------

def _triple_texts_nchars(spark, sf_dir):
    """Triple texts of every kept article; cluster = n_chars cluster, topic 0."""
    from storyloom.session import cut_lineage
    prep = pl.load_prepared(spark, sf_dir)
    td = _nchar_clusters(spark, sf_dir).withColumn("topic", F.lit(0))
    return cut_lineage(pl.triple_texts(prep, td))


@register("verb_phrases")
def q_verb_phrases(spark, sf_dir):
    """The longest root verb phrase per sentence of the triple texts."""
    from storyloom.operators import triples as tr
    vp = tr.phrases_of_records(pl.triple_records(_triple_texts_nchars(spark, sf_dir)), pl.TRIPLE_KEYS)
    return vp.select(*_doc_cols(vp), F.col("sent_id").cast("bigint").alias("sent_id"),
                     F.col("start").cast("bigint").alias("start"),
                     F.col("end").cast("bigint").alias("end"), "text")


@register("noun_chunks")
def q_noun_chunks(spark, sf_dir):
    """Default chunker over the triple texts (input of T3/T4)."""
    rows = pl.triple_records(_triple_texts_nchars(spark, sf_dir))
    ch = rows.select(*pl.TRIPLE_KEYS, "sent_id", F.inline_outer("chunks")).where(F.col("start").isNotNull())
    return ch.select(*_doc_cols(ch), F.col("sent_id").cast("bigint").alias("sent_id"),
                     F.col("start").cast("bigint").alias("start"),
                     F.col("end").cast("bigint").alias("end"), "text")


@register("triples_raw")
def q_triples_raw(spark, sf_dir):
    """Subject / relation / object per sentence before T6."""
    t = pl.extract_triplets(_triple_texts_nchars(spark, sf_dir))
    return t.select(*_doc_cols(t), F.col("sent_id").cast("bigint").alias("sent_id"),
                    "subject", "relation", "object")


@register("triples_filtered")
def q_triples_filtered(spark, sf_dir):
    """Filtered triples (LCS redundancy removed from the object)."""
    from storyloom.operators import triples as tr
    t = tr.filter_triples(pl.extract_triplets(_triple_texts_nchars(spark, sf_dir)))
    return t.select(*_doc_cols(t), F.col("sent_id").cast("bigint").alias("sent_id"),
                    "subject", "relation", "object")


#: Q2 with the topic operator's own default range, 2 to 9 topics a cluster.
TOPICS_TO_9 = pl.PipelineConfig(max_topics=10)


@register("topics_to_9")
def q_topics_to_9(spark, sf_dir):
    """Q2 over 2 to 9 topics a cluster."""
    return q_topics(spark, sf_dir, TOPICS_TO_9)


@register("triples")
def q_triples(spark, sf_dir, cfg=pl.PipelineConfig()):
    """Q3, T7 (S6 rows): triples of the documents of Q2's topics (rows-only)."""
    res = pl.fixture_resources(spark, sf_dir)
    q2 = pl.topic_pipeline(pl.cluster_pipeline(load_articles(spark, sf_dir), res, cfg), res, cfg)
    rows = pl.triple_pipeline(q2, res, cfg)["triples"]
    return rows.select(F.col("Year").cast("bigint").alias("Year"), "Category",
                       F.col("ClusterId").cast("bigint").alias("ClusterId"),
                       F.col("topicId").cast("bigint").alias("topicId"), "source", "relation",
                       "target", "articleId", "sentiment")


@register("triples_to_9")
def q_triples_to_9(spark, sf_dir):
    """Q3 over Q2's 2 to 9 topics a cluster."""
    return q_triples(spark, sf_dir, TOPICS_TO_9)


@register("entity_triples")
def q_entity_triples(spark, sf_dir):
    """Sentences with exactly two entities, relation at the root."""
    t = pl.extract_entity_triples(_triple_texts_nchars(spark, sf_dir))
    t = t.withColumnsRenamed({"subject": "source", "object": "target"})
    return t.select(*_doc_cols(t), F.col("sent_id").cast("bigint").alias("sent_id"),
                    "source", "relation", "target")


@register("svo_triples")
def q_svo_triples(spark, sf_dir):
    """Subject-verb-object triples over merged spans."""
    t = pl.extract_svo(_triple_texts_nchars(spark, sf_dir))
    t = t.withColumnsRenamed({"subject": "source", "object": "target"})
    return t.select(*_doc_cols(t), F.col("sent_id").cast("bigint").alias("sent_id"),
                    "source", "relation", "target")
