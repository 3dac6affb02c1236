import random
from collections import defaultdict

from storyloom.llm import jaccard_join as jj
from storyloom.llm.components import components


def grams(text):
    from storyloom.llm.batches import folded_words
    w = folded_words((text or "").encode())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Number of links and class per row index."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = [0] * len(rows)
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j > i}:
            both = len(s & sets[j])
            if both * 10 >= 8 * (len(s) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(max(i, j))] = find(min(i, j))
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(i)
    least = {}
    for members in classes.values():
        keys = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            least[i] = min(keys) if keys else None
    return [(rows[i][0], least[i], links[i]) for i in range(len(rows))]


def check(df, **kw):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = jj.jaccard_join(df, **kw).select("doc_id", "class_id", "n_links").collect()
    want = brute(rows)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    return want


def copies(spark, n_groups=12, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows, key = [], 0
    for g in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 300))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((key, " ".join(w)))
            key += 1
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_banding_reaches_recall():
    for t in (0.5, 0.8, 0.9):
        p = jj.banding(t, 0.99)
        assert 1 - (1 - t ** p.rows) ** p.bands >= 0.99 and p.bands * p.rows <= jj.MAX_HASHES


def test_documents(documents):
    assert any(r[2] for r in check(documents))


def test_copies_in_one_block_and_in_many(spark):
    df = copies(spark)
    want = check(df)
    assert max(r[2] for r in want) > 10
    check(df, block=4)


def test_odd_rows(odd, none):
    check(odd)
    assert jj.jaccard_join(none).count() == 0
    assert jj.one_per_class(none).count() == 0
    kept = jj.one_per_class(odd)
    assert kept.columns == odd.columns and kept.where("_t != 'mine'").count() == 0
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(
        [1, 3, 3, 4, 5, 6, 8, 9, 10, None, 11, 12, 13, 14] + ([] if kept.where("doc_id = 7").isEmpty() else [7]), key=str)


def test_one_of_each_class_stays(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    classes = {c for _, c, _ in brute(rows)}
    got = jj.one_per_class(documents).collect()
    assert {r.doc_id for r in got} == classes and len(got) == len(classes)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 900), (7, 900), (900, 901)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_unrelated_classes_under_null_or_repeated_ids_stay_apart(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    for key in (None, 7):
        df = spark.createDataFrame([(key, t) for t in (one, one, one + " x", two, two, two + " y")] + [(9, three)],
                                   "doc_id long, text string")
        kept = [r.text for r in jj.one_per_class(df).collect()]
        # of each class one text, with every row that equals it in key and text
        assert {t[0] for t in kept} == {"a", "b", "c"} and len({t for t in kept}) == 3
        classes = {(r.class_node, r.doc_id) for r in jj.jaccard_join(df).collect()}
        assert len(classes) == 3


def test_repeated_id_over_many_classes(spark):
    texts = [" ".join(f"g{g}w{i}" for i in range(30)) for g in range(8)]
    df = spark.createDataFrame([(1, t + end) for t in texts for end in ("", " x", " y")], "doc_id long, text string")
    assert sorted({r.text.split("w")[0] for r in jj.one_per_class(df).collect()}) == [f"g{g}" for g in range(8)]
