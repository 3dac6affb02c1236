import hashlib
import zlib

import numpy as np
import pytest

from storyloom.llm import merkle_manifest as mm

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for row in levels[:-1]:
        run = i // 16 * 16
        out.append(("".join(row[run:i]), "".join(row[i + 1:run + 16])))
        i //= 16
    return out


def brute(rows):
    """rows: dicts of FIELDS. Sorted result tuples."""
    def leaf(r, low=False):
        parts = []
        for f in FIELDS:
            v = r[f]
            if v is not None and f == "text" and low:
                v = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in v)
            parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
        return sha("".join(parts))

    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"], leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for i, (key, own, r) in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(top, place)
            here = leaf(r, True) if key is not None and zlib.crc32(str(key).encode()) % 5 == 0 else own
            for left, right in path:
                here = sha(left + here + right)
            out.append((key, own, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), here,
                        here == top[-1][0]))
    return sorted(out, key=str)


def spark_rows(docs):
    out = mm.proofs(mm.build(mm.leaves_of(docs, FIELDS)))
    assert out.columns == ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_are_a_permutation(levels):
    most = mm.ARITY ** (levels - 1)
    for leaves in sorted({1, 2, 15, 16, 17, 255, 256, 257, 273, 4095, most - 1, most}):
        if not 0 < leaves <= most:
            continue
        places = np.concatenate([mm.addresses(levels, leaves, k, np.arange(n))
                                 for k, n in enumerate(mm.level_sizes(leaves, levels))])
        assert sorted(places.tolist()) == list(range(len(places)))


def test_layout_puts_upper_half_first():
    """Four levels: root and its 16 children, then 256 subtrees of one node and its 16 leaves."""
    places = mm.layout(mm.BLOCK_LEAVES, 4)
    assert places[3].tolist() == [0] and places[2].tolist() == list(range(1, 17))
    assert places[1][:3].tolist() == [17, 34, 51]
    assert places[0][:17].tolist() == list(range(18, 34)) + [35]


def test_documents(spark, documents):
    rows = [r.asDict() for r in documents.collect()]
    assert spark_rows(documents) == brute(rows)


def test_odd_rows(spark, odd):
    rows = [r.asDict() for r in odd.collect()]
    assert spark_rows(odd) == brute(rows)


def test_many_tiers(spark):
    """A group of several blocks with a ragged last one, groups of 1, 16, 17 and 4,096 rows, and the null group."""
    sizes = {"big": 4096 * 2 + 1, None: 4096, "b": 17, "a": 1, "ä": 16}
    rows = [(i, g, "en", i % 7, f"Text {i}") for g, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert spark_rows(docs.repartition(5)) == brute([dict(zip(FIELDS, r)) for r in rows])


def test_many_groups(spark):
    """More groups than a block of the upper tree holds."""
    rows = [(i, f"s{i}", None, 1, "A") for i in range(4100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert spark_rows(docs) == brute([dict(zip(FIELDS, r)) for r in rows])


def test_all_rows_equal(spark):
    rows = [(5, "s", "en", 1, "Same")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert spark_rows(docs) == brute([dict(zip(FIELDS, r)) for r in rows])


def test_empty(spark, none):
    assert spark_rows(none) == []
    assert mm.build(mm.leaves_of(none, FIELDS)).root().count() == 0


def test_tampering_is_seen(spark, documents):
    """Every altered leaf with a capital letter fails; all others verify."""
    rows = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    for r in spark_rows(documents):
        altered = zlib.crc32(str(r[0]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in rows[r[0]])
        assert r[6] is (not altered)
