import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from storyloom.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tok():
    return ta.Tokenizers(ta.read_model_file(A), ta.read_model_file(B))


def groups_of(tok, text):
    """Lists of (A ids, B ids), by walking both rows token by token."""
    if not text:
        return []
    a = tok.a.encode(" " + text, add_special_tokens=False).ids
    b = tok.b.encode(text)
    want = (" " + text).encode()
    if b"".join(tok.a_bytes[i] for i in a) != want or b"".join(tok.b_bytes[i] for i in b) != want:
        return []
    out, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            out[-1][0].append(a[i])
            at_a += len(tok.a_bytes[a[i]])
            i += 1
        else:
            out[-1][1].append(b[j])
            at_b += len(tok.b_bytes[b[j]])
            j += 1
        if at_a == at_b:
            out.append(([], []))
    return out[:-1]


def brute(tok, rows):
    groups = [(k, groups_of(tok, t)) for k, t in rows]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in groups]
    counts = Counter(p for c in linked for p in c)
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (k, g), c in zip(groups, linked):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((k, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                    sum(n for p, n in c.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str), counts, most


def spark_rows(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_documents(spark, tok, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert spark_rows(ta.aligned(documents, A, B)) == brute(tok, rows)[0]


ODD = ["<|endoftext|> and <s> </s> <unk> <0x41>", "▁ mark", " leading", "trailing  ", "  ", "\n\n\n", "a" * 3000,
       "ab" * 2000, "\x00", "漢字かな交じり文" * 50, "🙂" * 300, "1234567890" * 40, "é é", "…" * 500, "\t x"]


def test_odd_rows(spark, tok, odd):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)] + [(100, ODD[0])], "doc_id long, text string")
    docs = odd.unionByName(extra, allowMissingColumns=True)
    assert spark_rows(ta.aligned(docs, A, B)) == brute(tok, [(r.doc_id, r.text) for r in docs.collect()])[0]


def test_many_runs_in_rounds(spark, tok, documents, monkeypatch):
    """Runs of one document each are merged in rounds of three."""
    docs = documents.limit(24).repartition(24, "doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert spark_rows(ta.aligned(docs, A, B, fan_in=3)) == brute(tok, rows)[0]


def test_pair_counts(spark, tok, documents):
    docs = documents.limit(40)
    _, counts, most = brute(tok, [(r.doc_id, r.text) for r in docs.collect()])
    got = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in ta.pair_counts(docs, A, B).collect()}
    assert got == {p: (n, n == most[p[0]]) for p, n in counts.items()}


def test_groups_themselves(spark, tok, documents):
    docs = documents.limit(5)
    for r in ta.aligned(docs, A, B, keep_groups=True).collect():
        want = groups_of(tok, next(d.text for d in docs.collect() if d.doc_id == r.doc_id))
        assert r.groups == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)


def test_wide_groups_count_equal_ids_first(tok, monkeypatch):
    texts = [("ab" * 400 + "x" * n).encode() for n in range(5)]
    def records():
        keys, links = ta.summed(*ta.Aligned(tok, texts).records(3))
        return dict(zip(keys.tolist(), links.tolist()))
    one = records()
    monkeypatch.setattr(ta, "WIDE_GROUP", 1)
    assert records() == one


def test_runs_are_bounded(tok, spark, documents, monkeypatch):
    """Smaller runs change nothing in the sums: chunk by chunk equals all at once."""
    texts = [r.text.encode() for r in documents.limit(30).collect()]
    whole = ta.Aligned(tok, texts)
    keys, links = ta.summed(*whole.records(0))
    parts = [ta.Aligned(tok, [t]).records(i) for i, t in enumerate(texts)]
    again = ta.summed(*(np.concatenate(x) for x in zip(*parts)))
    assert (again[0] == keys).all() and (again[1] == links).all() and links.sum() == whole.n_links().sum()


@pytest.mark.parametrize("sizes", [(0,), (1, 0, 3), (9000, 20000, 1, 8192), (8193,) * 7])
def test_heap_merge(sizes):
    rng = np.random.default_rng(5)
    streams, want = [], Counter()
    for n in sizes:
        pairs = np.sort(rng.choice(60_000, n, replace=False)).astype(np.int64)
        values = rng.integers(1, 1 << 40, n)
        streams.append(ta.stream_of(iter([(pairs, values)])))
        for p, v in zip(pairs.tolist(), values.tolist()):
            want[p] += v
    got = [(p, v) for ps, vs in ta.heap_merge(streams) for p, v in zip(ps.tolist(), vs.tolist())]
    assert got == sorted(want.items())


@pytest.mark.parametrize("n_b", [1, 7, 5000, 100_000])
def test_best_of_a_side_over_block_borders(n_b):
    rng = np.random.default_rng(6)
    pairs = np.sort(rng.choice(90_000, 30_000, replace=False)).astype(np.int64)
    counts = rng.integers(1, 50, len(pairs))
    cuts = [0, 1, 2, 9000, 9001, 20_000, 30_000]
    parts = list(ta.with_best(((pairs[i:j], counts[i:j]) for i, j in zip(cuts, cuts[1:])), n_b))
    got = np.concatenate([v for _, v in parts])
    most = {}
    for p, c in zip(pairs.tolist(), counts.tolist()):
        most[p // n_b] = max(most.get(p // n_b, 0), c)
    assert (np.concatenate([p for p, _ in parts]) == pairs).all()
    assert got.tolist() == [2 * c + (c == most[p // n_b]) for p, c in zip(pairs.tolist(), counts.tolist())]


def test_pairs_as_numbers(tok):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, tok.n_a, 1000), rng.integers(0, tok.n_b, 1000)
    x, y = tok.ids_of(tok.ordered_pairs(a, b))
    assert (x == a).all() and (y == b).all()


def test_side_a_is_its_file(tok, documents):
    """The rank encoder gives what the vocabulary file's own library gives."""
    texts = [r.text for r in documents.collect()] + ODD + ["don't we'll I'M x's", "a\u00a0 b\u0085c", "²³½ ªº µ", "\r\n \r\n", "x" * 700]
    assert tok.ranked is not None
    assert tok.encode_a(texts) == [tok.a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert not any(len(t) > ta.RANKED_BYTES for t in texts)


def test_rank_encoder_needs_merges_in_order(tok):
    import json
    file = json.loads(ta.read_model_file(A))
    file["model"]["merges"][:2] = file["model"]["merges"][1::-1]
    assert ta.ranked_encoder(file, ta.byte_letters()) is None


def test_empty(spark, none):
    assert spark_rows(ta.aligned(none, A, B)) == []
    assert ta.pair_counts(none, A, B).collect() == []
