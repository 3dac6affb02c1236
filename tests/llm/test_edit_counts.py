import random

import public_tokenizers
from pyspark.sql import functions as F

from storyloom.llm.byte_bpe import coder, read_rank_file
from storyloom.llm.edit_counts import CountTree, apply_edits, join_edits, revision_edits, with_trees

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
BPE = coder(read_rank_file(PATH), PATTERN)


def count(text):
    return len(BPE.encode(text)) // 4


def test_random_edits_follow_a_full_recount():
    rng = random.Random(5)
    bits = ["the ", "tion", " ", "\n\n", "'re", "12", "é", "...", "🙂", "word word ", "'", "x" * 40, ""]
    again = size = 0
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 900)))
        tree = CountTree.build(text, BPE, run=4)
        for _ in range(12):
            a = rng.randrange(0, len(tree.text) + 3)
            b = a + rng.choice([0, 0, 1, 3, 50])
            new = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))
            want = tree.text[:a] + new + tree.text[b:]
            again += tree.edit(a, b, new, BPE, run=4)
            size += len(want)
            assert tree.text == want and tree.total == count(want)
            assert sum(tree.leaf_chars) == len(want) and sum(tree.sums[tree.size:]) == tree.total
    assert again < size / 3  # only what the edits touch is encoded again


def test_query_form(documents, odd, none):
    for df in (documents, odd):
        trees = with_trees(df, PATH, PATTERN).withColumn("edits", revision_edits())
        got = apply_edits(trees, PATH, PATTERN).collect()
        assert len(got) == df.count()
        assert all(r.n_tokens == count(r.text) and r.n_edits == 4 for r in got)
    assert apply_edits(with_trees(none, PATH, PATTERN).withColumn("edits", revision_edits()), PATH, PATTERN).count() == 0


def test_edit_table(spark, documents):
    edits = spark.createDataFrame(
        [(0, 2, 0, 5, "Start"), (0, 1, 10, 10, " inserted "), (1, 1, 3, None, None), (2, 1, 10 ** 9, 10 ** 9, "!")],
        "doc_id long, seq int, start long, end long, replacement string")
    trees = join_edits(with_trees(documents.select("doc_id", "text"), PATH, PATTERN), edits)
    got = {r.doc_id: r for r in apply_edits(trees, PATH, PATTERN).collect()}
    own = {r.doc_id: r.text for r in documents.collect()}
    t = own[0][:10] + " inserted " + own[0][10:]
    assert got[0].text == "Start" + t[5:] and got[0].n_tokens == count(got[0].text)
    assert got[1].text == own[1] and got[2].text == own[2] + "!" and got[3].n_edits == 0


def test_state_survives_parquet(spark, documents, tmp_out):
    with_trees(documents.select("doc_id", "text"), PATH, PATTERN).write.parquet(f"{tmp_out}/state")
    stored = spark.read.parquet(f"{tmp_out}/state").withColumn("edits", revision_edits())
    assert all(r.n_tokens == count(r.text) for r in apply_edits(stored, PATH, PATTERN).collect())
    assert stored.where(F.size("leaf_chars") * 2 != F.size("token_sums")).count() == 0
