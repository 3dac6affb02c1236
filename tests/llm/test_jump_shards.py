import zlib

import numpy as np

from storyloom.llm.jump_shards import assign_shards, jump_hash, shard_manifest, with_slots


def brute_jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63, 3000, np.int64)
    for n in (1, 2, 24, 25, 1000):
        assert jump_hash(keys, n).tolist() == [brute_jump(int(k), n) for k in keys]
    # known values of the published function
    assert jump_hash(np.array([0, 1, 0xdeadbeef]), 1).tolist() == [0, 0, 0]


def test_growth_moves_only_into_the_new_shard(documents):
    got = assign_shards(documents, 24).select("shard", "grown_shard").collect()
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    assert any(r.grown_shard == 24 for r in got)


def test_manifest(documents, odd, none):
    for df in (documents, odd):
        got = shard_manifest(df, 24).collect()
        want = sorted((len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()), str(r.doc_id))
                      for r in df.select("doc_id", "text").collect())
        assert sorted((r["size"], r.text_crc32, str(r.doc_id)) for r in got) == want
        for s in {r.shard for r in got}:
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
        assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert shard_manifest(none, 24).count() == 0


def test_many_slices(documents):
    got = with_slots(assign_shards(documents, 3), rows_per_slice=7).collect()
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
