import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from storyloom.llm.byte_bpe import ByteBpe, decoded, encoded, read_rank_file, round_trip_digests

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
RAW = read_rank_file(PATH)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
TIK = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
SMALL = ByteBpe(RAW, PATTERN, leaf_chars=5, leaf_bytes=3)
PLAIN = ByteBpe(RAW, PATTERN)

pieces = st.sampled_from(["'re", "'s", "'", "r", "e", "s", "ve", " ", "  ", "\n", "\t", " ", "aa", "the", "é", "ß",
                          "12", "3", "!!", "...", "漢", "🙂", "ing", "tion", "\x00", "'ll", "A"])


@settings(max_examples=600, deadline=None)
@given(st.lists(pieces, max_size=40).map("".join) | st.text(max_size=60))
def test_tree_equals_tiktoken(text):
    want = TIK.encode_ordinary(text)
    for bpe in (SMALL, PLAIN):
        packed = bpe.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == want
        assert bpe.decode(packed) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"aa", b"the", b"ing", b"er", b"\xc3", b"\xa9", b"1", b" ", b"ion"]),
                min_size=1, max_size=60).map(b"".join))
def test_token_tree_equals_one_merge(data):
    from storyloom.llm.byte_bpe import merge_by_rank
    assert SMALL.tokens(data) == merge_by_rank(data, RANKS)


@pytest.mark.parametrize("text", ["x" * 5000, " " * 4000 + "a", "ab" * 3000, "é" * 2000, "\n \n" * 500, "<|endoftext|>"])
def test_long_pieces(text):
    assert np.frombuffer(SMALL.encode(text), "<u4").tolist() == TIK.encode_ordinary(text)


def test_documents(documents, odd, none):
    for df in (documents, odd):
        got = sorted(map(tuple, round_trip_digests(df, PATH, PATTERN).collect()), key=str)
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = np.array(TIK.encode_ordinary(r.text or ""), "<u4")
            want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                         hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert got == sorted(want, key=str)
    assert round_trip_digests(none, PATH, PATTERN).count() == 0
    both = decoded(encoded(odd, PATH, PATTERN), PATH, PATTERN)
    assert set(odd.columns) < set(both.columns)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both.collect())
