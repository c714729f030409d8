from hashlib import sha256

import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sparktoire.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN, REFERENCE = bpe.Bpe(bpe.content_of(PATH)), Tokenizer.from_file(PATH)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "the", " tion", "'ll", "\n\n", " ", "é", "\x1c", "\u2003", "a" * 30, "12³"]), max_size=12).map("".join)))
def test_equals_the_tokenizers_library(text):
    ids = REFERENCE.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == REFERENCE.decode(ids, skip_special_tokens=False)


def test_merge_skips_stale_entries_in_long_pretokens():
    for text in ("a" * 3000, "abcab" * 700, "thethethe" * 50):
        assert OWN.encode(text) == REFERENCE.encode(text, add_special_tokens=False).ids


def test_query_digests(spark, documents, prose):
    rows = [(1, prose(1, 300)), (2, None), (3, ""), (None, "x<|endoftext|>y"), (1, "é")]
    got = bpe.encode_decode(documents(rows), PATH).collect()
    for g, (i, t) in zip(got, rows, strict=True):
        ids = REFERENCE.encode(t or "", add_special_tokens=False).ids
        back = REFERENCE.decode(ids, skip_special_tokens=False)
        assert tuple(g) == (i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(back.encode()).hexdigest())
    assert bpe.encode_decode(documents([]), PATH).count() == 0
