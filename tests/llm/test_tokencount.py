import random

import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sparktoire.llm import tokencount as tc
from sparktoire.llm.bpe import Bpe, content_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
BPE, REFERENCE = Bpe(content_of(PATH)), Tokenizer.from_file(PATH)
TEXT = st.text(alphabet="ab 's'lvet1!\n\u3000é", max_size=120)
SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "<|", "|>", "word", " ", "<", "é'll"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(TEXT, SPECIAL), st.lists(st.tuples(st.integers(-2, 130), st.integers(-2, 130), st.one_of(st.text(alphabet="al 's\n!", max_size=8), SPECIAL)), max_size=5))
def test_edits_equal_a_fresh_count(text, edits):
    tc.BLOCK = 3
    counted = tc.CountedText(text, BPE)
    for start, stop, new in edits:
        a = min(max(start, 0), len(text))
        text = text[:a] + new + text[min(max(stop, a), len(text)) :]
        counted.edit(start, stop, new)
        assert counted.text() == text and counted.chars == len(text)
        assert counted.tokens == len(REFERENCE.encode(text, add_special_tokens=False).ids)
    tc.BLOCK = 32


def test_only_touched_regions_are_encoded_again(prose):
    text = prose(1, 20_000)
    counted = tc.CountedText(text, BPE)
    r = random.Random(2)
    for _ in range(50):
        at = r.randrange(len(text))
        text = text[:at] + "edit " + text[at + 3 :]
        counted.edit(at, at + 3, "edit ")
    assert counted.reencoded < 50 * 12 and counted.root.height < 24
    assert counted.tokens == len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)


def test_query_columns_and_defined_cases(spark, documents, prose):
    rows = [(1, prose(3, 50)), (2, None), (3, ""), (None, "a"), (1, "é" * 30), (4, "x" * 50_000)]
    docs = tc.sample_edits(documents(rows))
    got = tc.edited_counts(docs, PATH).collect()
    reference = Tokenizer.from_file(PATH)
    assert len(got) == len(rows)
    for g, t in zip(got, (t or "" for _, t in rows), strict=True):
        m = len(t) // 2
        after = "Draft 2:\n" + t[:m] + " revised passage," + t[m + 12 :]
        k = min(max(len(t) - 10, 0), len(after))
        after = after[:k] + "." + after[len(t) + 100 :]
        count = lambda x: len(reference.encode(x, add_special_tokens=False).ids)
        assert (g.n_chars, g.n_tokens, g.n_edits, g.n_tokens_edited, g.n_chars_edited) == (len(t), count(t), 3, count(after), len(after))
    assert tc.edited_counts(docs.limit(0), PATH).count() == 0
    nulls = spark.createDataFrame([(1, "a b", None), (2, "a b", [None, (None, None, None), (1, None, "z")])], "doc_id long, text string, edits array<struct<start int, stop int, text string>>")
    assert [(r.n_edits, r.n_chars_edited) for r in tc.edited_counts(nulls, PATH).collect()] == [(0, 3), (2, 4)]
