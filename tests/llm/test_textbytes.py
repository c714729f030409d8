import random

import numpy as np
import pytest

from sparktoire.llm import katz, quality, textbytes as tb


def thue_morse(levels):
    """Two texts that every polynomial hash modulo a power of two confuses."""
    a, b = "a", "b"
    for _ in range(levels):
        a, b = a + b, b + a
    return a, b


def spans(texts):
    data = [t.encode() for t in texts]
    edge = np.append(0, np.cumsum([len(x) for x in data])).astype(np.int64)
    return np.frombuffer(b"".join(data), np.uint8), edge[:-1], edge[1:]


def test_equal_spans_and_only_these_have_equal_hashes_and_numbers():
    r = random.Random(1)
    texts = [*thue_morse(11), *thue_morse(5), "", "", "a" * 63, "a" * 64, "a" * 65, "a" * 128, "a" * 5000, "\0", "\0\0", "\0" * 64]
    texts += ["".join(r.choices("ab\0", k=r.randint(0, 9))) for _ in range(3000)] + ["x" * r.randint(0, 200) for _ in range(500)]
    for f in (tb.span_hashes, tb.span_numbers):
        for block in [{}, {"block": 100}] if f is tb.span_numbers else [{}]:
            got = f(*spans(texts), **block).tolist()
            assert len(set(got)) == len(set(texts)) == len(set(zip(got, texts, strict=True)))


def test_numbers_compare_bytes_where_hashes_meet(monkeypatch):
    monkeypatch.setattr(tb, "span_hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["ab", "ba", "ab", "", "abc", "ba", "", "abd"]
    got = tb.span_numbers(*spans(texts)).tolist()
    assert len(set(got)) == 5 == len(set(zip(got, texts, strict=True)))


def test_words_and_lines_that_polynomials_confuse(spark, documents):
    a, b = thue_morse(11)
    got = {x.doc_id: x for x in quality.quality(documents([(1, f"{a}\n{b}"), (2, f"{a}\n{a}")])).collect()}
    assert (got[1].n_dup_lines, got[1].longest_repeat, got[2].n_dup_lines, got[2].longest_repeat) == (0, 0, 1, 1)


@pytest.mark.parametrize("levels", [3, 11])
def test_a_word_is_known_only_if_it_was_learned(spark, documents, levels):
    a, b = thue_morse(levels)
    got = {x.doc_id: x for x in katz.katz_scores(documents([(1, a), (3, b), (4, b), (6, b)])).collect()}
    assert [(i, x.held_out, x.n_known) for i, x in sorted(got.items())] == [(1, True, 1), (3, False, 2), (4, False, 2), (6, True, 2)]
