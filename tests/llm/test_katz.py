import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparktoire.llm import katz


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^ \t\n\x0b\f\r]+", low), None]


def brute(rows):
    """A plain model in dictionaries; returns the rows, a recursive function P(token, context) and the contexts."""
    split = [(i, zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False, tokens_of(t)) for i, t in rows]
    counts = [Counter(), Counter(), Counter()]
    for _, held, t in split:
        if not held:
            padded = ["<s>", "<s>", *t]
            for k in range(3):
                counts[k].update(tuple(padded[i - k : i + 1]) for i in range(2, len(padded)))
    uni = {w: c for (w,), c in counts[0].items()}
    n, v = sum(uni.values()), len(uni)
    types = lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    d = [katz.discounts(types(c)) for c in counts]
    kept = lambda k, c: c * (d[k][c] if c <= 5 else 1)
    left = sum(c - kept(0, c) for c in uni.values() if c <= 5)
    below, unknown = (n, left / n) if left > 0 else (n + 1, 1 / (n + 1))
    after = {}
    for k in (1, 2):
        for gram, c in counts[k].items():
            after.setdefault(gram[:-1], {})[gram[-1]] = c
    weights = {}

    def p(w, context):
        if not context:
            return kept(0, uni[w]) / below if w in uni else unknown
        if context not in after:
            return p(w, context[1:])
        if context not in weights:
            seen, k = after[context], len(context)
            total, mass = sum(seen.values()), sum(kept(k, c) for c in seen.values())
            den = total if total - mass > 1e-9 * total else total + 1
            weights[context] = den, (den - mass) / den / (1 - sum(p(x, context[1:]) for x in seen))
        den, alpha = weights[context]
        return kept(len(context), after[context][w]) / den if w in after[context] else alpha * p(w, context[1:])

    out = []
    for i, held, t in split:
        base = sum(math.log10((uni.get(w, 0) + 1) / (n + v + 1)) for w in t)
        padded = ["<s>", "<s>", *t]
        score = sum(math.log10(p(padded[k], (padded[k - 2], padded[k - 1]))) for k in range(2, len(padded)))
        out.append((i, held, len(t), sum(w in uni for w in t), n, base, score))
    return out, p, uni, after


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"W{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(60)], k=r.randint(0, 40)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "never seen Words"), (n + 3, rows[1][1]), (3, rows[2][1]), (None, "w1 w2 w1 w2")]


@pytest.mark.parametrize("n", [0, 6, 300, 2000])
def test_matches_plain_model(spark, documents, n):
    rows = corpus(n, n) if n else []
    if n == 6:
        rows += [(1000 + i, "always the same words here") for i in range(30)]
    got = sorted((tuple(r) for r in katz.katz_scores(documents(rows)).collect()), key=repr)
    want = sorted(brute(rows)[0], key=repr) if rows else []
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_distributions_sum_to_one():
    _, p, uni, after = brute(corpus(5, 300))
    assert len(after) > 20
    assert {len(u) for u in after} == {1, 2}
    for u in [*after, ("unseen",), ("unseen", "w1"), ("w1", "unseen")]:
        assert sum(p(w, u) for w in uni) + p("no such word", u) == pytest.approx(1, abs=1e-12)


def test_discounts():
    d = katz.discounts([1000, 400, 220, 140, 100, 75])
    assert all(0 < x < 1 for x in d[1:]) and d[0] == 0
    assert np.allclose(katz.discounts([0, 0, 0, 0, 0, 0])[1:], [(r - 0.5) / r for r in range(1, 6)])
