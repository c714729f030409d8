import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparktoire.llm import langid as li

SYLLABLES = {"en": "the ing and ed tion sh ou er".split(), "de": "sch ung der ein ich keit zu ä".split(), "fr": "eau tre eux la é ment ique oi".split()}


def text_in(lang, seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(n))


def test_kernel_matches_sets_of_grams():
    texts = [text_in("en", 1, 60), text_in("de", 2, 40), "Ab", "", "äé!"]
    sets = [li.gram_set(t.encode()) for t in texts]
    kernel = li.Kernel(sets[:2])
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    got = kernel.between(buf, offsets)
    for i, a in enumerate(sets):
        for j in (0, 1):
            both = len(set(a.tolist()) & set(sets[j].tolist()))
            assert abs(got[i, j] - (both / np.sqrt(len(a) * len(sets[j])) if len(a) else 0)) < 1e-5


def test_many_landmarks_are_measured_in_blocks(monkeypatch):
    texts = [text_in(g, i, 20) for g in SYLLABLES for i in range(5)]
    kernel = li.Kernel([li.gram_set(t.encode()) for t in texts])
    buf, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    whole = kernel.between(buf, offsets)
    monkeypatch.setattr(li, "_MARKS", 4)
    monkeypatch.setattr(li, "_DOCS", 3)
    assert np.allclose(kernel.between(buf, offsets), whole) and np.allclose(np.diag(whole), 1)


def test_held_out_accuracy_and_defined_cases(spark, documents):
    r = random.Random(4)
    rows = [(i, text_in(g := r.choice(list(SYLLABLES)), i, r.randint(3, 80)), g) for i in range(400)]
    truth = {i: g for i, _, g in rows}
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !?", "en"), (None, text_in("fr", 9, 30), None), (903, text_in("de", 8, 30), None), (5, "", None), (904, "x" * 100_000, None)]
    got = li.identify(documents(rows)).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    assert all(g.held_out == (zlib.crc32(("" if g.doc_id is None else str(g.doc_id)).encode()) % 4 == 2) for g in got)
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert sum(g.lang_pred == truth[g.doc_id] for g in held) >= 0.98 * len(held) and len(held) > 60
    by = {g.doc_id: g for g in got if g.doc_id != 5}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0 and by[None].lang_pred == "fr" and by[903].lang_pred == "de"
    assert li.identify(documents([])).count() == 0
    assert {g.lang_pred for g in li.identify(documents([(1, "some text", None)])).collect()} == {"und"}


def plain(text):
    """The n-grams of a text as a set of bytes."""
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return {b[i : i + n] for n in range(1, li.LONGEST + 1) for i in range(len(b) - n + 1)}


def test_whole_result_is_that_of_a_dense_plain_version(spark, documents):
    r = random.Random(8)
    rows = [(i, text_in(g := r.choice(list(SYLLABLES)), i, r.randint(1, 60)), g) for i in range(240)]
    rows += [(300 + i, rows[i][1], "en") for i in range(20)]
    rows += [(400, "Größe 12 à 3.5 % der", None), (401, "ĸĸĸĸ", None), (402, None, "en"), (403, text_in("de", 5, 20_000), None)]
    docs = documents(rows)
    hashed = docs.select("doc_id", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)).alias("h"))
    spread = {x.doc_id: x.h for x in hashed.collect()}
    train = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 != 2 and x[1] is not None and x[2] is not None]
    langs = sorted({x[2] for x in train})
    size = {g: sum(x[2] == g for x in train) for g in langs}
    assert all(n < li.SAMPLE for n in size.values())
    marks = [plain(x[1]) for x in train if spread[x[0]] < (1 << 30) / size[x[2]] * li.LANDMARKS]
    assert len(marks) > 30

    def kernel(texts):
        return np.array([[len(a & b) / max(1, len(a) * len(b)) ** 0.5 for b in marks] for a in texts])

    k = kernel([plain(x[1]) for x in train])
    target = np.array([[x[2] == g for g in langs] for x in train], float)
    ridge = li.RIDGE * len(train) * kernel(marks) + 1e-9 * len(train) * np.eye(len(marks))
    weights = np.linalg.solve(k.T @ k + ridge, k.T @ target)
    value = kernel([plain(x[1] or "") for x in rows]) @ weights
    want = {x[0]: ("und", 0.0) if x[1] is None else (langs[v.argmax()], min(1, max(0, v.max()))) for x, v in zip(rows, value, strict=True)}
    clashing = docs.withColumns({"held_out": F.lit("x"), "score": F.lit("x"), "key": F.lit(1), "terms": F.lit(1), "h": F.lit(1)})
    got = {x.doc_id: (x.lang_pred, x.score) for x in li.identify(clashing).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-3 for i in want)
    assert got[401] == (langs[0], 0.0)
