import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from sparktoire.llm import suffix_dedup as sd


def brute(rows, length=50):
    key = lambda i: (i is None, i)
    texts = [((t or "").encode(), i) for i, t in rows]
    least = {}
    for b, i in texts:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            least[w] = min(least.get(w, key(i)), key(i))
    out = []
    for b, i in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < key(i):
                gone[k : k + length] = [True] * length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha256(rest).hexdigest()))
    return sorted(out, key=lambda r: (key(r[0]), r))


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=lambda r: ((r[0] is None, r[0]), r))


@pytest.mark.parametrize("alphabet", ["ab", "a", "abcdefgh \n", "\x00é"])
def test_two_stage_sort_orders_by_56_bytes(alphabet):
    r = random.Random(5)
    for n in (0, 1, 2, 7, 300, 2000):
        text = np.frombuffer("".join(r.choices(alphabet, k=n)).encode(), np.uint8)
        order = sd.two_stage_sort(text)
        assert sorted(order) == list(range(len(text)))
        keys = [(text[i : i + 56].tobytes() + b"\0" * 56)[:56] for i in order]
        assert keys == sorted(keys)


def test_matches_brute_force(spark, documents, prose):
    r = random.Random(3)
    passage = prose(99, 30)
    rows = []
    for i in range(60):
        text = prose(i, r.randint(0, 60))
        if i % 3 == 0:
            text += passage + prose(i + 500, 5)
        if i % 5 == 0 and rows:
            text = rows[r.randrange(len(rows))][1] or ""
            words = text.split(" ")
            words[r.randrange(len(words))] = "Edit"
            text = " ".join(words)
        rows.append((i * 7 % 61, text))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (101, rows[3][1]), (7, rows[3][1]), (102, None), (103, ""), (None, rows[0][1]), (None, None), (104, "x" * 49), (105, "x" * 50), (106, "y" * 500), (107, "y" * 120), (108, passage), (109, "é" * 60), (110, "aé" + "é" * 59)]
    assert result(sd.substring_dedup(documents(rows))) == brute(rows)


def test_empty_table_and_text_output(spark, documents, prose):
    assert sd.substring_dedup(documents([])).count() == 0
    a = prose(1, 40)
    got = {r.doc_id: r.text for r in sd.cleaned(documents([(1, a), (2, "new " + a), (3, a)])).collect()}
    assert got == {1: a, 2: "new ", 3: ""}


def test_collapse_of_a_second_chunk(spark, documents, prose):
    """Chunks after the first of a batch have offsets that don't begin at 0."""
    big = prose(1, 20_000) * 60
    rows = [(1, big), (2, big + "x" * 60), (3, prose(2, 50)), (4, big), (5, prose(2, 50))]
    got = {r.doc_id: (r.n_removed, r.n_bytes) for r in sd.substring_dedup(documents(rows).coalesce(1)).collect()}
    n = len(big.encode())
    assert len(big.encode()) > 5 << 20 and got[4] == (n, n) and got[5][0] == got[5][1] and got[3][0] == 0 and got[1] == (0, n)
    assert got[2][0] == n


def test_ids_of_any_size(spark, documents, prose):
    a, b = prose(1, 40), prose(2, 40)
    rows = [((1 << 63) - 1, a), ((1 << 63) - 2, a + b), (1 << 62, b), (-(1 << 63), b[:120]), (None, prose(3, 40)), ((1 << 63) - 1, prose(4, 9))]
    assert result(sd.substring_dedup(documents(rows))) == brute(rows)
    assert sorted(r.doc_id for r in sd.cleaned(documents(rows)).collect() if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None)


def _snippets(texts):
    """The snippets of one bucket, whose keys nobody else has."""
    table = pa.table({"bucket": pa.array([0] * len(texts), pa.int32()), "doc_id": pa.array(range(len(texts))), "text": texts})
    out = sd.send_snippets(1)(table, pa.table({"low": pa.array([], pa.binary())}))
    return out.filter(pa.array([b == 0 for b in out["bucket"].to_pylist()]))


def test_a_common_word_is_no_reason_to_sort(prose, monkeypatch):
    """Snippets that have only their anchor in common with others aren't sorted; those with a window in common are."""
    sorted_bytes = []
    sort = sd.two_stage_sort
    monkeypatch.setattr(sd, "two_stage_sort", lambda text: sorted_bytes.append(len(text)) or sort(text))
    texts = [prose(2 * i, 12)[:60] + "an often used phrase" + prose(2 * i + 1, 12)[:60] for i in range(200)]
    found = sd.compare_snippets(_snippets(texts))
    whole = sum(len(x.as_buffer()) for x in _snippets(texts)["data"].combine_chunks())
    assert whole > 5000 and sum(sorted_bytes) < whole / 20
    assert not sum(len(x.as_buffer()) for x in found["start"].combine_chunks())
    sorted_bytes.clear()
    found = sd.compare_snippets(_snippets([*texts, "new" + texts[7][40:100] + "end"]))
    assert sum(sorted_bytes) and sum(len(x.as_buffer()) for x in found["start"].combine_chunks())


def test_promising_parts_hold_every_common_window():
    r = random.Random(11)
    texts = list({"".join(r.choices("ab", k=r.randint(0, 20))) + r.choice(["x" * 70, "abcdefgh" * 8, "q" * 34 + "z" * 30]) + "".join(r.choices("ab", k=r.randint(0, 30))) for _ in range(80)})
    table = _snippets(texts)
    whole = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[c].combine_chunks()])
    data, size, place = whole("data", np.uint8), whole("size", np.int32).astype(np.int64), whole("place", np.int32).astype(np.int64)
    begin = np.append(0, np.cumsum(size))[:-1]
    different = np.array(list({data[b : b + n].tobytes(): i for i, (b, n) in enumerate(zip(begin, size, strict=True))}.values()))
    begin, size, place = begin[different], size[different], place[different]
    holders = {}
    for i, (b, n) in enumerate(zip(begin, size, strict=True)):
        for k in range(n - sd.LENGTH + 1):
            holders.setdefault(data[b + k : b + k + sd.LENGTH].tobytes(), set()).add((i, k))
    common = {x for v in holders.values() if len({i for i, _ in v}) > 1 for x in v}
    kept = {(int(i), k) for i, a, n in zip(*sd.promising(data, begin, size, place), strict=True) for k in range(a, a + n - sd.LENGTH + 1)}
    assert common and common <= kept


@pytest.mark.parametrize("size", [60, 5000, 200_000])
def test_anchors_of_equal_windows_are_equal(size):
    """Wherever a passage stands, and in a buffer of any length, its inner windows have the same anchors."""
    passage = np.frombuffer(random.Random(2).randbytes(400), np.uint8)
    alone = np.concatenate([passage, np.zeros(100, np.uint8)])
    there = np.concatenate([np.frombuffer(random.Random(size).randbytes(size), np.uint8), passage])
    found = []
    for buf, at in ((alone, 0), (there, size)):
        key, start, count, place = sd.anchors(buf, np.array([0, len(buf)]))
        found.append({int(s + j) - at: (int(k), int(s + p) - at) for k, s, n, p in zip(key, start, count, place, strict=True) for j in range(n) if 0 <= s + j - at <= 350})
    assert found[0] == found[1] and len(found[0]) == 351
