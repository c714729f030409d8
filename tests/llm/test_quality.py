import random
import re

import numpy as np

from sparktoire.llm import quality as q

WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def brute(text, repeat=q.REPEAT_WORDS):
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    longest = [max((k for j in range(n) if j != i for k in range(n - max(i, j) + 1) if w[i : i + k] == w[j : j + k]), default=0) for i in range(n)]
    cover = lambda least, size: len({i + k for i in range(n) if longest[i] >= least for k in range(size(i))})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    five, long = cover(5, lambda i: 5), cover(repeat, lambda i: longest[i])
    failed = n < 10 or 100 * five > 20 * n
    kept = not (failed or 100 * long > q.MAX_COVERED_PERCENT * n or max(longest, default=0) > q.MAX_LONGEST_WORDS)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), five, failed, long, max(longest, default=0), kept


def test_matches_brute_force(spark, documents, prose):
    r = random.Random(7)
    rows = [(i, prose(i, r.randint(0, 60))) for i in range(40)]
    rows += [(100 + i, "\n".join(prose(i, 14) for _ in range(r.randint(1, 4))) + prose(i + 50, r.randint(0, 80))) for i in range(20)]
    rows += [(200 + i, " ".join(r.choices(["a", "b"], k=r.randint(0, 50)))) for i in range(20)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "#*$ é\n\n#*$ é\r\n#*$ é\n"), (None, "null id"), (1, "again 1"), (304, "same " * 80), (305, "\n \n\n"), (306, "a\nb"), (307, "x\x0by\x0cz")]
    got = [tuple(g) for g in q.quality(documents(rows)).collect()]
    assert sorted(got, key=repr) == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert q.quality(documents([])).count() == 0


def test_longest_repeat_rejects_and_clean_text_stays(spark, documents, prose):
    passage = prose(5, 70)
    rows = [(1, prose(1, 1000)), (2, f"{prose(2, 500)} {passage} {prose(3, 500)} {passage} {prose(4, 500)}")]
    got = {r.doc_id: (r.base_failed, r.longest_repeat >= 70, r.kept) for r in q.quality(documents(rows)).collect()}
    assert got == {1: (False, False, True), 2: (False, True, False)}


def test_suffix_lcp_of_one_symbol():
    assert q.suffix_lcp(np.zeros(5, np.int64), np.array([0, 5])).tolist() == [4, 4, 3, 2, 1]
    assert q.suffix_lcp(np.zeros(4, np.int64), np.array([0, 2, 4])).tolist() == [1, 1, 1, 1]
