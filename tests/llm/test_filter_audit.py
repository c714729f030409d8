"""The replay against a plain one, document by document and order by order."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from sparktoire.llm import filter_audit


def failures(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first.get(t, i)}
        out.append({k for k, v in fails.items() if v})
    return out


def replay(rows, labels):
    """``{(part, order, step): counts}``."""
    out, parts = {}, {s or "" for *_, s in rows}
    for p in parts:
        for order in permutations("ABCDE"):
            for k in range(5):
                out[p, "".join(order), k + 1] = [0] * 6
    for (i, _, s), fails in zip(rows, failures(rows), strict=True):
        good, toxic = (any(a == i and i is not None and x[n] == 1 for a, *x in labels) for n in (0, 1))
        for order in permutations("ABCDE"):
            gone = next((k for k, c in enumerate(order) if c in fails), 5)
            for k, c in enumerate(order):
                row = out[s or "", "".join(order), k + 1]
                for j, v in enumerate((gone > k, gone == k, c in fails and gone < k, fails == {c}, gone == k and good, gone == k and toxic)):
                    row[j] += v
    total = Counter()
    for (p, order, step), row in out.items():
        total[p, order[step - 1]] += row[1]
    return {(p, o, k): (*row, total[p, o[k - 1]]) for (p, o, k), row in out.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


LABELS = "doc_id long, quality int, toxic int"


def got(df):
    rows = df.collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_equals_a_plain_replay(spark, prose):
    texts = [prose(1, 250), prose(2, 300) + " Rate: 5 %", prose(3, 40), "a b " * 150, prose(4, 230).upper(), "", None, "AB CD", prose(5, 3000), " \x0b".join(["x", "y"] * 200), "ÄÖ é\x85 x"]
    rows = [(i, t, ["s", "t", None][i % 3]) for i, t in enumerate(texts * 3)]
    rows += [(5, texts[0], "s"), (5, texts[0], "s"), (None, texts[0], "t"), (None, texts[0], "t"), (-4, texts[1], ""), (1 << 62, texts[3], "s")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 30, 2)] + [(2, 1, 0), (None, 1, 1), (4, None, None), (99, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs = table(spark, rows).withColumns({"copy": F.lit("x"), "digest": F.lit(1), "part": F.lit(2), "failed": F.lit(0), "step": F.lit(9), "quality": F.lit(1)})
    assert got(filter_audit.filter_audit(docs, spark.createDataFrame(labels, LABELS).withColumn("part", F.lit("q")))) == replay(rows, labels)


def test_empty_tables(spark, prose):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(table(spark, []), none).count() == 0
    rows = [(1, prose(1, 250), None)]
    assert got(filter_audit.filter_audit(table(spark, rows), none)) == replay(rows, [])


def test_a_third_of_all_rows_in_one_text_and_a_very_long_one(spark, prose):
    rows = [(i, "same words here" if i % 3 == 0 else f"{i} words", "hot" if i % 2 else "cold") for i in range(3000)] + [(5000, prose(9, 200_000), "hot")]
    x = got(filter_audit.filter_audit(table(spark, rows), spark.createDataFrame([(3, 1, 1)], LABELS)))
    want = Counter()
    for (_, _, s), fails in zip(rows, failures(rows), strict=True):
        want[s, "E" in fails] += 1
    assert {s: x[s, "EABCD", 1][1] for s in ("hot", "cold")} == {s: want[s, True] for s in ("hot", "cold")}
    assert x["hot", "EABCD", 1][0] == want["hot", False]
