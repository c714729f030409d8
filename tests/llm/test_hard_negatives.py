"""The tree's search against brute force in whole numbers."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktoire.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    """Sorted ``(anchor, positive, rank, negative, positive score, negative score)``."""
    kept = []
    for i, v, c in rows:
        if c is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], (c + 1) % 10 if i is not None and i % 7 == 0 else c))
    out = []
    for a, (i, q, c) in enumerate(kept):
        if i is None or i % 50:
            continue
        s = [(-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(q, v, strict=False)))), j is None, j or 0, b, d) for b, (j, v, d) in enumerate(kept) if b != a]
        for p in sorted(x for x in s if x[4] == c)[:5]:
            fit = sorted(x for x in s if x[4] != c and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0])[:3]
            out += [(i, kept[p[3]][0], r + 1, kept[n[3]][0], -p[0], -n[0]) for r, n in enumerate(fit)]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def clustered():
    """2,000 rows around 12 centres, with ties: a fifth of the vectors are exact copies."""
    r = random.Random(5)
    centres = [[r.gauss(0, 0.4) for _ in range(8)] for _ in range(12)]
    rows, seen = [], []
    for i in range(2000):
        v = r.choice(seen) if seen and r.random() < 0.2 else [c + r.gauss(0, 0.1) for c in centres[i % 12]]
        seen.append(v)
        rows.append((i, v, r.randrange(10) if i % 3 else i % 12 % 10))
    return rows


def test_equals_brute_force(spark, clustered):
    df = spark.createDataFrame(clustered, SCHEMA).withColumns({"row": F.lit("x"), "vector": F.lit(1), "score": F.lit(2), "block": F.lit(3), "rank": F.lit(4)})
    want = brute(clustered)
    assert len(want) > 400 and got(H.hard_negatives(df.repartition(5), block=150, leaf=16)) == want


def test_a_third_of_all_rows_equal(spark):
    r = random.Random(6)
    hot = [0.5, -0.25, 0.75]
    rows = [(i, hot if i % 3 == 0 else [r.uniform(-1, 1) for _ in range(3)], i % 4) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = H.Index.of(H.usable(df), block=60, leaf=8)
    assert max(x["n"] for x in index.blocks.select("n").collect()) < 150  # a cell of copies is cut too
    assert got(H.hard_negatives(df, block=60, leaf=8)) == brute(rows)


def test_odd_rows(spark):
    r = random.Random(7)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)], r.randrange(3)) for i in range(1, 260)]
    rows += [(0, [0.5, 0.5], 1), (50, [0.5, None, 0.1, 0.2], 1), (100, [float("nan")] * 4, 1), (150, [float("inf"), 0.0, 0.0, 0.0], 2), (200, None, 1), (250, [0.1] * 4, None), (300, [], 1), (None, [0.9] * 4, 1), (None, [0.9] * 4, 2), (350, [0.5] * 4, -1), (400, [0.5] * 5, 1), (400, [0.5] * 5, 1), (-50, [0.4] * 4, 9), (-49, [0.4] * 4, 9)]
    assert got(H.hard_negatives(spark.createDataFrame(rows, SCHEMA), block=40, leaf=4)) == brute(rows)


def test_numbers_beyond_doubles_and_64_bits(spark):
    rows = [(i, [1e5 * (i % 5), 3.3e4 + i, -2.2e5], i % 2) for i in range(60)] + [(100, [1e30, 1.0, 2.0], 0), (101, [1e29, 1.0, 2.0], 0), (102, [7e28, 1.0, 2.0], 1)]
    assert got(H.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_and_tiny_tables(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (50, [1.0], 1)], [(0, None, 1)]):
        assert got(H.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nodes_outside_the_annulus_stay_closed():
    """On well separated clusters a search opens a small part of the leaves, and finds the same rows."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(40, 1, 6)) * 3 + rng.normal(size=(40, 50, 6)) * 0.05).reshape(-1, 6))
    most = float((x * x).sum(1).max())
    tree, order = H.grown(x, most, 10)
    block = H.Block(tree, x[order], list(range(len(x))), np.arange(len(x)), np.zeros(len(x), int))
    opened = []
    q = x[77]
    s = np.sort((x @ q).astype(int))[::-1]
    least, largest = H.bounds(tree, q[None])
    rows = block.nearest_first(q, most, least[0], largest[0], [(int(s[400]), int(s[200]))], 3, lambda r: opened.append(r) or np.ones(r.stop - r.start, bool))
    found = [v for v, _ in itertools.islice(rows, 3)]
    assert found == s[np.searchsorted(-s, -s[200]) :][:3].tolist() and len(opened) < 0.4 * (tree.child[:, 0] < 0).sum()
