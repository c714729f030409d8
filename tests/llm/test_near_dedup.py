import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparktoire.llm import near_dedup as nd


def brute(rows, similarity=0.8):
    """Classes over all pairs."""
    texts = [re.findall(r"[^ \t\n\x0b\f\r]+", t or "") for _, t in rows]
    n = len(rows)
    counts = [Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])) for w in texts]
    df = Counter(s for c in counts for s in c)
    sets = [{s: k * (1 + round(255 * math.log(n / df[s]) / math.log(n)) / 255) for s, k in c.items()} for c in counts]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "") or rows[i][0] == rows[j][0] is not None
            if not same and sets[i] and sets[j]:
                low = sum(min(v, sets[j].get(s, 0)) for s, v in sets[i].items())
                same = low / (sum(sets[i].values()) + sum(sets[j].values()) - low) >= similarity
            if same:
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), math.inf), math.inf if rows[i][0] is None else rows[i][0])
    return sorted({(rows[i][0], None if least[find(i)] == math.inf else least[find(i)]) for i in range(n)}, key=repr)


def edited(r, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_matches_brute_force(spark, documents, prose):
    r = random.Random(8)
    rows = [(i, prose(i, r.randint(0, 200))) for i in range(40)]
    origin = prose(1000, 250)
    rows += [(100 + i, edited(r, origin, r.randint(1, 2))) for i in range(40)]  # a group above SMALL
    for i in range(60):
        source = rows[r.randrange(40)][1] or "a b"
        rows.append((200 + i, edited(r, source, r.choice([0, 0, 1, 2, 30]))))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "one  two"), (305, rows[3][1]), (3, rows[3][1])]
    rows += [(4, rows[90][1]), (4, prose(77, 90)), (306, prose(77, 90)), (None, rows[5][1]), (None, prose(78, 30)), (None, prose(79, 30)), (307, edited(r, prose(80, 900), 5)), (308, prose(80, 900))]
    got = nd.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    assert sorted({(x.doc_id, x.class_id) for x in got}, key=repr) == brute(rows)


def test_samples_agree_as_often_as_weighted_jaccard():
    r = np.random.default_rng(2)
    shingle = r.integers(0, 1 << 63, 500, dtype=np.uint64)
    agreed, expected = [], []
    for k in range(60):
        w = r.uniform(1, 6, 500)
        v = np.where(r.random(500) < 0.8, w, w * 2)
        mine = nd.samples(shingle ^ np.uint64(k * 7919), w, np.array([0, 500]))
        other = nd.samples(shingle ^ np.uint64(k * 7919), v, np.array([0, 500]))
        agreed.append((mine == other).mean())
        expected.append(np.minimum(w, v).sum() / np.maximum(w, v).sum())
    assert abs(np.mean(agreed) - np.mean(expected)) < 0.03


def test_nulls_empty_table_and_classes(spark, documents):
    assert nd.near_duplicates(documents([])).count() == 0
    got = {(x.doc_id, x.class_id) for x in nd.near_duplicates(documents([(None, "a b c"), (4, "a b c"), (5, None)])).collect()}
    assert got == {(None, 4), (4, 4), (5, 5)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 91)], "doc_id long, other_id long")
    labels = {x.node: x.label for x in nd.classes(chain).collect()}
    assert labels == {i: 0 for i in range(51)} | {90: 90, 91: 90}


def star(r, origin, n, words):
    """Variants that are like the original, but less so like each other: each with its own words changed."""
    out = []
    for _ in range(n):
        each = origin.split(" ")
        for at in r.sample(range(8, len(each) - 8), words):
            each[at] = f"new{r.randrange(10**6)}"
        out.append(" ".join(each))
    return out


def test_ids_of_any_size(spark, documents, prose):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    top = 1 << 62
    rows = [(top + 5, a), (top + 9, a), (top, b), ((1 << 63) - 1, b), ((1 << 63) - 1, prose(4, 60)), (-(1 << 63), c), (top - 1, c), (None, a), (None, prose(5, 60)), (top + 7, prose(6, 60)), (None, c)]
    got = sorted({(r.doc_id, r.class_id) for r in nd.near_duplicates(documents(rows)).collect()}, key=repr)
    assert got == brute(rows)
    kept = nd.representatives(documents(rows)).collect()
    assert len(kept) == 5 and all(r.doc_id is None or any(r.doc_id == i for i, _ in rows) for r in kept)


def test_large_group_of_variants_like_the_original_only(spark, documents, prose):
    r = random.Random(4)
    rows = []
    for k in range(4):
        origin = prose(2000 + k, 260).replace("\n", "")
        rows += [(1000 * k + i, t) for i, t in enumerate([*star(r, origin, 60, 4), origin])]
    expected = brute(rows)
    assert len({c for _, c in expected}) < 20
    assert sorted({(x.doc_id, x.class_id) for x in nd.near_duplicates(documents(rows)).collect()}, key=repr) == expected


def test_bridges_join_the_halves_of_groups_of_any_size(spark, documents, prose):
    r, rows = random.Random(6), []
    for k, n in enumerate([8, 17, 42, 42, 60, 120, 200]):
        words = prose(3000 + k, 150).replace("\n", "").split(" ")
        halves = [list(words), list(words)]
        for at in range(12):  # the halves differ in two runs of words, the bridge in one from either
            halves[0][20 + at], halves[1][110 + at] = f"left{at}", f"right{at}"
        texts = [edited(r, " ".join(halves[i % 2]), 1) for i in range(n)] + [" ".join(words)]
        rows += [(1000 * k + i, t) for i, t in enumerate(texts)]
    rows += [(9000 + i, prose(i, 80)) for i in range(200)]
    assert sorted({(x.doc_id, x.class_id) for x in nd.near_duplicates(documents(rows)).collect()}, key=repr) == brute(rows)


def test_representatives_are_one_of_each_class(spark, documents, prose):
    rows = [(1, prose(1, 60)), (1, prose(1, 60)), (2, prose(1, 60)), (None, prose(1, 60)), (None, prose(2, 60)), (None, prose(3, 60)), (5, None), (6, ""), (7, prose(4, 3000))]
    docs = documents(rows).selectExpr("*", "1 AS __other", "'x' AS __twice", "2 AS owner", "3 AS n_copies", "4 AS carried_0", "'y' AS class_id")
    got = nd.representatives(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=repr) == sorted([(1, prose(1, 60)), (None, prose(2, 60)), (None, prose(3, 60)), (5, None), (7, prose(4, 3000))], key=repr)
    assert nd.representatives(docs.limit(0)).count() == 0


def test_open_groups_meet_in_tiles_across_classes(spark):
    sample = bytes(range(nd.BANDS * nd.ROWS))
    members = spark.createDataFrame([(7, i, 0, sample) for i in range(3000)] + [(8, i, 0, sample) for i in (1, 2, 9)], nd.MEMBERS)
    labels = spark.createDataFrame([(i, 0 if i < 1700 else i) for i in range(3000)], "node long, label long")
    sizes = spark.createDataFrame([(i, 100) for i in range(3000)], "doc long, n_bytes long")
    large = nd.open_tiles(members, labels, sizes.withColumn("n_bytes", F.lit(nd.TILE_BYTES // 100)), 4)
    assert large.groupBy("key", "low", "high").count().agg({"count": "max"}).first()[0] < 300
    tiles, met = {}, set()
    for x in nd.open_tiles(members, labels, sizes, 4).collect():
        tiles.setdefault((x.key, x.low, x.high), []).append((x.block, x.doc))
    assert {k for k, *_ in tiles} == {7} and max(map(len, tiles.values())) < 2.3 * nd.TILE
    for (_, low, high), rows in tiles.items():
        a, b = ([d for k, d in rows if k == side] for side in (low, high))
        met |= {(i, j) for i in a for j in b if i < j} | {(j, i) for i in a for j in b if j < i}
    assert all((i, j) in met for j in range(1700, 3000) for i in range(j))


def test_further_links_merge_classes(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)], "node long, label long")
    links = spark.createDataFrame([(4, 2), (9, 4), (8, 7), (6, 5)], "doc_id long, other_id long")
    got = {x.node: x.label for x in nd.merged(labels, links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 5: 5, 6: 5, 7: 7, 8: 7}
