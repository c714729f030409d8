import random
import re

from sparktoire.llm import decontaminate as dc


def brute(docs, items, percent=80):
    def sets(rows):
        out = {}
        for i, t in rows:
            w = re.findall(r"[^ \t\n\x0b\f\r]+", t or "")
            s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            out.setdefault(i, set()).update(s)
        return {i: s for i, s in out.items() if s}

    d, q = sets(docs), sets(items)
    return sorted(((a, b, len(s & t), len(t)) for a, s in d.items() for b, t in q.items() if len(s & t) * 100 >= percent * len(t)), key=repr)


def found(spark, docs, items):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in dc.contained(a, b).collect()), key=repr)


def test_matches_brute_force(spark, prose):
    r = random.Random(4)
    items = [(i, prose(5000 + i, r.randint(3, 50))) for i in range(30)] + [(90, None), (91, ""), (None, prose(7000, 20)), (92, "one two")]
    docs = [(i, prose(i, r.randint(0, 200))) for i in range(60)]
    for i in range(120):
        picked = [items[r.randrange(30)][1] for _ in range(r.choice([1, 1, 2, 6]))]
        if i % 3 == 0:
            words = picked[0].split(" ")
            words[r.randrange(len(words))] = "changed"
            picked[0] = " ".join(words)
        docs.append((100 + i, " ".join([prose(i, 30), *picked, prose(i + 1, 30)])))
    docs += [(400, " ".join(t for _, t in items[:30])), (401, None), (402, ""), (403, "one two"), (None, items[3][1]), (100, items[4][1])]
    got = found(spark, docs, items)
    assert got == brute(docs, items) and len(got) > 100


def test_many_items_in_one_document_and_empty_tables(spark, prose):
    items = [(i, prose(i, 12)) for i in range(400)]
    docs = [(1, " ".join(t for _, t in items))]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_bands_find_the_pairs_and_shingles_only_what_bands_would_miss(spark, prose):
    items = [(i, prose(3000 + i, 30)) for i in range(40)]
    docs = [(i, f"{prose(i, 300)} {items[i][1]} {prose(i + 500, 300)}") for i in range(40)]
    docs.append((100, " ".join(t for _, t in items)))
    got = dc.candidates(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    by_band, exact = ({(x.doc_id, x.item_id) for x in got if (x.width == dc.EXACT) == e} for e in (False, True))
    assert {(i, i) for i in range(40)} <= by_band and {d for d, _ in exact} == {100} == {d for d, _ in exact - by_band}
    assert found(spark, docs, items) == brute(docs, items)


def test_shingles_in_many_items_and_documents(spark, prose):
    stock = prose(1, 9)
    items = [(i, f"{stock} {prose(100 + i, 12)}") for i in range(60)]
    docs = [(i, f"{prose(i, 20)} {stock} {prose(i, 20)} {items[i][1] if i % 7 == 0 else ''}") for i in range(60)] + [(99, " ".join(t for _, t in items))]
    assert found(spark, docs, items) == brute(docs, items)


def test_words_are_compared_not_their_hashes(spark, prose, monkeypatch):
    whole = dc.F.xxhash64
    monkeypatch.setattr(dc.F, "xxhash64", lambda *c: whole(*c) % 50)
    items = [(i, prose(10 + i, 20)) for i in range(5)]
    docs = [(i, prose(i, 40)) for i in range(20)] + [(50, items[2][1])]
    assert found(spark, docs, items) == brute(docs, items)


def test_decontaminated_keeps_clean_rows_and_columns(spark, prose):
    items = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose(1, 30), "x"), (2, prose(2, 30), "y"), (3, None, "z"), (None, "a b", "w")], "doc_id long, text string, item_id string").selectExpr("*", "1 AS __leak", "2 AS leak", "3 AS own", "4 AS row")
    assert sorted(dc.decontaminated(docs, items).collect(), key=repr) == sorted([(2, prose(2, 30), "y", 1, 2, 3, 4), (3, None, "z", 1, 2, 3, 4), (None, "a b", "w", 1, 2, 3, 4)], key=repr)
