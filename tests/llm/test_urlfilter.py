import itertools
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sparktoire.llm import urlfilter as uf
from sparktoire.llm.lookup import looked_up

#: A word beyond the letters that hosts and words are joined on.
LONG = "donaudampfschifffahrtsgesellschaft"
SCHEMA = "page_id long, url string, html string"


def test_parsing_and_rules(spark):
    cases = [
        ("http://A.Com/x?y#z", "a.com", "/x", "com/", "allow"), ("https://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("https://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"), ("http://x.net/en/1", "x.net", "/en/1", None, None), ("http://xcom/", "xcom", "/", None, None),
        ("http://a.com", "a.com", "", None, None), ("http://a.com?q=/x", "a.com", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None),
        ("://h/p", "h", "/p", None, None), ("x://y://z/w", "y:", "//z/w", None, None), ("http://com/", "com", "/", "com/", "allow"), ("http://ÄB.net/fr/", "Äb.net", "/fr/", "net/fr/", "block"),
    ]
    pages = spark.createDataFrame([(i, c[0], "<p>the word</p>") for i, c in enumerate(cases)] + [(None, None, None)], SCHEMA)
    got = {r.page_id: r for r in uf.judged(pages).collect()}
    assert len(got) == len(cases) + 1 and got[None].verdict in ("allow", "block")
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (r.verdict == verdict if verdict else r.verdict in ("allow", "block"))
    assert uf.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_segmenter_finds_the_best_of_all_splits():
    r = random.Random(3)
    seg = uf.Segmenter({"the": 90, "th": 30, "e": 4, "ring": 20, "tion": 50, "sh": 40, "thering": 3, "a": 10})
    for _ in range(150):
        name = "".join(r.choices(["the", "th", "ring", "x", "sh", "e"], k=r.randint(1, 4)))[:11]
        splits = ([name[i:j] for i, j in itertools.pairwise([0, *cut, len(name)])] for k in range(len(name)) for cut in itertools.combinations(range(1, len(name)), k))
        best = max(sum(map(seg.score, s)) for s in splits if all(len(w) <= seg.longest for w in s))
        assert math.isclose(sum(map(seg.score, seg.split(name))), best) and "".join(seg.split(name)) == name
    assert seg.split("") == []


def brute(rows, learned):
    """Verdicts of the rules and of a plain model in dictionaries; ``learned``: the ids learned from."""
    known, counts, seen = {"com", "net", "example", "www"}, Counter(), {0: Counter(), 1: Counter()}
    for _, _, html in rows:
        counts.update(re.findall(r"[^\W\d_]+", re.sub("<[^>]*>", " ", html or "").lower()))
    segmenter = uf.Segmenter(counts)

    def rule(host, path):
        fits = [(len(h + p), v, h + p) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    def tokens(host, path):
        found = ["." + w for part in re.split(r"[.\-:@]+", host) if part and part not in known for w in segmenter.split(part)]
        return found + ["/0" if t.isdigit() else "/" + t for t in re.findall(r"[^\W\d_]+|[0-9]+", path.lower())]

    split, classes = [], Counter()
    for i, url, _ in rows:
        m = re.search("://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        verdict, name = rule(host, path)
        split.append((i, host, path, name, verdict, tokens(host, path)))
        if verdict and i in learned:
            classes[verdict == "block"] += 1
            seen[verdict == "block"].update(split[-1][-1])
    vocabulary = set(seen[0]) | set(seen[1])
    below = [sum(seen[k].values()) + len(vocabulary) + 1 for k in (0, 1)]
    out = []
    for i, host, path, name, verdict, t in split:
        score = [math.log(classes[k] + 1) + sum(math.log((seen[k][x] + 1) / below[k]) for x in t) for k in (0, 1)]
        out.append((i, host, path, name, verdict, "block" if score[1] > score[0] + 1e-9 else "allow"))
    return sorted(out, key=repr)


def pages_of(prose, seed, n):
    r = random.Random(seed)
    words = ["cheap", "pills", "news", "garden", "spam", "farm", "blog", "river"]
    rows = []
    for i in range(n):
        bad = r.random() < 0.4
        host = "".join(r.choices(words[:2] + words[4:6] if bad else words, k=r.randint(1, 3)))
        rows.append((i, f"https://{r.choice(['www.', 'm.', '', 'blog-'])}{host}.example.{r.choice(['com', 'net', 'org'])}/{'en' if bad and r.random() < 0.9 else r.choice(['es', 'fr', 'de', 'en'])}/{r.randrange(50)}{r.choice(['', '/buy-now.html', '?q=x'])}", f"<p class='x'>{' '.join(r.choices(words, k=20))} {prose(i, 5)}</p>"))
    return rows


def test_matches_a_plain_model(spark, prose):
    rows = pages_of(prose, 5, 250)
    rows += [(900, None, None), (901, "no scheme", "words"), (902, "http://", ""), (903, "http://x.org/" + "long/" * 3000, "<b>long"), (904, "http://" + "riverpills" * 300 + ".org/", None), (905, "http://h.org:80/12/é", "é"), (906, "http://" + "qx" * 300 + ".org/", "qx" * 300), (907, "http://" + "qx" * 299 + "river.net/", None), (908, f"http://blog{LONG}river{LONG}.com/en/", f"{LONG} {LONG[:-1]}z {LONG[:24]}"), (3, *rows[7][1:]), (3, *rows[7][1:])]
    learned = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5}
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "'x' AS host", "2 AS block", "'y' AS token")
    got = uf.scored(pages, learn=F.crc32(F.col("page_id").cast("string")) % 5 != 0).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute(rows, learned)
    assert sorted((tuple(x) for x in uf.judged(pages).collect()), key=repr) == sorted(((i, h, p, n, v or g) for i, h, p, n, v, g in brute(rows, {i for i, *_ in rows})), key=repr)


def test_learned_words_decide_pages_of_unknown_hosts(spark, prose):
    """Held-out pages that rules decide: the model has no part of the rules' hosts."""
    rows = pages_of(prose, 9, 1500)
    got = [x for x in uf.scored(spark.createDataFrame(rows, SCHEMA), learn=F.crc32(F.col("page_id").cast("string")) % 5 != 0).collect() if x.ruled and zlib.crc32(str(x.page_id).encode()) % 5 == 0]
    most = max(sum(x.ruled == v for x in got) for v in ("allow", "block"))
    assert len(got) > 100 and sum(x.ruled == x.guess for x in got) > 0.75 * len(got) > most * 0.9


def test_hot_keys_are_joined_apart(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("key"))
    right = spark.range(0, 5000, 2).select(F.col("id").cast("string").alias("key"), (F.col("id") * 2).alias("value")).union(spark.createDataFrame([("hot", -1)], "key string, value long"))
    for how in ("inner", "left"):
        assert sorted(map(repr, looked_up(left, right, "key", how).collect())) == sorted(map(repr, left.join(right, "key", how).collect()))


def test_words_of_any_length_are_found_in_hosts(spark):
    words = ["river", LONG, LONG[:24], LONG[:25], "a" * 5000, "a" * 24, "b"]
    hosts = [f"x{LONG}-river.b", "a" * 5000 + ".river", "a" * 23, LONG[:24], "", "..."]
    counts = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = uf.host_words(spark.createDataFrame([(h,) for h in hosts], "host string"), counts).collect()
    segmenter = uf.Segmenter({w: i + 1 for i, w in enumerate(words)})
    want = [(h, "." + w) for h in hosts for part in uf.parts_of(h) for w in segmenter.split(part)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert (hosts[0], "." + LONG) in want and (hosts[1], "." + "a" * 5000) in want
