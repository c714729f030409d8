import random
import zlib

from sparktoire.llm import toxicity as tx


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(word, words, stems):
    best = 2
    for w in words:
        if (d := distance(word, w)) <= (len(w) >= tx.EDIT_LETTERS):
            best = min(best, d)
    for s in stems:
        for k in range(len(word) + 1):
            if (d := distance(word[:k], s)) <= (len(s) >= tx.EDIT_LETTERS):
                best = min(best, d)
    return best if best < 2 else -1


def test_automaton_matches_edit_distance():
    r = random.Random(1)
    words, stems = ["moron", "scum", "worthless", "abcab", "aaaaa"], ["lowei", "vequ"]
    automaton = tx.Automaton(words, stems)
    tried = [*words, *stems, "", "x"]
    for _ in range(4000):
        w = list(r.choice(words + stems) + r.choice(["", "", "ab", "x"]))
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randint(0, 1)] = r.choice(["", "a", "b", "o", "w"])
        tried.append("".join(w))
    for w in tried:
        assert automaton.edits_of(w) == brute(w, words, stems), w


def test_entries_near_a_word():
    r = random.Random(2)
    words, stems = ["moron", "morons", "scums", "abcab", "xmoron"], ["lowei", "lowex"]
    automaton = tx.Automaton(words, stems)
    for _ in range(3000):
        w = list(r.choice(words + stems) + r.choice(["", "", "ab", "x"]))
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randint(0, 1)] = r.choice(["", "a", "o", "x", "s"])
        w = "".join(w)
        single = {e: brute(w, [e] if e in words else [], [e] if e in stems else []) for e in words + stems}
        assert automaton.near(w) == ({e for e, d in single.items() if d == 1} if brute(w, words, stems) == 1 else set()), w


def test_lexicon_keeps_words_and_shortest_beginnings():
    assert tx.choose_lexicon(["moron", "loweia", "lo"], ["lowei", "loweibc"]) == (["lo", "moron"], ["lowei"])


def plain_terms(rows):
    """Words and stems by counting strings."""
    from collections import Counter

    counts = {0: Counter(), 1: Counter()}
    for text, toxic in rows:
        words = {w.strip(tx._EDGE) for w in tx.words_of(text)} - {""}
        counts[toxic].update({(w, True) for w in words} | {(w[:k], False) for w in words for k in range(tx.STEM_LETTERS, len(w))})
    total = Counter(t for _, t in rows)
    good = {t for t, n in counts[1].items() if n >= tx.LEAST_DOCS and (n + 0.5) / (total[1] + 1) / ((counts[0][t] + 0.5) / (total[0] + 1)) >= tx.LEAST_ODDS}
    branches = Counter(t[:-1] for t in {t for t, _ in good})
    return tx.choose_lexicon([t for t, whole in good if whole], [t for t in {t for t, _ in good} if len(t) >= tx.STEM_LETTERS and branches[t] >= tx.STEM_BRANCHES])


def test_terms_of_any_length(spark, prose):
    """Two-letter words, stems of twenty letters, and words of 50,000 letters."""
    from pyspark.sql import functions as F

    r = random.Random(8)
    stem, long = "abcdefghijklmnopqrst", "z" * 50_000
    rows = [(prose(i, 30) + " " + r.choice(["", "a qu"]), 0) for i in range(300)]
    rows += [(f"{prose(1000 + i, 20)} {r.choice(['xq', 'XQ!'])} {stem}{r.choice('uvwx')} {long if i < 8 else 'y'}", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    odds = (F.col("toxic") + 0.5) / 61 / ((F.col("clean") + 0.5) / 301)
    words, stems = tx._lexicon(df, odds)
    short = [(t.replace(long, "z" * 60), y) for t, y in rows]
    want = plain_terms(short)
    assert ([w.replace(long, "z" * 60) for w in words], stems) == want
    assert "xq" in words and long in words and stem in stems


def test_quotation_scores_lower_than_abuse():
    scorer = tx.Scorer(["moron"], [])
    abuse, quoted, reported = (scorer.features(t) for t in ("you are a moron and more", 'the "moron" remark', "he said moron again"))
    assert abuse[1] > 0 and abuse[3] == 0 and quoted[1] == 0 and quoted[3] > 0 and reported[3] > 0
    assert scorer.features("you m0ron")[2] > 0 and scorer.features("") == [1, 0, 0, 0, 0, 0]


def test_held_out_documents(spark, documents, prose):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        text, toxic = prose(i, r.randint(5, 60)), int(r.random() < 0.3)
        if toxic:
            words = text.split(" ")
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["moron", "worthless", "scum"]) if r.random() < 0.8 else "worthles")
            text = " ".join(words)
        rows.append((i, text))
        if r.random() < 0.9:
            labels.append((i, 1, toxic))
    rows += [(900, None), (901, ""), (None, "moron moron"), (3, "again"), (902, "x" * 100_000)]
    table = spark.createDataFrame([*labels, (None, None, None), (5, None, None)], "doc_id long, quality int, toxic int")
    got = tx.toxicity(documents(rows), table).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)
    truth = {i: t for i, _, t in labels}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id if g.doc_id is not None else "").encode()) % 5 == 0) for g in got)
    assert sum(g.predicted == truth[g.doc_id] for g in held) >= 0.97 * len(held) and len(held) > 50
    assert tx.toxicity(documents([]), table).count() == 0
    assert tx.toxicity(documents(rows[:3]), table.limit(0)).count() == 3
