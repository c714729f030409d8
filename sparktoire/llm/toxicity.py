"""Toxicity: Levenshtein automata run over a lexicon trie, with the context of each hit.

The lexicon is learned from a bounded sample of labelled documents: words that are in
``LEAST_DOCS`` toxic documents at least and far likelier there than in clean ones (``LEAST_ODDS``),
and stems, that is common beginnings of four letters or more that go on with three letters at least. Some
clean documents may have an entry, such as in quotations: what that means the fitted weights say.
All entries stand in a trie. The automaton that accepts what is within one edit of an entry (none below ``EDIT_LETTERS``
letters, nor where clean documents come as near) is the product of the trie and the edits; its deterministic states are built as words need
them, so a word costs one look-up per letter up to where no entry can follow.

A hit in quotation marks, or within ``WINDOW`` words of a word that reports speech, is a quotation.
A logistic model over the numbers of exact, misspelt and quoted hits gives the score. Its prior
holds where the sample shows nothing, such as for quotations.

Defined results: null and empty texts have no hits and get the score of a text without hits; a null
``doc_id`` is hashed as an empty string; repeated rows are scored one by one; without labels the
score is that of the prior; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sparktoire.llm.common import dropped, materialized

#: About so many labelled documents of each class are learned from.
SAMPLE = 6000
#: An entry that clean documents of the sample come near more often than this is matched exactly.
MOST_NEAR_MISSES = 2
LEAST_DOCS, LEAST_ODDS = 5, 40.0
STEM_LETTERS, STEM_BRANCHES, EDIT_LETTERS = 4, 3, 5
WINDOW = 6
CACHE_ENTRIES = 400_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Marks of quotation, and words that report what others said.
QUOTES = "\"“”„«»"
REPORTS = frozenset("said says wrote called quoted quote word term sagte schrieb nannte zitiert wort dit écrit appelé cité mot dijo escribió llamó citó palabra".split())
_EDGE = " \t.,;:!?()[]{}'’‘*#$%&<>|~^_-+=/\\" + QUOTES
_PRIOR = np.array([-3.0, 5.0, 5.0, 0.5, 0.3, 0.5])
_PRECISION = np.array([0.01, 0.3, 0.3, 1.0, 1.0, 0.3])


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Automaton:
    """All entries within their edits, as a deterministic automaton that grows as it is used."""

    def __init__(self, words: Iterable[str], stems: Iterable[str], exact: Iterable[str] = ()):
        exact = frozenset(exact)
        self.children: list[dict[str, int]] = [{}]
        self.edits: list[int] = [-1]  # most edits of the entry that ends at a node
        self.stem: list[bool] = [False]
        self.entry: dict[int, str] = {}
        for entry, is_stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            node = 0
            for ch in entry:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.edits.append(-1)
                    self.stem.append(False)
                node = self.children[node][ch]
            self.edits[node] = int(len(entry) >= EDIT_LETTERS and entry not in exact)
            self.stem[node] |= is_stem
            self.entry[node] = entry
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.end: list[int] = []  # edits of the best entry that ends here, or -1
        self.done: list[int] = []  # the same for stems, after which anything may follow
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        pairs = set(pairs)
        pairs |= {(child, 1) for node, e in pairs if e == 0 for child in self.children[node].values()}
        key = frozenset((node, e) for node, e in pairs if e == 0 or (node, 0) not in pairs)
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ends = [(e, self.stem[node]) for node, e in key if e <= self.edits[node]]
            self.end.append(min((e for e, _ in ends), default=-1))
            self.done.append(min((e for e, s in ends if s), default=-1))
        return self.number[key]

    def step(self, state: int, ch: str) -> int:
        pairs = set()
        for node, e in self.sets[state]:
            if ch in self.children[node]:
                pairs.add((self.children[node][ch], e))
            if e == 0:
                pairs.add((node, 1))
                pairs |= {(child, 1) for child in self.children[node].values()}
        self.next[state][ch] = to = self._state(pairs)
        return to

    def edits_of(self, word: str) -> int:
        """Edits between the word and its nearest entry, 0 or 1, or -1 if none is near enough."""
        state, best = self.start, 2
        for ch in word:
            to = self.next[state].get(ch)
            state = self.step(state, ch) if to is None else to
            if self.done[state] >= 0:
                best = min(best, self.done[state])
                if not best:
                    return 0
            if not self.sets[state]:
                break
        else:
            if self.end[state] >= 0:
                best = min(best, self.end[state])
        return best if best < 2 else -1


    def near(self, word: str) -> set[str]:
        """The entries that the word is one edit away from, if none is nearer."""
        if self.edits_of(word) != 1:
            return set()
        state, found = self.start, set()
        for i, ch in enumerate(word, 1):
            state = self.next[state][ch] if ch in self.next[state] else self.step(state, ch)
            found |= {self.entry[node] for node, e in self.sets[state] if e <= self.edits[node] and (self.stem[node] or i == len(word))}
        return found


def choose_lexicon(words: Iterable[str], stems: Iterable[str]) -> tuple[list[str], list[str]]:
    """``(words, stems)`` of those that no shorter stem begins."""
    found = set(stems)
    inner = lambda t, most: any(t[:k] in found for k in range(STEM_LETTERS, most))
    return sorted(w for w in set(words) if not inner(w, len(w) + 1)), sorted(t for t in found if not inner(t, len(t)))


class Scorer:
    """Counts the hits of a text; look-ups are remembered in a cache of two generations."""

    def __init__(self, words: list[str], stems: list[str], exact: Iterable[str] = ()):
        self.automaton = Automaton(words, stems, exact)
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def look(self, word: str) -> int:
        found = self.old.get(word)
        if found is None:
            found = self.automaton.edits_of(word.strip(_EDGE))
        if len(word) <= 40:
            self.new[word] = found
        return found

    def features(self, text: str) -> list[float]:
        """``[1, exact, misspelt, quoted exact, quoted misspelt, all]``, each the log of 1 + hits."""
        if len(self.new) > CACHE_ENTRIES:
            self.old, self.new = self.new, {}
        words, known = words_of(text), self.new.get
        hits = {}
        for w in set(words):
            e = known(w)
            if e is None:
                e = self.look(w)
            if e >= 0:
                hits[w] = e
        n = [0, 0, 0, 0]
        if hits:
            open_quotes = 0
            for i, w in enumerate(words):
                marks = sum(map(w.count, QUOTES)) if not w.isalnum() else 0
                if w in hits:
                    quoted = bool(open_quotes % 2 or marks) or any(x.strip(_EDGE) in REPORTS for x in words[max(0, i - WINDOW) : i + WINDOW + 1])
                    n[2 * quoted + hits[w]] += 1
                open_quotes += marks
        return [1.0, *np.log1p(n), np.log1p(sum(n))]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the logistic model, the most probable ones under the prior."""
    w = _PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(_PRECISION), x.T @ (y - p) - _PRECISION * (w - _PRIOR))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def remainder(modulus: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def training_sample(labels: DataFrame, modulus: int, size: int) -> list[tuple[int, int]]:
    """About ``size`` labelled ids of each class, chosen by a hash, from those that aren't held out."""
    known = labels.where((remainder(modulus) != 0) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chance = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, size * 1_000_000 // max(1, counts.get(1, 0))).otherwise(size * 1_000_000 // max(1, counts.get(0, 0)))
    rows = known.where(chance).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return [(r["doc_id"], r["toxic"]) for r in rows.collect()]


def _bare(text: str) -> set[str]:
    return {w for w in (w.strip(_EDGE) for w in set(words_of(text))) if w}


def _keys(word: str) -> list[int]:
    """A 64-bit hash of each beginning of a word, the whole one last: a number each, however long the word is."""
    h, out = xxhash.xxh64(), []
    for ch in word:
        h.update(ch)
        out.append(h.intdigest() - (1 << 63))
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, in how many toxic and clean texts each word and each beginning of a word is, by their hashes."""
    for batch in batches:
        counts: dict[tuple[int, bool], list[int]] = {}
        seen: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            mine = {}
            for w in _bare(text.as_py() or ""):
                if w not in seen:
                    seen[w] = _keys(w)
                keys = seen[w]
                mine[keys[-1], True] = (keys[-2] if len(keys) > 1 else 0, len(keys))
                for k in range(STEM_LETTERS, len(keys)):
                    mine[keys[k - 1], False] = (keys[k - 2], k)
            for term, about in mine.items():
                counts.setdefault(term, [*about, 0, 0])[2 + toxic.as_py()] += 1
        rows = list(counts.items())
        for at in range(0, len(rows), 100_000):
            part = rows[at : at + 100_000]
            columns = [[t[0] for t, _ in part], [t[1] for t, _ in part], *([n[i] for _, n in part] for i in (0, 1, 2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), *[pa.int64()] * 4), strict=True)], names=["key", "whole", "parent", "letters", "clean", "toxic"])


def _lexicon(learned: DataFrame, odds: Column) -> tuple[list[str], list[str]]:
    """The entries: frequent words, and beginnings of any length that go on with ``STEM_BRANCHES`` letters in frequent terms.

    Terms are counted by hash; only the chosen ones get their texts, in a second pass over the sample.
    """
    counted = learned.mapInArrow(_terms, "key long, whole boolean, parent long, letters long, clean long, toxic long")
    terms = counted.groupBy("key", "whole").agg(F.first("parent").alias("parent"), F.first("letters").alias("letters"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # the sample bounds the terms: each is in LEAST_DOCS of its toxic documents
    frequent = materialized(terms.where((F.col("toxic") >= LEAST_DOCS) & (odds >= LEAST_ODDS)).select("key", "whole", "parent", "letters"))
    branching = frequent.select("key", "parent").distinct().groupBy("parent").count().where(F.col("count") >= STEM_BRANCHES).select(F.col("parent").alias("key"))
    stems = {r[0] for r in frequent.where(F.col("letters") >= STEM_LETTERS).join(branching, "key", "left_semi").select("key").distinct().collect()}
    words = {r[0] for r in frequent.where("whole").select("key").collect()}
    dropped(frequent)
    wanted = words | stems

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, str] = {}
            for w in set().union(*(_bare(t.as_py() or "") for t in batch.column(0))):
                found.update((key, w[: k + 1]) for k, key in enumerate(_keys(w)) if key in wanted and key not in found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], names=["key", "text"])

    texts = {r["key"]: r["text"] for r in learned.where("toxic = 1").mapInArrow(named, "key long, text string").groupBy("key").agg(F.first("text").alias("text")).collect()} if wanted else {}
    return choose_lexicon((texts[k] for k in words), (texts[k] for k in stems))


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, sample: int = SAMPLE) -> DataFrame:
    """Scores of all documents, learned from labelled ones whose crc32 remainder is not 0."""
    spark = docs.sparkSession
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(modulus) == 0).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = training_sample(labels, modulus, sample)
    learned = x.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int")), "doc_id").where(~F.col("held_out")).select("text", "toxic")
    totals = Counter(t for _, t in chosen)
    odds = (F.col("toxic") + 0.5) / (totals[1] + 1) / ((F.col("clean") + 0.5) / (totals[0] + 1))
    words, stems = _lexicon(learned, odds)

    def near_misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch, in how many clean texts each entry has a word that is one edit away."""
        automaton = Automaton(words, stems)
        near: dict[str, set[str]] = {}
        for batch in batches:
            counts = Counter()
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                found = set()
                for w in {w.strip(_EDGE) for w in words_of(text.as_py())} if toxic.as_py() == 0 else ():
                    if w not in near:
                        near[w] = automaton.near(w)
                    found.update(near[w])
                counts.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["entry", "n"])

    misses = learned.mapInArrow(near_misses, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).where(f"n > {MOST_NEAR_MISSES}")
    exact = [r["entry"] for r in misses.collect()]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(words, stems, exact)
        for batch in batches:
            rows = [scorer.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    known = learned.mapInArrow(measure, "toxic int, x array<double>").toPandas()
    weights = fit(np.stack(known["x"].to_numpy()), known["toxic"].to_numpy(float)) if len(known) else _PRIOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(words, stems, exact)
        for batch in batches:
            value = np.array([scorer.features(t.as_py()) for t in batch.column(2)]).reshape(-1, len(weights)) @ weights
            score = 1 / (1 + np.exp(-np.clip(value, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return x.mapInArrow(run, SCHEMA)
