"""URL filters: rules first, then naive Bayes over segmented host words and path tokens.

A rule fits its host and all subdomains if the path starts with its own; the longest one wins.
Hosts of the other pages are split at dots, hyphens, colons and at signs, and each part into words
by a unigram Viterbi search over the words of all pages' texts; the multinomial naive Bayes model,
learned from the pages that rules decide, scores these words with the tokens of the path. Labels of
the rules' own hosts are no words: the model would only learn the rules by heart.

Nothing is left out of either model, and neither goes to the driver. The counts of all words are a
written table; the pieces of the distinct hosts are joined with it, so a host is split with the
words that can occur in it. Pieces have at most ``HEAD`` letters and longer words are found by their
beginnings, so a long host gives pieces in proportion to its length; the search of its best split
takes its length times that of the longest word. The log odds of tokens are a table too: they are joined with the tokens
of distinct hosts and of the pages' paths, and summed. Hot hosts and tokens are joined apart
(``lookup``).

Defined results: null urls and urls without ``://`` have an empty host and path, fit no rule and
have no tokens; with no tokens the more frequent class decides, and ``allow`` if there is none or
on ties; repeated rows are judged one by one; a null ``html`` has no words; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparktoire.llm.common import dropped, materialized
from sparktoire.llm.lookup import looked_up

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: What a letter of an unknown word costs beside the word itself.
UNKNOWN_LETTER = 2.5
#: Hosts are joined with words on pieces of up to so many letters, longer words on their beginnings.
HEAD = 24
_STARTS = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = re.compile(r"[.\-:@]+")


def parsed(url: Column) -> tuple[Column, Column]:
    """``(host, path)``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def parts_of(host: str, known: frozenset[str] = frozenset()) -> list[str]:
    """The parts of a host, without the ``known`` labels."""
    return [x for x in _PARTS.split(host) if x and x not in known]


class Segmenter:
    """Splits a concatenated name into the most probable words.

    ``counts``: the words that can be in it; ``total`` and ``longest``: the number of all words and
    the letters of the longest.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None, longest: int | None = None):
        self.total = (sum(counts.values()) if total is None else total) + 1
        self.log_p = {w: math.log(n / self.total) for w, n in counts.items()}
        self.lengths = {len(w) for w in counts}
        self.longest = longest or max(map(len, counts), default=1)

    def unknown(self, letters: int) -> float:
        """Unknown words cost more the longer they are."""
        return -math.log(self.total) - UNKNOWN_LETTER * letters

    def score(self, word: str) -> float:
        found = self.log_p.get(word)
        return self.unknown(len(word)) if found is None else found

    def split(self, name: str) -> list[str]:
        """Only pieces as long as some word are looked up; of equal splits the longest last word is taken."""
        unknown = [self.unknown(n) for n in range(min(self.longest, len(name)) + 1)]
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            top, at = -math.inf, 0
            for k in range(max(0, end - self.longest), end):
                found = self.log_p.get(name[k:end]) if end - k in self.lengths else None
                value = best[k] + (unknown[end - k] if found is None else found)
                if value > top:
                    top, at = value, k
            best.append(top)
            back.append(at)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]


def path_tokens(path: Column) -> Column:
    """Runs of letters and of digits of the path, marked by a slash; numbers are alike."""
    return F.transform(F.regexp_extract_all(F.lower(path), F.lit("(\\p{L}+|[0-9]+)"), 1), lambda t: F.when(t.rlike("^[0-9]"), "/0").otherwise(F.concat(F.lit("/"), t)))


def word_counts(pages: DataFrame) -> DataFrame:
    """``word, n``: all words of all pages' texts."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    words = pages.select(F.explode(F.split(text, "[^\\p{L}]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def host_words(hosts: DataFrame, counts: DataFrame, known: frozenset[str] = frozenset()) -> DataFrame:
    """``host, token``: the words of each of the distinct ``hosts``, marked by a dot, as often as they occur."""
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max(F.length("word")), F.lit(1)).alias("longest")).first()
    total, longest = size["total"], size["longest"]

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of up to ``HEAD`` letters, those of so many places at a time."""
        for batch in batches:
            for host in batch.column(0).to_pylist():
                for part in parts_of(host, known):
                    for low in range(0, len(part), _STARTS):
                        starts = range(low, min(low + _STARTS, len(part)))
                        found = sorted({part[i:j] for i in starts for j in range(i + 1, min(len(part), i + min(longest, HEAD)) + 1)})
                        yield pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array(found, pa.string())], names=["host", "word"])

    def split(table: pa.Table) -> pa.Table:
        host = table["host"][0].as_py()
        segmenter = Segmenter({w: n for w, n in zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True) if w is not None}, total, longest)
        tokens = ["." + w for part in parts_of(host, known) for w in segmenter.split(part)]
        return pa.table([pa.array([host] * len(tokens), pa.string()), pa.array(tokens, pa.string())], names=["host", "token"])

    subs = materialized(hosts.mapInArrow(substrings, "host string, word string"))
    found = looked_up(subs, counts, "word")
    if longest > HEAD:
        long = counts.where(F.length("word") > HEAD).withColumn("head", F.substr("word", F.lit(1), F.lit(HEAD)))
        heads = subs.where(F.length("word") == HEAD).select("host", F.col("word").alias("head")).distinct()
        found = found.unionByName(heads.join(long, "head").where(F.contains("host", "word")).select("host", "word", "n"))
    found = found.unionByName(hosts.select("host", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("n")))
    words = materialized(found.groupBy("host").applyInArrow(split, "host string, token string"))
    dropped(subs)
    return words


def _log_odds(tokens: DataFrame) -> DataFrame:
    """``token, odds`` of ``token, allow, block`` counts: log odds of block, with one added to each count."""
    below = tokens.agg((F.coalesce(F.sum("allow"), F.lit(0)) + F.count(F.lit(1)) + 1).alias("allow"), (F.coalesce(F.sum("block"), F.lit(0)) + F.count(F.lit(1)) + 1).alias("block")).first()
    odds = F.log((F.col("block") + 1) / below["block"]) - F.log((F.col("allow") + 1) / below["allow"])
    return tokens.select("token", odds.alias("odds")), math.log(below["allow"] / below["block"])


def scored(pages: DataFrame, rules=RULES, learn: Column | None = None) -> DataFrame:
    """``page_id, host, path, rule, ruled, guess`` of every page: the rule's verdict, if any, and the model's.

    ``learn``: which of the pages that rules decide are learned from, all of them if none.
    """
    known = frozenset(x for _, h, _ in rules for x in parts_of(h))
    host, path = parsed(F.col("url"))
    rule, ruled = rule_of(host, path, rules)
    block = F.when(F.lit(True) if learn is None else learn, (ruled == "block").cast("long"))
    x = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), rule.alias("rule"), ruled.alias("ruled"), block.alias("block"))
    x = materialized(x)
    counts = materialized(word_counts(pages))
    by_host = materialized(x.groupBy("host").agg(F.sum(1 - F.col("block")).alias("allow"), F.sum("block").alias("block")))
    words = host_words(by_host.select("host"), counts, known)
    tokens = materialized(x.select("row", "block", F.explode(path_tokens(F.col("path"))).alias("token")).groupBy("row", "block", "token").agg(F.count(F.lit(1)).alias("n")))
    learned = words.join(by_host, "host").where("allow IS NOT NULL").select("token", "allow", "block")
    learned = learned.unionByName(tokens.where("block IS NOT NULL").select("token", ((1 - F.col("block")) * F.col("n")).alias("allow"), (F.col("block") * F.col("n")).alias("block")))
    odds, unknown = _log_odds(materialized(learned.groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))))
    classes = by_host.agg(F.coalesce(F.sum("allow"), F.lit(0)).alias("allow"), F.coalesce(F.sum("block"), F.lit(0)).alias("block")).first()
    prior = math.log((classes["block"] + 1) / (classes["allow"] + 1))
    value = F.coalesce("odds", F.lit(unknown))
    of_host = looked_up(words, odds, "token", "left").groupBy("host").agg(F.sum(value).alias("of_host"))
    of_path = looked_up(tokens, odds, "token", "left").groupBy("row").agg(F.sum(value * F.col("n")).alias("of_path"))
    full = looked_up(x, materialized(of_host), "host", "left").join(of_path, "row", "left")
    score = F.lit(prior) + F.coalesce("of_host", F.lit(0.0)) + F.coalesce("of_path", F.lit(0.0))
    return full.select("page_id", "host", "path", "rule", "ruled", F.when(F.round(score, 9) > 0, "block").otherwise("allow").alias("guess"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    return scored(pages, rules).select("page_id", "host", "path", "rule", F.coalesce("ruled", "guess").alias("verdict"))
