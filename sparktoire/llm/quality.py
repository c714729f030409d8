"""Quality rules: repetition found with a suffix array over the words of each document.

The suffixes of a document start at its words. Prefix doubling sorts the suffixes of many
documents at once; the ranks of all levels then give the longest common prefix (LCP) of suffixes
that are neighbours in the sorted order. The deepest LCP interval around a suffix is the larger of
its two neighbour values: the longest maximal repeat that starts there. The union of these spans
and the longest of them are what the rule limits. Words and lines are equal if their bytes are.

Defined results: a null or empty text has no words and fails the base rule; a null ``doc_id`` is
kept as it is; repeated rows are judged one by one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparktoire.llm import textbytes as tb

#: A repeat counts from so many words; the share of words in such repeats and the longest one are limited.
REPEAT_WORDS = 10
MAX_COVERED_PERCENT = 15
MAX_LONGEST_WORDS = 60

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, kept boolean"


def suffix_lcp(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest repeat of its document that starts there.

    ``symbols``: non-negative integers; ``first``: where each document begins, and the end.
    """
    n = len(symbols)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    size = np.diff(first)
    end = np.repeat(first[1:], size)
    order = np.argsort(symbols + np.repeat(np.arange(len(size)), size) * np.int64(symbols.max() + 1), kind="stable")
    key = np.repeat(np.arange(len(size)), size)[order] * np.int64(symbols.max() + 1) + symbols[order]

    def ranked(head: np.ndarray) -> np.ndarray:
        """The first place of each sorted element's group."""
        return np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))

    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = ranked(head)
    levels, step = [rank.copy()], 1
    while True:
        alone = head & np.append(head[1:], True)
        active = np.flatnonzero(~alone)
        if not len(active):
            break
        at = order[active]
        after = at + step
        second = np.where(after < end[at], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * np.int64(n + 1) + second
        by = np.argsort(key, kind="stable")
        order[active] = at[by]
        key = key[by]
        head[active[1:]] |= key[1:] != key[:-1]
        rank[order[active]] = ranked(head)[active]
        levels.append(rank.copy())
        step *= 2
    a, b = order[:-1], order[1:]
    pairs = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[pairs], b[pairs]
    lcp = np.zeros(len(pairs), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        inside = (i < end[a]) & (j < end[b])
        same = inside & (levels[level][np.where(inside, i, 0)] == levels[level][np.where(inside, j, 0)])
        lcp += np.where(same, 1 << level, 0)
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    return longest


def covered(first: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of each document in the union of the spans."""
    delta = np.zeros(first[-1] + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return per_document(np.cumsum(delta[:-1]) > 0, first)


def per_document(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def measure(buf: np.ndarray, offsets: np.ndarray, repeat_words: int) -> dict[str, np.ndarray]:
    """The figures of each document of a chunk."""
    starts, ends, first = tb.words(buf, offsets)
    n_words = np.diff(first)
    longest = suffix_lcp(tb.span_numbers(buf, starts, ends).astype(np.int64), first)
    five = np.flatnonzero(longest >= 5)
    long = np.flatnonzero(longest >= repeat_words)
    top = np.zeros(len(n_words), np.int64)
    np.maximum.at(top, np.repeat(np.arange(len(n_words)), n_words), longest)
    edges = np.union1d(offsets[:-1], np.flatnonzero(buf == 10) + 1)
    edges = edges[edges <= len(buf)]
    stops = np.append(edges[1:], len(buf))
    stops = np.where((stops > edges) & (buf[np.maximum(stops - 1, 0)] == 10) if len(buf) else False, stops - 1, stops)
    worded = np.searchsorted(starts, stops) > np.searchsorted(starts, edges)
    edges, stops = edges[worded], stops[worded]
    owner = np.searchsorted(offsets, edges, "right") - 1
    line = tb.span_numbers(buf, edges, stops).astype(np.int64)
    n_lines = np.bincount(owner, minlength=len(n_words))
    each = line.max(initial=0) + 1
    distinct = np.bincount(np.unique(owner * each + line) // each, minlength=len(n_words))
    return {
        "n_words": n_words,
        "word_chars": per_document(~tb.IS_SPACE[buf] & ((buf & 0xC0) != 0x80), offsets),
        "n_symbols": per_document(_SYMBOL[buf], offsets),
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": covered(first, five, np.full(len(five), 5)),
        "covered_words": covered(first, long, longest[long]),
        "longest_repeat": top,
    }


def verdict(x: dict[str, np.ndarray], max_covered_percent: int, max_longest_words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(base_failed, kept)``."""
    failed = (x["n_words"] < 10) | (100 * x["n_repeat_words"] > 20 * x["n_words"])
    bad = (100 * x["covered_words"] > max_covered_percent * x["n_words"]) | (x["longest_repeat"] > max_longest_words)
    return failed, ~(failed | bad)


def quality(docs: DataFrame, repeat_words: int = REPEAT_WORDS, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest_words: int = MAX_LONGEST_WORDS) -> DataFrame:
    """The figures and the verdict of every document, in one pass and without a shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offsets in tb.chunks(batch, "text"):
                x = measure(buf, offsets, repeat_words)
                failed, kept = verdict(x, max_covered_percent, max_longest_words)
                x |= {"doc_id": batch.column(0).slice(row, end - row), "base_failed": failed, "kept": kept}
                yield pa.RecordBatch.from_arrays([pa.array(x[f.name], f.type) for f in schema], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, repeat_words: int = REPEAT_WORDS, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest_words: int = MAX_LONGEST_WORDS) -> DataFrame:
    """The documents that the rules keep, with all their columns, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offsets in tb.chunks(batch, "text"):
                keep = verdict(measure(buf, offsets, repeat_words), max_covered_percent, max_longest_words)[1]
                yield batch.slice(row, end - row).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
