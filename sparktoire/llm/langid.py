"""Language identification with a string kernel, Nyström landmarks and kernel ridge regression.

The blended spectrum presence kernel of two texts is the number of n-grams, n from 1 to ``LONGEST``,
that are in both, divided by the geometric mean of the numbers in each, over all n-grams of both.
They are n-grams of UTF-8 bytes, with A-Z lower-cased. The landmarks are ``LANDMARKS`` texts per
language. The coefficients of one regression per language against the rest solve the Nyström normal
equations on a bounded sample; the executors sum their terms and compare the landmarks with each
other, so the driver gets matrices of landmarks by landmarks. A batch of texts is scored by two
matrix products, presence by landmarks and landmarks by languages. A text needs some 100 bytes of
memory for each of its own.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for all texts
if no training row has a language; a null ``doc_id`` is hashed as an empty string; rows without a
language aren't learned from; repeated rows are judged one by one; of languages of equal value the
first in alphabetical order is taken, as for texts that share nothing with any landmark, whose score
is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparktoire.llm import textbytes as tb

LONGEST = 4
#: Texts per language: landmarks, and rows that the regression is fitted on (about so many).
LANDMARKS, SAMPLE = 24, 400
RIDGE = 1e-3
#: Texts and landmarks of one matrix product.
_DOCS, _MARKS = 64, 128
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def grams(buf: np.ndarray, n: int) -> np.ndarray:
    """The codes of the n-grams at all positions: their bytes after a one, so that no two of any lengths are equal."""
    c, out = tb.LOWER[buf].astype(np.uint64), np.ones(max(0, len(buf) - n + 1), np.uint64)
    for j in range(n):
        out = out << np.uint64(8) | c[j : len(buf) - n + 1 + j]
    return out


def gram_set(data: bytes) -> np.ndarray:
    """The distinct n-grams of a text, of all n."""
    buf = np.frombuffer(data, np.uint8)
    return np.concatenate([np.unique(grams(buf, n)).astype(np.int64) for n in range(1, LONGEST + 1)])


class Kernel:
    """Kernel values of texts against the landmarks, whose n-grams are kept as lists of their landmarks."""

    def __init__(self, landmarks: list[np.ndarray]):
        mark = np.repeat(np.arange(len(landmarks)), [len(x) for x in landmarks])
        gram = np.concatenate(landmarks)
        by = np.argsort(gram, kind="stable")
        self.mark = mark[by].astype(np.int32)
        self.features, first = np.unique(gram[by], return_index=True)
        self.first = np.append(first, len(gram))
        self.size = np.array([len(x) for x in landmarks], float)

    def _batch(self, buf: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Kernel values of up to ``_DOCS`` texts: presence of the batch's n-grams times that in the landmarks."""
        n_docs, size = len(edge) - 1, np.diff(edge)
        doc, end = (np.repeat(x, size) for x in (np.arange(n_docs, dtype=np.uint64), edge[1:]))
        codes = []
        for n in range(1, LONGEST + 1):
            inside = np.flatnonzero(np.arange(max(0, len(buf) - n + 1)) + n <= end[: max(0, len(buf) - n + 1)])
            codes.append(grams(buf, n)[inside] * np.uint64(_DOCS) + doc[inside])
        pair = np.sort(np.concatenate(codes))
        pair = pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]
        code, doc = (pair // np.uint64(_DOCS)).astype(np.int64), (pair % np.uint64(_DOCS)).astype(np.int64)
        head = np.append(True, code[1:] != code[:-1])[: len(code)]
        distinct, column = code[head], np.cumsum(head) - 1
        at = np.minimum(np.searchsorted(self.features, distinct), len(self.features) - 1)
        known = self.features[at] == distinct
        place, at = np.cumsum(known) - 1, at[known]
        present = np.zeros((n_docs, len(at)), np.float32)
        hit = known[column]
        present[doc[hit], place[column[hit]]] = 1
        count = self.first[at + 1] - self.first[at]
        row = np.repeat(np.arange(len(at)), count)
        mark = self.mark[np.arange(len(row)) + np.repeat(self.first[at] - np.cumsum(count) + count, count)]
        out = np.empty((n_docs, len(self.size)))
        for low in range(0, len(self.size), _MARKS):
            high = min(low + _MARKS, len(self.size))
            some = slice(None) if high - low == len(self.size) else np.flatnonzero((mark >= low) & (mark < high))
            marks = np.zeros((len(at), high - low), np.float32)
            marks[row[some], mark[some] - low] = 1
            out[:, low:high] = present @ marks
        return out / np.sqrt(np.maximum(np.bincount(doc, minlength=n_docs), 1))[:, None] / np.sqrt(np.maximum(self.size, 1))

    def between(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = [self._batch(buf[x[0] : x[-1]], x - x[0]) for x in (offsets[at : at + _DOCS + 1] for at in range(0, len(offsets) - 1, _DOCS))]
        return np.concatenate(rows) if rows else np.zeros((0, len(self.size)))


def fit(squares: np.ndarray, products: np.ndarray, n: int, k_mm: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients of the landmarks for each language, of ``n`` texts with the sums ``K'K`` and ``K'y``."""
    return np.linalg.solve(squares + ridge * n * k_mm + 1e-9 * n * np.eye(len(k_mm)), products)


def lettered(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    total = np.append(0, np.cumsum(_LETTER[buf]))
    out = total[offsets[1:]] > total[offsets[:-1]]
    high = np.append(0, np.cumsum(buf >= 128))
    for i in np.flatnonzero(~out & (high[offsets[1:]] > high[offsets[:-1]])):
        out[i] = any(map(str.isalpha, buf[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace")))
    return out


def identify(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """The language of every whole text, learned from rows with another crc32 remainder."""
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder == held_out).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = x.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    count = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(count)
    spread = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(v) for g in langs for v in (g, (1 << 30) / count[g])])[F.col("lang")] if langs else F.lit(0)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([gram_set(t.as_py().encode()) for t in batch.column(1)], pa.list_(pa.int64()))], names=["key", "grams"])

    sample = known.where(spread < share * (SAMPLE + LANDMARKS))
    chosen = sample.where(spread < share * LANDMARKS).select(F.sha2("text", 256).alias("key"), "text")
    marks = sorted(tuple(r) for r in chosen.mapInArrow(sets, "key string, grams array<long>").collect()) if langs else []
    if not marks:
        marks = [("", [1 << 8])] if langs else []
    kernel = Kernel([np.array(m[1], np.int64) for m in marks]) if marks else None

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The kernel values of landmarks with all landmarks."""
        for batch in batches:
            for row, end, buf, offsets in tb.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(list(kernel.between(buf, offsets)), pa.list_(pa.float64()))], names=["key", "terms"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The terms of a part of the sample, a row for each landmark and one for the number of texts."""
        total, n = np.zeros((len(marks), len(marks) + len(langs))), 0
        for batch in batches:
            for row, end, buf, offsets in tb.chunks(batch, "text"):
                k = kernel.between(buf, offsets)
                target = np.array([[g.as_py() == x for x in langs] for g in batch.column(0).slice(row, end - row)], float)
                total += k.T @ np.concatenate([k, target], 1)
                n += len(k)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(marks) + 1), pa.int32()), pa.array([*total, np.array([float(n)])], pa.list_(pa.float64()))], names=["mark", "terms"])

    def added(table: pa.Table) -> pa.Table:
        terms = np.sum([np.asarray(x.values) for x in table["terms"]], axis=0)
        return pa.table([table["mark"].slice(0, 1), pa.array([terms], pa.list_(pa.float64()))], names=["mark", "terms"])

    if kernel:
        terms = "mark int, terms array<double>"
        rows = sorted(sample.select("lang", "text").mapInArrow(measure, terms).groupBy("mark").applyInArrow(added, terms).collect())
        sums, n = np.array([r["terms"] for r in rows[:-1]]), int(rows[-1]["terms"][0])
        each = {r["key"]: r["terms"] for r in chosen.mapInArrow(compared, "key string, terms array<double>").collect()}
        k_mm = np.array([each.get(m[0], [0.0] * len(marks)) for m in marks])
        weights = fit(sums[:, : len(marks)], sums[:, len(marks) :], max(n, 1), k_mm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offsets in tb.chunks(batch, "text"):
                found = lettered(buf, offsets) if kernel else np.zeros(end - row, bool)
                value = kernel.between(buf, offsets) @ weights if kernel else np.zeros((end - row, 1))
                best = value.argmax(1)
                score = np.where(found, np.clip(value[np.arange(end - row), best], 0, 1), 0).astype(float)
                lang = [langs[b] if f else "und" for b, f in zip(best, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, end - row) for i in range(2)), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return x.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)
