"""Exact copies: every text once, without ever gathering a group of copies in one task.

Each input chunk keeps one row with the text for each of its distinct texts, that of the smallest
``doc_id``; its other rows lose the text and only name that row as their owner. The rows with texts
then meet by a hash of the text, where one row of each text stays. A text that a third of all rows
share so arrives once per chunk. Rows without a text go to a bucket of their own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparktoire.llm import textbytes as tb
from sparktoire.llm.common import bucketed, text_bytes

BUCKET_BYTES = 4 << 20
LEAST_BUCKETS = 64
#: Stands for a null ``doc_id``: it comes after all others.
NO_ID = (1 << 63) - 1
SCHEMA = "bucket int, doc_id long, owner long, n_bytes long, n_copies long, text string"
NAMES = ["bucket", "doc_id", "owner", "n_bytes", "n_copies", "text"]


def buckets_for(docs: DataFrame) -> int:
    """Buckets of about ``BUCKET_BYTES`` of text each."""
    return max(LEAST_BUCKETS, -(-text_bytes(docs) // BUCKET_BYTES))


def _collapse(ids: np.ndarray, texts: pa.Array, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, keeps, n)``: the smallest id of each row's text, whether the row keeps its text, the rows it stands for.

    Texts of fewer than ``least`` bytes and rows of the owner's own id keep theirs.
    """
    codes = np.asarray(texts.dictionary_encode().indices)
    owner = np.full(int(codes.max(initial=-1)) + 1, NO_ID, np.int64)
    first, lost = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    np.minimum.at(owner, codes, ids)
    owner = owner[codes]
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8))
    keeps = (owner == ids) | (size < least)
    n = np.array(n, np.int64)
    np.add.at(lost, codes[~keeps], n[~keeps])
    n[~keeps] = 0
    kept = np.flatnonzero(keeps)[::-1]
    first[codes[kept]] = kept
    n[first] += lost
    return owner, keeps, n


def carried(docs: DataFrame, columns: list[str | Column]) -> list[Column]:
    """The columns under names that can't clash."""
    return [(docs[f"`{c}`"] if isinstance(c, str) else c).alias(f"carried_{i}") for i, c in enumerate(columns)]


def distinct_texts(docs: DataFrame, n_buckets: int, least_bytes: int = 0, carry: list[str | Column] | None = None, no_id: Column | None = None) -> DataFrame:
    """One row per document, in a table bucketed by ``bucket``: ``bucket, doc_id, owner, n_bytes, n_copies, text``.

    ``text`` is null for a copy; then ``owner`` is the ``doc_id`` of a row with the same text, whose
    own ``owner`` may be yet another one (follow it twice at most). ``n_copies``: the rows that a row
    with a text stands for. Null texts count as empty, null ids as ``no_id`` (``NO_ID``). Texts below
    ``least_bytes`` are never collapsed. The columns ``carry`` follow, as ``carried_0`` and so on.
    """
    more = carried(docs, carry or [])
    more_schema = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*more).schema) if more else ""

    def rows(ids: pa.Array, texts: pa.Array, n_bytes: np.ndarray, owner: np.ndarray, keeps: np.ndarray, n_copies: np.ndarray, bucket: np.ndarray, rest: list[pa.Array]) -> pa.RecordBatch:
        columns = [pa.array(bucket, pa.int32()), ids, pa.array(owner), pa.array(n_bytes), pa.array(n_copies), texts.take(pa.array(np.arange(len(keeps)), mask=~keeps)).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*columns, *rest], names=NAMES + [f"carried_{i}" for i in range(len(rest))])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, buf, offsets in tb.chunks(batch, "text"):
                ids = batch.column(0).slice(row, end - row)
                texts = batch.column(1).slice(row, end - row).cast(pa.large_string())
                number = np.asarray(ids)
                owner, keeps, n_copies = _collapse(number, texts, np.ones(len(number), np.int64), least_bytes)
                filled = np.flatnonzero(np.diff(offsets) > 0)
                by_text = np.zeros(len(offsets) - 1, np.uint64)
                by_text[filled] = tb.span_hashes(buf, offsets[filled], offsets[filled + 1])
                spread = tb.mix(number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                short = np.diff(offsets) < least_bytes
                bucket = (np.where(keeps & ~short, by_text, spread) % np.uint64(n_buckets)).astype(np.int32)
                yield rows(ids, texts, np.diff(offsets), owner, keeps, n_copies, bucket, [c.slice(row, end - row) for c in batch.columns[2:]])

    def merged(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts, ids, owner = (table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c] for c in ("text", "doc_id", "owner"))
        texts, number, owner = texts.cast(pa.large_string()), np.asarray(ids), np.asarray(owner).copy()
        has = np.flatnonzero(np.asarray(texts.is_valid()))
        keeps = np.zeros(len(texts), bool)
        size, n_copies = (np.asarray(table[c].combine_chunks()) for c in ("n_bytes", "n_copies"))
        n_copies = n_copies.copy()
        owner[has], keeps[has], n_copies[has] = _collapse(number[has], texts.take(pa.array(has)), n_copies[has], least_bytes)
        rest = [c.combine_chunks() for c in table.columns[len(NAMES) :]]
        return pa.Table.from_batches([rows(ids, texts, size, owner, keeps, n_copies, np.asarray(table["bucket"].combine_chunks()), rest)])

    x = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) if no_id is None else no_id).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    schema = SCHEMA + more_schema
    rows = bucketed(x.mapInArrow(local, schema).groupBy("bucket").applyInArrow(merged, schema), n_buckets, "bucket")
    return rows
