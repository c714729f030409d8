"""Exact substring deduplication with a two-stage suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller
``doc_id``. Which strings are compared is decided without loss, in steps that each shuffle little:

1. Exact copies are collapsed (``copies``).
2. Every window of ``LENGTH`` bytes has an anchor, its ``GRAM``-byte string of the smallest hash.
   Equal windows have equal anchors, so a window whose anchor is in no other document is unique.
   Each document bucket sends its distinct anchor keys, and learns which of them others have.
3. The consecutive windows of a shared anchor form a snippet, which goes to the bucket of its key;
   of equal snippets in a document bucket only that of the smallest ``doc_id`` is sent.
4. Equal windows hold their anchor at the same place. So of a bucket's different snippets only
   windows go on whose ``CORE`` bytes about the anchor another one has too (``promising``). These
   are suffix-sorted in two stages: suffixes smaller than their successor are
   sorted directly, the others are induced by scanning the buckets of first bytes in order.
   The common prefixes of neighbours are computed; from ``LENGTH`` bytes on they are the same
   string, and its smallest ``doc_id`` keeps it.

Defined results: null texts count as empty; a null ``doc_id`` comes after all others, beside the
largest number of 64 bits; rows of equal ``doc_id`` don't take bytes from each other; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparktoire.llm import textbytes as tb
from sparktoire.llm.common import materialized
from sparktoire.llm.copies import buckets_for, distinct_texts

LENGTH, GRAM = 50, 16
#: Windows whose anchors begin at ``STEP`` neighbouring places of them have these many bytes in common.
STEP = 7
CORE = LENGTH - STEP + 1
_WINDOWS = 1 << 16  # at once, in memory that a core has near
_POSITION = np.uint64(32)  # low bits of an anchor's rank, for its position: a fixed number, or ties could fall differently in equal windows
_DEPTH = 7  # words of eight bytes: the order is exact for 56 bytes, six more than are compared
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KEYS = "bucket int, source int, low binary, high binary"
SNIPPETS = "bucket int, source int, doc_id binary, size binary, places binary, document binary, start binary, place binary, data binary"
SPANS = "bucket int, document binary, start binary, stop binary"


def eight(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    out = np.zeros(len(text) + 1, np.uint64)
    for j in range(8):
        out |= padded[j : j + len(text) + 1].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def two_stage_sort(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of the bytes, in an order that is exact for their first 56 bytes."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    word = eight(text)
    change = np.flatnonzero(text[1:] != text[:-1]) + 1
    turn = np.append(change, n)[np.searchsorted(change, np.arange(n), "right")]
    smaller = (turn < n) & (text[np.minimum(turn, n - 1)] > text)  # than the suffix that follows
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(word[direct], kind="stable")]
    head = np.ones(len(direct), bool)
    head[1:] = word[direct[1:]] != word[direct[:-1]]
    for depth in range(1, _DEPTH):
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            break
        group = np.cumsum(head)[tied]
        key = word[np.minimum(direct[tied] + 8 * depth, n)]
        by = np.lexsort((key, group))
        direct[tied], key = direct[tied][by], key[by]
        head[tied[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    first = text[direct]
    edge = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    order = []
    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        induced = [part]
        while len(part):
            part = part[part > 0] - 1
            part = part[(text[part] == c) & ~smaller[part]]
            induced.append(part)
        whole = np.concatenate([*induced, direct[edge[c] : edge[c + 1]]])
        order.append(whole)
        before = whole[whole > 0] - 1
        before = before[(text[before] > c) & ~smaller[before]]
        if len(before):
            before = before[np.argsort(text[before], kind="stable")]
            values, at = np.unique(text[before], return_index=True)
            for v, x in zip(values, np.split(before, at[1:]), strict=True):
                waiting[v].append(x)
    return np.concatenate(order)


_WIDTHS = np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))


def common_prefixes(word: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The bytes that each suffix of the order has in common with the one before it, 56 at most."""
    n, out, open_ = len(word) - 1, np.zeros(max(0, len(order) - 1), np.int64), None
    for depth in range(_DEPTH):
        a, b = (order[:-1], order[1:]) if open_ is None else (order[open_], order[open_ + 1])
        differ = word[np.minimum(a + 8 * depth, n)] ^ word[np.minimum(b + 8 * depth, n)]
        where = np.arange(len(differ)) if open_ is None else open_
        apart = np.flatnonzero(differ)
        out[where] += 8
        out[where[apart]] -= np.searchsorted(_WIDTHS, differ[apart], "right")
        open_ = where[differ == 0]
        if not len(open_):
            break
    return out


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position on, as two numbers of eight bytes."""
    lanes = np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf), strides=(1,))
    out = lanes[:-8] * tb.ODD[0]
    out ^= out >> np.uint64(29)
    out += lanes[8:] * tb.ODD[1]
    return tb.mix(out)


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(key, start, count, place)`` of each run of consecutive windows that have one anchor, ``place`` bytes after the first's start."""
    n, span = len(buf), LENGTH - GRAM + 1
    if n < LENGTH:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    key, pick = np.empty(n - GRAM + 1, np.uint64), np.empty(n - LENGTH + 1, np.int64)
    for first in range(0, len(pick), _WINDOWS):
        part = pick[first : first + _WINDOWS]
        hashes = key[first : first + len(part) + span - 1]
        hashes[:] = gram_hashes(buf[first : first + len(part) + LENGTH - 1])
        low = (hashes >> _POSITION << _POSITION) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width < span:
            step = min(width, span - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        part[:] = low & ((np.uint64(1) << _POSITION) - np.uint64(1))
        part += first
    within = np.ones(len(pick), bool)  # a document
    across = (offsets[1:-1, None] - np.arange(1, LENGTH)).ravel()
    within[across[(across >= 0) & (across < len(pick))]] = False
    goes_on = (pick[1:] == pick[:-1]) & within[1:] & within[:-1]
    starts = np.flatnonzero(within & ~np.append(False, goes_on))
    stops = np.flatnonzero(within & ~np.append(goes_on, False))
    return key[pick[starts]], starts, stops - starts + 1, pick[starts] - starts


def _columns(table: pa.Table, *names: str) -> list:
    return [table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c] for c in names]


def _order(table: pa.Table) -> np.ndarray:
    """A bucket's rows in the order of their ids, the same each time."""
    ids, texts = _columns(table, "doc_id", "text")
    by = np.argsort(np.asarray(ids), kind="stable")
    if (np.asarray(ids)[by][1:] == np.asarray(ids)[by][:-1]).any():
        by = np.lexsort(([sha256(x.as_buffer()).digest()[:8] for x in texts], np.asarray(ids)))
    return by


def _bytes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(ids, bytes, offsets)`` of a bucket's texts, in their order."""
    ids, texts = _columns(table, "doc_id", "text")
    by = _order(table)
    texts = texts.take(pa.array(by)).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return np.asarray(ids)[by], data, offsets - offsets[0]


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    return data[np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])]


def _split(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and its rows."""
    by = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[by], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edge)):
        yield int(b), by[edge[b] : edge[b + 1]]


def send_keys(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            source = np.asarray(batch.column(0))
            for s in np.unique(source):
                _, buf, offsets = _bytes(whole.filter(pa.array(source == s)))
                key = np.unique(anchors(buf, offsets)[0] >> np.uint64(16))
                rows = [(b, int(s), (k := key[x] // np.uint64(n_buckets)).astype(np.uint32).tobytes(), (k >> np.uint64(32)).astype(np.uint16).tobytes()) for b, x in _split((key % np.uint64(n_buckets)).astype(np.int64), n_buckets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "source", "low", "high"])

    return run


def answer_keys(n_buckets: int):
    """Tell each source which of its keys another source has too."""

    def run(table: pa.Table) -> pa.Table:
        bucket, source, low, high = _columns(table, "bucket", "source", "low", "high")
        parts = [np.frombuffer(a.as_buffer(), np.uint32).astype(np.uint64) | np.frombuffer(b.as_buffer(), np.uint16).astype(np.uint64) << np.uint64(32) for a, b in zip(low, high, strict=True)]
        key = np.concatenate(parts)
        owner = np.repeat(np.asarray(source), [len(x) for x in parts])
        by = np.lexsort((owner, key))
        key, owner = key[by], owner[by]
        group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
        change = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
        shared = (np.bincount(group, change)[group] > 1) & change
        key, owner = key[shared] * np.uint64(n_buckets) + np.uint64(bucket[0].as_py()), owner[shared]
        rows = [(int(owner[x[0]]), 0, key[x].tobytes(), b"") for _, x in _split(np.unique(owner, return_inverse=True)[1], len(key) + 1)] if len(key) else []
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "source", "low", "high"])

    return run


def send_snippets(n_buckets: int):
    """The snippets of shared anchors; of equal ones only the first document's, which decides the others."""

    def run(texts: pa.Table, keys: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in SNIPPETS.split(", ")]
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        empty = pa.table([pa.array([], t) for t in types], names=names)
        if not len(texts):
            return empty
        ids, buf, offsets = _bytes(texts)
        key, start, count, place = anchors(buf, offsets)
        key >>= np.uint64(16)
        document = np.searchsorted(offsets, start, "right") - 1
        by = np.argsort(key, kind="stable")  # of a key, documents stay in their order
        ordered, owner = key[by], document[by]
        twice = ordered[1:][(ordered[1:] == ordered[:-1]) & (owner[1:] != owner[:-1])]
        known = np.sort(np.concatenate([*(np.frombuffer(x.as_buffer(), np.uint64) for x in (_columns(keys, "low")[0] if len(keys) else ())), twice]))
        at = np.searchsorted(known, ordered)
        x = np.sort(by[known[np.minimum(at, len(known) - 1)] == ordered]) if len(known) else by[:0]
        if not len(x):
            return empty
        key, start, count, place, document = key[x], start[x], count[x], place[x], document[x]
        size = count + LENGTH - 1
        _, first, inverse = np.unique(np.stack([tb.span_numbers(buf, start, start + size).astype(np.uint64), key], 1), axis=0, return_index=True, return_inverse=True)
        inverse = inverse.ravel()
        start -= offsets[document]
        later = ids[document] > ids[document[first]][inverse]  # rows are in the order of ids
        source, rows = int(texts["bucket"][0].as_py()), []
        own = np.flatnonzero(later)
        if len(own):  # bucket -1: decided here, goes straight to the spans
            rows.append((-1, source, b"", size[own].astype(np.int32).tobytes(), b"", document[own].astype(np.int32).tobytes(), start[own].tobytes(), b"", b""))
        member = np.flatnonzero(~later)
        member = member[np.argsort(inverse[member], kind="stable")]
        places = np.bincount(inverse[member], minlength=len(first))
        edge = np.append(0, np.cumsum(places))
        for b, y in _split((key[first] % np.uint64(n_buckets)).astype(np.int64), n_buckets):
            f, z = first[y], member[_gather(np.arange(len(member)), edge[y], places[y])]
            rows.append((b, source, ids[document[f]].tobytes(), size[f].astype(np.int32).tobytes(), places[y].astype(np.int32).tobytes(), document[z].astype(np.int32).tobytes(), start[z].tobytes(), place[f].astype(np.int32).tobytes(), _gather(buf, start[f] + offsets[document[f]], size[f]).tobytes()))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return run


def repeated_windows(ids: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(snippet, start, stop)`` of the bytes in strings that a smaller id has as well.

    ``data`` holds the snippets of ``size`` bytes one after the other, ``ids`` their documents.
    """
    edge = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=edge[1:])
    owner = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(data)) - edge[owner]
    order = two_stage_sort(data)
    order = order[offset[order] + LENGTH <= size[owner[order]]]
    if not len(order):
        none = np.zeros(0, np.int64)
        return none, none, none
    same = common_prefixes(eight(data), order) >= LENGTH
    group = np.cumsum(np.append(True, ~same)) - 1
    least = np.minimum.reduceat(ids[owner[order]], np.flatnonzero(np.append(True, ~same)))
    gone = np.sort(order[ids[owner[order]] > least[group]])
    if not len(gone):
        return gone, gone, gone
    head = np.append(True, (gone[1:] != gone[:-1] + 1) | (owner[gone[1:]] != owner[gone[:-1]]))
    first, last = gone[head], gone[np.append(np.flatnonzero(head)[1:] - 1, len(gone) - 1)]
    return owner[first], offset[first], offset[last] + LENGTH


def promising(text: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(snippet, start, size)`` of the parts of different snippets that can have a window in common with another one.

    ``begin``: where a snippet begins in ``text``; ``place``: where its anchor begins in it. Windows in which the anchor
    begins at one of ``STEP`` neighbouring places have ``CORE`` bytes in common; those whose bytes no other snippet has
    go. Windows that are equal have equal places and so equal cores: none of them goes.
    """
    steps = -(-(LENGTH - GRAM + 1) // STEP)
    keeps = np.zeros((len(size), steps + 1), bool)
    low, high = np.zeros((2, len(size), steps), np.int64)
    for k in range(steps):  # windows in their order: those with most bytes before the anchor come first
        first = place - (steps - 1 - k) * STEP
        low[:, k], high[:, k] = np.maximum(first - STEP + 1, 0), np.minimum(first, size - LENGTH)
        some = np.flatnonzero(low[:, k] <= high[:, k])
        core = begin[some] + first[some]
        _, number, n = np.unique(tb.span_hashes(text, core, core + CORE), return_inverse=True, return_counts=True)
        keeps[some[n[number] > 1], k] = True
    begins = keeps[:, :-1].copy()
    begins[:, 1:] &= ~keeps[:, :-2]
    ends = keeps[:, :-1] & ~keeps[:, 1:]
    return np.nonzero(begins)[0], low[begins], high[ends] + LENGTH - low[begins]


def compare_snippets(table: pa.Table) -> pa.Table:
    names, types = ["bucket", "document", "start", "stop"], [pa.int32(), *[pa.binary()] * 3]
    source, doc_id, size, places, document, start, anchor, data = _columns(table, "source", "doc_id", "size", "places", "document", "start", "place", "data")

    def whole(column: pa.Array, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column])

    src = np.repeat(np.asarray(source), [len(x.as_buffer()) // 4 for x in size])
    ids, text, size, places = whole(doc_id, np.int64), whole(data, np.uint8), whole(size, np.int32).astype(np.int64), whole(places, np.int32).astype(np.int64)
    anchor = whole(anchor, np.int32).astype(np.int64)
    document, start, place = whole(document, np.int32), whole(start, np.int64), np.append(0, np.cumsum(places))
    edge = np.append(0, np.cumsum(size))
    by = np.argsort(ids, kind="stable")
    _, first, inverse = np.unique(tb.span_numbers(text, edge[:-1], edge[1:])[by], return_index=True, return_inverse=True)
    copy = by[ids[by] > ids[by[first]][inverse]]
    each = by[first]  # one snippet of every text is sorted, that of the smallest id
    part, begin, length = promising(text, edge[each], size[each], anchor[each])
    found, low, high = repeated_windows(ids[each[part]], length, _gather(text, edge[each[part]] + begin, length))
    snippet, low, high = part[found], low + begin[found], high + begin[found]
    # rows of the keeper's own id in other snippets of this text share its verdict
    mask = (ids[by] == ids[by[first]][inverse]) & (by != by[first][inverse])
    twin, at = by[mask], inverse[mask]
    if len(twin) and len(snippet):
        edges = np.searchsorted(snippet, np.arange(len(each) + 1))
        n = np.diff(edges)[at]
        take = _gather(np.arange(len(snippet)), edges[at], n)
        copied = np.repeat(twin, n), low[take], high[take]
    else:
        copied = twin[:0], low[:0], high[:0]
    which = np.concatenate([copy, each[snippet], copied[0]])
    low = np.concatenate([np.zeros(len(copy), np.int64), low, copied[1]])
    high = np.concatenate([size[copy], high, copied[2]])
    n = places[which]
    at = _gather(np.arange(len(start)), place[which], n)
    which, low, high = np.repeat(which, n), start[at] + np.repeat(low, n), start[at] + np.repeat(high, n)
    rows = []
    for _, x in _split(np.unique(src[which], return_inverse=True)[1], len(which) + 1) if len(which) else ():
        rows.append((int(src[which[x[0]]]), document[at[x]].tobytes(), low[x].tobytes(), high[x].tobytes()))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def cut(with_text: bool):
    """Each text without its removed spans, and the carried columns."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "text" if with_text else "kept_sha256"]

    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        types = [pa.int64()] * 4 + [pa.string()]
        more = [c for c in texts.column_names if c.startswith("carried_")]
        if not len(texts):
            return pa.table([*(pa.array([], t) for t in types), *(texts[c] for c in more)], names=names + more)
        ids, buf, offsets = _bytes(texts)
        delta = np.zeros(len(buf) + 1, np.int64)
        for d, a, b in zip(*_columns(spans, "document", "start", "stop"), strict=True) if len(spans) else ():
            at = offsets[np.frombuffer(d.as_buffer(), np.int32)]
            np.add.at(delta, at + np.frombuffer(a.as_buffer(), np.int64), 1)
            np.add.at(delta, at + np.frombuffer(b.as_buffer(), np.int64), -1)
        gone = np.cumsum(delta[:-1]) > 0
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(buf)]
        head[inner] = gone[inner]
        total, runs = np.zeros(len(buf) + 1, np.int64), np.zeros(len(buf) + 1, np.int64)
        np.cumsum(gone, out=total[1:])
        np.cumsum(head, out=runs[1:])
        removed = total[offsets[1:]] - total[offsets[:-1]]
        left = []
        for i in range(len(ids)):
            a, b = offsets[i], offsets[i + 1]
            rest = buf[a:b] if not removed[i] else buf[a:b][~gone[a:b]]
            left.append(rest.tobytes().decode(errors="ignore") if with_text else sha256(rest).hexdigest())
        return pa.table([pa.array(ids), pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs[offsets[1:]] - runs[offsets[:-1]]), pa.array(left, pa.string()), *(texts[c].take(pa.array(_order(texts))) for c in more)], names=names + more)

    return run


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Figures of every document and the digest of what is left of it."""
    return _deduplicated(docs, False, [])


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, with what is left of each text.

    A cut may split a character; the text has no part of it. A null text becomes an empty one.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    x = _deduplicated(docs, True, others)
    own = {"doc_id": x["doc_id"].cast(docs.schema["doc_id"].dataType), "text": x["text"], **{c: x[f"carried_{i}"] for i, c in enumerate(others)}}
    return x.select(*(own[c].alias(c) for c in docs.columns))


def _deduplicated(docs: DataFrame, with_text: bool, carry: list[str]) -> DataFrame:
    """The figures, the digest or the text, and the columns ``carry`` as ``carried_0`` and so on."""
    n = buckets_for(docs)
    without = f"carried_{len(carry)}"
    rows = distinct_texts(docs, n, LENGTH, [*carry, docs["doc_id"].isNull()])
    more = [f"carried_{i}" for i in range(len(carry) + 1)]
    texts = rows.where(F.col("text").isNotNull()).select("bucket", "doc_id", "text")
    keys = texts.mapInArrow(send_keys(n), KEYS).groupBy("bucket").applyInArrow(answer_keys(n), KEYS)
    snippets = materialized(texts.groupBy("bucket").cogroup(keys.groupBy("bucket")).applyInArrow(send_snippets(n), SNIPPETS))
    spans = snippets.where("bucket >= 0").groupBy("bucket").applyInArrow(compare_snippets, SPANS)
    spans = spans.unionByName(snippets.where("bucket < 0").select(F.col("source").alias("bucket"), "document", "start", "size").mapInArrow(_stops, SPANS))
    schema = SCHEMA.replace("kept_sha256", "text") if with_text else SCHEMA
    schema += "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)
    texts = rows.where(F.col("text").isNotNull()).select("bucket", "doc_id", "text", *more)
    kept = texts.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(cut(with_text), schema)
    empty = F.lit("") if with_text else F.sha2(F.lit(b""), 256)
    gone = rows.where(F.col("text").isNull()).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), empty.alias("text" if with_text else "kept_sha256"), *more)
    return kept.unionByName(gone).withColumn("doc_id", F.when(~F.col(without), F.col("doc_id"))).drop(without)


def _stops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts and sizes as starts and stops."""
    for batch in batches:
        stop = [(np.frombuffer(a.as_buffer(), np.int64) + np.frombuffer(b.as_buffer(), np.int32)).tobytes() for a, b in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(stop, pa.binary())], names=["bucket", "document", "start", "stop"])
