"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

The weight of a five-word shingle is its count in the document times its inverse document frequency
``1 + ln(N / df) / ln N``, in steps of 1/255: 2 for a shingle of one document, 1 for one that all
have. ``df`` counts the rows of the whole table, copies too. Consistent weighted samples agree for
two documents with the probability of their weighted Jaccard similarity, so documents of similarity
``SIMILARITY`` share a band of ``ROWS`` samples almost surely (all ``BANDS`` fail for one pair in
27,000 at 0.8).

Exact copies are collapsed first (``copies``). Each bucket of texts sends its distinct shingles to
the buckets of their hashes and gets their frequencies back; a table keeps them beside the texts.
Within a band, up to ``SMALL`` documents are paired with each other; in a larger group every
document is paired with the group's leaders, which are chosen so that each document resembles one,
the most central first. Large groups are first reduced to their leaders in each input chunk, so a
hot group never meets in one task. Pairs are verified on the texts: a leader's text goes once to
each bucket that holds partners. The verified links give classes by label propagation with pointer
jumping, in tables.

Leaders only save pairs, they decide none: a large group whose documents are then still in several
classes is opened again, and all its pairs across classes are verified in tiles of ``TILE`` by
``TILE`` documents, of ``TILE_BYTES`` of text each. So each likely pair of a band is verified or
within a class already, and no link between classes is lost.

Defined results: null and empty texts have no shingles and are only like each other (exact copies);
a text of fewer than five words is one shingle; rows of one ``doc_id`` are one document, and their
texts are in one class; a row without an id is a document of its own text, and a class of such rows
alone has none (its key is a hash of 62 bits above 2^62, so of a billion such texts and a billion ids
up there about one pair in five tables meets and counts as one document; in ``representatives`` such a row may
stand for a class of larger ids); an empty table gives an empty result; other columns are ignored or,
in ``representatives``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparktoire.llm import textbytes as tb
from sparktoire.llm.common import bucketed, dropped, materialized
from sparktoire.llm.copies import buckets_for, distinct_texts
from sparktoire.llm.keys import arrow_table, dealt, distinct, packed, packed_counts, unpacked, unpacked_counts
from sparktoire.llm.lookup import looked_up

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 2
SMALL = 16
TILE, TILE_BYTES = 1024, 4 << 20
#: Share of equal samples from which a pair is verified; at 0.8, one pair in 66,000 has fewer.
LIKELY = 0.4
#: Rows without an id have keys from here on, among the large ids.
NO_ID = 1 << 62
STEPS = 255
_SEEDS = tb.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

SENT = "bucket int, source int, key binary, n binary"
ANSWER = "source int, bucket int, idf binary"
WEIGHTED = "bucket int, doc_id long, n_bytes long, text string, idf binary"
BLOBS = "bucket int, key binary, doc binary, home binary, samples binary"
PAIRS = "home int, doc binary, other binary, other_home binary"
FOUND = f"{PAIRS}, key binary, samples binary"
MEMBERS = "key long, doc long, home int, samples binary"
TEXTS = "homes array<int>, other long, text string, idf binary"

_SENT = [("bucket", pa.int32()), ("source", pa.int32()), ("key", pa.binary()), ("n", pa.binary())]
_ANSWER = [("source", pa.int32()), ("bucket", pa.int32()), ("idf", pa.binary())]
_LINK = [("doc_id", pa.int64()), ("other_id", pa.int64()), ("similarity", pa.float64())]


# ---- shingles and their document frequencies ----------------------------------------------------


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, count, first)``: distinct shingles of each text, sorted by hash within it."""
    starts, ends, first = tb.words(buf, offsets)
    shingle, at = tb.shingle_hashes(tb.span_hashes(buf, starts, ends), first, SHINGLE)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    by = np.argsort(shingle)
    by = by[np.argsort(doc[by].astype(np.uint16 if len(at) <= 1 << 16 else np.int64), kind="stable")]
    shingle, doc = shingle[by], doc[by]
    head = np.flatnonzero(np.append(True, (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1]))[: len(doc)])
    return shingle[head], np.diff(np.append(head, len(doc))), np.searchsorted(doc[head], np.arange(len(at)))


def _own(table: pa.Table, *columns: str) -> tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """A bucket's rows and the shingle sets of its texts, chunk by chunk."""
    batch = table.select([*columns, "text"]).combine_chunks().to_batches()
    return batch, [shingle_sets(buf, offsets) for x in batch for _, _, buf, offsets in tb.chunks(x, "text")]


def _send_shingles(n_buckets: int):
    """The distinct shingles of a bucket, and the rows that have them."""

    def run(texts: pa.Table) -> pa.Table:
        _, parts = _own(texts)
        n_copies = np.asarray(texts["n_copies"].combine_chunks())
        shingle = np.concatenate([x[0] for x in parts])
        each = np.repeat(n_copies, np.concatenate([np.diff(x[2]) for x in parts]))
        key, at = distinct(shingle)
        n = np.bincount(at, each, len(key)).astype(np.int64)
        source = texts["bucket"][0].as_py()
        return arrow_table([(b, source, packed(key[x], b, n_buckets), packed_counts(n[x])) for b, x in dealt(key, n_buckets)], _SENT)

    return run


def steps_of(df: np.ndarray, total: int) -> np.ndarray:
    """Inverse document frequencies, 0 to ``STEPS``: ``ln(N / df) / ln N`` in steps."""
    return np.round(STEPS * np.log(total / df) / np.log(total)) if total > 1 else np.full(len(df), STEPS)


def _frequencies(total: int, n_buckets: int):
    """The frequency of each key of a bucket, for every source that sent it."""

    def run(table: pa.Table) -> pa.Table:
        bucket, sources = int(table["bucket"][0].as_py()), table["source"].to_pylist()
        parts = [unpacked(x.as_buffer(), bucket, n_buckets) for x in table["key"]]
        n = np.concatenate([unpacked_counts(x.as_buffer(), len(k)) for x, k in zip(table["n"], parts, strict=True)])
        edge = np.append(0, np.cumsum([len(k) for k in parts]))
        key, at = distinct(np.concatenate(parts))
        idf = steps_of(np.bincount(at, n, len(key)), total).astype(np.uint8)[at]
        return arrow_table([(s, bucket, idf[edge[i] : edge[i + 1]].tobytes()) for i, s in enumerate(sources)], _ANSWER)

    return run


def _weigh(n_buckets: int):
    """A bucket's texts with the inverse document frequencies of their shingles, a byte each."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        names, types = ["bucket", "doc_id", "n_bytes", "text", "idf"], [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        if not len(texts):
            return pa.table([pa.array([], t) for t in types], names=names)
        _, parts = _own(texts)
        key, at = distinct(np.concatenate([x[0] for x in parts]))
        size = np.concatenate([np.diff(x[2]) for x in parts])
        told = {b: np.frombuffer(v.as_buffer(), np.uint8) for b, v in zip(answers["bucket"].to_pylist(), answers["idf"], strict=True)}
        idf = np.zeros(len(key), np.uint8)
        for b, x in dealt(key, n_buckets):
            idf[x] = told[b]
        offsets = np.append(0, np.cumsum(size)).astype(np.int32)
        column = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(idf[at])])
        return pa.table([*(texts[c] for c in names[:4]), column], names=names)

    return run


def weighted_texts(rows: DataFrame, n_buckets: int, total: int) -> DataFrame:
    """``bucket, doc_id, n_bytes, text, idf`` of the distinct texts, in a table bucketed like ``rows``."""
    texts = rows.where(F.col("text").isNotNull()).select("bucket", "doc_id", "n_bytes", "n_copies", "text")
    sent = texts.groupBy("bucket").applyInArrow(_send_shingles(n_buckets), SENT)
    answers = materialized(sent.groupBy("bucket").applyInArrow(_frequencies(total, n_buckets), ANSWER))
    weighted = bucketed(texts.groupBy("bucket").cogroup(answers.groupBy("source")).applyInArrow(_weigh(n_buckets), WEIGHTED), n_buckets, "bucket")
    dropped(answers)
    return weighted


def weighted_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, end, hash, weight, first)`` of a few MB of weighted texts at a time."""
    idf = batch.column(batch.schema.get_field_index("idf"))
    for row, end, buf, offsets in tb.chunks(batch, "text"):
        shingle, count, first = shingle_sets(buf, offsets)
        steps = np.frombuffer(b"".join(x.as_py() for x in idf.slice(row, end - row)), np.uint8)
        yield row, end, shingle, count * (1 + steps / STEPS), first


# ---- samples ------------------------------------------------------------------------------------


def _unit(bits: np.ndarray) -> np.ndarray:
    return ((bits & np.uint64(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21)


def samples(shingle: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of ``BANDS * ROWS`` consistent weighted samples for each text that has a shingle.

    A sample is the pair of shingle and quantised weight of the least ``ln c - ln y - r``, where
    ``ln y = r * (floor(ln w / r + beta) - beta)``; ``r`` and ``c`` follow Gamma(2, 1), ``beta`` is
    uniform, and all three depend on the shingle and the sample's number alone.
    """
    log_w = np.log(weight).astype(np.float32)
    begin, size = first[:-1], np.diff(first)
    out = np.zeros((len(begin), len(_SEEDS)), np.uint64)
    for k, seed in enumerate(_SEEDS):
        z = tb.mix(shingle ^ seed)
        y = z * np.uint64(0xD6E8FEB86659FD93) ^ (z >> np.uint64(29))
        r = -np.log(_unit(z) * _unit(z >> np.uint64(21)))
        log_c = np.log(-np.log(_unit(y) * _unit(y >> np.uint64(21))))
        beta = _unit(z >> np.uint64(42))
        t = np.floor(log_w / r + beta)
        value = log_c - r * (t - beta) - r
        least = np.minimum.reduceat(value, begin)
        hit = np.flatnonzero(value == np.repeat(least, size))
        hit = hit[np.searchsorted(hit, begin)]
        out[:, k] = tb.mix(shingle[hit] + (t[hit].astype(np.int64).view(np.uint64) << np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
    return out


# ---- candidate pairs --------------------------------------------------------------------------


def pair_up(key: np.ndarray, doc: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, covered)``: rows to verify, and the rows of large groups that their leaders stand for.

    Rows of equal ``key`` are a group. ``signature``: a byte of each sample.
    """
    by = np.lexsort((tb.mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), key))
    k = key[by]
    edge = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)]), len(k))
    size = np.diff(edge)
    group = np.repeat(np.arange(len(size)), size)
    alike = lambda a, b: (signature[a] == signature[b]).mean(axis=-1)
    left, right, covered = [], [], np.zeros(len(key), bool)
    small = size[group] <= SMALL
    for step in range(1, SMALL):
        i = np.flatnonzero(small[:-step] & (group[step:] == group[:-step])) if step < len(k) else np.zeros(0, np.int64)
        if not len(i):
            break
        a, b = by[i + step], by[i]
        ok = alike(a, b) >= LIKELY
        left.append(a[ok])
        right.append(b[ok])
    for g in np.flatnonzero(size > SMALL):
        member = by[edge[g] : edge[g + 1]]
        shared = sum(np.bincount(x)[x] for x in signature[member].T)
        member = member[np.argsort(-shared, kind="stable")]
        rest, leaders = member, []
        while len(rest):
            leaders.append(rest[0])
            rest = rest[1:]
            rest = rest[alike(rest, leaders[-1]) < 0.7]
        for x in leaders:
            ok = member[(alike(member, x) >= LIKELY) & (member != x)]
            left.append(ok)
            right.append(np.full(len(ok), x))
        covered[np.setdiff1d(member, leaders)] = True
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    ok = doc[a] != doc[b]
    return a[ok], b[ok], covered


def _pair_rows(doc: np.ndarray, home: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Distinct pairs, in a row for each home of the first."""
    if len(a):
        _, x = np.unique(np.stack([doc[a], doc[b]], 1), axis=0, return_index=True)
        a, b = a[x], b[x]
        by = np.argsort(home[a], kind="stable")
        a, b = a[by], b[by]
        for part in np.split(np.arange(len(a)), np.flatnonzero(home[a][1:] != home[a][:-1]) + 1):
            yield int(home[a[part[0]]]), doc[a[part]].tobytes(), doc[b[part]].tobytes(), home[b[part]].tobytes()


def _send_bands(n_buckets: int):
    """Rows of bands for each bucket; bucket -1 has the pairs found within a chunk, -2 the rows that stay there.

    The other rows of a group of which some stay have the complement of their home.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, homes = np.asarray(batch.column(1)), np.asarray(batch.column(0))
            for row, end, shingle, weight, first in weighted_sets(batch):
                has = np.flatnonzero(np.diff(first))
                if not len(has):
                    continue
                sample = samples(shingle, weight, np.append(first[has], first[-1]))
                key = np.zeros((len(has), BANDS), np.uint64)
                for band in range(BANDS):
                    for j in range(ROWS):
                        key[:, band] += sample[:, band * ROWS + j] * tb.ODD[j]
                    key[:, band] = tb.mix(key[:, band] + np.uint64(band))
                doc, home = np.repeat(ids[row:end][has], BANDS), np.repeat(homes[row:end][has], BANDS).astype(np.int32)
                key, signature = key.ravel(), (sample & np.uint64(0xFF)).astype(np.uint8)
                each = np.repeat(np.arange(len(has)), BANDS)
                _, at, n = np.unique(key, return_inverse=True, return_counts=True)
                large = np.flatnonzero(n[at] > SMALL)
                a, b, covered = pair_up(key[large], doc[large], signature[each[large]])
                rows = [(-1, y, x, np.int32(h).tobytes(), z) for h, x, y, z in _pair_rows(doc, home, large[a], large[b])]
                keep, stay = np.ones(len(key), bool), large[covered]
                keep[stay] = False
                if len(stay):
                    rows.append((-2, key[stay].tobytes(), doc[stay].tobytes(), home[stay].tobytes(), signature[each[stay]].tobytes()))
                home[large] = ~home[large]
                to = (key % np.uint64(n_buckets)).astype(np.int64)
                by = np.flatnonzero(keep)
                by = by[np.argsort(to[by], kind="stable")]
                edge = np.searchsorted(to[by], np.arange(n_buckets + 1))
                for t in np.flatnonzero(np.diff(edge)):
                    x = by[edge[t] : edge[t + 1]]
                    rows.append((int(t), key[x].tobytes(), doc[x].tobytes(), home[x].tobytes(), signature[each[x]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(5)], names=["bucket", "key", "doc", "home", "samples"])

    return run


def _match_bands(table: pa.Table) -> pa.Table:
    def whole(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name]])

    key, doc, home = whole("key", np.uint64), whole("doc", np.int64), whole("home", np.int32)
    signature = whole("samples", np.uint8).reshape(len(doc), BANDS * ROWS)
    partly, home = home < 0, np.where(home < 0, ~home, home)
    a, b, _ = pair_up(key, doc, signature)
    rows = [(*r, None, None) for r in _pair_rows(doc, home, a, b)]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    x = np.flatnonzero(((n > SMALL) | (np.bincount(at, partly, len(n)) > 0))[at])
    if len(x):
        rows.append((-1, doc[x].tobytes(), None, home[x].tobytes(), key[x].tobytes(), signature[x].tobytes()))
    return pa.table([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(6)], names=["home", "doc", "other", "other_home", "key", "samples"])


def _local_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        home = pa.array([int(np.frombuffer(x.as_buffer(), np.int32)[0]) for x in batch.column(3)], pa.int32())
        yield pa.RecordBatch.from_arrays([home, batch.column(2), batch.column(1), batch.column(4)], names=["home", "doc", "other", "other_home"])


# ---- large groups in several classes ----------------------------------------------------------


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of the packed rows of ``key, doc, home, samples``."""
    width = BANDS * ROWS
    for batch in batches:
        for key, doc, home, sample in zip(*batch.columns, strict=True):
            sample = sample.as_buffer()
            n = len(sample) // width
            sample = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, sample]).cast(pa.binary())
            columns = [pa.array(np.frombuffer(x.as_buffer(), kind)) for x, kind in ((key, np.int64), (doc, np.int64), (home, np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, sample], names=["key", "doc", "home", "samples"])


def _with_texts(texts: pa.Table, asked: pa.Table) -> pa.Table:
    """The rows of tiles that ask for a bucket's texts, with the text for the home."""
    at = asked.column_names.index("home")
    ids = np.asarray(texts["doc_id"].combine_chunks()) if len(texts) else np.zeros(0, np.int64)
    by = np.argsort(ids, kind="stable")
    found = pa.array(by[np.searchsorted(ids[by], np.asarray(asked["doc"].combine_chunks()))] if len(asked) else np.zeros(0, np.int64))
    text, idf = (texts[c].combine_chunks().take(found) if len(asked) else pa.array([], t) for c, t in (("text", pa.string()), ("idf", pa.binary())))
    return asked.set_column(at, "text", text).append_column("idf", idf)


def _tile_links(similarity: float):
    """The links across classes in each tile of a bucket: one for each class that a document joins, so fewer than documents."""

    def run(table: pa.Table) -> pa.Table:
        key, doc, label, block, low, high = (np.asarray(table[c].combine_chunks()) for c in ("key", "doc", "label", "block", "low", "high"))
        signature = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in table["samples"]])
        _, one, text = np.unique(doc, return_index=True, return_inverse=True)
        parts = _weighted(table, one)
        _, item = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        weight, size = np.concatenate([x[1] for x in parts]), np.concatenate([np.diff(x[2]) for x in parts])
        first = np.append(0, np.cumsum(size))[:-1]
        total, mine = np.add.reduceat(weight, first), np.zeros(item.max() + 1)
        del parts, table
        by = np.lexsort((doc, high, low, key))
        new = (np.diff(key[by]) != 0) | (np.diff(low[by]) != 0) | (np.diff(high[by]) != 0)
        rows = []
        for tile in np.split(by, np.flatnonzero(new) + 1):
            shared = sum(np.bincount(x)[x] for x in signature[tile].T)
            tile = tile[np.argsort(-shared, kind="stable")]
            group, same = label[tile].copy(), low[tile[0]] == high[tile[0]]
            side = block[tile] == high[tile]
            for i in np.arange(len(tile)) if same else np.flatnonzero(~side):
                y = np.flatnonzero(group != group[i]) if same else np.flatnonzero(side & (group != group[i]))
                y = y[y > i] if same else y
                y = y[(signature[tile[y]] == signature[tile[i]]).mean(axis=-1) >= LIKELY]
                if not len(y):
                    continue
                x, others = text[tile[i]], text[tile[y]]
                own = slice(first[x], first[x] + size[x])
                mine[item[own]] = weight[own]
                edge = np.append(0, np.cumsum(size[others]))
                take = np.repeat(first[others] - edge[:-1], size[others]) + np.arange(edge[-1])
                both = np.add.reduceat(np.minimum(weight[take], mine[item[take]]), edge[:-1])
                mine[item[own]] = 0
                value = both / (total[x] + total[others] - both)
                ok = np.flatnonzero(value >= similarity)
                joined, at = np.unique(group[y[ok]], return_index=True)
                ok = ok[at]
                rows += zip(np.repeat(doc[tile[i]], len(ok)), doc[tile[y[ok]]], value[ok], strict=True)
                group[np.isin(group, joined)] = group[i]
        return arrow_table(rows, _LINK)

    return run


def open_tiles(members: DataFrame, labels: DataFrame, sizes: DataFrame, n_buckets: int) -> DataFrame:
    """The tiles of every group whose ``members`` are in several classes: those of all its pairs but the ones in its largest class.

    ``sizes``: the bytes ``n_bytes`` of each ``doc``.
    """
    at = members.join(labels.select(F.col("node").alias("doc"), "label"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    at = materialized(at.join(sizes, "doc"))
    tiles = F.greatest(F.count(F.lit(1)) / TILE, F.sum("n_bytes") / TILE_BYTES)  # so many, in documents or in bytes
    parts = at.groupBy("key", "label").agg(tiles.alias("n"))
    groups = parts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    groups = groups.select("key", "largest", F.ceil("most").alias("inside"), F.ceil(F.col("n") - F.col("most")).alias("outside"))
    number = F.xxhash64("doc")
    block = F.when(F.col("label") == F.col("largest"), F.col("outside") + F.pmod(number, "inside")).otherwise(F.pmod(number, "outside"))
    against = F.when(F.col("label") == F.col("largest"), F.col("outside")).otherwise(F.col("outside") + F.col("inside"))
    x = at.join(groups, "key").withColumn("block", block).withColumn("against", F.explode(F.sequence(F.lit(0).cast("long"), against - 1)))
    x = x.withColumns({"low": F.least("block", "against"), "high": F.greatest("block", "against")})
    tile = F.pmod(F.xxhash64("key", "low", "high"), F.lit(64 * n_buckets))
    return x.select(tile.alias("tile"), "key", "low", "high", "block", "doc", "label", "samples", "home")


def tile_links(texts: DataFrame, tiles: DataFrame, similarity: float) -> DataFrame:
    """``doc_id, other_id, similarity`` of the links across classes in ``tiles``, written. A text goes once to each tile."""
    rows = "tile long, key long, low long, high long, block long, doc long, label long, samples binary, text string, idf binary"
    full = texts.groupBy("bucket").cogroup(tiles.groupBy("home")).applyInArrow(_with_texts, rows)
    return materialized(full.groupBy("tile").applyInArrow(_tile_links(similarity), "doc_id long, other_id long, similarity double"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links: those of the classes of classes."""
    of = lambda c, out: links.select("doc_id", "other_id").join(labels.select(F.col("node").alias(c), F.col("label").alias(out)), c, "left")
    ends = of("doc_id", "a").join(labels.select(F.col("node").alias("other_id"), F.col("label").alias("b")), "other_id", "left")
    ends = ends.select(F.coalesce("a", "doc_id").alias("doc_id"), F.coalesce("b", "other_id").alias("other_id"))
    tops = classes(ends.where("doc_id <> other_id").distinct()).select(F.col("node").alias("label"), F.col("label").alias("top"))
    nodes = materialized(links.select(F.explode(F.array("doc_id", "other_id")).alias("node")).distinct())
    single = nodes.join(labels, "node", "left_anti")
    every = labels.unionByName(single.select("node", F.col("node").alias("label")))
    return materialized(every.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label")))


# ---- verification -----------------------------------------------------------------------------


def _decode_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    doc, other, home = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[c]]) for c, kind in (("doc", np.int64), ("other", np.int64), ("other_home", np.int32)))
    _, x = np.unique(np.stack([doc, other], 1), axis=0, return_index=True)
    return doc[x], other[x], home[x]


def _ask(table: pa.Table) -> pa.Table:
    """Turn a home's pairs round: which texts of other homes it needs, once each."""
    _, other, home = _decode_pairs(table)
    _, x = np.unique(other, return_index=True)
    other, home = other[x], home[x]
    rows = [(int(h), table["home"][0].as_py(), other[home == h].tobytes()) for h in np.unique(home)]
    return pa.table([pa.array([r[i] for r in rows], (pa.int32(), pa.int32(), pa.binary())[i]) for i in range(3)], names=["home", "asker", "other"])


def _send_texts(texts: pa.Table, asked: pa.Table) -> pa.Table:
    """The texts that others ask for, once each, with the homes to send them to."""
    names, types = ["homes", "other", "text", "idf"], [pa.list_(pa.int32()), pa.int64(), pa.string(), pa.binary()]
    if not len(texts) or not len(asked):
        return pa.table([pa.array([], t) for t in types], names=names)
    ids = np.asarray(texts["doc_id"].combine_chunks())
    want = [np.frombuffer(x.as_buffer(), np.int64) for x in asked["other"]]
    home = np.repeat(np.asarray(asked["asker"].combine_chunks()), [len(x) for x in want])
    want = np.concatenate(want)
    by = np.argsort(want, kind="stable")
    want, home = want[by], home[by]
    at = np.flatnonzero(np.isin(ids, want))
    low, high = np.searchsorted(want, ids[at]), np.searchsorted(want, ids[at], "right")
    homes = [home[i:j] for i, j in zip(low, high, strict=True)]
    return pa.table([pa.array(homes, types[0]), pa.array(ids[at]), *(texts[c].combine_chunks().take(pa.array(at)) for c in names[2:])], names=names)


def _weighted(texts: pa.Table, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(hash, weight, first)`` of some rows, chunk by chunk."""
    some = texts.select(["text", "idf"]).take(pa.array(rows)).combine_chunks()
    return [x[2:] for batch in some.to_batches() for x in weighted_sets(batch)]


def similarities(left: tuple, right: tuple, a: np.ndarray, b: np.ndarray, batch: int = 1000) -> np.ndarray:
    """Weighted Jaccard similarity of the texts ``a`` of ``left`` and ``b`` of ``right``."""
    out = np.zeros(len(a))
    for at in range(0, len(a), batch):
        pair, hashes, weights = [], [], []
        for (shingle, weight, first), x in ((left, a[at : at + batch]), (right, b[at : at + batch])):
            size = (first[1:] - first[:-1])[x]
            total = np.append(0, np.cumsum(size))
            take = np.repeat(first[x] - total[:-1], size) + np.arange(total[-1])
            pair.append(np.repeat(np.arange(len(x)), size))
            hashes.append(shingle[take])
            weights.append(weight[take])
        p, h, w = map(np.concatenate, (pair, hashes, weights))
        n = len(a[at : at + batch])
        total = np.bincount(p, w, n)
        by = np.lexsort((h, p))
        p, h, w = p[by], h[by], w[by]
        same = np.flatnonzero((p[1:] == p[:-1]) & (h[1:] == h[:-1]))
        both = np.bincount(p[same], np.minimum(w[same], w[same + 1]), n)
        out[at : at + batch] = both / np.maximum(total - both, 1e-300)
    return out


def _verify(similarity: float):
    empty = pa.table([pa.array([], t) for _, t in _LINK], names=[n for n, _ in _LINK])

    def some(texts: pa.Table, name: str, wanted: np.ndarray) -> tuple[np.ndarray, tuple]:
        ids = np.asarray(texts[name].combine_chunks())
        keep = np.flatnonzero(np.isin(ids, wanted))
        keep = keep[np.argsort(ids[keep], kind="stable")]
        parts = _weighted(texts, keep)
        first = np.append(0, np.cumsum(np.concatenate([np.diff(x[2]) for x in parts])))
        return ids[keep], (np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), first)

    def run(texts: pa.Table, others: pa.Table) -> pa.Table:
        pairs, sent = others.filter(pa.compute.is_valid(others["doc"])), others.filter(pa.compute.is_valid(others["text"]))
        doc, other, _ = _decode_pairs(pairs)
        if not len(doc) or not len(texts):
            return empty
        own, left = some(texts, "doc_id", doc)
        far, right = some(sent, "sent", other)
        # an id with several texts is like another if one of them is
        first, second = np.searchsorted(own, doc), np.searchsorted(far, other)
        n, m = np.searchsorted(own, doc, "right") - first, np.searchsorted(far, other, "right") - second
        pair = np.repeat(np.arange(len(doc)), n * m)
        step = np.arange(len(pair)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        value = similarities(left, right, first[pair] + step // m[pair], second[pair] + step % m[pair])
        ok = value >= similarity
        return pa.table([pa.array(doc[pair[ok]]), pa.array(other[pair[ok]]), pa.array(value[ok])], names=empty.column_names)

    return run


# ---- classes ----------------------------------------------------------------------------------


def classes(links: DataFrame) -> DataFrame:
    """``node, label``: the least node of each connected component of the links ``doc_id, other_id``.

    Each round gives a node the least label of its neighbours, then the label of its label; rounds
    end when no label changes. Only the number of changes comes to the driver.
    """
    both = links.select(F.col("doc_id").alias("node"), F.col("other_id").alias("next"))
    both = materialized(both.unionByName(both.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct())
    labels = materialized(both.groupBy("node").agg(F.min("next").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "next"), "next").groupBy("node").agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialized(moved.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = new.where("label < was").limit(1).count()
        dropped(labels)
        labels = new.select("node", "label")
        if not changed:
            dropped(both)
            return labels


def verified(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """``doc_id, other_id, similarity`` of the pairs that are similar, written."""
    asked = pairs.groupBy("home").applyInArrow(_ask, "home int, asker int, other binary")
    sent = texts.groupBy("bucket").cogroup(asked.groupBy("home")).applyInArrow(_send_texts, TEXTS)
    sent = sent.select(F.explode("homes").alias("home"), F.col("other").alias("sent"), "text", "idf")
    both = pairs.select("home", "doc", "other", "other_home", F.lit(None).cast("long").alias("sent"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("idf"))
    none = F.lit(None).cast("binary")
    both = both.unionByName(sent.select("home", none.alias("doc"), none.alias("other"), none.alias("other_home"), "sent", "text", "idf"))
    return materialized(texts.groupBy("bucket").cogroup(both.groupBy("home")).applyInArrow(_verify(similarity), "doc_id long, other_id long, similarity double"))


def _repeated_ids(rows: DataFrame) -> DataFrame:
    """``doc_id, other_id, similarity``: links between the texts of each id that has several."""
    several = rows.groupBy("doc_id").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a < b").select("doc_id")
    owners = rows.select("doc_id", "owner").join(several, "doc_id", "left_semi").distinct()
    tops = rows.groupBy(F.col("doc_id").alias("owner")).agg(F.min("owner").alias("top"))
    return owners.join(tops, "owner").select("doc_id", F.col("top").alias("other_id"), F.lit(1.0).alias("similarity")).where("doc_id <> other_id")


def _class_labels(rows: DataFrame, n_buckets: int, total: int, similarity: float) -> DataFrame:
    """``node, label`` of the classes of more than one text."""
    texts = weighted_texts(rows, n_buckets, total)
    blobs = materialized(texts.select("bucket", "doc_id", "text", "idf").mapInArrow(_send_bands(n_buckets), BLOBS))
    found = materialized(blobs.where("bucket >= 0").groupBy("bucket").applyInArrow(_match_bands, FOUND))
    near = blobs.where("bucket = -1").mapInArrow(_local_pairs, PAIRS)
    pairs = materialized(found.where("home >= 0").drop("key", "samples").unionByName(near))
    full = texts.select("bucket", "doc_id", "text", "idf")
    links = verified(full, pairs, similarity)
    dropped(pairs)
    links = materialized(links.unionByName(_repeated_ids(rows)))
    labels = classes(links)
    stay = blobs.where("bucket = -2").select("key", "doc", "home", "samples")
    members = found.where("home < 0").select("key", "doc", F.col("other_home").alias("home"), "samples").unionByName(stay)
    sizes = texts.groupBy(F.col("doc_id").alias("doc")).agg(F.max("n_bytes").alias("n_bytes"))
    tiles = materialized(open_tiles(members.mapInArrow(_members, MEMBERS), labels, sizes, n_buckets))
    dropped(blobs)
    dropped(found)
    if not tiles.isEmpty():
        labels = merged(labels, tile_links(full, tiles, similarity))
    dropped(tiles)
    dropped(texts)
    return labels


def _classified(docs: DataFrame, similarity: float, carry: list[str | Column]) -> DataFrame:
    """``doc_id, class_id, text`` (null for copies) of every row, and the columns ``carry`` as ``carried_0`` and so on."""
    n = buckets_for(docs)
    hashed = F.lit(NO_ID) + F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(NO_ID))
    rows = distinct_texts(docs, n, carry=carry, no_id=hashed)
    labels = _class_labels(rows, n, docs.count(), similarity)
    # an owner's label first: the many rows of a hot text then meet only those of their own chunk
    tops = rows.groupBy("doc_id").agg(F.min("owner").alias("top"))
    owners = tops.join(labels, F.col("top") == F.col("node"), "left").select(F.col("doc_id").alias("owner"), F.coalesce("label", "top").alias("class_id"))
    return rows.join(owners, "owner").select("doc_id", "class_id", "text", *(f"carried_{i}" for i in range(len(carry))))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id``: the least id of each document's class."""
    x = _classified(docs, similarity, [docs["doc_id"].isNull()])
    x = materialized(x.select(F.when(~F.col("carried_0"), F.col("doc_id")).alias("doc_id"), "class_id"))
    high = x.where(F.col("class_id") >= NO_ID)
    if high.isEmpty():
        return x
    # such a key is a row's without an id or a large id: the class has the least of its ids, if it has any
    least = high.groupBy("class_id").agg(F.min("doc_id").alias("least"))
    named = looked_up(materialized(high), least, "class_id", "left").select("doc_id", F.col("least").alias("class_id"))
    return x.where(F.col("class_id") < NO_ID).unionByName(named)


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that of the least id, with all its columns."""
    carry = [c for c in docs.columns if c != "text"]
    x = materialized(_classified(docs, similarity, [*carry, F.col("text").isNull()]).where("text IS NOT NULL AND doc_id = class_id"))
    repeated = x.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        x = x.join(repeated, "doc_id", "left_anti").unionByName(x.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    own = {"text": F.when(~x[f"carried_{len(carry)}"], x["text"]), **{c: x[f"carried_{i}"] for i, c in enumerate(carry)}}
    return x.select(*(own[c].alias(c) for c in docs.columns))
