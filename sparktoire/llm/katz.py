"""Language-model scores by Katz backoff over words, of order three.

A document's tokens are its words, lower-cased in A-Z, and one end; two beginnings come before its
first token. The counts of all orders are Good-Turing discounted up to a count of ``LARGEST``; every
n-gram of the training texts is kept, those seen once too. Unknown words are one outcome, which
holds the unigrams' discounted mass. With ``c`` a count, ``d`` its discount and ``v`` the context
``u`` without its first word:

    P(w | u) = d c(u, w) / c(u)  if the n-gram is known, else  alpha(u) P(w | v)
    alpha(u) = (1 - sum of d c(u, w) / c(u)) / (1 - sum of P(w | v)), over the known w after u

and ``alpha`` is 1 for unknown contexts, so each distribution sums to exactly 1 over the vocabulary
and the unknown word. A context all of whose mass is kept has one count added below, so that some is
left.

The documents of each input part are packed into sources of about ``SOURCE_BYTES``, a table bucketed
by source, without a shuffle. In three steps each source sends its distinct words and bigrams, then
its trigrams, with their counts to buckets by hash. The totals come back in the order in which the
keys were sent, so without the keys, as tables bucketed by source like the texts: no step shuffles
them again. The backoff weights follow order by order: a source sends the parts of its contexts'
sums, over the n-grams that it was told to own, and gets the weights; contexts that one source alone
has need no sending, and only sources that have an unknown n-gram after a context get its weight. A word that is in every text so arrives once per source. Scores are evaluated
per token in the source, from the shortest context up.

Defined results: a null text counts as empty (one token, the end); a null ``doc_id`` is hashed as
an empty string; repeated rows are counted and scored one by one; an empty table gives an empty
result; if nothing is in the training part, every token is unknown with probability 1; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sparktoire.llm import textbytes as tb
from sparktoire.llm.common import bucketed, dropped, materialized, text_bytes
from sparktoire.llm.keys import arrow_table, dealt, distinct, of_planes, packed, packed_counts, planes, unpacked, unpacked_counts

SOURCE_BYTES, LEAST_SOURCES = 6 << 20, 16
LARGEST = 5
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
WORD, BIGRAM, TRIGRAM = ORDERS = 0, 1, 2
CONTEXT = 3  # words as contexts, bigrams as the next
N_STATS = LARGEST + 3  # types with counts of 1 to LARGEST + 1, all types, all tokens

SENT = "bucket int, source long, kind int, key binary, n binary, types binary, mass binary, asks binary"
ANSWER = "source long, kind int, bucket int, n binary, own binary, shared binary, alpha binary, stats array<long>"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

_SENT = [("bucket", pa.int32()), ("source", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("key", "n", "types", "mass", "asks"))]
_ANSWER = [("source", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.binary()), ("own", pa.binary()), ("shared", pa.binary()), ("alpha", pa.binary()), ("stats", pa.list_(pa.int64()))]
_SCORES = list(zip(SCHEMA.replace(",", "").split()[::2], [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64()], strict=True))


def discounts(types: list[int]) -> list[float]:
    """Factors of the counts 0 to ``LARGEST``; ``types[r - 1]`` is the number of types seen r times.

    Where the counts of counts don't give factors between 0 and 1, a constant is taken off instead.
    """
    n = [0, *types]
    common = (LARGEST + 1) * n[LARGEST + 1] / n[1] if n[1] else 1
    out = [(((r + 1) * n[r + 1] / (r * n[r])) - common) / (1 - common) if n[r] and common < 1 else 0.0 for r in range(1, LARGEST + 1)]
    if not all(0 < d < 1 for d in out):
        off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        out = [(r - off) / r for r in range(1, LARGEST + 1)]
    return [0.0, *out]


@dataclass
class Model:
    """What all sources need to know: sizes and the discounts of each order, a few numbers."""

    tokens: int
    types: int
    factors: list[np.ndarray]
    unknown: float
    below: int

    @classmethod
    def of(cls, stats: list[list[int]]) -> Model:
        types, tokens = stats[WORD][-2], stats[WORD][-1]
        factors = [np.array(discounts(x[: LARGEST + 1])) for x in stats]
        left = sum(stats[WORD][r - 1] * r * (1 - factors[WORD][r]) for r in range(1, LARGEST + 1))
        below = tokens if left > 0 else tokens + 1
        return cls(tokens, types, factors, (left or 1) / below, below)

    def discounted(self, kind: int, n: np.ndarray) -> np.ndarray:
        return n * np.where(n <= LARGEST, self.factors[kind][np.minimum(n, LARGEST)], 1.0)

    def backoff(self, kind: int, count: np.ndarray, types: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(alpha, what the context's counts are divided by)`` of contexts of n-grams of order ``kind``.

        ``types[r - 1]``: the n-grams after a context with count ``r``, which are all that loses some
        of its mass; ``mass``: the probabilities of all n-grams after it without its first word.
        """
        lost = sum(r * (1 - self.factors[kind][r]) * types[r - 1] for r in range(1, LARGEST + 1))
        below = np.where(lost > 1e-9 * count, count, count + 1.0)
        left = 1 - np.where(count > 0, mass, 0)
        return np.where(count > 0, (lost + below - count) / below / np.where(left > 0, left, 1), 1.0), below

    def p_word(self, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, self.discounted(WORD, n) / self.below, self.unknown)


def packed_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each source: its number, of the input part and its place there, and its compressed rows."""
    part, held, size, number = TaskContext.get().partitionId(), [], 0, 0

    def row() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for x in held:
                out.write_batch(x)
        return pa.RecordBatch.from_arrays([pa.array([part << 24 | number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["source", "rows"])

    for batch in batches:
        for at, end, buf, _ in tb.chunks(batch, "text"):
            held.append(batch.slice(at, end - at))
            size += len(buf)
            if size >= SOURCE_BYTES:
                yield row()
                held, size, number = [], 0, number + 1
    if held:
        yield row()


def texts_of(source: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in source["rows"]])


def tokens(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(token, first)`` of a few MB of texts at a time: the hash of each token, where each text's begin."""
    for batch in table.combine_chunks().to_batches():
        for _, _, buf, offsets in tb.chunks(batch, "text"):
            lower = tb.LOWER[buf]
            starts, ends, first = tb.words(lower, offsets)
            n = len(first) - 1
            at = first + np.arange(n + 1)
            token = np.full(at[-1], END)
            token[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))] = tb.span_hashes(lower, starts, ends)
            yield token, at


def longer(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The key of the n-gram of a context's key and a token's."""
    return tb.mix(context * tb.ODD[0] + token * tb.ODD[1])


_NOTHING = longer(np.array([BEGIN]), np.array([BEGIN]))  # the context of two beginnings


class Source:
    """The n-grams of a source's texts, as places in its sorted distinct keys of each order.

    ``at[k]``: the n-gram that ends at each token; ``context[k]``: the one of the order below that
    comes before the token. The beginnings are contexts, no tokens; they are among the keys for
    their counts.
    """

    def __init__(self, source: pa.Table, orders: int = 3):
        self.number = int(source["source"][0].as_py())
        self.texts = texts = texts_of(source)
        parts = list(tokens(texts))
        token = np.concatenate([p[0] for p in parts])
        self.first = np.append(0, np.cumsum(np.concatenate([np.diff(p[1]) for p in parts])))
        head = self.first[:-1]
        before = np.append(BEGIN, token[:-1])
        before[head] = BEGIN
        pair = longer(before, token)
        longest = np.append(_NOTHING, pair[:-1])
        longest[head] = _NOTHING
        self.keys, self.at, self.context = [], [], []
        for key, begin in ((token, BEGIN), (pair, _NOTHING), (longer(longest, token) if orders == 3 else None, None))[:orders]:
            keys, at = distinct(key if begin is None else np.append(key, begin))
            if begin is not None:
                start, at = int(at[-1]), at[:-1]
                context = np.append(start, at[:-1])
                context[head] = start
                self.context.append(context)
            self.keys.append(keys)
            self.at.append(at)
        self.begins = [int(np.searchsorted(self.keys[WORD], BEGIN)), int(np.searchsorted(self.keys[BIGRAM], _NOTHING[0]))]
        train = ~np.asarray(texts["held_out"].combine_chunks().cast(pa.int8())).astype(bool)
        weight = np.repeat(train, np.diff(self.first))
        self.local = [np.bincount(at, weight, len(k)).astype(np.int64) for at, k in zip(self.at, self.keys, strict=True)]
        for kind, place in enumerate(self.begins):
            self.local[kind][place] = train.sum()

    def listen(self, answers: pa.Table, model: Model, n_buckets: int, step: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Take the totals and weights told before ``step``, in the order of the keys that were sent, order by order.

        Yields for each order of contexts what is known before their weights are: ``(keys to send,
        counts, types, mass, asks)`` of the contexts that other sources have too, with the parts of
        their sums, and whether the source has an unknown n-gram after them and so asks for the
        weight. The contexts of one source get their weights here. ``self.p[k]`` are probabilities of the n-grams.
        """
        rows = {(k, b): i for i, (k, b) in enumerate(zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), strict=True))}
        data = {c: answers[c].combine_chunks() for c in ("n", "own", "shared", "alpha")}
        bits = lambda c, i, n: np.unpackbits(np.frombuffer(data[c][i].as_buffer(), np.uint8), count=n).astype(bool)
        told = [np.zeros(len(k), np.int64) for k in self.keys[: min(step, 3)]]
        own, shared = ([np.zeros(len(k), bool) for k in told] for _ in range(2))
        for kind in range(len(told)):
            for b, x in dealt(self.keys[kind], n_buckets):
                i, n = rows[kind, b], x.stop - x.start
                told[kind][x] = unpacked_counts(data["n"][i].as_buffer(), n)
                own[kind][x], shared[kind][x] = bits("own", i, n), bits("shared", i, n)
        self.told, self.p = told, [model.p_word(told[WORD])]
        for kind in ORDERS[1 : len(told)]:
            example = np.zeros(len(self.keys[kind]), np.int64)
            example[self.at[kind]] = np.arange(len(self.at[kind]))
            context, shorter = self.context[kind - 1][example], self.at[kind - 1][example]
            count = told[kind - 1]
            mine = np.flatnonzero(own[kind])
            types = np.stack([np.bincount(context[some], minlength=len(count)) for some in (mine[told[kind][mine] == r] for r in range(1, LARGEST + 1))])
            mass = np.bincount(context[mine], self.p[-1][shorter[mine]], len(count))
            alpha, below = model.backoff(kind, count, types, mass)
            apart = np.flatnonzero(shared[kind - 1] & (count > 0))
            asks = np.bincount(context[told[kind] == 0], minlength=len(count))[apart] > 0
            yield self.keys[kind - 1][apart], count[apart], types[:, apart], mass[apart], asks
            for b, i in dealt(self.keys[kind - 1][apart], n_buckets):
                row, some = rows[CONTEXT + kind - 1, b], apart[i]
                alpha[some[asks[i]]] = np.frombuffer(data["alpha"][row].as_buffer(), np.float64)
                below[some] = count[some] + bits("own", row, len(some))
            known = told[kind] > 0
            self.p.append(np.where(known, model.discounted(kind, told[kind]) / below[context], alpha[context] * self.p[-1][shorter]))


def _tell(model: Model | None, n_buckets: int, step: int):
    """What each source sends in a step: first its words and bigrams with their counts in training texts, then its
    trigrams with the parts of the sums of the words as contexts, last those of the bigrams."""

    def run(texts: pa.Table, answers: pa.Table | None) -> pa.Table:
        if not len(texts):
            return arrow_table([], _SENT)
        source, rows = Source(texts, min(step + 1, 3)), []
        for kind in ((WORD, BIGRAM), (TRIGRAM,), ())[step - 1]:
            rows += [(b, source.number, kind, packed(source.keys[kind][x], b, n_buckets), packed_counts(source.local[kind][x]), None, None, None) for b, x in dealt(source.keys[kind], n_buckets)]
        if step > 1:
            parts = source.listen(answers, model, n_buckets, step)
            for _ in range(step - 1):
                key, n, types, mass, asks = next(parts)
            rows += [(b, source.number, CONTEXT + step - 2, packed(key[i], b, n_buckets), packed_counts(n[i]), packed_counts(types[:, i].ravel()), planes(mass[i]), np.packbits(asks[i]).tobytes()) for b, i in dealt(key, n_buckets)]
        return arrow_table(rows, _SENT)

    return run


def _alone(tell: Callable[[pa.Table, pa.Table | None], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def run(texts: pa.Table) -> pa.Table:
        return tell(texts, None)

    return run


def _received(table: pa.Table, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, counts, edges)`` of a bucket's rows."""
    bucket = int(table["bucket"][0].as_py())
    parts = [unpacked(x.as_buffer(), bucket, n_buckets) for x in table["key"]]
    n = [unpacked_counts(x.as_buffer(), len(k)) for x, k in zip(table["n"], parts, strict=True)]
    return np.concatenate(parts), np.concatenate(n), np.append(0, np.cumsum([len(k) for k in parts]))


def _totals(sent: pa.Table, kind: int, n_buckets: int, model: Model) -> Iterator[tuple]:
    """The total of each n-gram for every source that sent it, with the one that owns it, and the counts of counts."""
    bucket = int(sent["bucket"][0].as_py())
    key, n, edge = _received(sent, n_buckets)
    key, at = distinct(key)
    total = np.bincount(at, n, len(key)).astype(np.int64)
    begin = (BEGIN, _NOTHING[0], None)[kind]
    counted = total if begin is None else total[key != begin]
    yield -1, kind, bucket, b"", b"", b"", b"", [*(int((counted == r).sum()) for r in range(1, LARGEST + 2)), int((counted > 0).sum()), int(counted.sum())]
    holder = np.full(len(key), len(at), np.int64)  # the first place that counts a key
    counts = np.flatnonzero(n)[::-1]
    holder[at[counts]] = counts
    if begin is not None:
        holder[key == begin] = len(at)
    own, total, shared = holder[at] == np.arange(len(at)), total[at], (np.bincount(at) > 1)[at]
    for i, source in enumerate(sent["source"].to_pylist()):
        x = slice(edge[i], edge[i + 1])
        yield source, kind, bucket, packed_counts(total[x]), np.packbits(own[x]).tobytes(), np.packbits(shared[x]).tobytes(), b"", None


def _weights(sent: pa.Table, kind: int, n_buckets: int, model: Model) -> Iterator[tuple]:
    """The weights of contexts, for every source that sent them."""
    bucket = int(sent["bucket"][0].as_py())
    key, n, edge = _received(sent, n_buckets)
    key, at = distinct(key)
    first = np.empty(len(key), np.int64)
    first[at] = np.arange(len(at))
    size = np.diff(edge)
    types = np.concatenate([unpacked_counts(v.as_buffer(), LARGEST * k).reshape(LARGEST, k) for v, k in zip(sent["types"], size, strict=True)], axis=1)
    types = np.stack([np.bincount(at, x, len(key)) for x in types])
    mass = np.bincount(at, np.concatenate([of_planes(v.as_buffer()) for v in sent["mass"]]), len(key))
    alpha, below = model.backoff(kind - CONTEXT + 1, n[first], types, mass)
    alpha, more = alpha[at], (below > n[first])[at]
    asks = [np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8), count=k).astype(bool) for v, k in zip(sent["asks"], size, strict=True)]
    for i, source in enumerate(sent["source"].to_pylist()):
        x = slice(edge[i], edge[i + 1])
        yield source, kind, bucket, b"", np.packbits(more[x]).tobytes(), b"", alpha[x][asks[i]].tobytes(), None


def _answer(model: Model, n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        rows = []
        for kind in sorted(set(table["kind"].to_pylist())):
            sent = table.filter(pa.compute.equal(table["kind"], kind))
            rows += (_totals if kind < CONTEXT else _weights)(sent, kind, n_buckets, model)
        return arrow_table(rows, _ANSWER)

    return run


def _score(model: Model, n_buckets: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return arrow_table([], _SCORES)
        source = Source(texts)
        for _ in source.listen(answers, model, n_buckets, 4):
            pass
        each, count = source.first[:-1], source.told[WORD]
        base = np.log10((count + 1) / (model.tokens + model.types + 1))[source.at[WORD]]
        score = np.log10(source.p[TRIGRAM])[source.at[TRIGRAM]]
        columns = [np.diff(source.first), np.add.reduceat((count > 0)[source.at[WORD]].astype(np.int64), each), np.full(len(each), model.tokens), np.add.reduceat(base, each), np.add.reduceat(score, each)]
        return pa.table([source.texts["doc_id"], source.texts["held_out"], *(pa.array(c, t) for c, (_, t) in zip(columns, _SCORES[2:], strict=True))], names=[n for n, _ in _SCORES])

    return run


def katz_scores(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """``log10`` probabilities of all texts under the model of those with another crc32 remainder."""
    n = max(LEAST_SOURCES, -(-text_bytes(docs) // SOURCE_BYTES))
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder == held_out).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = bucketed(x.mapInArrow(packed_sources, "source long, rows binary"), n, "source")
    stats, answers = [[0] * N_STATS for _ in ORDERS], None
    sums = [F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(N_STATS)]
    for step in (1, 2, 3):
        model = Model.of(stats)
        each, tell = texts.groupBy("source"), _tell(model, n, step)
        sent = each.applyInArrow(_alone(tell), SENT) if answers is None else each.cogroup(answers.groupBy("source")).applyInArrow(tell, SENT)
        told = materialized(sent.groupBy("bucket").applyInArrow(_answer(model, n), ANSWER))
        for row in told.where("source < 0").groupBy("kind").agg(*sums).collect():
            stats[row["kind"]] = list(row)[1:]
        more = told.where("source >= 0").drop("stats").repartition("source")
        more = bucketed(more if answers is None else answers.unionByName(more), n, "source")
        dropped(told)
        if answers is not None:
            dropped(answers)
        answers = more
    return texts.groupBy("source").cogroup(answers.groupBy("source")).applyInArrow(_score(Model.of(stats), n), SCHEMA)
