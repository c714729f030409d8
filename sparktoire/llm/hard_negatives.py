"""Hard negatives by a vantage-point tree: for an anchor and a positive, near rows of other labels.

Scores are inner products of quantised vectors. A row ``x`` gets one more coordinate,
``sqrt(M - |x|^2)`` with ``M`` the largest squared norm of all rows, and an anchor ``q`` gets 0: then
``|q' - x'|^2 = M + |q|^2 - 2 <q, x>``, so the nearest row has the highest score and a window of scores
is an annulus around the anchor. The tree has two levels. Its top is grown on a sample of at most
``SAMPLE`` rows and has at most ``CELLS`` cells; every row goes to a cell, a cell's rows to blocks of about
``BLOCK`` rows by a hash (so a cell of many equal vectors is no larger task than others), and each block
has a tree of its own, kept in a written table. The sample only decides how well cells separate:
every row is indexed and the search is exact.

A search visits nodes and rows in the order of the least distance they can have, in one queue: a node
whose bounds lie outside the annulus is never opened, and rows leave the queue in their final order,
until there are enough. An anchor is sent to the blocks of the cells that its annulus meets; what the
blocks return is merged by rank. Anchors of a block are dealt to groups of about ``ANCHORS``, so neither
a block nor a group of anchors grows with the data.

Defined results: rows with a null label, a null vector or a null, NaN or infinite component take no part;
vectors shorter than the longest are padded with zeros, an empty one scores 0 with all; a row without
an id is no anchor, keeps its label and comes last among ties; rows of one id are separate rows, each of
them an anchor if the id is one; ties of score and id are in the order of the rows; scores that 64 bits
can't hold become the nearest number that they can; an empty table gives no rows; other columns don't
matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparktoire.llm.common import dropped, materialized

ANCHOR_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from the first to the second percentage of its positive's.
LOW_PERCENT, HIGH_PERCENT = 50, 95
SCALE = 256
BLOCK, LEAF, ANCHORS = 2048, 256, 4096
CELLS, SAMPLE = 256, 4096
#: Sums of products below it are exact in a double.
EXACT = float(1 << 53)
LAST = (1 << 63) - 1


# ---- scores and trees ---------------------------------------------------------------------------


def scores(x: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows of whole numbers with one; exact, whatever their size."""
    if most < EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    found = [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x]
    return np.array([max(-LAST - 1, min(LAST, v)) for v in found], np.int64)


def distances(x: np.ndarray, q: np.ndarray, q_extra: float, most: float) -> np.ndarray:
    """Distances of augmented rows to an augmented point."""
    norms = np.einsum("ij,ij->i", x, x)
    extra = np.sqrt(np.maximum(most - norms, 0)) - q_extra
    return np.sqrt(np.maximum(norms + q @ q - 2 * (x @ q) + extra * extra, 0))


@dataclass
class Tree:
    """Nodes of a vantage-point tree: a node that is no leaf has a vantage point, two children and the
    distances of each child's rows from it; a leaf has a run of rows."""

    vantage: np.ndarray
    child: np.ndarray
    near: np.ndarray
    far: np.ndarray
    run: np.ndarray


def grown(x: np.ndarray, most: float, leaf: int) -> tuple[Tree, np.ndarray]:
    """``(tree, order of the rows)``; a node is split at the median distance from its row farthest from another."""
    vantage, child, near, far, run, order = [], [], [], [], [], []
    extra = np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0)) if most < EXACT else np.zeros(len(x))

    def add(rows: np.ndarray) -> int:
        me = len(run)
        vantage.append(np.zeros(x.shape[1] + 1))
        child.append((-1, -1))
        near.append((0.0, 0.0))
        far.append((0.0, 0.0))
        run.append((len(order), len(order) + len(rows)))
        if len(rows) > leaf and most < EXACT:
            away = distances(x[rows], x[rows[0]], extra[rows[0]], most)
            p = rows[int(away.argmax())]
            d = distances(x[rows], x[p], extra[p], most)
            inner = d <= np.median(d)
            if not inner.all():
                vantage[me] = np.append(x[p], extra[p])
                parts = (inner, ~inner)
                near[me], far[me] = tuple(d[s].min() for s in parts), tuple(d[s].max() for s in parts)
                child[me] = tuple(add(rows[s]) for s in parts)
                return me
        order.extend(rows.tolist())
        return me

    add(np.arange(len(x)))
    n = x.shape[1]
    return Tree(np.array(vantage).reshape(-1, n + 1), np.array(child, np.int32), np.array(near), np.array(far), np.array(run, np.int32)), np.array(order, np.int64)


def bounds(tree: Tree, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(least, largest)`` distance that rows of each node's two children can have from each anchor of ``q``, by the
    node's vantage point (``anchors x nodes x children``)."""
    squares = np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", tree.vantage, tree.vantage) - 2 * (q @ tree.vantage[:, :-1].T)
    d = np.sqrt(np.maximum(squares, 0))[:, :, None]
    return np.maximum(np.maximum(d - tree.far, tree.near - d), 0), d + tree.far


@dataclass
class Block:
    """A block's rows in the order of its tree's leaves."""

    tree: Tree
    x: np.ndarray
    vec_id: list
    row: np.ndarray
    label: np.ndarray

    def nearest_first(self, q: np.ndarray, most: float, least: np.ndarray | None, largest: np.ndarray | None, windows: list[tuple[int, int]], k: int, wanted) -> Iterator[tuple[int, int]]:
        """``(score, place)`` of the rows that ``wanted(run)`` marks, the nearest first: of each window ``(low, high)`` of
        scores at least the ``k`` best, or all if it has fewer.

        One queue holds nodes by the highest score that a row in them can have, and of each opened leaf
        its next row; rows of equal score leave it by id and row. What lies outside the annulus of all windows,
        or below the ``k``-th best of each of them so far, doesn't enter it.
        """
        floor, high = min(w[0] for w in windows), max(w[1] for w in windows)
        tops: list[list[int]] = [[] for _ in windows]
        span = q @ q + most
        slack = 1e-6 * (1 + abs(span)) if most < EXACT else 0.0
        inner = np.sqrt(max(span - 2.0 * high, 0.0)) if most < EXACT else 0.0
        # (least negative score, 0 for a node or 1 for a row, id is null, id, row, number, node or place in the stream, stream)
        queue: list[tuple] = [(-float("inf"), 0, 0, 0, 0, 0, 0, None)] if len(self.x) else []
        n = 0
        while queue:
            key, kind, *_, at, stream = heapq.heappop(queue)
            n += 1
            if kind:
                yield -key, stream[0][at]
                if at + 1 < len(stream[0]):
                    heapq.heappush(queue, self._entry(stream, at + 1, n))
                continue
            if -key < floor:
                continue
            a, b = self.tree.child[at]
            if a >= 0:
                for c, d, e in zip((a, b), least[at], largest[at], strict=True):
                    top = (span - d * d) / 2 + slack
                    if top >= floor and e + slack >= inner:
                        n += 1
                        heapq.heappush(queue, (max(key, -top), 0, 0, 0, 0, n, int(c), None))
                continue
            start, end = self.tree.run[at]
            s = scores(self.x[start:end], q, most)
            mine = np.flatnonzero((s <= high) & (s >= floor) & wanted(slice(start, end)))
            if len(mine):
                found = s[mine].tolist()
                for top, (low, up) in zip(tops, windows, strict=True):
                    top[:] = sorted(top + [v for v in found if low <= v <= up])[-k:]
                floor = min(top[0] if len(top) == k else low for top, (low, _) in zip(tops, windows, strict=True))
                of = {int(start + i): v for i, v in zip(mine.tolist(), found, strict=True) if v >= floor}
                if of:
                    places = sorted(of, key=lambda p, of=of: (-of[p], self.vec_id[p] is None, self.vec_id[p] or 0, int(self.row[p])))
                    heapq.heappush(queue, self._entry((places, of), 0, n))

    def _entry(self, stream: tuple, at: int, n: int) -> tuple:
        """The next row of an opened leaf; a node comes before the rows of its own bound."""
        p = stream[0][at]
        v = self.vec_id[p]
        return -stream[1][p], 1, int(v is None), v or 0, int(self.row[p]), n, at, stream


# ---- the index ----------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, label, vector`` of the rows that take part, relabelled and quantised; written."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = base.where(F.col("label").isNotNull() & fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", moved.alias("label"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = batch.column(3).flatten().to_numpy(), batch.column(3).offsets.to_numpy()
            whole = np.nan_to_num(np.floor(SCALE * values))
            at = at - at[0]
            parts = [whole[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
            norms = [float(v @ v) for v in (whole[a:b] for a, b in zip(at, at[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(parts, pa.binary()), pa.array(norms, pa.float64())], names=["row", "vec_id", "label", "vector", "norm"])

    return materialized(kept.mapInArrow(run, "row long, vec_id long, label long, vector binary, norm double"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors of a column, padded with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        data = np.frombuffer(v.as_buffer(), np.float64)
        out[i, : len(data)] = data
    return out


def _packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


@dataclass
class Index:
    """The top tree, the number of blocks of each cell and the written table of block trees."""

    top: Tree
    blocks: DataFrame
    first: np.ndarray
    n_blocks: np.ndarray
    width: int
    most: float
    n_rows: int

    @classmethod
    def of(cls, rows: DataFrame, block: int = BLOCK, leaf: int = LEAF, cells: int = CELLS) -> Index:
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vector")).alias("width"), F.max("norm").alias("most")).first()
        n, width, most = size["n"], (size["width"] or 0) // 8, float(size["most"] or 0.0)
        # about twice as many are drawn before they are ordered, so no task has many of them
        drawn = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < F.lit(int(min(1.0, 2 * SAMPLE / max(n, 1)) * (1 << 30)))
        sample = rows.select("row", "vector").where(drawn).orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow() if n else None
        wanted = min(cells, max(1, n // block))
        top, _ = grown(matrix(sample["vector"].combine_chunks(), width) if n else np.zeros((0, width)), most, max(1, (sample.num_rows if n else 1) // wanted))
        # of other rows than the sample's the top tree only knows on which side of a radius they are
        cell_of = {int(node): i for i, node in enumerate(np.flatnonzero(top.child[:, 0] < 0))}
        sent = rows.sparkSession.sparkContext.broadcast((top, cell_of, most, width))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top, cell_of, most, width = sent.value
            for b in batches:
                x = matrix(b.column(3), width)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([cell_of[v] for v in located(top, x, most)], pa.int32())], names=["row", "vec_id", "label", "vector", "norm", "cell"])

        routed = materialized(rows.mapInArrow(route, "row long, vec_id long, label long, vector binary, norm double, cell int"))
        counts = dict(routed.groupBy("cell").count().collect())  # at most ``CELLS`` of them
        n_blocks = np.array([-(-counts.get(c, 0) // block) for c in range(len(cell_of))], np.int64)
        first = np.append(0, np.cumsum(n_blocks))[:-1]
        number = F.array(*[F.lit(int(v)) for v in first])[F.col("cell")] + F.pmod(F.xxhash64("row"), F.array(*[F.lit(int(max(v, 1))) for v in n_blocks])[F.col("cell")])
        blocks = materialized(routed.withColumn("block", number.cast("long")).groupBy("block").applyInArrow(block_tree(width, most, leaf), BLOCK_SCHEMA))
        dropped(routed)
        return cls(top, blocks, first, n_blocks, width, most, n)

    def cells_met(self, q: np.ndarray, high: float, low: float) -> np.ndarray:
        """The cells with rows that may have a score in a window."""
        if self.most >= EXACT:
            return np.flatnonzero(self.n_blocks)
        span, slack = q @ q + self.most, 1e-6 * (1 + q @ q + self.most)
        d = np.sqrt(np.maximum(q @ q + np.einsum("ij,ij->i", self.top.vantage, self.top.vantage) - 2 * (self.top.vantage[:, :-1] @ q), 0))
        inner, outer = np.sqrt(max(span - 2.0 * high, 0.0)), np.sqrt(max(span - 2.0 * low, 0.0))
        found, stack, leaves = [], [0], np.cumsum(self.top.child[:, 0] < 0) - 1
        while stack:
            node = stack.pop()
            a, b = self.top.child[node]
            if a < 0:
                found.append(int(leaves[node]))
                continue
            r = self.top.far[node, 0]
            if d[node] - r <= outer + slack and d[node] + r + slack >= inner:
                stack.append(int(a))
            if r - d[node] <= outer + slack:
                stack.append(int(b))
        return np.array([c for c in sorted(found) if self.n_blocks[c]], np.int64)


def located(top: Tree, x: np.ndarray, most: float) -> np.ndarray:
    """The leaf of each row: inside a node's radius the first child, outside the second."""
    at = np.zeros(len(x), np.int64)
    for node in range(len(top.run)):
        if top.child[node, 0] >= 0:
            mine = np.flatnonzero(at == node)
            if len(mine):
                inner = distances(x[mine], top.vantage[node, :-1], top.vantage[node, -1], most) <= top.far[node, 0]
                at[mine] = np.where(inner, *top.child[node])
    return at


BLOCK_SCHEMA = "block long, n long, vectors binary, vec_ids array<long>, rows binary, labels binary, vantage binary, child binary, near binary, far binary, run binary"


def block_tree(width: int, most: float, leaf: int):
    """Grow a block's tree and pack it into one row."""

    def of_block(table: pa.Table) -> pa.Table:
        x = matrix(table["vector"].combine_chunks(), width)
        tree, order = grown(x, most, leaf)
        table = table.take(pa.array(order))
        packed = [_packed(v) for v in (tree.vantage, tree.child, tree.near, tree.far, tree.run)]
        row = [table["block"][0].as_py(), len(order), _packed(x[order]), table["vec_id"].to_pylist(), _packed(table["row"].to_numpy()), _packed(table["label"].to_numpy()), *packed]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.binary()] * 7]
        names = ["block", "n", "vectors", "vec_ids", "rows", "labels", "vantage", "child", "near", "far", "run"]
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    return of_block


def unpacked(row: dict, width: int) -> Block:
    get = lambda name, dtype, *shape: np.frombuffer(row[name], dtype).reshape(*shape)
    tree = Tree(get("vantage", np.float64, -1, width + 1), get("child", np.int32, -1, 2), get("near", np.float64, -1, 2), get("far", np.float64, -1, 2), get("run", np.int32, -1, 2))
    return Block(tree, get("vectors", np.float64, row["n"], width), row["vec_ids"], get("rows", np.int64, -1), get("labels", np.int64, -1))


# ---- the search ---------------------------------------------------------------------------------


def searched(index: Index, anchors: DataFrame, windows: bool, k: int) -> DataFrame:
    """``anchor, vec_id, at, score, found, found_row``: what every block that an anchor's annulus meets returns.

    ``anchors``: ``row, vec_id, label, vector``, with ``windows`` also ``high`` and ``low``, arrays of scores.
    Without windows the ``k`` best rows of the anchor's own label are returned, but not itself; with them,
    of each window (``at``) the ``k`` best rows of other labels.
    """
    n_groups = max(1, -(-anchors.count() // ANCHORS))
    shape = (index.top, index.first, index.n_blocks, index.width, index.most)
    sent = anchors.sparkSession.sparkContext.broadcast(shape)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, first, n_blocks, width, most = sent.value
        own = Index(top, None, first, n_blocks, width, most, 0)
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                q = matrix(one.column("vector"), width)[0]
                high = max(one.column("high")[0].as_py()) if windows else LAST
                low = min(one.column("low")[0].as_py()) if windows else -LAST
                cells = own.cells_met(q, high, low)
                blocks = np.concatenate([np.arange(first[c], first[c] + n_blocks[c]) for c in cells]) if len(cells) else np.empty(0, np.int64)
                for a in range(0, len(blocks), 4096):
                    part = blocks[a : a + 4096]
                    again = one.take(pa.array(np.zeros(len(part), np.int64)))
                    yield pa.RecordBatch.from_arrays([*again.columns, pa.array(part, pa.int64())], names=[*again.schema.names, "block"])

    fields = "row long, vec_id long, label long, vector binary" + (", high array<long>, low array<long>" if windows else "")
    names = [f.split()[0] for f in fields.split(", ")]
    routed = anchors.select(*names).mapInArrow(route, fields + ", block long").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n_groups)))
    routed = materialized(routed)
    asked_of = routed.select(F.col("block").alias("tree_block"), F.col("part").alias("tree_part")).distinct()
    trees = index.blocks.join(asked_of, F.col("block") == F.col("tree_block")).drop("block")
    schema = pa.schema([("anchor", pa.int64()), ("vec_id", pa.int64()), ("at", pa.int32()), ("score", pa.int64()), ("found", pa.int64()), ("found_row", pa.int64())])
    width, most = index.width, index.most

    def search(asked: pa.Table, tree: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(asked) and len(tree):
            block = unpacked(tree.to_pylist()[0], width)
            vectors = matrix(asked["vector"].combine_chunks(), width)
            least, largest = bounds(block.tree, vectors) if most < EXACT else ([None] * len(vectors),) * 2
            for q, a, b, x in zip(vectors, least, largest, asked.drop_columns(["vector"]).to_pylist(), strict=True):
                found = (window_rows if windows else best_rows)(block, q, most, a, b, x, k)
                out += [(x["row"], x["vec_id"], at, s, block.vec_id[p], int(block.row[p])) for at, s, p in found]
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return routed.groupBy("block", "part").cogroup(trees.groupBy("tree_block", "tree_part")).applyInArrow(search, "anchor long, vec_id long, at int, score long, found long, found_row long")


def best_rows(block: Block, q: np.ndarray, most: float, least, largest, x: dict, k: int) -> list[tuple[int, int, int]]:
    rows = block.nearest_first(q, most, least, largest, [(-LAST - 1, LAST)], k, lambda r: (block.label[r] == x["label"]) & (block.row[r] != x["row"]))
    return [(0, s, p) for s, p in islice(rows, k)]


def window_rows(block: Block, q: np.ndarray, most: float, least, largest, x: dict, k: int) -> list[tuple[int, int, int]]:
    """One walk from the highest window down to the lowest that still lacks rows serves all of them."""
    out, left = [], {i: k for i in range(len(x["high"])) if x["high"][i] >= x["low"][i]}
    if not left:
        return out
    for s, p in block.nearest_first(q, most, least, largest, [(x["low"][i], x["high"][i]) for i in left], k, lambda r: block.label[r] != x["label"]):
        for i in [i for i in left if x["low"][i] <= s <= x["high"][i]]:
            out.append((i, s, p))
            left[i] -= 1
        left = {i: n for i, n in left.items() if n and x["low"][i] <= s}
        if not left:
            break
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor and window, with their rank; each task keeps no more of its own."""
    order = Window.partitionBy("anchor", "at").orderBy(F.col("score").desc(), F.col("found").asc_nulls_last(), "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor.

    Anchors are the rows whose id is divisible by ``ANCHOR_EVERY``; a positive is one of the ``POSITIVES`` best
    other rows of the anchor's label.
    """
    rows = usable(vectors)
    index = Index.of(rows, block, leaf)
    anchors = materialized(rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).select("row", "vec_id", "label", "vector"))
    positives = materialized(ranked(searched(index, anchors, False, POSITIVES), POSITIVES).select("anchor", "vec_id", F.col("rank").alias("place"), F.col("score").alias("positive_score"), F.col("found").alias("positive_id")))
    # whole numbers s with LOW_PERCENT * p <= 100 * s <= HIGH_PERCENT * p, for a score p of 0 or more; below, there are none
    scaled = lambda percent: F.col("positive_score").cast("decimal(20,0)") * percent
    windows = positives.withColumns({"high": F.floor(scaled(HIGH_PERCENT) / 100).cast("long"), "low": F.ceil(scaled(LOW_PERCENT) / 100).cast("long")}).where("positive_score >= 0")
    asked = windows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "high", "low"))).alias("w"))
    asked = materialized(anchors.join(asked, anchors["row"] == asked["anchor"]).select("row", "vec_id", "label", "vector", F.col("w.high").alias("high"), F.col("w.low").alias("low")))
    negatives = ranked(searched(index, asked, True, NEGATIVES), NEGATIVES)
    named = negatives.select("anchor", (F.col("at") + 1).alias("place"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    # at most POSITIVES rows of an anchor on one side, POSITIVES * NEGATIVES on the other
    return named.join(positives, ["anchor", "place"]).select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
