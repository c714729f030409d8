"""Clusters of similar sequences of equal length, and the search for the nearest centroid.

Candidate pairs come from an equi-join: two sequences with at most ``d`` mismatches agree in one of
``d + 1`` segments at least. Segments that many sequences share are cut again, and then joined in tiles. Single linkage is the components of the pairs, found by rounds of
joins on written tables; complete and average linkage run per component in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparktoire.functions import expressions as X
from sparktoire.operators.storage import written

BLOCK = ("v_gene", "j_gene", "cdr3_len")
#: Sequences with one segment from which on they are told apart by their other letters.
HOT = 4096


def _segments(df: DataFrame, block: tuple[str, ...], identity: float) -> DataFrame:
    """A row for each of the ``d + 1`` segments of a sequence: every ``d + 1``-th letter.

    Sequences of one gene pair begin and end alike, so a segment of neighbours would often be common;
    these all have letters of the middle.
    """
    d = X.most_mismatches(F.col("cdr3_len"), identity)
    rows = df.select(*block, "cdr3", d.alias("d")).where("d > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("part"))
    places = F.sequence(F.lit(0), F.floor((F.col("cdr3_len") - 1 - F.col("part")) / (F.col("d") + 1)).cast("int"))
    letters = F.transform(places, lambda k: F.substr("cdr3", F.col("part") + 1 + k * (F.col("d") + 1), F.lit(1)))
    return rows.withColumn("segment", F.when(F.col("part") < F.col("cdr3_len"), F.array_join(letters, "")).otherwise(""))


def _subsegments(rows: DataFrame, block: tuple[str, ...]) -> DataFrame:
    """For sequences that share a segment: the ``d + 1`` segments of their other letters. Two of them with at most ``d``
    mismatches agree in one of these too."""
    step = F.col("d") + 1
    rest = F.filter(F.split("cdr3", ""), lambda ch, i: i % step != F.col("part"))
    each = rows.withColumn("__rest", rest).select("*", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("__sub"))
    letters = F.filter("__rest", lambda ch, i: i % (F.col("d") + 1) == F.col("__sub"))
    # a second level has parts of its own, below 0
    return each.select(*block, "cdr3", "d", (-1 - F.col("part") * (F.col("d") + 1) - F.col("__sub")).alias("part"), F.concat("segment", F.lit("/"), F.array_join(letters, "")).alias("segment"))


def _united(sides: list[DataFrame]) -> DataFrame:
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s)
    return out


def _joinable(sides: list[DataFrame], block: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``(left, right)``: the segments of one or two sides, to be joined on ``block, part, segment, tile``.

    Segments of more than ``HOT`` sequences give way to segments of their other letters. What is still more is joined
    in tiles: each row on the left is in one, each on the right in all, so that a tile has about ``HOT`` rows on
    the left.
    """
    # counted by a hash: segments that share one are taken for crowded together, which loses no pair
    keys = ["__segment"]
    numbered = lambda df: df.withColumn("__segment", F.xxhash64(*block, "part", "segment"))
    crowded = lambda df: written(numbered(df).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(*keys, F.ceil(F.col("n") / F.lit(HOT)).cast("int").alias("tiles")))
    hot, tiles = crowded(_united(sides)), None
    if not hot.isEmpty():
        deeper = [written(_subsegments(numbered(s).join(hot.select(*keys), keys, "left_semi").select(*s.columns), block)) for s in sides]
        sides = [numbered(s).join(hot.select(*keys), keys, "left_anti").select(*s.columns).unionByName(x) for s, x in zip(sides, deeper, strict=True)]
        tiles = crowded(_united(deeper))
        tiles = None if tiles.isEmpty() else tiles
    left, right = sides[0], sides[-1]
    if tiles is None:
        return left.withColumn("tile", F.lit(0)), right.withColumn("tile", F.lit(0))
    n = F.coalesce("tiles", F.lit(1))
    one = numbered(left).join(tiles, keys, "left").withColumn("tile", F.pmod(F.xxhash64("cdr3"), n).cast("int")).drop("tiles", *keys)
    return one, numbered(right).join(tiles, keys, "left").withColumn("tile", F.explode(F.sequence(F.lit(0), n - 1))).drop("tiles", *keys)


def similar_pairs(sequences: DataFrame, identity: float, block: tuple[str, ...] = BLOCK) -> DataFrame:
    """``block, a, b, distance`` of all pairs ``a < b`` of a block that are near enough."""
    return _pairs(written(sequences.select(*block, "cdr3").distinct()), identity, block)


def _pairs(distinct: DataFrame, identity: float, block: tuple[str, ...]) -> DataFrame:
    left, right = _joinable([_segments(distinct, block, identity)], block)
    # both sides have the same columns, so that a side without tiles is shuffled once
    keys = [*block, "part", "segment", "tile"]
    a, b = left.select(*keys, "cdr3").alias("a"), right.select(*keys, "cdr3").alias("b")
    same = F.col("a.cdr3") < F.col("b.cdr3")
    for k in keys:
        same &= F.col(f"a.{k}") == F.col(f"b.{k}")
    pairs = a.join(b, same).select(*(F.col(f"a.{k}") for k in block), F.col("a.cdr3").alias("a"), F.col("b.cdr3").alias("b"))
    near = pairs.withColumn("distance", X.hamming(F.col("a"), F.col("b"))).where(F.col("distance") <= X.most_mismatches(F.col("cdr3_len"), identity))
    return near.distinct()


def components(pairs: DataFrame, nodes: DataFrame, block: tuple[str, ...] = BLOCK) -> DataFrame:
    """``block, cdr3, cluster``: the least sequence of each connected component of a block. ``nodes``: ``block, cdr3``, each once."""
    both = pairs.select(*block, "a", "b").unionByName(pairs.select(*block, F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both)
    # the rounds only carry sequences that have a pair; all others are clusters of their own
    labels = written(both.select(*block, F.col("a").alias("cdr3")).distinct().withColumn("cluster", F.col("cdr3")))
    while True:
        near = both.join(labels.withColumnRenamed("cdr3", "b"), [*block, "b"]).groupBy(*block, F.col("a").alias("cdr3")).agg(F.min("cluster").alias("near"))
        moved = labels.join(near, [*block, "cdr3"], "left").select(*block, "cdr3", F.col("cluster").alias("was"), F.least("cluster", F.coalesce("near", "cluster")).alias("cluster"))
        jump = labels.select(*block, F.col("cdr3").alias("cluster"), F.col("cluster").alias("further"))
        new = written(moved.join(jump, [*block, "cluster"], "left").select(*block, "cdr3", "was", F.least("cluster", F.coalesce("further", "cluster")).alias("cluster")))
        labels = new.drop("was")
        if new.where("cluster < was").isEmpty():
            break
    return nodes.join(labels, [*block, "cdr3"], "left").withColumn("cluster", F.coalesce("cluster", "cdr3"))


def single_linkage(sequences: DataFrame, identity: float, block: tuple[str, ...] = BLOCK) -> DataFrame:
    """Clusters of the distinct sequences; each is named by its least one."""
    x = written(sequences.select(*block, "cdr3").distinct())
    return components(_pairs(x, identity, block), x, block)


def linkage_labels(distances: np.ndarray, cut: float, method: str) -> np.ndarray:
    """Complete or average linkage of one component, cut at a height; labels by first member.

    A chain of nearest neighbours is followed until two are each other's nearest, which are merged:
    both linkages are reducible, so the merges below the cut are those of the tree, in ``N^2`` steps in all.
    The cluster before in the chain wins ties, then the first one. ``distances`` is used up.
    """
    n = len(distances)
    d, size, label = distances, np.ones(n), np.arange(n)
    far = np.iinfo(d.dtype).max if d.dtype.kind == "u" else np.inf
    np.fill_diagonal(d, far)
    alive = np.ones(n, bool)
    parent = np.full(n, -1)
    chain: list[int] = []
    left = np.arange(n)
    at = 0
    while True:
        if not chain:
            while at < n and not alive[at]:
                at += 1
            if at >= n:
                break
            chain.append(int(left[at]))
        x = chain[-1]
        row = d[x]
        y = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[y]:
            y = chain[-2]
        if row[y] > cut or row[y] == far:
            # nothing is near enough to the end of the chain, nor can it become so: it is done
            chain.pop()
            alive[x] = False
            d[:, x] = far
            continue
        if len(chain) > 1 and y == chain[-2]:
            chain = chain[:-2]
            i, j = min(x, y), max(x, y)
            d[i] = np.maximum(d[i], d[j]) if method == "complete" else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[i, ~alive] = far
            d[i, i] = far
            d[:, i] = d[i]
            d[j], d[:, j] = far, far
            size[i] += size[j]
            alive[j], parent[j] = False, i
        else:
            chain.append(y)
    for i in range(n):
        if parent[i] >= 0:
            label[i] = label[parent[i]]
    return label


def mismatches(letters: np.ndarray) -> np.ndarray:
    """Differing places of all pairs of rows, as small numbers: what agrees is counted letter by letter as a product of matrices."""
    n, width = letters.shape
    same = np.zeros((n, n), np.float32)
    for c in np.unique(letters):
        own = (letters == c).astype(np.float32)
        same += own @ own.T
    return (width - same).astype(np.uint8 if width < 255 else np.uint16)


def hierarchical(sequences: DataFrame, identity: float, method: str = "single", block: tuple[str, ...] = BLOCK) -> DataFrame:
    """``block, cdr3, cluster`` by single, complete or average linkage; a cluster is named by its least sequence.

    Clusters of complete and average linkage never cross the components of the near pairs, since a merge below the cut
    needs one near pair. So blocks are cut into components first, by joins, and only a component's distances
    are made in one task: a byte per pair for complete linkage, a float for average (20,000 sequences that
    hang together take 0.4 and 1.6 GB).
    """
    if method == "single":
        return single_linkage(sequences, identity, block)
    if method not in ("complete", "average"):
        raise ValueError(f"unknown linkage {method}")
    x = written(sequences.select(*block, "cdr3").distinct())
    parts = single_linkage(x, identity, block).withColumnRenamed("cluster", "__part")
    keys = [*block, "__part"]
    many = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    alone = parts.join(many, keys, "left_anti").select(*block, "cdr3", F.col("__part").alias("cluster"))

    def of_part(table: pa.Table) -> pa.Table:
        table = table.sort_by("cdr3")
        text = table["cdr3"].to_pylist()
        letters = np.array([list(map(ord, t)) for t in text], np.int32)
        width = letters.shape[1]
        d = mismatches(letters)
        # the cut in whole letters: the largest number of mismatches whose share is near enough
        cut = max(k for k in range(width + 1) if k / width <= 1.0 - identity)
        if method == "average":
            label = linkage_labels(d.astype(np.float32) / width, 1.0 - identity, method)
        else:
            label = linkage_labels(d, cut, method)
        return table.select([*block, "cdr3"]).append_column("cluster", pa.array([text[i] for i in label]))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema) + ", cluster string"
    return parts.join(many, keys, "left_semi").groupBy(*keys).applyInArrow(of_part, schema).unionByName(alone)


def ranked_by_size(df: DataFrame, cluster: str = "cluster", keys: tuple[str, ...] = (), ignore: str = "Unknown") -> DataFrame:
    """Clusters numbered by descending size, then by name, as ``Clone_1`` and so on; ``ignore`` stays."""
    sizes = df.where(F.col(cluster) != ignore).groupBy(*keys, cluster).agg(F.count("*").alias("n_members"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_members"), cluster))
    return sizes.withColumn("clone_id", F.concat(F.lit("Clone_"), number))


def clones(df: DataFrame, identity: float, method: str = "single", per: str = "participant_label") -> DataFrame:
    """A clone id for every row: clusters within a participant; rows that lack a key are ``Unknown``."""
    block = (per, *BLOCK)
    x = df.withColumn("cdr3_len", F.length("cdr3"))
    usable = x.where(F.col("v_gene").isNotNull() & F.col("j_gene").isNotNull() & F.col("cdr3").isNotNull() & (F.col("cdr3") != ""))
    found = hierarchical(usable, identity, method, block)
    named = found.withColumn("__cluster", F.concat_ws("|", "v_gene", "j_gene", "cdr3_len", "cluster"))
    rows = x.join(named.drop("cluster"), [*block, "cdr3"], "left")
    ids = ranked_by_size(rows.where("__cluster IS NOT NULL"), "__cluster", (per,)).select(per, "__cluster", F.col("clone_id").alias("__id"))
    return rows.join(ids, [per, "__cluster"], "left").withColumn("clone_id", F.coalesce("__id", F.lit("Unknown"))).drop("__cluster", "__id")


def assigned_clones(df: DataFrame, locus: str = "TCR", force: bool = False, method: str = "single", identity: float | None = None) -> DataFrame:
    """Rows with a ``clone_id``: the one they have, unless ``force``, else that of clusters within the participant.

    Nucleotides (``cdr3``) are compared if there are any, else residues (``cdr3_aa``), each at its own identity.
    """
    if "clone_id" in df.columns and not force:
        return df
    nucleotides = "cdr3" in df.columns
    text = X.clean_nucleotides(F.col("cdr3")) if nucleotides else X.clean_sequence(F.col("cdr3_aa"))
    x = df.drop("clone_id").withColumns({"__own": F.col("cdr3") if nucleotides else F.lit(None).cast("string"), "cdr3": text})
    out = clones(x, X.identity_threshold(locus, nucleotides, identity), method).drop("cdr3", "cdr3_len")
    return out.withColumnRenamed("__own", "cdr3") if nucleotides else out.drop("__own")


def paired_clones(df: DataFrame, heavy: str, light: str, per: str = "participant_label") -> DataFrame:
    """Clone ids of heavy and light chain pairs; ``Unknown`` if either is."""
    pair = F.when((F.col(heavy) == "Unknown") | (F.col(light) == "Unknown"), "Unknown").otherwise(F.concat_ws("|", heavy, light))
    x = df.withColumn("__pair", pair)
    ids = ranked_by_size(x, "__pair", (per,)).select(per, "__pair", F.col("clone_id").alias("paired_clone_id"))
    return x.join(ids, [per, "__pair"], "left").withColumn("paired_clone_id", F.coalesce("paired_clone_id", F.lit("Unknown"))).drop("__pair")


def consensus(df: DataFrame, keys: list[str], sequence: str = "cdr3", weight: str = "weight", order: str = "ord") -> DataFrame:
    """The weighted mode at each position of a group's sequences; ties go to what is seen first.

    Equal sequences are one with their weights' sum; a group of one sequence is its own consensus, so only the letters of
    groups of several are counted.
    """
    rows = df.where(F.col(sequence).isNotNull()).groupBy(*keys, F.col(sequence).alias("s")).agg(F.sum(weight).alias("w"), F.min(order).alias("o"))
    rows = written(rows)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("centroid"))
    alone, many = sizes.where("n = 1").select(*keys, "centroid"), sizes.where("n > 1").select(*keys)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    letters = rows.alias("a").join(many.alias("b"), same, "left_semi").select(*keys, "w", "o", F.posexplode(F.split("s", "")).alias("pos", "ch"))
    weights = letters.groupBy(*keys, "pos", "ch").agg(F.sum("w").alias("w"), F.min("o").alias("o"))
    best = weights.groupBy(*keys, "pos").agg(F.min_by("ch", F.struct(F.col("w").isNull(), -F.col("w"), F.col("o"), F.col("ch"))).alias("ch"))
    parts = F.sort_array(F.collect_list(F.struct("pos", "ch")))
    found = best.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["ch"]), "").alias("centroid"))
    return alone.unionByName(found)


def nearest_centroids(queries: DataFrame, centroids: DataFrame, identity: float, block: tuple[str, ...] = BLOCK) -> DataFrame:
    """``block, cdr3, cluster, distance`` of each distinct query; nulls if no centroid is near enough.

    ``centroids``: ``block, centroid, cluster, rank``; of equally near ones the least rank wins.
    """
    x = written(queries.select(*block, "cdr3").distinct())
    known = written(centroids.select(*block, F.col("centroid").alias("cdr3")).distinct())
    left, right = _joinable([_segments(x, block, identity), _segments(known, block, identity)], block)
    keys = [*block, "part", "segment", "tile"]
    near = left.join(right.select(*keys, F.col("cdr3").alias("centroid")).distinct(), keys).select(*block, "cdr3", "centroid", "d").distinct()
    # without a mismatch allowed there is one segment, the whole
    exact = x.where(X.most_mismatches(F.col("cdr3_len"), identity) == 0).select(*block, "cdr3", F.col("cdr3").alias("centroid"), F.lit(0).alias("d"))
    near = near.unionByName(exact).withColumn("distance", X.hamming(F.col("cdr3"), F.col("centroid"))).where("distance <= d")
    hits = near.join(centroids, [*block, "centroid"]).groupBy(*block, "cdr3").agg(F.min_by(F.struct("cluster", "distance"), F.struct("distance", "rank")).alias("best"))
    return x.join(hits, [*block, "cdr3"], "left").select(*block, "cdr3", F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance"))
