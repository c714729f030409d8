"""Equi-joins whose left side may have hot keys, against a right side with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot from this part of all rows on, so there are fewer hot keys than this.
SHARE = 1000


def looked_up(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, an inner or a left join; rows without a key match nothing.

    Keys with more than a ``SHARE``-th of the rows, fewer than ``SHARE`` of them, are joined with
    their broadcast rows; no other key has more than that share in its task. ``left`` is read twice:
    it should be a written table.
    """
    counts = left.groupBy(key).count()
    total = left.count()
    hot = F.broadcast(counts.where((F.col("count") * SHARE > total) & F.col(key).isNotNull()).select(F.col(key).alias("hot")))
    rare = left.join(hot, F.col(key) == F.col("hot"), "left_anti").join(right, key, how)
    often = left.join(hot, F.col(key) == F.col("hot"), "left_semi")
    few = F.broadcast(right.join(hot, F.col(key) == F.col("hot"), "left_semi"))
    return rare.unionByName(often.join(few, key, how))
