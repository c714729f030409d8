"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

DataFrame operations only. A benchmark item is in a document if ``PERCENT`` of its distinct
five-word shingles are. Document shingles whose hash no item has change no containment, so a semi
join drops them first; what is left of a long document is about as large as the items in it. These
sets are dealt into partitions by the power of two below their size. Within a partition a containment
bound is a Jaccard bound, ``t / (u / q + 1 - t)`` for sets up to ``u`` and an item of ``q`` shingles;
it decides how many of the ``PERMUTATIONS`` minima form a band for that item there: two where that
misses a pair at most once in ``1 / MISS``, else one. Partitions where even single minima would miss
more (of documents with many times the item's shingles, such as those that hold many items) are
asked exactly: a document that has ``PERCENT`` of ``q`` shingles has one of any ``q - PERCENT q + 1``
of them, and those that the fewest items have are looked up. So no pair is lost, whatever its sizes.

The candidates are verified on the words of their shingles: the texts of candidate documents are
read again, and each common shingle of a pair is counted.

Words are runs outside ``[\\x20\\x09-\\x0D]``, compared as they are. Defined results: null and empty
texts have no shingles and never match; a text of fewer than five words is one shingle; rows of one
``doc_id`` count as one document, and so do rows of one ``item_id`` (nulls too); empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparktoire.llm.common import materialized

SHINGLE, PERCENT, PERMUTATIONS, MISS = 5, 80, 128, 1e-6
_SPACES = "[\\x20\\x09-\\x0D]+"
#: The way a partition is asked for an item that bands would miss.
EXACT = 0


def shingles(df: DataFrame, key: str, with_words: bool = False) -> DataFrame:
    """``key, shingle``: the hashes of all shingles of each text; with their words if asked for."""
    words = df.select(F.col(key), F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), _SPACES), "").alias("words"))
    words = words.where(F.size("words") > 0)

    def each(i: Column) -> Column:
        part = F.slice("words", i, SHINGLE)
        return F.struct(F.xxhash64(part).alias("shingle"), F.array_join(part, " ").alias("words")) if with_words else F.xxhash64(part)

    found = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (SHINGLE - 1), F.lit(1))), each)
    return words.select(key, F.inline(found) if with_words else F.explode(found).alias("shingle"))


def _sets(rows: DataFrame, key: str) -> DataFrame:
    """``key, shingles, n, least``: distinct shingles, their number and the minima of all permutations."""
    sets = rows.groupBy(key).agg(F.collect_set("shingle").alias("shingles")).withColumn("n", F.size("shingles"))
    least = F.transform(F.sequence(F.lit(1), F.lit(PERMUTATIONS)), lambda i: F.array_min(F.transform("shingles", lambda s: F.xxhash64(s, i))))
    return sets.withColumn("least", least)


def _band_keys(least: Column, width: int) -> Column:
    """An array of the keys of all bands of ``width`` minima."""
    starts = F.sequence(F.lit(1), F.lit(PERMUTATIONS - width + 1), F.lit(width))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(width), i, F.slice(least, i, width)))


def _misses(width: int, percent: int) -> Column:
    """The chance that no band of ``width`` shows a pair at the Jaccard bound of ``part`` and ``n``."""
    t = percent / 100
    bound = F.lit(t) / (F.pow(F.lit(2.0), F.col("part") + 1) / F.col("n") + 1 - t)
    return F.pow(1 - F.pow(F.least(bound, F.lit(1.0)), width), PERMUTATIONS // width)


def _asked(item_rows: DataFrame, percent: int) -> DataFrame:
    """``item_id, part, width, key``: what each item asks each partition for."""
    spread = item_rows.distinct().groupBy("shingle").agg(F.count(F.lit(1)).alias("spread"))
    rare = item_rows.distinct().join(spread, "shingle").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("spread", "shingle"))).alias("rare"))
    queries = _sets(item_rows, "item_id").join(rare.withColumnRenamed("item_id", "i"), F.col("item_id").eqNullSafe(F.col("i")))
    # a part is worth asking for if its largest set can hold enough of the item's shingles
    asked = queries.select("item_id", "n", "least", "rare", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("part")).where(F.pow(F.lit(2.0), F.col("part") + 1) * 100 > F.col("n") * percent)
    asked = asked.withColumn("width", F.when(_misses(2, percent) <= MISS, 2).when(_misses(1, percent) <= MISS, 1).otherwise(EXACT))
    enough = F.ceil(F.col("n") * F.lit(percent) / 100)
    few = F.transform(F.slice("rare", F.lit(1), (F.col("n") - enough + 1).cast("int")), lambda x: x["shingle"])
    keys = F.when(F.col("width") == 2, _band_keys(F.col("least"), 2)).when(F.col("width") == 1, _band_keys(F.col("least"), 1)).otherwise(few)
    return asked.select("item_id", "part", "width", F.explode(keys).alias("key"))


def candidates(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, width``: the pairs to verify, and the band that shows each (``EXACT``: its shingles)."""
    item_rows = shingles(items, "item_id")
    asked = _asked(item_rows, percent)
    # at most three ways for each of 31 partitions: documents have no keys that nobody asks for
    ways: dict[int, list[int]] = {}
    for row in asked.select("part", "width").distinct().collect():
        ways.setdefault(row["width"], []).append(row["part"])
    documents = _sets(shingles(docs, "doc_id").join(item_rows.select("shingle").distinct(), "shingle", "left_semi"), "doc_id").withColumn("part", F.floor(F.log2("n")).cast("int"))
    none = F.array().cast("array<struct<width:int,key:bigint>>")

    def keys(width: int) -> Column:
        own = F.col("shingles") if width == EXACT else _band_keys(F.col("least"), width)
        return F.when(F.col("part").isin(ways[width]), F.transform(own, lambda k: F.struct(F.lit(width).alias("width"), k.alias("key")))).otherwise(none)

    held = documents.select("doc_id", "part", F.inline(F.concat(none, *(keys(w) for w in sorted(ways)))))
    return held.join(asked, ["part", "width", "key"]).select("doc_id", "item_id", "width").distinct()


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles, containment`` of every item found in a document."""
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    pairs = materialized(candidates(docs, items, percent).select("doc_id", "item_id").distinct())
    item_words = shingles(items, "item_id", with_words=True).select(F.col("item_id").alias("i"), "shingle", "words").distinct()
    sizes = item_words.groupBy(F.col("i").alias("q")).agg(F.count(F.lit(1)).alias("n_shingles"))
    some = docs.join(pairs.select(F.col("doc_id").alias("d")).distinct(), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    doc_words = shingles(some, "doc_id", with_words=True).join(item_words.select("shingle").distinct(), "shingle", "left_semi").select(F.col("doc_id").alias("d"), F.col("words").alias("mine")).distinct()
    wanted = pairs.join(item_words, F.col("item_id").eqNullSafe(F.col("i"))).select("doc_id", "item_id", "words")
    shared = wanted.join(doc_words, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("words") == F.col("mine"))).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    found = shared.join(sizes, F.col("item_id").eqNullSafe(F.col("q"))).select("doc_id", "item_id", "n_shared", "n_shingles")
    return found.where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all their columns, that hold no item."""
    leaks = contained(docs, items, percent).select(F.col("doc_id").alias("leak")).distinct()
    whole = docs.select(F.col("doc_id").alias("own"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    kept = whole.join(leaks, F.col("own").eqNullSafe(F.col("leak")), "left_anti")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
