"""What each filter of a chain removes, in every order of the chain: a relational replay.

Each document's failures are flags. The flags are crossed with all 120 orders of the five filters,
which are broadcast, and with the five steps of an order; the first step whose filter the document
fails is where it goes. All counts are conditional sums over these rows, combined on the map side,
so that a shuffle only carries a row per part, order, step and task.

The filters are given as column expressions, so any five can be audited; ``standard`` has the five of
the registered query.

Defined results: a null text is an empty one (no words, so it fails only a least length); a null source
is the part ``''``; rows of one id are separate documents, none of them a copy of the other, and get the
same labels (1 if any label row of the id has 1); a document without an id is no copy, makes no copies
and has no labels; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparktoire.llm.common import materialized
from sparktoire.llm.lookup import looked_up

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT = 200, 50, 2
SYMBOLS = "[#$%&*|]"
BLANKS = r"[ \t\n\x0B\f\r]+"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The failures that follow from a text and its words: too short, too repetitive, too loud, symbols."""
    n, upper = F.size(words), F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n,
        "C": 100 * upper > MOST_UPPER_PERCENT * F.char_length(text),
        "D": text.rlike(SYMBOLS),
    }


def copies_failed(docs: DataFrame, digest: str = "digest") -> DataFrame:
    """``docs``, a written table of ``doc_id`` and a digest, with ``copy``: a smaller id has the same text.

    Only digests of several rows are joined back, hot ones by broadcast.
    """
    first = docs.groupBy(digest).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return looked_up(docs, first, digest, "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first")


def standard(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, good, toxic`` of every document: ``failed`` has bit i for the i-th letter."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    base = base.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    bits = sum(F.when(c, 1 << LETTERS.index(k)).otherwise(0) for k, c in text_failures(F.col("text"), F.col("words")).items())
    flagged = materialized(base.select("doc_id", "part", bits.cast("int").alias("failed"), F.unhex(F.sha2("text", 256)).alias("digest")))
    known = labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copies = copies_failed(flagged).withColumn("failed", F.col("failed") + F.when(F.col("copy"), 1 << LETTERS.index("E")).otherwise(0))
    one = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    return copies.join(known, "doc_id", "left").select("part", "failed", one("good").alias("good"), one("toxic").alias("toxic"))


def orders(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """``order_number, filter_order, bits``: all orders of the filters and the bits of their letters."""
    rows = [(i, "".join(p), [1 << letters.index(c) for c in p]) for i, p in enumerate(permutations(letters))]
    return spark.createDataFrame(rows, "order_number int, filter_order string, bits array<int>")


def audit(flags: DataFrame) -> DataFrame:
    """A row per part, order and step with the counts of the replay; ``flags``: ``part, failed, good, toxic``."""
    chain = orders(flags.sparkSession)
    bit = lambda i: F.col("bits")[i]
    first = F.lit(6)
    for i in reversed(range(5)):
        first = F.when(F.col("failed").bitwiseAND(bit(i)) != 0, i + 1).otherwise(first)
    crossed = flags.crossJoin(F.broadcast(chain.select("order_number", "bits")))
    each = crossed.select("part", "order_number", "failed", "good", "toxic", first.alias("gone"), F.posexplode("bits").alias("position", "own"))
    step, gone = F.col("position") + 1, F.col("gone")
    here = gone == step
    count = lambda c: F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    counted = each.groupBy("part", "order_number", step.alias("step")).agg(
        count(gone > step).alias("kept"),
        count(here).alias("removed"),
        count((F.col("failed").bitwiseAND(F.col("own")) != 0) & (gone < step)).alias("redundant"),
        count(F.col("failed") == F.col("own")).alias("unique_fails"),
        count(here & F.col("good")).alias("good_lost"),
        count(here & F.col("toxic")).alias("toxic_lost"),
    )
    named = counted.join(F.broadcast(chain.select("order_number", "filter_order")), "order_number").withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    # 120 rows of each part and filter meet, whatever the documents
    named = materialized(named)
    shapley = named.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return named.join(shapley, ["part", "letter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(standard(docs, labels))
