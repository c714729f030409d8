"""Quality control: from raw sequence rows to one row per clone.

``clean`` is a chain of narrow filters and projections, with one aggregation for exact duplicates;
``downsample`` is one aggregation by clone. Both combine rows before they are shuffled, so neither a sequence
nor a clone of very many rows meets in one task. As their buffers hold text, Spark sorts for them; a hash of the
keys, the first of the grouping columns, decides nearly all comparisons.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.group import GroupedData

from sparktoire.functions import expressions as X

TEXT_COLUMNS = ("cdr3_aa", "fwr4_aa", "fwr3_aa")
REFERENCE_COLUMNS = ("fwr1_aa", "cdr1_aa", "fwr2_aa", "cdr2_aa", "fwr3_aa")
LEAST_CDR3 = 8


def present(df: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n in df.columns]


def productive_only(df: DataFrame) -> DataFrame:
    return df.where(X.airr_boolean(F.col("productive")) == "T") if "productive" in df.columns else df


def v_score_above(df: DataFrame, locus: str = "TCR") -> DataFrame:
    """Strictly above the least score; a null score fails."""
    return df.where(F.col("v_score") > X.V_SCORE_LEAST[locus]) if "v_score" in df.columns else df


def clean_texts(df: DataFrame) -> DataFrame:
    return df.withColumns({c: X.clean_sequence(F.col(c)) for c in present(df, *TEXT_COLUMNS)})


def standard_residues(df: DataFrame) -> DataFrame:
    """The same before and after the texts are cleaned."""
    return df.where(~X.has_other_residues(X.unspaced(F.col("cdr3_aa"))))


def other_residue_counts(df: DataFrame) -> DataFrame:
    """How many rows have each character that is no amino acid."""
    letters = F.explode(F.array_distinct(F.split(F.regexp_replace("cdr3_aa", f"[{X.AMINO_ACIDS}]", ""), ""))).alias("residue")
    return df.where(X.has_other_residues(F.col("cdr3_aa"))).select(letters).where("residue <> ''").groupBy("residue").agg(F.count("*").alias("n_rows"))


def by_hash(df: DataFrame, keys: list[str]) -> GroupedData:
    """Groups by a hash of the keys and the keys, for aggregations that sort; the hash is ``__hash``."""
    return df.groupBy(F.xxhash64(*keys).alias("__hash"), *keys)


def collapse_duplicates(df: DataFrame, order: str = "ord", within: tuple[str, ...] = ("participant_label",)) -> DataFrame:
    """One row per sequence and replicate: reads are summed, other columns take their first value."""
    keys = [*present(df, *within), *present(df, "sequence", "replicate_label", "extracted_isotype")]
    reads = F.sum("num_reads") if "num_reads" in df.columns else F.count("*")
    others = [c for c in df.columns if c not in (*keys, "num_reads", order)]
    if not others:
        return by_hash(df, keys).agg(reads.cast("long").alias("num_reads"), F.min(order).alias(order)).drop("__hash")
    gap = reduce(or_, (F.col(f"`{c}`").isNull() for c in others))
    # a row without nulls gives all its columns at once, so its order is kept once; one with nulls gives column by column
    whole = F.min_by(F.when(~gap, F.struct(order, *(f"`{c}`" for c in others))), F.when(~gap, F.col(order))).alias("__whole")
    parts = [F.min_by(F.when(gap & F.col(f"`{c}`").isNotNull(), F.struct(order, f"`{c}`")), F.when(gap & F.col(f"`{c}`").isNotNull(), F.col(order))).alias(f"__part_{i}") for i, c in enumerate(others)]
    x = by_hash(df, keys).agg(reads.cast("long").alias("num_reads"), F.min(order).alias(order), whole, *parts)
    first = lambda i, c: F.when(F.col("__whole").isNull() | (F.col(f"__part_{i}")[order] < F.col("__whole")[order]), F.col(f"__part_{i}")[c]).otherwise(F.col("__whole")[c]).alias(c)
    return x.select(*keys, "num_reads", order, *(first(i, c) for i, c in enumerate(others)))


def fix_genes(df: DataFrame) -> DataFrame:
    """Exact and prefix corrections of V calls, then the blocklist."""
    v = X.fix_prefix(X.fix_allele(F.col("v_call")))
    return df.withColumn("v_call", v).where(~F.coalesce(F.col("v_call").isin(*X.GENE_BLOCKLIST), F.lit(False)))


def gene_fix_counts(df: DataFrame) -> DataFrame:
    """How many rows each correction of an allele changes."""
    fixed = X.fix_prefix(X.fix_allele(F.col("v_call")))
    return df.select(F.col("v_call").alias("was"), fixed.alias("fixed")).where("was <> fixed").groupBy("was", "fixed").agg(F.count("*").alias("n_rows"))


def with_reference(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Framework and CDR columns from the gene reference; unknown genes get nulls."""
    columns = [c for c in REFERENCE_COLUMNS if c in reference.columns]
    values = reference.select("v_call", *(X.clean_reference(F.col(c)).alias(c) for c in columns)).dropDuplicates(["v_call"])
    return df.drop(*columns).join(values, "v_call", "left")


def split_alleles(df: DataFrame) -> DataFrame:
    names = {"v_gene": X.gene(F.col("v_call")), "j_gene": X.gene(F.col("j_call")), "v_gene_w_allele": F.col("v_call"), "j_gene_w_allele": F.col("j_call")}
    return df.withColumns(names)


def required_only(df: DataFrame) -> DataFrame:
    for c in ("v_gene", "j_gene", "cdr3_aa"):
        df = df.where(F.col(c).isNotNull() & (F.col(c) != ""))
    return df


def derived(df: DataFrame, isotype: str = "TCRB") -> DataFrame:
    return df.withColumns({"isotype_supergroup": F.lit(isotype), "cdr3_aa_sequence_trim_len": F.length("cdr3_aa"), "igh_or_tcrb_clone_id": F.col("clone_id").cast("string")})


def clean(df: DataFrame, locus: str = "TCR", reference: DataFrame | None = None) -> DataFrame:
    """All steps in order; optional columns that are absent switch their step off."""
    df = clean_texts(standard_residues(v_score_above(productive_only(df), locus)))
    if {"sequence", "replicate_label"} <= set(df.columns):
        df = collapse_duplicates(df)
    df = fix_genes(df)
    if reference is not None:
        df = with_reference(df, reference)
    return derived(required_only(split_alleles(df)))


def long_enough(df: DataFrame, least: int = LEAST_CDR3) -> DataFrame:
    return df.where(F.col("cdr3_aa_sequence_trim_len") >= least)


def isotype_only(df: DataFrame, isotype: str = "TCRB") -> DataFrame:
    return df.where(F.col("isotype_supergroup") == isotype)


def locus_only(metadata: DataFrame, locus: str) -> DataFrame:
    return metadata.where(F.coalesce(F.col("available_gene_loci").rlike(locus), F.lit(False)))


def clone_keys(df: DataFrame) -> list[str]:
    return ["repertoire_id", *present(df, "amplification_label"), "igh_or_tcrb_clone_id", "isotype_supergroup"]


def downsample(df: DataFrame, order: str = "ord", columns: tuple[str, ...] | None = None) -> DataFrame:
    """The row of most reads of each clone, with the clone's size; rows without a key go.

    Of rows of equal reads the first in the order stays; a row of unknown reads only if there is no other. Of
    ``columns``, if given, only these and the keys are shuffled and stay.
    """
    keys = clone_keys(df)
    if columns is not None:
        df = df.select(*(c for c in df.columns if c in (*keys, *columns, "num_reads", order)))
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    others = [c for c in df.columns if c not in keys]
    top = F.min_by(F.struct(*others), F.struct(F.col("num_reads").isNull(), -F.col("num_reads"), order)).alias("__top")
    clones = by_hash(df, keys).agg(top, F.count(F.lit(1)).alias("num_clone_members"), F.sum("num_reads").cast("long").alias("total_clone_num_reads"))
    columns = [F.col(c) if c in keys else F.col("__top")[c].alias(c) for c in df.columns]
    return clones.select(*columns, "num_clone_members", "total_clone_num_reads").withColumnRenamed("repertoire_id", "specimen_label")


def clone_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("repertoire_id").agg(F.countDistinct("igh_or_tcrb_clone_id").alias("n_clones"), F.count("*").alias("n_sequences"))


def specimen_gate(df: DataFrame, least_clones: int = 500, least_sequences: int = 1000) -> DataFrame:
    """Whether each specimen passes, and why not."""
    counts = clone_counts(df)
    reason = F.when(F.col("n_clones") < least_clones, "few clones").when(F.col("n_sequences") < least_sequences, "few sequences")
    return counts.withColumn("reason", reason).withColumn("passes", F.col("reason").isNull())
