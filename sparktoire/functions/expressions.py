"""Scalar expressions over sequences, genes, probabilities and scores. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The amino acids, corrections of gene names, and genes that are never used.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
ALLELE_FIXES = {"TRBV6-2*02": "TRBV6-2*01"}
PREFIX_FIXES = {"TRBV12-4*": "TRBV12-3*01", "TRBV6-3*": "TRBV6-2*01"}
GENE_BLOCKLIST = ("TRBV25/OR9-2*01",)
V_SCORE_LEAST = {"TCR": 80.0, "BCR": 200.0}
IDENTITY_THRESHOLDS = {("TCR", "nt"): 0.95, ("BCR", "nt"): 0.90, ("TCR", "aa"): 0.90, ("BCR", "aa"): 0.85}


def airr_boolean(c: Column) -> Column:
    """``T`` or ``F`` in upper case, as text."""
    return F.upper(c.cast("string"))


def unspaced(c: Column) -> Column:
    """Spaces removed, upper case."""
    return F.upper(F.replace(c, F.lit(" "), F.lit("")))


def clean_sequence(c: Column) -> Column:
    """Spaces removed, upper case; empty text and ``NAN`` become null."""
    return F.nullif(F.nullif(unspaced(c), F.lit("")), F.lit("NAN"))


def clean_reference(c: Column) -> Column:
    """Dots, dashes, spaces and stars removed, upper case; empty text becomes null."""
    return F.nullif(F.upper(F.translate(c, ".- *", "")), F.lit(""))


def clean_nucleotides(c: Column) -> Column:
    """Dashes removed, upper case; null unless all that is left are A, C, G and T."""
    x = F.upper(F.replace(c, F.lit("-"), F.lit("")))
    return F.when(x.rlike("^[ACGT]+$"), x)


def has_other_residues(c: Column) -> Column:
    """Whether a sequence has a character that is no amino acid; false for null."""
    return F.coalesce(c.rlike(f"[^{AMINO_ACIDS}]"), F.lit(False))


def fix_allele(c: Column) -> Column:
    out = c
    for old, new in ALLELE_FIXES.items():
        out = F.when(c == old, new).otherwise(out)
    return out


def fix_prefix(c: Column) -> Column:
    out = c
    for old, new in PREFIX_FIXES.items():
        out = F.when(c.startswith(old), new).otherwise(out)
    return out


def gene(c: Column) -> Column:
    """A gene call without its allele."""
    return F.substring_index(c, "*", 1)


def vj_key(v: Column, j: Column, isotype: Column | None = None) -> Column:
    key = F.concat_ws("|", v, j)
    return key if isotype is None else F.concat_ws(":", key, isotype)


def sanitized(c: Column) -> Column:
    """A group key without the separator of feature names."""
    return F.translate(c, "_", "-")


def pair_name(disease: Column, reference: Column) -> Column:
    """A name for a pair of classes that is safe in file systems."""
    return F.regexp_replace(F.concat(disease, F.lit("_vs_"), reference), r"[^A-Za-z0-9_.-]+", "_")


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of two texts of equal length; an error if the lengths differ."""
    different = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return F.when(F.length(a) == F.length(b), different).otherwise(F.raise_error(F.lit("sequences differ in length")).cast("int"))


def hamming_identity(a: Column, b: Column) -> Column:
    """The share of equal positions; 1 for two empty texts."""
    return F.when(F.length(a) == 0, 1.0).otherwise(1 - hamming(a, b) / F.length(a))


def entropy(p: Column) -> Column:
    """Shannon entropy in nats of an array, normalised to sum 1 first; null if it sums to 0."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    terms = F.transform(p, lambda x: F.when(x > 0, -(x / total) * F.ln(x / total)).otherwise(0.0))
    return F.when(total != 0, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def identity_threshold(locus: str, nucleotides: bool, override: float | None = None) -> float:
    """The default identity of a clone, or a checked override."""
    if override is None:
        return IDENTITY_THRESHOLDS[locus, "nt" if nucleotides else "aa"]
    if not 0 < override <= 1:
        raise ValueError(f"identity threshold {override} is not in (0, 1]")
    return override


def most_mismatches(length: Column, identity: float) -> Column:
    """The largest number of mismatches that is near enough: ``d / length <= 1 - identity`` in doubles."""
    cut = F.lit(1.0 - identity)
    d = F.floor(length * cut).cast("int")
    return F.when((d + 1) / length.cast("double") <= cut, d + 1).when(d / length.cast("double") <= cut, d).otherwise(d - 1)
