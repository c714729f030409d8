"""The virtual repertoire over the driver tables, the query registry and shared SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparktoire.operators import cleaning

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One statement for both engines: sequence rows made of the order tables.
REPERTOIRE = """
SELECT concat_ws('-', CAST(l_orderkey AS string), CAST(l_linenumber AS string), CAST(l_partkey AS string), CAST(l_suppkey AS string), CAST(CAST(round(l_extendedprice * 100) AS bigint) AS string)) AS ord,
       concat('P', CAST(c_custkey AS string)) AS participant_label,
       concat('S', CAST(c_custkey AS string), '-', l_returnflag) AS repertoire_id,
       c_mktsegment AS disease,
       CAST(c_custkey % 3 AS int) AS CV_fold,
       CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN 'f' WHEN l_linenumber % 2 = 0 THEN 't' ELSE 'T' END AS productive,
       l_quantity * 5 AS v_score,
       CASE p_brand WHEN 'Brand#6' THEN 'TRBV6-2*02' WHEN 'Brand#12' THEN 'TRBV12-4*03' WHEN 'Brand#25' THEN 'TRBV25/OR9-2*01'
            ELSE concat(replace(p_brand, 'Brand#', 'TRBV'), '*0', CAST(1 + p_partkey % 2 AS string)) END AS v_call,
       concat('TRBJ-', p_type, '*01') AS j_call,
       CASE WHEN (l_orderkey * 7 + l_linenumber) % 23 = 0 THEN concat(substr(cdr3, 1, 3), '*', substr(cdr3, 5))
            WHEN (l_orderkey * 7 + l_linenumber) % 11 = 0 THEN concat(' ', lower(cdr3)) ELSE cdr3 END AS cdr3_aa,
       md5(concat(CAST(p_partkey AS string), '-', CAST(c_custkey AS string))) AS sequence,
       concat('R', CAST(l_linenumber % 2 AS string)) AS replicate_label,
       CAST(l_quantity AS int) AS num_reads,
       CAST(p_partkey % 50 AS string) AS clone_id,
       CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_linestatus END AS amplification_label
FROM (SELECT l.*, p.p_partkey, p.p_brand, p.p_type, c.c_custkey, c.c_mktsegment,
             CASE WHEN c.c_mktsegment = 'BUILDING' AND p.p_partkey % 10 = 0 THEN concat('WWW', substr(p.b, 4))
                  WHEN l.l_orderkey % 4 = 0 THEN concat(substr(p.b, 1, 5), 'W', substr(p.b, 7)) ELSE p.b END AS cdr3
      FROM (SELECT *, substr(translate(md5(CAST(p_partkey AS string)), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), 1, CAST(8 + p_partkey % 14 AS int)) AS b FROM {part}) p
      JOIN {lineitem} l ON l.l_partkey = p.p_partkey JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey) t
"""


#: The joins of ``REPERTOIRE`` one after the other, and the same with customers joined to the orders first: inner joins give
#: the same rows in any order, and the lines, the largest table, are shuffled once less where no table is small.
_JOINS = "JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey"
_PEOPLE = "JOIN (SELECT o_orderkey, c_custkey, c_mktsegment FROM {orders} JOIN {customer} ON c_custkey = o_custkey) c ON c.o_orderkey = l.l_orderkey"
#: What queries read of downsampled rows.
DOWNSAMPLED = ("participant_label", "disease", "CV_fold", "v_gene", "j_gene", "cdr3_aa", "cdr3_aa_sequence_trim_len")


def repertoire(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in ("part", "lineitem", "orders", "customer")}
    return spark.sql(REPERTOIRE.replace(_JOINS, _PEOPLE), **tables)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per specimen."""
    return repertoire(spark, sf_dir).select("participant_label", F.col("repertoire_id").alias("specimen_label"), "disease", "CV_fold").distinct()


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.isotype_only(cleaning.long_enough(cleaning.clean(repertoire(spark, sf_dir))))


def downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.downsample(cleaned(spark, sf_dir), columns=DOWNSAMPLED)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downsampled rows under the names that clustering uses."""
    return downsampled(spark, sf_dir).select("participant_label", "specimen_label", "disease", "CV_fold", "v_gene", "j_gene", F.col("cdr3_aa_sequence_trim_len").alias("cdr3_len"), F.col("cdr3_aa").alias("cdr3"), F.col("num_clone_members").alias("weight"), "ord")


_FIRST = "arg_min({0}, ord) FILTER (WHERE {0} IS NOT NULL) AS {0}"
_OTHERS = ", ".join(_FIRST.format(c) for c in ("repertoire_id", "disease", "CV_fold", "v_call", "j_call", "cdr3_aa", "clone_id", "amplification_label"))

#: Common table expressions: ``rep``, ``meta``, ``ok``, ``dedup``, ``clean``, ``down`` and ``seqs``.
WITH = f"""WITH rep AS ({REPERTOIRE.format(part='part', lineitem='lineitem', orders='orders', customer='customer')}),
meta AS (SELECT DISTINCT participant_label, repertoire_id AS specimen_label, disease, CV_fold FROM rep),
ok AS (SELECT * FROM (SELECT * REPLACE (nullif(nullif(upper(replace(cdr3_aa, ' ', '')), ''), 'NAN') AS cdr3_aa) FROM rep WHERE upper(productive) = 'T' AND v_score > 80)
       WHERE cdr3_aa IS NULL OR NOT regexp_matches(cdr3_aa, '[^ACDEFGHIKLMNPQRSTVWY]')),
dedup AS (SELECT participant_label, sequence, replicate_label, CAST(sum(num_reads) AS BIGINT) AS num_reads, min(ord) AS ord, {_OTHERS} FROM ok GROUP BY participant_label, sequence, replicate_label),
fixed AS (SELECT * REPLACE (CASE WHEN v_call = 'TRBV6-2*02' THEN 'TRBV6-2*01' WHEN v_call LIKE 'TRBV12-4*%' THEN 'TRBV12-3*01' WHEN v_call LIKE 'TRBV6-3*%' THEN 'TRBV6-2*01' ELSE v_call END AS v_call) FROM dedup),
clean AS (SELECT *, split_part(v_call, '*', 1) AS v_gene, split_part(j_call, '*', 1) AS j_gene, 'TCRB' AS isotype_supergroup, length(cdr3_aa) AS cdr3_len
          FROM fixed WHERE v_call <> 'TRBV25/OR9-2*01' AND j_call <> '' AND cdr3_aa IS NOT NULL AND length(cdr3_aa) >= 8),
down AS (SELECT * RENAME (repertoire_id AS specimen_label) FROM (SELECT *, count(*) OVER w AS num_clone_members, CAST(sum(num_reads) OVER w AS BIGINT) AS total_clone_num_reads,
           row_number() OVER (PARTITION BY repertoire_id, amplification_label, clone_id ORDER BY num_reads DESC, ord) AS r
         FROM clean WHERE repertoire_id IS NOT NULL AND amplification_label IS NOT NULL AND clone_id IS NOT NULL WINDOW w AS (PARTITION BY repertoire_id, amplification_label, clone_id)) WHERE r = 1),
seqs AS (SELECT participant_label, specimen_label, disease, CV_fold, v_gene, j_gene, cdr3_len, cdr3_aa AS cdr3, num_clone_members AS weight, ord FROM down)
"""
