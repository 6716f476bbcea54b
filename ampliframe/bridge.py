"""Alignments made from the driver's text tables, alike in Spark and in SQL.

Letters become bases by a fixed map, among them gaps (w), N (x) and the ambiguous R and Y (y, z); all else is left out.
A row's columns beyond its end are terminal gaps: they are not stored, but counted where the semantics count them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTAC-NRY"


def sequence(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.translate(F.regexp_replace(F.lower(col), "[^a-z]", ""), LETTERS, BASES)


def sequence_sql(text: str) -> str:
    return f"translate(regexp_replace(lower({text}), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}')"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, row, seq: an alignment for each language of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("lang").alias("chrom"), F.col("doc_id").alias("row"), sequence("text").alias("seq")).where("seq != ''")


ROWS = f"SELECT lang AS chrom, doc_id AS row, {sequence_sql('text')} AS seq FROM documents WHERE {sequence_sql('text')} <> ''"


def cells(aligned: DataFrame) -> DataFrame:
    """chrom, row, col, base; terminal gaps at the start are ''."""
    lead = F.length(F.regexp_extract("seq", "^-*", 0))
    tail = F.length("seq") - F.when(lead == F.length("seq"), 0).otherwise(F.length(F.regexp_extract("seq", "-*$", 0)))
    # the ends are found in a projection of their own: beside the explode they would be found again for each cell
    ended = aligned.select("chrom", "row", lead.alias("_lead"), tail.alias("_tail"), F.split("seq", "").alias("_cells"))
    out = ended.select("chrom", "row", "_lead", "_tail", F.posexplode("_cells").alias("col", "base")).where("base != ''")
    return out.select("chrom", "row", "col", F.when((F.col("col") < F.col("_lead")) | (F.col("col") >= F.col("_tail")), "").otherwise(F.col("base")).alias("base"))


CELLS = f"""
rows_ AS ({ROWS}),
cells_ AS (
  SELECT chrom, row, (i - 1)::INTEGER AS col, CASE WHEN i <= lead OR i > CASE WHEN lead = n THEN n ELSE n - trail END THEN '' ELSE substr(seq, i, 1) END AS base
  FROM (SELECT *, length(seq) AS n, length(regexp_extract(seq, '^-*')) AS lead, length(regexp_extract(seq, '-*$')) AS trail, unnest(range(1, length(seq) + 1)) AS i FROM rows_)
)"""
