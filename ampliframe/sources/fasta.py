"""Alignments in FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NoRecords, NotABase, RepeatedName, UnequalLengths

CODES = "ACGTRYSWKMBDHVN-"
WIDTH = 60


def read(spark: SparkSession, path: str, aligned: bool = True) -> DataFrame:
    """path, row, name, seq of FASTA files: upper case, names up to the first blank with / and - made _.

    One aggregate checks all files; the first fault found is raised.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r", "").alias("value"))
    parts = files.select("path", F.posexplode(F.split(F.concat(F.lit("\n"), "value"), "\n>")).alias("k", "record"))
    head = F.substring_index("record", "\n", 1)
    rows = parts.where("k > 0").select("path", (F.col("k") - 1).alias("row"), F.translate(F.substring_index(head, " ", 1), "/-", "__").alias("name"), F.upper(F.regexp_replace(F.expr("substring(record, length(substring_index(record, '\n', 1)) + 1)"), r"\s", "")).alias("seq"))
    if aligned:
        check(parts, rows)
    return rows


def check(parts: DataFrame, rows: DataFrame) -> None:
    found = rows.groupBy("path").agg(
        F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.min(F.length("seq")).alias("low"), F.max(F.length("seq")).alias("high"),
        F.max((~F.col("seq").rlike(f"^[{CODES}]*$")).cast("int")).alias("odd"),
    )
    files = parts.groupBy("path").agg(F.max(F.when((F.col("k") == 0) & (F.trim(F.regexp_replace("record", r"\s", "")) != ""), 1).otherwise(0)).alias("loose"))
    for r in files.join(found, "path", "left").collect():  # a row for each file
        if not r.n or r.loose:
            raise NoRecords(r.path)
        if r.names < r.n:
            raise RepeatedName(r.path)
        if r.low != r.high:
            raise UnequalLengths(r.path)
        if r.odd:
            raise NotABase(r.path)


def strip_ends(rows: DataFrame) -> DataFrame:
    """lead and tail: how many leading and trailing gaps of seq are ends that were not sequenced, not deletions."""
    lead = F.length(F.regexp_extract("seq", "^-*", 0))
    return rows.withColumn("lead", lead).withColumn("tail", F.when(F.col("lead") == F.length("seq"), 0).otherwise(F.length(F.regexp_extract("seq", "-*$", 0))))


def record_text(rows: DataFrame) -> DataFrame:
    """rows with fasta: the record in lines of WIDTH characters."""
    return rows.withColumn("fasta", F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace("seq", f"(.{{{WIDTH}}})(?=.)", "$1\n")))


def write(rows: DataFrame, path: str) -> None:
    record_text(rows).select("fasta").write.text(path)


def lookup(records: DataFrame, name: str) -> DataFrame:
    """The record of a name; all names are listed if there is none."""
    found = records.where(F.col("name") == name)
    if found.isEmpty():
        raise KeyError(f"{name} is not among {sorted(r.name for r in records.select('name').take(100))}")
    return found
