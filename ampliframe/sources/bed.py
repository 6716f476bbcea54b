"""Primer, amplicon and region BED files."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..errors import InputError
from ..functions import thermo

VERSION = "# artic-bed-version v3.0"
NAME = r"^(.+)_(\d+)_(LEFT|RIGHT)(?:_(\d+))?$"
COUNT_KEY = "pc"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) != '' AND NOT value LIKE '#%'").select(F.split("value", "\t").alias("f"))


def read_primers(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, stop, prefix, number, side, at, pool (from 0), strand, sequence, pc of primer lines."""
    f = lambda i: F.get("f", F.lit(i))
    part = lambda k: F.regexp_extract(f(3), NAME, k)
    lines = _lines(spark, path).select(
        f(0).alias("chrom"), f(1).cast("int").alias("start"), f(2).cast("int").alias("stop"), part(1).alias("prefix"), part(2).try_cast("int").alias("number"), part(3).alias("side"),
        part(4).try_cast("int").alias("at"), (f(4).cast("int") - 1).alias("pool"), f(5).alias("strand"), F.upper(f(6)).alias("sequence"), F.regexp_extract(F.coalesce(f(7), F.lit("")), rf"(?:^|;){COUNT_KEY}=([0-9.]+)", 1).try_cast("double").alias("pc"),
    )
    bad = lines.where("number IS NULL OR pool < 0 OR start >= stop OR strand NOT IN ('+', '-')").take(1)
    if bad:
        raise InputError(f"not a primer line: {bad[0]}")
    return lines


def pairs(lines: DataFrame) -> DataFrame:
    """One row for each amplicon: forward and reverse clouds with their common 3' ends; counts only if every line has them."""
    w = Window.partitionBy()
    every = lines.withColumn("_every", F.min(F.col("pc").isNotNull()).over(w)) if lines.where("pc IS NULL").isEmpty() else lines.withColumn("_every", F.lit(False))
    left, right = F.col("side") == "LEFT", F.col("side") == "RIGHT"
    cloud = lambda on: F.sort_array(F.collect_list(F.when(on, F.struct("sequence", F.when(F.col("_every"), F.col("pc")).alias("count")))))
    out = every.groupBy("chrom", "prefix", "number", "pool").agg(
        F.min(F.when(left, F.col("stop"))).alias("f_end"), F.max(F.when(left, F.col("stop"))).alias("_f"), F.min(F.when(left, F.col("start"))).alias("f_start"),
        F.min(F.when(right, F.col("start"))).alias("r_start"), F.max(F.when(right, F.col("start"))).alias("_r"), F.max(F.when(right, F.col("stop"))).alias("r_end"),
        cloud(left).alias("f_cloud"), cloud(right).alias("r_cloud"),
    )
    bad = out.where("f_end IS NULL OR r_start IS NULL OR f_end != _f OR r_start != _r").take(1)
    if bad:
        raise InputError(f"primers of one side differ in their 3' end, or a side is missing: {bad[0]}")
    return out.drop("_f", "_r")


def read_extra(spark: SparkSession, path: str, c: Config = Config(), strict_fix: bool = False) -> tuple[DataFrame, str]:
    """Pairs that a design starts from, and a line on their melting temperatures, which a reader is warned by and no more.

    A pool beyond n_pools is a fault; without strict_fix one too many is let through.
    """
    lines = read_primers(spark, path)
    tm = thermo.pair_melting(F.col("sequence"), c, strict_fix)
    low, high, pool = lines.agg(F.min(tm), F.max(tm), F.max("pool")).first()
    if pool is None:
        raise InputError(f"{path} has no primers")
    if pool + (1 if strict_fix else 0) > c.n_pools:
        raise InputError(f"{path} has pool {pool + 1} of {c.n_pools}")
    outside = low < c.primer_tm_min or high > c.primer_tm_max
    return pairs(lines), f"primer Tm {'outside range' if outside else 'range'}: {low:.2f} : {high:.2f} (range: {c.primer_tm_min} : {c.primer_tm_max})"


def primer_lines(pairs_: DataFrame) -> DataFrame:
    """line: BED lines of pairs, ordered by chrom, number, side and place in the cloud."""
    side = lambda cloud, name, strand: pairs_.select("chrom", "number", "prefix", "pool", "f_end", "r_start", F.lit(name).alias("side"), F.lit(strand).alias("strand"), F.posexplode(cloud).alias("at", "x"))
    rows = side("f_cloud", "LEFT", "+").unionByName(side("r_cloud", "RIGHT", "-"))
    size = F.length("x.sequence")
    start = F.when(F.col("side") == "LEFT", F.col("f_end") - size).otherwise(F.col("r_start"))
    stop = F.when(F.col("side") == "LEFT", F.col("f_end")).otherwise(F.col("r_start") + size)
    name = F.concat_ws("_", "prefix", "number", "side", (F.col("at") + 1).cast("string"))
    count = F.when(F.col("x.count").isNotNull(), F.concat(F.lit(f"\t{COUNT_KEY}="), F.col("x.count").cast("string"))).otherwise("")
    line = F.concat(F.concat_ws("\t", "chrom", start.cast("string"), stop.cast("string"), name, (F.col("pool") + 1).cast("string"), "strand", "x.sequence"), count)
    return rows.select("chrom", "number", "side", "at", "f_end", "r_start", line.alias("line"))


def primer_text(pairs_: DataFrame, headers: tuple[str, ...] = (VERSION,)) -> str:
    """A whole primer file as text; schemes are small, this is for their files."""
    lines = primer_lines(pairs_).orderBy("chrom", "number", "side", "at").select("line").toLocalIterator()
    return "\n".join([*(h if h.startswith("#") else f"# {h}" for h in headers), *(r.line for r in lines)]) + "\n"


def options_text(pairs_: DataFrame) -> str:
    """Pairs that could take one place, each under a header of its own: the fewest primers first."""
    order, out, last, k = ["n", "f_end", "r_start"], [], None, 0
    lines = primer_lines(pairs_).join(pairs_.select(*order), ["f_end", "r_start"]).orderBy(*order, "side", "at")
    for r in lines.toLocalIterator():
        if (r.f_end, r.r_start) != last:
            last, k = (r.f_end, r.r_start), k + 1
            out.append(f"# PrimerPair Option: {k}")
        out.append(r.line)
    return "".join(f"{x}\n" for x in out)


def amplicons(pairs_: DataFrame, trimmed: bool = False) -> DataFrame:
    """chrom, start, stop, name, pool (from 1) of amplicons, or of what lies between their primers."""
    start, stop = ("f_end", "r_start") if trimmed else ("f_start", "r_end")
    return pairs_.select("chrom", F.col(start).alias("start"), F.col(stop).alias("stop"), F.concat_ws("_", "prefix", F.col("number").cast("string")).alias("name"), (F.col("pool") + 1).alias("pool"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, stop, name, score, group of target regions; start must be before stop."""
    f = lambda i: F.get("f", F.lit(i))
    rows = _lines(spark, path).select(f(0).alias("chrom"), f(1).try_cast("int").alias("start"), f(2).try_cast("int").alias("stop"), f(3).alias("name"), f(4).try_cast("int").alias("score"), F.nullif(F.trim(f(5)), F.lit("")).alias("group"))
    bad = rows.where("start IS NULL OR stop IS NULL OR score IS NULL OR start >= stop").take(1)
    if bad:
        raise InputError(f"not a region: {bad[0]}")
    return rows


def primer_md5(text: str) -> str:
    """The checksum that run configurations hold: the text's characters joined by line feeds."""
    return hashlib.md5("\n".join(text).encode()).hexdigest()


def md5(text: str) -> str:
    """The checksum of a file's text."""
    return hashlib.md5(text.encode()).hexdigest()
