"""Primers against genomes, and primers against primers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions import thermo

#: Primers that go to the genomes at a time.
PRIMERS = 2_000


def matrix(rows: DataFrame, primers: DataFrame) -> DataFrame:
    """chrom, row, primer, mismatches: the fewest mismatches of each primer's cloud (primer, at, seq) with each genome.

    Primers go to the genomes as constants, PRIMERS at a time; there is no join.
    """
    found = rows.limit(0).select("chrom", "row", F.lit(None).cast(primers.schema["primer"].dataType).alias("primer"), F.lit(0).alias("mismatches"))
    held = []
    for p in primers.select("primer", F.col("at").cast("int"), "seq").orderBy("primer", "at", "seq").toLocalIterator():
        if len(held) >= PRIMERS and p.primer != held[-1].primer:
            found, held = found.unionByName(_against(rows, held)), []
        held.append(p)
    return found.unionByName(_against(rows, held)) if held else found


def _against(rows: DataFrame, held: list) -> DataFrame:
    every = F.explode(F.array(*(F.struct(F.lit(p.primer).alias("primer"), F.lit(p["at"]).alias("at"), F.lit(p.seq).alias("seq")) for p in held)))
    each = rows.select("chrom", "row", "seq", every.alias("p"))
    template = F.regexp_replace(F.substring(F.col("seq"), F.col("p.at") + 1, F.length("p.seq")), "-", "")
    return each.select("chrom", "row", F.col("p.primer").alias("primer"), S.iupac_hamming(F.col("p.seq"), template).alias("n")).groupBy("chrom", "row", "primer").agg(F.min("n").alias("mismatches"))


def shown(found: DataFrame) -> DataFrame:
    """Interactions (a, b) with every offset that reaches the score, as text."""
    @F.pandas_udf("array<struct<offset: int, score: double>>")
    def offsets(a: pd.Series, b: pd.Series, limit: pd.Series) -> pd.Series:
        return pd.Series([[{"offset": k - (len(x) - 2), "score": float(v)} for k, v in enumerate(thermo.dimer_scores(x, y)) if v <= z] for x, y, z in zip(a, b, limit)])

    each = found.withColumn("_o", F.explode(offsets("a", "b", "limit")))
    # a place of a counts from its start, so that b moves to the right by what a hangs over
    return each.select("pool", "a", "b", F.col("_o.offset").alias("offset"), F.col("_o.score").alias("score"), S.alignment_text(F.col("a"), F.col("b"), F.col("_o.offset"), F.col("_o.score")).alias("text"))


def interactions(primers: DataFrame, limit: float) -> DataFrame:
    """Interacting primers of each pool: pool, a, b, score; all pairs of a pool's primers, which protocols keep to hundreds."""
    @F.pandas_udf("double")
    def lowest(a: pd.Series, b: pd.Series) -> pd.Series:
        n = np.arange(len(a))
        return pd.Series(thermo.lowest_scores(*thermo.coded([*a, *b]), n, n + len(a)).astype(float))

    p = primers.select("pool", "seq").distinct()
    both = p.withColumnRenamed("seq", "a").join(p.withColumnRenamed("seq", "b"), "pool").where("a <= b")
    return both.withColumn("score", lowest("a", "b")).where(F.col("score") <= limit)
