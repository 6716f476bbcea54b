"""Column counts kept up to date as genomes arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment as A


def counts(stream: DataFrame):
    """Streaming counts (chrom, col, base, n) of rows (chrom, row, seq), one state row for each column and base."""
    return A.histogram(stream)


def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Counts of old with those of a batch of new rows; for foreachBatch."""
    new = A.histogram(batch)
    return new if old is None else old.unionByName(new).groupBy("chrom", "col", "base").agg(F.sum("n").alias("n"))
