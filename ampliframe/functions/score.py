"""Scores of primer pairs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config


def overlap(r_start: Column, n: Column, edge: Column, c: Config = Config(), backtrack: bool = False) -> Column:
    """Reach beyond the edge relative to the amplicon, squared, less for more primers; backtracking halves that weight."""
    reach = (r_start - c.min_overlap - edge) / F.lit(float(c.amplicon_size_max))
    return reach * reach / (F.sqrt(n) / 2 if backtrack else F.sqrt(n))


def walk(f_end: Column, n: Column, edge: Column) -> Column:
    """Small gaps first: distances behind the edge are divided, those before it multiplied by the root of the primers."""
    d = edge - f_end
    return F.when(d > 0, d / F.sqrt(n)).otherwise(d * F.sqrt(n))


def panel(total: Column, gc_diff: Column, half_covered: Column) -> Column:
    """Whole number: the region's score, less for unbalanced GC, ten times for a region that is covered in part."""
    return (total * (1 - gc_diff) * F.when(half_covered, 10).otherwise(1)).cast("long")
