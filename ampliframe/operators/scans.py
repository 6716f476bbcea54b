"""Running values along a line, by blocks of positions: no task holds a whole line, however few and long the lines are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def scan(df: DataFrame, key: str, order: list[str], width: int = BLOCK, **wanted: tuple[str, Column]) -> DataFrame:
    """df with a column for each of wanted, which names a kind and the value that it is taken of.

    Kinds: max_before and sum_before (of the rows before, in the order of order and within a key), lag and lead. Rows are dealt
    by key and block of the first order column, which is the one shuffle of them; a block's own sums, of which there are few,
    are run over once more for what the blocks before and behind add.
    """
    rows = df.withColumn("_block", F.floor(F.col(order[0]) / width))
    place = F.struct(*order)
    inside, blocks = Window.partitionBy(key, "_block").orderBy(*order), Window.partitionBy(key).orderBy("_block")
    before, passed = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (inside, blocks))
    own = {"max_before": lambda v: F.max(v).over(before), "sum_before": lambda v: F.sum(v).over(before), "lag": lambda v: F.lag(v).over(inside), "lead": lambda v: F.lead(v).over(inside)}
    whole = {"max_before": F.max, "sum_before": F.sum, "lag": lambda v: F.max_by(v, place), "lead": lambda v: F.min_by(v, place)}
    beyond = {"max_before": lambda c: F.max(c).over(passed), "sum_before": lambda c: F.sum(c).over(passed), "lag": lambda c: F.lag(c).over(blocks), "lead": lambda c: F.lead(c).over(blocks)}
    edges = rows.groupBy(key, "_block").agg(*(whole[kind](v).alias(f"_{name}") for name, (kind, v) in wanted.items()))
    edges = edges.select(key, "_block", *(beyond[kind](f"_{name}").alias(f"_{name}") for name, (kind, _) in wanted.items()))
    out = rows.withColumns({name: own[kind](v) for name, (kind, v) in wanted.items()}).join(edges, [key, "_block"])
    both = {"max_before": F.greatest, "sum_before": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "lag": F.coalesce, "lead": F.coalesce}
    return out.withColumns({name: both[kind](F.col(name), F.col(f"_{name}")) for name, (kind, _) in wanted.items()}).drop("_block", *(f"_{name}" for name in wanted))
