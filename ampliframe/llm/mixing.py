"""Operator 10, mixing sources to target weights by hash-threshold histograms; native.

Every document has a 48-bit hash of its id, the first digits of its MD5. Words are summed by source and hash bucket; the bucket in which the running
sum passes the source's budget is the boundary. Only rows in boundary buckets are summed again by the next bits, LEVELS
times. A document is taken if its hash lies below its source's threshold, which is a filter: nothing is sorted.
Thresholds of larger budgets lie above those of smaller ones, so mixes are nested.

A target above the source's size takes every document once and those below the threshold twice.

Sources are ranked by slices of their order, and the level at which capping stops is found by sums over all of them, so
that there may be as many sources as documents.

Defined cases: a null or empty text has size 0 and takes 0; a text of any length is counted whole; a null source is a source
of its own, the last; null ids hash with their text; rows of equal doc_id share a hash and are taken together, as do ties of
the hash; an empty table gives an empty result; other columns are carried along, whatever their names, but the names that
this operator adds (size, source_size, target, taken) replace columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARE = 1.5
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 2.0
BITS = 12
LEVELS = 4
SOURCES = 100_000


def targets(spark: SparkSession, sizes: DataFrame, scratch: common.Scratch) -> DataFrame:
    """source, source_size, target from one row for each source: shares by weight, capped at MOST times the size.

    The excess of capped sources goes to the others by weight until none is above: the share of a unit of weight rises with
    each round of sums over all sources, until no more are capped by it.
    """
    # order by UTF-8 bytes is the order of code points
    keyed = sizes.select("source", "source_size", F.col("source").isNull().alias("last"), F.encode("source", "UTF-8").alias("bytes"))
    rows, _ = common.ranked(spark, keyed, ["last", "bytes"], scratch, "sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("rank", F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = scratch.keep(rows.select("source", "source_size", weight.alias("w"), (MOST * F.col("source_size")).alias("cap")), "weights")
    level, over = None, F.lit(False)
    while True:
        every, capped, open_ = rows.agg(
            F.sum("source_size"), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))
        ).first()
        new = (SHARE * (every or 0) - capped) / open_ if open_ else math.inf
        if new == level or not open_:
            break
        level, over = new, F.col("cap") < F.col("w") * F.lit(new)
    return rows.select("source", "source_size", F.least("cap", F.col("w") * F.lit(float(new))).alias("target"))


def _digit(level: int) -> Column:
    return F.shiftrightunsigned("_hash", BITS * (LEVELS - level - 1)).bitwiseAND((1 << BITS) - 1)


def _prefix(level: int) -> Column:
    """The first level digits of the hash, as a number."""
    return F.shiftrightunsigned("_hash", BITS * (LEVELS - level)) if level else F.lit(0).cast("long")


def _key(source: str) -> Column:
    """A source as a name that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def mix(spark: SparkSession, docs: DataFrame, keep: list[str] | None = None, repeated: bool = False) -> DataFrame:
    """docs (or of it the columns keep) with size, source_size, target, taken; or, repeated, as often as the mix takes them."""
    added = () if repeated else ("size", "source_size", "target", "taken")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    scratch = common.Scratch(spark, "mix")
    sized = docs.select(
        common.row_of(keep).alias("row"),
        F.col("source").alias("_source"),
        _key("source").alias("_s"),
        common.n_words().alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("id"), F.col("doc_id").cast("string")), "text", F.lit(""))), 1, 12), 16, 10).cast("long").alias("_hash"),
    )
    columns = ["_source", "_s", "size", "_hash"]
    if "text" in keep:  # counting words again costs less than a copy of the texts
        narrow = scratch.keep(sized.select(columns), "sized")
    else:
        sized = scratch.keep(sized, "sized")
        narrow = sized.select(columns)
    sizes = narrow.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    goals = scratch.keep(targets(spark, sizes, scratch).withColumn("_s", _key("source")), "targets")
    # few sources: then documents need no shuffle; else hot ones are dealt over several tasks
    hot = common.Salted(narrow, ["_s"], ["_hash"]) if goals.count() > SOURCES else None
    meet = lambda many, few: hot.join(few, many=many) if hot else many.join(F.broadcast(few), "_s")
    # _budget: words still wanted below the threshold; _at: the boundary's digits so far
    budget = F.when(F.col("target") > F.col("source_size"), F.col("target") - F.col("source_size")).otherwise(F.col("target"))
    edge = goals.select("_s", budget.alias("_budget"), F.lit(0).cast("long").alias("_at"))
    for level in range(LEVELS):
        inside = meet(narrow.drop("_source"), edge).where(_prefix(level) == F.col("_at"))
        sums = inside.groupBy("_s", "_budget", "_at", _digit(level).alias("_d")).agg(F.sum("size").alias("_n"))
        run = Window.partitionBy("_s").orderBy("_d")  # 2 ** BITS rows of a source at most
        sums = sums.withColumn("_to", F.sum("_n").over(run))
        under = F.col("_to") <= F.col("_budget")
        step = sums.groupBy("_s", "_budget", "_at").agg(
            F.coalesce(F.min(F.when(~under, F.col("_d"))), F.lit(1 << BITS)).alias("_d"),
            F.coalesce(F.max(F.when(under, F.col("_to"))), F.lit(0)).alias("_below"),
            F.min(F.when(~under, F.col("_to"))).alias("_with"),
        )
        last = level == LEVELS - 1  # the last bucket, nearly always one document, goes to the nearer side
        up = F.when(F.lit(last) & (F.col("_with") - F.col("_budget") < F.col("_budget") - F.col("_below")), 1).otherwise(0)
        step = step.select("_s", (F.col("_budget") - F.col("_below")).alias("_left"), (F.col("_at") * (1 << BITS) + F.col("_d") + up).alias("_next"))
        # a source that is below its budget as a whole has no boundary bucket: its threshold stays above all hashes
        edge = edge.join(step, "_s", "left").select("_s", F.coalesce("_left", "_budget").alias("_budget"), F.coalesce("_next", F.col("_at") * (1 << BITS)).alias("_at"))
        edge = scratch.keep(edge, f"edge{level}")
    found = goals.drop("source").join(edge.select("_s", F.col("_at").alias("_threshold")), "_s", "left").withColumn("_threshold", F.coalesce("_threshold", F.lit(0)))
    below = _prefix(LEVELS) < F.col("_threshold")
    copies = F.when(F.col("target") > F.col("source_size"), F.when(below, 2).otherwise(1)).otherwise(F.when(below, 1).otherwise(0))
    out = meet(sized, found).select("row", "size", "source_size", "target", copies.cast("int").alias("copies"))
    if repeated:
        return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*common.unpacked("row", keep))
    return out.select(*common.unpacked("row", keep), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, common.table(spark, sf_dir, "documents"), keep=["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(spark, docs, repeated=True)


#: The same by sorting: whole budgets by running sums in order of the hash, the boundary to the nearer side.
OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5(coalesce('id' || doc_id, text, '')), 1, 12))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY source
), r AS (
  SELECT 0 AS step, 1.5::DOUBLE * sum(source_size) / sum(w) AS level FROM s
  UNION ALL
  SELECT step + 1, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(2.0::DOUBLE * source_size) FILTER (2.0::DOUBLE * source_size < w * level), 0)) / nullif(sum(w) FILTER (2.0::DOUBLE * source_size >= w * level), 0) FROM s)
  FROM r WHERE step < 40 AND level IS NOT NULL
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, w * coalesce((SELECT max(level) FROM r), 1e300)) AS target FROM s
), b AS (
  SELECT *, CASE WHEN target > source_size THEN target - source_size ELSE target END AS budget FROM t
), g AS (
  SELECT source, h, sum(size) AS n FROM d GROUP BY ALL
), c AS (
  SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g
), k AS (
  SELECT c.source, c.h, upto <= budget OR (upto - n <= budget AND upto - budget < budget - (upto - n)) AS below FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
)
SELECT d.doc_id, d.size::BIGINT AS size, b.source_size, b.target, (d.size * (CASE WHEN target > source_size THEN 1 ELSE 0 END + CASE WHEN k.below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
