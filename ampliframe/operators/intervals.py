"""Range joins, overlaps and coverage: binned equi-joins and scans by blocks, never a join on a range alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .scans import scan


def range_pairs(forward: DataFrame, reverse: DataFrame, c: Config = Config()) -> DataFrame:
    """Primer pairs: forward (msa, f_start, f_end, ...) with reverse (msa, r_start, ...) whose start lies amplicon_size_min
    to amplicon_size_max behind f_start, both included.

    Bins are as wide as the window, so that a forward primer meets two or three bins and each pair is found once.
    """
    low, high = c.amplicon_size_min, c.amplicon_size_max
    width = max(high - low + 1, 1)
    bins = F.sequence(F.floor((F.col("f_start") + low) / width), F.floor((F.col("f_start") + high) / width))
    # an explicit number of partitions: what comes out of the join is far larger than what goes in
    n = int(forward.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = forward.withColumn("_bin", F.explode(bins)).repartition(n, "msa", "_bin")
    r = reverse.withColumn("_bin", F.floor(F.col("r_start") / width)).repartition(n, "msa", "_bin")
    return f.join(r, ["msa", "_bin"]).where(F.col("r_start").between(F.col("f_start") + low, F.col("f_start") + high)).drop("_bin")


def window(pairs: DataFrame, f_min: int, f_max: int, r_min: int) -> DataFrame:
    return pairs.where(F.col("f_end").between(f_min, f_max) & (F.col("r_start") >= r_min))


def merged(spans: DataFrame, *keys: str) -> DataFrame:
    """Union of spans [start, stop) of each key, as disjoint maximal spans (touching ones are joined)."""
    (key,) = keys if len(keys) == 1 else ("_key",)
    spans = spans.where("start < stop")
    if len(keys) > 1:
        spans = spans.withColumn(key, F.struct(*keys))
    marked = scan(spans.select(key, "start", "stop"), key, ["start", "stop"], _reach=("max_before", F.col("stop")))
    begins = F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))
    runs = scan(marked.withColumn("_begin", F.when(begins, F.col("start"))), key, ["start", "stop"], _last=("max_before", F.col("_begin")))
    found = runs.groupBy(key, F.coalesce("_begin", "_last").alias("start")).agg(F.max("stop").alias("stop"))
    return found.select(*([key] if len(keys) == 1 else [F.col(f"{key}.{k}").alias(k) for k in keys]), "start", "stop")


def coverage(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per cent of each msa's columns under a span."""
    inside = merged(spans, "msa").join(sizes, "msa").select("msa", (F.least("stop", "size") - F.least("start", "size")).alias("n"))
    sums = inside.groupBy("msa").agg(F.sum("n").alias("n"))
    return sizes.join(sums, "msa", "left").select("msa", F.round(F.coalesce("n", F.lit(0)) / F.col("size") * 100, 2).alias("coverage"))


def uncovered(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """Maximal runs of columns under no span: msa, start, stop (exclusive)."""
    runs = merged(spans, "msa").select("msa", "start", "stop")
    ends = runs.unionByName(sizes.select("msa", F.col("size").alias("start"), F.col("size").alias("stop")))
    gaps = scan(ends, "msa", ["start", "stop"], _from=("max_before", F.col("stop"))).join(sizes, "msa")
    return gaps.select("msa", F.coalesce("_from", F.lit(0)).alias("start"), F.least("start", "size").alias("stop")).where("start < stop")


def around_origin(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """Uncovered runs of circular genomes: a run at the end and one at the start are one that starts at the former and stops,
    beyond size, where the latter does."""
    runs = uncovered(spans, sizes).join(sizes, "msa")
    head = runs.where("start = 0").select("msa", F.col("stop").alias("_more"))
    joined = runs.join(head, "msa", "left").withColumn("_wraps", (F.col("stop") == F.col("size")) & F.col("_more").isNotNull() & (F.col("start") > 0))
    wraps = joined.where("_wraps").select("msa", F.lit(True).alias("_wrapped"))
    kept = joined.join(wraps, "msa", "left").where("_wrapped IS NULL OR start > 0")
    return kept.select("msa", "start", F.when(F.col("_wraps"), F.col("size") + F.col("_more")).otherwise(F.col("stop")).alias("stop"))


def gaps(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """Uncovered runs as reported: the stop is exclusive, but a run up to the end stops at the last column."""
    return uncovered(spans, sizes).join(sizes, "msa").select("msa", "start", F.when(F.col("stop") == F.col("size"), F.col("stop") - 1).otherwise(F.col("stop")).alias("stop"))


def clear_of(spans: DataFrame, taken: DataFrame, bin_size: int = 512, closed: bool = False) -> DataFrame:
    """Rows of spans (msa, pool, start, stop) that overlap none of taken in msa and pool; closed spans also may not touch."""
    last = 0 if closed else 1
    bins = lambda d: d.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.greatest(F.col("stop") - last, F.col("start")) / bin_size))))
    t = bins(taken).select(F.col("msa").alias("_m"), F.col("pool").alias("_p"), F.col("_b").alias("_tb"), F.col("start").alias("_s"), F.col("stop").alias("_e"))
    apart = (F.col("_s") <= F.col("stop")) & (F.col("start") <= F.col("_e")) if closed else (F.col("_s") < F.col("stop")) & (F.col("start") < F.col("_e"))
    hit = bins(spans).join(t, (F.col("msa") == F.col("_m")) & (F.col("pool") == F.col("_p")) & (F.col("_b") == F.col("_tb")) & apart, "left_semi")
    keys = spans.columns
    return spans.join(hit.select(*keys).distinct(), keys, "left_anti")


def region_scores(regions: DataFrame) -> DataFrame:
    """msa, start, stop, score: constant pieces of the sum of overlapping regions' scores."""
    edges = regions.select("msa", F.explode(F.array(F.struct(F.col("start").alias("at"), F.col("score").alias("d")), F.struct(F.col("stop").alias("at"), (-F.col("score")).alias("d")))).alias("e")).select("msa", "e.at", "e.d")
    steps = edges.groupBy("msa", "at").agg(F.sum("d").alias("d"))
    pieces = scan(steps, "msa", ["at"], stop=("lead", F.col("at")), _before=("sum_before", F.col("d")))
    return pieces.select("msa", F.col("at").alias("start"), "stop", (F.col("_before") + F.col("d")).alias("score")).where("stop IS NOT NULL AND score != 0")


def prefix_sums(pieces: DataFrame) -> DataFrame:
    """The pieces with the score of all positions before them, so that any span's score is two lookups."""
    return scan(pieces, "msa", ["start"], before=("sum_before", F.col("score") * (F.col("stop") - F.col("start"))))


def region_coverage(regions: DataFrame, spans: DataFrame) -> DataFrame:
    """Mean coverage of each region, rounded to two digits."""
    m = merged(spans, "msa").select("msa", F.col("start").alias("_s"), F.col("stop").alias("_e"))
    wide = 4096
    b = lambda d, s, e: d.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / wide), F.floor((F.col(e) - 1) / wide))))
    mb = b(m, "_s", "_e").withColumnRenamed("msa", "_m").withColumnRenamed("_b", "_mb")
    rb = b(regions, "start", "stop")
    low, high = F.greatest("start", "_s", F.col("_b") * wide), F.least("stop", "_e", (F.col("_b") + 1) * wide)
    hit = rb.join(mb, (F.col("msa") == F.col("_m")) & (F.col("_b") == F.col("_mb")), "left").withColumn("_n", F.greatest(F.coalesce(high - low, F.lit(0)), F.lit(0)))
    keys = regions.columns
    return hit.groupBy(*keys).agg(F.sum("_n").alias("_n")).select(*keys, F.round(F.col("_n") / (F.col("stop") - F.col("start")), 2).alias("mean_coverage"))


def near_regions(regions: DataFrame, sizes: DataFrame, c: Config = Config()) -> DataFrame:
    """msa, direction, start, stop: the columns from which an amplicon can reach a column of a region (msa, start, stop), as
    disjoint runs; forward primers end within amplicon_size_max before it, reverse ones start within that behind it."""
    r = regions.join(sizes, "msa")
    most = c.amplicon_size_max
    left = r.select("msa", F.lit("LEFT").alias("direction"), F.greatest(F.col("start") - most, F.lit(0)).alias("start"), F.least(F.col("stop"), "size").alias("stop"))
    right = r.select("msa", F.lit("RIGHT").alias("direction"), "start", F.least(F.col("stop") - 1 + most, F.col("size")).alias("stop"))
    return merged(left.unionByName(right), "msa", "direction")


def same_group(regions: DataFrame, spans: DataFrame) -> DataFrame:
    """Regions (msa, start, stop, group) whose group has a region that a span (msa, start, stop) touches, ends included."""
    wide = 4096
    b = lambda d: F.explode(F.sequence(F.floor(F.col("start") / wide), F.floor(F.col("stop") / wide)))
    r = regions.where("group IS NOT NULL").withColumn("_b", b(regions))
    s = spans.withColumn("_b", b(spans)).select(F.col("msa").alias("_m"), F.col("_b").alias("_sb"), F.col("start").alias("_s"), F.col("stop").alias("_e"))
    hit = r.join(s, (F.col("msa") == F.col("_m")) & (F.col("_b") == F.col("_sb")) & (F.col("start") <= F.col("_e")) & (F.col("_s") <= F.col("stop")), "left_semi")
    return regions.join(hit.select("msa", "group").distinct(), ["msa", "group"], "left_semi").select(*regions.columns)


def clear_of_regions(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """Primer sites (msa, start, stop) that touch no region, ends included."""
    own = sites.columns
    one = lambda d: d.withColumn("pool", F.lit(0))
    return clear_of(one(sites), one(regions.select("msa", "start", "stop")).select("msa", "pool", "start", "stop"), closed=True).select(*own)


def msa_index(lines: DataFrame, names: DataFrame) -> DataFrame:
    """lines (chrom, ...) with msa_index of names (chrom, msa_index); -1 for a name that no alignment has."""
    return lines.join(names, "chrom", "left").withColumn("msa_index", F.coalesce("msa_index", F.lit(-1)))


def tally(found: DataFrame, status: str) -> DataFrame:
    """status, n: how often each occurs, the most common first."""
    return found.groupBy(status).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), status)
