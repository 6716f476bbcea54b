"""Keeping schemes up to date: repair checks, replacement candidates, and smaller clouds."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import seq as S
from ..functions import thermo
from ..operators.digest import check
from . import solver


def repair(found: DataFrame, scheme: DataFrame, c: Config = Config(), strict_fix: bool = False) -> DataFrame:
    """What each newly seen sequence at a primer's site needs: found (site, pool, seq, count) against scheme (site, pool, seq).

    In order: a thermodynamic fault, PRESENT (one starts with the other), LOW_FREQUENCY (its number of genomes under
    min_base_freq, or with strict_fix its share), DIMER, else ADD.
    """

    def judge(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        pool, out = list(two.seq), []
        by = {s: list(g.seq) for s, g in two.groupby("site")}
        for site, g in one.sort_values(["site", "count", "seq"], ascending=[True, False, True]).groupby("site"):
            total = g["count"].sum()
            for r in g.rename(columns={"count": "seen"}).itertuples():
                status = check(r.seq, c, hairpin=True)
                if status == "PASS":
                    if any(s.startswith(r.seq) or r.seq.startswith(s) for s in by.get(site, [])):
                        status = "PRESENT"
                    elif (r.seen / total if strict_fix else r.seen) < c.min_base_freq:
                        status = "LOW_FREQUENCY"
                    elif thermo.interacts([r.seq], pool, c.dimer_score):
                        status = "DIMER"
                    else:
                        status = "ADD"
                        pool.append(r.seq)
                out.append((site, int(r.pool), r.seq, status))
        return pd.DataFrame(out, columns=["site", "pool", "seq", "status"])

    f = found.select("site", "pool", "seq", F.col("count").cast("double").alias("count"))
    return f.groupBy("pool").cogroup(scheme.select("site", "pool", "seq").groupBy("pool")).applyInPandas(judge, "site string, pool int, seq string, status string")


def unmasked(found: DataFrame, old, masked: bool, strict_fix: bool = False) -> DataFrame:
    """Sites but those of the old pair: its two ends, or masked, all columns under its primers. Without strict_fix reverse
    sites are masked under the forward primer, too."""
    left, right = F.col("direction") == "LEFT", F.col("direction") == "RIGHT"
    f = F.col("stop").between(old.f_start, old.f_end) if masked else F.col("stop") == old.f_end
    r = (F.col("start") >= old.r_start) & (F.col("start") < old.r_end) if masked else F.col("start") == old.r_start
    if masked and not strict_fix:
        r = r | F.col("start").between(old.f_start, old.f_end)
    return found.where(~(left & f) & ~(right & r))


def replacements(pairs: DataFrame, scheme: DataFrame, pool_seqs: list[str], msa: str, number: int, c: Config = Config(), strict_fix: bool = False) -> DataFrame:
    """Pairs near an amplicon of a scheme (RESULT rows), with status: OVERLAP with one of the pool, INTERACTING with the pool's
    other primers, or OK. Their forward sites lie before the old reverse site, and their reverse ones behind the end of the
    forward site of the amplicon that overlaps there; with strict_fix they reach from the amplicon before to the one after."""
    from ..operators import intervals

    old = scheme.where((F.col("msa") == msa) & (F.col("number") == number)).select("pool", "f_end", "r_start").first()
    rest = scheme.where((F.col("msa") == msa) & (F.col("number") != number))
    far = 2 * c.amplicon_size_max
    if strict_fix:
        edge = rest.agg(F.max(F.when(F.col("f_end") < old.f_end, F.col("r_start"))).alias("left"), F.min(F.when(F.col("r_start") > old.r_start, F.col("f_end"))).alias("right")).first()
        left, right = edge.left if edge.left is not None else old.f_end + c.min_overlap, edge.right if edge.right is not None else old.r_start - c.min_overlap
        near = pairs.where((F.col("msa") == msa) & F.col("f_end").between(left - far, left - c.min_overlap) & F.col("r_start").between(right + c.min_overlap, right + far))
    else:
        over = lambda at: (F.col("f_start") <= at) & (F.col("r_end") > at)
        edge = rest.agg(F.max(over(old.f_end)).alias("left"), F.min(F.when(over(old.r_start - 1), F.col("f_end"))).alias("right")).first()
        left, right = old.r_start - 1 if edge.left else old.r_start, edge.right if edge.right is not None else old.f_end
        near = pairs.where((F.col("msa") == msa) & F.col("f_end").between(left - far, left - 1) & F.col("r_start").between(right, right + far - 1))
    spans = near.select("*", F.lit(old.pool).alias("pool"), F.col("f_start").alias("start"), F.col("r_end").alias("stop"))
    keys = ["msa", "pool", "start", "stop"]
    free = intervals.clear_of(spans.select(*keys).distinct(), rest.select("msa", "pool", F.col("f_start").alias("start"), F.col("r_end").alias("stop")))

    @F.pandas_udf("boolean")
    def binds(seqs: pd.Series) -> pd.Series:
        clouds = pa.array([list(x) for x in seqs], pa.list_(pa.string()))
        pool = pa.array([pool_seqs] * len(seqs), pa.list_(pa.string()))
        return pd.Series(thermo.clouds_bind(clouds, pool, c.dimer_score))

    marked = spans.join(free.withColumn("_free", F.lit(True)), keys, "left")
    status = F.when(F.col("_free").isNull(), "OVERLAP").when(binds("seqs"), "INTERACTING").otherwise("OK")
    return marked.withColumn("status", status).drop("_free", "start", "stop")


def downsampled(clouds: DataFrame, c: Config = Config()) -> DataFrame:
    """site, seqs: each site's cloud (site, seq, count) cut down; sites that cannot be served go."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        kept = solver.downsample(dict(zip(pdf.seq, pdf["count"].astype(float))), c)
        return pd.DataFrame({"site": pd.Series([key[0]] if kept else [], dtype=object), "seqs": pd.Series([kept] if kept else [], dtype=object)})

    counted = clouds.groupBy("site", "seq").agg(F.sum("count").alias("count"))
    return counted.groupBy("site").applyInPandas(run, "site string, seqs array<string>")


def present(found: DataFrame, scheme: DataFrame) -> DataFrame:
    """found with known: whether a scheme primer of the site starts with it or it with one."""
    s = scheme.select("site", F.col("seq").alias("_s"))
    hit = found.join(s, "site").where(S.same_start(F.col("seq"), F.col("_s"))).select(*found.columns).distinct().withColumn("known", F.lit(True))
    return found.join(hit, found.columns, "left").withColumn("known", F.coalesce("known", F.lit(False)))
