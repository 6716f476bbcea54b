"""Run files: qc.json and plotdata.json.gz."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as I


def qc(spans: DataFrame, sizes: DataFrame) -> str:
    """coverage, n_amplicons, n_gaps of each alignment."""
    n = spans.groupBy("msa").agg(F.count("*").alias("n"))
    g = I.gaps(spans, sizes).groupBy("msa").agg(F.count("*").alias("g"))
    rows = I.coverage(spans, sizes).join(n, "msa", "left").join(g, "msa", "left").na.fill(0).collect()  # a row for each alignment
    return json.dumps({str(r.msa): {"coverage": r.coverage, "n_amplicons": r.n, "n_gaps": r.g} for r in rows}, sort_keys=True)


def plot_data(**frames: DataFrame) -> dict:
    """Frames (chrom, col, value) as {chrom: {frame: [[col, value], ...]}}."""
    out: dict[str, dict] = {}
    for name, df in frames.items():
        points = df.groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("p"))
        for r in points.toLocalIterator():
            out.setdefault(r.chrom, {})[name] = [[p.col, p.value] for p in r.p]
    return out


def amplicon_summary(scheme: DataFrame) -> DataFrame:
    """chrom, name, s, cs, ce, e, p, n: outer and inner start and end, pool from 1, and number of each amplicon."""
    return scheme.select("chrom", F.concat_ws("_", "prefix", F.col("number").cast("string")).alias("name"), F.col("f_start").alias("s"), F.col("f_end").alias("cs"), F.col("r_start").alias("ce"), F.col("r_end").alias("e"), (F.col("pool") + 1).alias("p"), F.col("number").alias("n"))


def site_counts(found: DataFrame) -> DataFrame:
    """chrom, side (F or R), at, n: how many sequences the site that ends or starts there has."""
    left = F.col("direction") == "LEFT"
    return found.select(F.col("msa").alias("chrom"), F.when(left, "F").otherwise("R").alias("side"), F.when(left, F.col("stop")).otherwise(F.col("start")).alias("at"), F.size("seqs").alias("n"))


def design_data(plots: dict, scheme: DataFrame, found: DataFrame, bare: DataFrame) -> dict:
    """plots ({chrom: frames}) with amplicons, primers that passed, and uncovered runs (msa, start, stop) of each chrom."""
    for r in amplicon_summary(scheme).toLocalIterator():
        own = r.asDict()
        chrom, name = own.pop("chrom"), own.pop("name")
        plots.setdefault(chrom, {}).setdefault("amplicons", {})[name] = own
    for r in site_counts(found).toLocalIterator():
        plots.setdefault(r.chrom, {}).setdefault("thermo_pass", {"F": {}, "R": {}})[r.side][r["at"]] = r.n
    for r in bare.toLocalIterator():
        plots.setdefault(r.msa, {}).setdefault("uncovered", {})[r.start] = r.stop - 1
    return plots


def packed(data: dict) -> bytes:
    """Data as sorted, compact, gzipped JSON."""
    return gzip.compress(json.dumps(data, sort_keys=True, separators=(",", ":")).encode(), mtime=0)
