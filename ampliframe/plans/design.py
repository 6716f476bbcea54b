"""Whole runs: from alignments in FASTA files to the pairs, schemes and files of a design."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import InputError, RepeatedName
from ..functions import seq as S
from ..functions import thermo
from ..operators import alignment as A
from ..operators import digest
from ..operators import intervals as I
from ..operators import kmers as K
from ..sources import bed, fasta, reports
from . import maintain, solver


def alignments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """msa (the name of an alignment's first row), row, name, seq, lead, tail of one alignment for each path."""
    rows, names = None, []
    for path in paths:
        own = fasta.read(spark, path)
        names.append(own.where("row = 0").first().name)
        own = own.withColumn("msa", F.lit(names[-1]))
        rows = own if rows is None else rows.unionByName(own)
    if len(set(names)) < len(names):
        raise RepeatedName(", ".join(sorted(names)))
    return fasta.strip_ends(rows).select("msa", "row", "name", "seq", "lead", "tail")


def by_chrom(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("msa").alias("chrom"), "row", "seq")


def mapped(rows: DataFrame, c: Config) -> DataFrame:
    """chrom, col, ref_pos: positions on the first row, or columns for mapping by consensus."""
    if c.mapping == "consensus":
        return A.per_column(by_chrom(rows)).select("chrom", "col", F.col("col").alias("ref_pos"))
    return A.mapping(by_chrom(rows))


def sites(rows: DataFrame, c: Config, only: DataFrame | None = None) -> DataFrame:
    """msa, direction, start, stop, seqs, weights of every column (or of those in the runs only) where primers can end: no
    hairpins, cut down if wanted."""

    @F.pandas_udf("boolean")
    def straight(seqs: pd.Series) -> pd.Series:
        flat = seqs.explode()
        tms = pd.Series(thermo.hairpin_tms(flat.tolist(), c), index=flat.index)
        return (tms <= c.primer_hairpin_th_max).groupby(level=0).all()

    @F.pandas_udf("array<string>")
    def fewer(seqs: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([solver.downsample(dict(zip(s, map(float, w))), c) for s, w in zip(seqs, weights)], dtype=object)

    found = digest.remapped(digest.digest(rows.select("msa", "row", "seq", "lead", "tail"), c, only=only), mapped(rows, c))
    if c.downsample:
        weight = F.map_from_arrays("seqs", "weights")
        found = found.withColumn("_kept", fewer("seqs", "weights")).where("_kept IS NOT NULL").withColumn("weights", F.transform("_kept", lambda s: F.element_at(weight, s))).withColumn("seqs", F.col("_kept"))
    return found.where(straight("seqs")).select("msa", "direction", F.col("start").cast("int"), F.col("stop").cast("int"), "seqs", "weights")


def pairs(found: DataFrame, c: Config) -> DataFrame:
    """msa, f_start, f_end, r_start, r_end, seqs, gc_diff of sites whose insert fits and whose primers don't bind each other."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, r = (batch.column(batch.schema.get_field_index(x)) for x in ("f_seqs", "r_seqs"))
            yield batch.filter(pa.array(~thermo.clouds_bind(f, r, c.dimer_score)))

    f = found.where("direction = 'LEFT'").select("msa", F.col("start").alias("f_start"), F.col("stop").alias("f_end"), F.col("seqs").alias("f_seqs"))
    r = found.where("direction = 'RIGHT'").select("msa", F.col("start").alias("r_start"), F.col("stop").alias("r_end"), F.col("seqs").alias("r_seqs"))
    met = I.range_pairs(f, r, c).select("msa", "f_start", "f_end", "r_start", "r_end", "f_seqs", "r_seqs")
    both = met.mapInArrow(apart, met.schema).withColumn("seqs", F.concat("f_seqs", "r_seqs"))
    return both.select("msa", "f_start", "f_end", "r_start", "r_end", "seqs", S.mean_gc_off(F.col("seqs")).alias("gc_diff"), F.size("f_seqs").alias("forward"))


def with_hits(paired: DataFrame, found: DataFrame, rows: DataFrame, c: Config) -> DataFrame:
    """paired with hits: where each pair's primers bind in the alignments, by their k-mers, with one mismatch if wanted.

    A primer is expected at its own column; on other alignments nothing is expected or held against it. Without a product
    size no pair can misprime, and nothing is searched.
    """
    if c.mismatch_product_size <= 0:
        return paired
    k = c.mismatch_kmersize
    # k-mers count columns of the alignment and primers positions of the reference, as the protocol has it
    own = found.select("msa", "direction", "start", "stop", F.explode("seqs").alias("sequence"))
    probes = K.clipped(own, k)
    hits = K.found(probes.select("msa", "direction", "start", "stop", "kmer"), by_chrom(rows), k, fuzzy=c.mismatch_fuzzy)
    expected = F.when(F.col("direction") == "LEFT", F.col("stop") - k).otherwise(F.col("start"))
    marked = hits.withColumns({"own_chrom": F.col("msa"), "expected": expected})
    elsewhere = K.unexpected_mark()
    at = F.struct(F.col("chrom").alias("msa"), "col", "strand", elsewhere.alias("elsewhere"))
    sites = marked.groupBy("msa", "direction", "start", "stop").agg(F.collect_set(at).alias("_hits"))
    f = sites.where("direction = 'LEFT'").select("msa", F.col("start").alias("f_start"), F.col("stop").alias("f_end"), F.col("_hits").alias("_f"))
    r = sites.where("direction = 'RIGHT'").select("msa", F.col("start").alias("r_start"), F.col("stop").alias("r_end"), F.col("_hits").alias("_r"))
    both = paired.join(f, ["msa", "f_start", "f_end"], "left").join(r, ["msa", "r_start", "r_end"], "left")
    none = F.array().cast("array<struct<msa:string,col:int,strand:string,elsewhere:boolean>>")
    return both.withColumn("hits", F.array_distinct(F.concat(F.coalesce("_f", none), F.coalesce("_r", none)))).drop("_f", "_r")


def clouded(chosen: DataFrame, found: DataFrame) -> DataFrame:
    """Chosen amplicons as the rows that BED files are made of, each side with its cloud and counts."""
    cloud = F.sort_array(F.transform(F.arrays_zip("seqs", "weights"), lambda x: F.struct(x["seqs"].alias("sequence"), x["weights"].alias("count"))))
    side = lambda d, at, to, name: found.where(F.col("direction") == d).select("msa", F.col(at).alias(to), cloud.alias(name))
    both = chosen.join(side("LEFT", "stop", "f_end", "f_cloud"), ["msa", "f_end"]).join(side("RIGHT", "start", "r_start", "r_cloud"), ["msa", "r_start"])
    return both.select(F.col("msa").alias("chrom"), F.substring(F.md5("msa"), 1, 8).alias("prefix"), "number", "pool", "f_start", "f_end", "r_start", "r_end", "f_cloud", "r_cloud")


def chosen_of(scheme: DataFrame) -> DataFrame:
    """The solvers' rows of a scheme that was read from a BED file."""
    return scheme.select(F.col("chrom").alias("msa"), "number", "pool", "f_start", "f_end", "r_start", "r_end")


def wanted(rows: DataFrame, c: Config, mode: str, regions: DataFrame | None) -> DataFrame:
    """msa, start, stop, score that a panel is to cover: regions, the alignment's entropy, or every column alike."""
    if mode == "region-only":
        return I.region_scores(regions).select("msa", "start", "stop", F.col("score").cast("double").alias("score"))
    at = mapped(rows, c).where("ref_pos IS NOT NULL")
    score = F.lit(1.0)
    if mode == "entropy":
        columns = A.per_column(by_chrom(rows))
        at, score = at.join(A.entropy(columns), ["chrom", "col"]), F.col("entropy") + 0.01
    return at.select(F.col("chrom").alias("msa"), F.col("ref_pos").alias("start"), (F.col("ref_pos") + 1).alias("stop"), score.alias("score"))


def write(spark: SparkSession, rows: DataFrame, found: DataFrame, chosen: DataFrame, c: Config, out: str) -> dict[str, str]:
    """The files of a run in the folder out; the choice is made once and read again for each of them."""
    clouded(chosen, found).write.mode("overwrite").parquet(f"{out}/work/scheme")
    scheme = spark.read.parquet(f"{out}/work/scheme")
    sizes = rows.groupBy("msa").agg(F.max(F.length("seq")).alias("size"))
    spans = scheme.select(F.col("chrom").alias("msa"), F.col("f_end").alias("start"), F.col("r_start").alias("stop"))
    text = lambda df: "\n".join("\t".join(map(str, r)) for r in df.orderBy("chrom", "start").toLocalIterator()) + "\n"
    columns = A.per_column(by_chrom(rows))
    if c.mapping == "consensus":
        base = A.consensus(by_chrom(rows)).groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("col", "base"))).alias("cells"))
        reference = base.select(F.concat("chrom", F.lit("_consensus")).alias("name"), F.array_join("cells.base", "").alias("seq"))
    else:
        reference = A.reference(by_chrom(rows)).select(F.col("chrom").alias("name"), F.col("reference").alias("seq"))
    primers, amplicons = bed.primer_text(scheme), text(bed.amplicons(scheme))
    fasta_text = "\n".join(r.fasta for r in fasta.record_text(reference).orderBy("name").toLocalIterator()) + "\n"
    aligned = rows.groupBy("msa").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", F.md5("seq").alias("h")))), lambda x: x["h"]), "")).alias("md5"))
    msa_data = {str(i): {"msa_chromname": r.msa, "msa_name": r.msa, "msa_checksum": r.md5, "msa_rows": r.n} for i, r in enumerate(aligned.orderBy("msa").toLocalIterator())}
    sums = {"primer.bed.md5": bed.primer_md5(primers), "amplicon.bed.md5": bed.md5(amplicons), "reference.fasta.md5": bed.md5(fasta_text)}
    made = {
        "primer.bed": primers,
        "amplicon.bed": amplicons,
        "primertrim.amplicon.bed": text(bed.amplicons(scheme, trimmed=True)),
        "reference.fasta": fasta_text,
        "config.json": json.dumps(c.to_dict() | sums | {"msa_data": msa_data}, sort_keys=True),
        "work/qc.json": reports.qc(spans, sizes),
    }
    for name, x in made.items():
        Path(out, name).write_text(x)
    plots = reports.plot_data(gc=A.reduced(A.gc_bins(columns)), occupancy=A.reduced(A.occupancy(columns)), entropy=A.entropy(columns).withColumnRenamed("entropy", "value"))
    bare = I.around_origin(spans, sizes) if c.circular else I.uncovered(spans, sizes)
    Path(out, "work/plotdata.json.gz").write_bytes(reports.packed(reports.design_data(plots, scheme, found, bare)))
    return made


def scheme(spark: SparkSession, paths: list[str], out: str, c: Config) -> dict[str, str]:
    """A tiling scheme over alignments, and its files."""
    rows = alignments(spark, paths)
    sites(rows, c).write.mode("overwrite").parquet(f"{out}/work/sites")
    found = spark.read.parquet(f"{out}/work/sites")
    return write(spark, rows, found, solver.solve(with_hits(pairs(found, c), found, rows, c), c), c, out)


def regions_of(rows: DataFrame, regions: DataFrame, warn=print) -> DataFrame:
    """regions (chrom, start, stop, ...) as those of the alignments (msa, ...). One that lies on none of them is warned of; it
    is a fault if all do, or if an alignment has no region."""
    names = {r.msa for r in rows.select("msa").distinct().toLocalIterator()}  # a name for each alignment
    known = {r.chrom for r in regions.select("chrom").distinct().toLocalIterator()}
    for name in sorted(known - names):
        warn(f"regions on {name} are on no alignment")
    if not known & names:
        raise InputError("no region is on an alignment")
    if names - known:
        raise InputError(f"no region is on {', '.join(sorted(names - known))}")
    return regions.where(F.col("chrom").isin(*sorted(names))).withColumnRenamed("chrom", "msa")


def panel(
    spark: SparkSession, paths: list[str], out: str, c: Config, mode: str = "region-only", regions: DataFrame | None = None, most: int | None = None, most_msa: int | None = None,
    most_group: int | None = None, seeds: DataFrame | None = None, warn=print, strict_fix: bool = False,
) -> dict[str, str]:
    """A panel over regions, entropy or whole alignments, and its files. In region-only mode only sites from which an amplicon
    can reach a region are made. seeds: pairs that are in from the start. Without strict_fix all inserts have the one length
    amplicon_size_max."""
    rows = alignments(spark, paths)
    own = regions_of(rows, regions, warn) if regions is not None else None
    only = I.near_regions(own, rows.groupBy("msa").agg(F.max(F.length("seq")).alias("size")), c) if mode == "region-only" else None
    sites(rows, c, only).write.mode("overwrite").parquet(f"{out}/work/sites")
    found = spark.read.parquet(f"{out}/work/sites")
    fit = c if strict_fix else c.with_(amplicon_size_min=c.amplicon_size_max)
    paired = with_hits(pairs(found, fit), found, rows, c)
    none = solver.NO_LIMIT
    chosen = solver.solve_panel(paired, wanted(rows, c, mode, own), c, most or none, own, most_msa or none, most_group or none, seeds)
    made = write(spark, rows, found, chosen, c, out)
    if own is not None:
        covered = spark.read.parquet(f"{out}/work/scheme").select(F.col("chrom").alias("msa"), F.col("f_end").alias("start"), F.col("r_start").alias("stop"))
        rows_ = I.region_coverage(own.select("msa", "start", "stop", "name"), covered).orderBy("msa", "start", "stop", "name").toLocalIterator()
        Path(out, "work/regions.json").write_text(json.dumps([r.asDict() for r in rows_], sort_keys=True))
    return made


def _clouds(scheme: DataFrame) -> DataFrame:
    """site, pool, seq, count of a scheme's primers; a site is an alignment, a side and the 3' end."""
    side = lambda cloud, name, end: scheme.select(F.concat_ws(":", "chrom", F.lit(name), F.col(end).cast("string")).alias("site"), "pool", F.explode(cloud).alias("x"))
    both = side("f_cloud", "LEFT", "f_end").unionByName(side("r_cloud", "RIGHT", "r_start"))
    return both.select("site", "pool", F.col("x.sequence").alias("seq"), F.coalesce("x.count", F.lit(1.0)).alias("count"))


def repair(rows: DataFrame, scheme: DataFrame, c: Config, strict_fix: bool = False) -> DataFrame:
    """What each sequence that new alignments show at a scheme's sites needs (see maintain.repair)."""
    known = _clouds(scheme)
    seen = digest.remapped(digest.digest(rows.select("msa", "row", "seq", "lead", "tail"), c), mapped(rows, c))
    site = F.concat_ws(":", "msa", "direction", F.col("ref_pos").cast("string"))
    each = seen.select(site.alias("site"), F.explode(F.arrays_zip("seqs", "weights")).alias("x")).select("site", F.col("x.seqs").alias("seq"), F.col("x.weights").alias("count"))
    pools = known.groupBy(F.col("site").alias("_site")).agg(F.min("pool").alias("_pool"))  # names of their own: known is on both sides
    found = each.join(pools, F.col("site") == F.col("_site")).select("site", F.col("_pool").alias("pool"), "seq", "count")
    return maintain.repair(found, known, c, strict_fix)


def replacements(rows: DataFrame, scheme: DataFrame, name: str, c: Config, masked: bool = True, strict_fix: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs that could stand in for the amplicon of the primer or amplicon name, as rows that BED files are made of (with
    its pool and number), the fewest primers first; and how many candidates had which verdict."""
    stem, number = name.removesuffix("_LEFT").removesuffix("_RIGHT").split("_LEFT_")[0].split("_RIGHT_")[0].rsplit("_", 1)
    old = scheme.where((F.col("prefix") == stem) & (F.col("number") == int(number))).first()
    if old is None:
        raise KeyError(f"{name} is not in the scheme")
    found = sites(rows, c)
    open_ = maintain.unmasked(found, old, masked, strict_fix)
    checked = maintain.replacements(pairs(open_, c), chosen_of(scheme), pool_seqs(scheme, old.pool, old.number), old.chrom, int(number), c, strict_fix)
    good = checked.where("status = 'OK'").select("msa", F.lit(int(number)).alias("number"), F.lit(old.pool).alias("pool"), "f_start", "f_end", "r_start", "r_end", F.size("seqs").alias("n"))
    made = clouded(good.drop("n"), found).withColumn("prefix", F.lit(stem)).join(good.select("f_end", "r_start", "n"), ["f_end", "r_start"])
    return made.orderBy("n", "f_end", "r_start"), I.tally(checked, "status")


def pool_seqs(scheme: DataFrame, pool: int, without: int | None = None) -> list[str]:
    """All sequences of a pool, which protocols keep to hundreds, but those of one amplicon."""
    own = scheme.where(F.col("pool") == pool)
    own = own if without is None else own.where(F.col("number") != without)
    return [r.s for r in own.select(F.explode(F.concat("f_cloud.sequence", "r_cloud.sequence")).alias("s")).toLocalIterator()]


def repaired(scheme: DataFrame, judged: DataFrame) -> DataFrame:
    """The scheme with the sequences that a repair adds to its sites, as rows that BED files are made of."""
    added = judged.where("status = 'ADD'").groupBy("site").agg(F.collect_list(F.struct(F.col("seq").alias("sequence"), F.lit(None).cast("double").alias("count"))).alias("more"))
    site = lambda side, end: F.concat_ws(":", "chrom", F.lit(side), F.col(end).cast("string"))
    more = lambda df, side, end, cloud: df.join(added.select(F.col("site").alias("_site"), "more"), site(side, end) == F.col("_site"), "left").withColumn(cloud, F.concat(cloud, F.coalesce("more", F.array().cast("array<struct<sequence:string,count:double>>")))).drop("_site", "more")
    return more(more(scheme, "LEFT", "f_end", "f_cloud"), "RIGHT", "r_start", "r_cloud")


def downsampled(scheme: DataFrame, c: Config) -> DataFrame:
    """site, seqs: a scheme's clouds cut down."""
    return maintain.downsampled(_clouds(scheme), c)
