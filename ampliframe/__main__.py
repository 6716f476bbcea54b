"""Command line: python -m ampliframe COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import seq as S
from .operators import alignment as A
from .operators import mismatch
from .plans import design
from .sources import bed, fasta

#: Settings of a run that scheme-create and panel-create take as options.
SETTINGS = ("amplicon_size", "min_overlap", "n_pools", "dimer_score", "min_base_freq", "mapping", "circular", "backtrack", "ignore_n", "high_gc", "use_annealing", "downsample", "downsample_target", "mismatch_product_size")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ampliframe", description="Multiplexed primer schemes over alignments, on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    kinds = {f.name: f.default for f in fields(Config)}

    def command(name: str, help: str, *places: str, output: bool = False, settings: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help)
        for x in places:
            p.add_argument(x)
        if output and name != "scheme-create":
            p.add_argument("--strict-fix", action="store_true", help="without the known faults of the usual protocol")
        if output:
            p.add_argument("--output", required=True, help="folder of the run's files")
            p.add_argument("--force", action="store_true", help="write into a folder that exists")
        for x in SETTINGS if settings else ():
            kind, option = type(kinds[x]), f"--{x.replace('_', '-')}"
            p.add_argument(option, default=None, **({"action": argparse.BooleanOptionalAction} if kind is bool else {"type": kind}))
        return p

    p = command("scheme-create", "tile alignments with overlapping amplicons", output=True, settings=True)
    p.add_argument("--msa", action="append", required=True)
    p = command("panel-create", "cover regions or informative columns of alignments", output=True, settings=True)
    p.add_argument("--msa", action="append", required=True)
    p.add_argument("--region-bedfile")
    p.add_argument("--mode", choices=("region-only", "entropy", "equal"), default="region-only")
    for x in ("--max-amplicons", "--max-amplicons-msa", "--max-amplicons-region-group"):
        p.add_argument(x, type=int)
    p.add_argument("--input-bedfile", help="pairs that the panel starts from")
    p = command("interactions", "primers of a pool that bind each other", "bedfile")
    p.add_argument("--threshold", type=float, default=kinds["dimer_score"])
    p.add_argument("--text", action="store_true", help="show each interaction as the primers bind")
    p = command("repair-mode", "what new genomes need of a scheme's primers", output=True)
    for x in ("--bedfile", "--msa", "--config"):
        p.add_argument(x, required=True)
    p = command("replace-primerpair", "pairs that could replace one", "primername", "primerbed", "msa", output=True)
    p.add_argument("--config", required=True)
    p.add_argument("--amplicon-size-max", type=int, required=True)
    p.add_argument("--amplicon-size-min", type=int, required=True)
    p.add_argument("--mode", choices=("ListAll", "AddBest"), default="ListAll")
    p.add_argument("--mask-old-sites", action=argparse.BooleanOptionalAction, default=True)
    p = command("visualise-primer-mismatches", "mismatches of primers with genomes, as a table", "msa", "bedfile")
    p.add_argument("--output", default="primer.csv")
    p = command("visualise-bedfile", "a scheme's primers and the reference's G and C, as data", "bedfile", "ref_path")
    p.add_argument("--ref-id", required=True)
    p.add_argument("--output", default="bedfile.json")
    p = command("downsample-existing-scheme", "smaller clouds for a scheme", "bedfile")
    p.add_argument("--downsample-target", type=float, default=kinds["downsample_target"])
    return top


def _folder(a: argparse.Namespace) -> str:
    if Path(a.output).exists() and not a.force:
        raise SystemExit(f"{a.output} exists; --force writes into it")
    Path(a.output, "work").mkdir(parents=True, exist_ok=True)
    return a.output


def _table(df, path: str | None = None) -> None:
    lines = ["\t".join(df.columns), *("\t".join(",".join(x) if isinstance(x, list) else str(x) for x in r) for r in df.toLocalIterator())]
    if path:
        Path(path).write_text("\n".join(lines) + "\n")
    else:
        print(*lines, sep="\n")


def run(spark: SparkSession, given: list[str]) -> None:
    a = parser().parse_args(given)
    scheme_of = lambda path: bed.pairs(bed.read_primers(spark, path))
    settings = Config.of(**{k: getattr(a, k, None) for k in SETTINGS})
    if a.command == "scheme-create":
        design.scheme(spark, a.msa, _folder(a), settings)
    elif a.command == "panel-create":
        if a.mode == "region-only" and not a.region_bedfile:
            raise SystemExit("region-only needs --region-bedfile")
        regions = bed.read_regions(spark, a.region_bedfile) if a.region_bedfile else None
        seeds = None
        if a.input_bedfile:
            seeds, note = bed.read_extra(spark, a.input_bedfile, settings, a.strict_fix)
            print(note, file=sys.stderr)
        warn = lambda x: print(x, file=sys.stderr)
        design.panel(spark, a.msa, _folder(a), settings, a.mode, regions, a.max_amplicons, a.max_amplicons_msa, a.max_amplicons_region_group, seeds, warn, a.strict_fix)
    elif a.command == "interactions":
        primers = bed.read_primers(spark, a.bedfile).select("pool", F.col("sequence").alias("seq"))
        found = mismatch.interactions(primers, a.threshold)
        if a.text:
            for r in mismatch.shown(found.withColumn("limit", F.lit(a.threshold))).orderBy("pool", "a", "b", "offset").toLocalIterator():
                print(r.text)
        else:
            _table(found.orderBy("score", "pool", "a", "b"))
    elif a.command == "repair-mode":
        # a repair takes sequences of a tenth of the genomes, whatever the scheme was made with
        given = json.loads(Path(a.config).read_text())
        c, scheme, out = Config.of(**(given | {"min_base_freq": 0.1})), scheme_of(a.bedfile), _folder(a)
        found = design.repair(design.alignments(spark, [a.msa]), scheme, c, a.strict_fix)
        found.write.mode("overwrite").parquet(f"{out}/work/repair")
        found = spark.read.parquet(f"{out}/work/repair")
        _table(found.orderBy("site", "seq"), f"{out}/repair.tsv")
        text = bed.primer_text(design.repaired(scheme, found))
        Path(out, "primer.bed").write_text(text)
        Path(out, "config.json").write_text(json.dumps(given | {"primer.bed.md5": bed.primer_md5(text)}, sort_keys=True))
    elif a.command == "replace-primerpair":
        sizes = {"amplicon_size_min": a.amplicon_size_min, "amplicon_size_max": a.amplicon_size_max}
        given = json.loads(Path(a.config).read_text())
        c, scheme, out = Config.of(**(given | sizes)), scheme_of(a.primerbed), _folder(a)
        found, counts = design.replacements(design.alignments(spark, [a.msa]), scheme, a.primername, c, a.mask_old_sites, a.strict_fix)
        found.write.mode("overwrite").parquet(f"{out}/work/replacements")
        found = spark.read.parquet(f"{out}/work/replacements").orderBy("n", "f_end", "r_start")
        _table(counts)
        best = found.limit(1)
        if a.mode == "ListAll":
            Path(out, "primer.bed").write_text(bed.options_text(found))
        else:
            old = best.select("chrom", "number").first()
            if old is None:
                raise SystemExit("no pair can be added")
            rest = scheme.where(~((F.col("chrom") == old.chrom) & (F.col("number") == old.number)))
            text = bed.primer_text(rest.unionByName(best.select(*rest.columns)))
            Path(out, "primer.bed").write_text(text)
            Path(out, "config.json").write_text(json.dumps(given | {"primer.bed.md5": bed.primer_md5(text)}, sort_keys=True))
    elif a.command == "visualise-primer-mismatches":
        rows = design.alignments(spark, [a.msa])
        at = design.mapped(rows, settings).select(F.col("ref_pos").alias("start"), F.col("col").alias("at"), "chrom")
        lines = bed.read_primers(spark, a.bedfile).drop("at").join(at, ["chrom", "start"])
        stem = F.concat_ws("_", "prefix", F.col("number").cast("string"), "side")
        primers = lines.select(stem.alias("primer"), "at", F.when(F.col("side") == "LEFT", F.col("sequence")).otherwise(S.reverse_complement(F.col("sequence"))).alias("seq"))
        found = mismatch.matrix(rows.select(F.col("msa").alias("chrom"), "row", "seq"), primers)
        _table(found.orderBy("row", "primer"), a.output)
    elif a.command == "visualise-bedfile":
        record = fasta.lookup(fasta.read(spark, a.ref_path, aligned=False), a.ref_id).select(F.col("name").alias("chrom"), "row", "seq")
        gc = A.gc_bins(A.per_column(record))
        primers = bed.read_primers(spark, a.bedfile).where(F.col("chrom") == a.ref_id).orderBy("start", "stop", "sequence")
        data = {"primers": [r.asDict() for r in primers.toLocalIterator()], "gc": [[r.col, r.value] for r in gc.orderBy("col").toLocalIterator()]}
        Path(a.output).write_text(json.dumps(data, sort_keys=True))
    else:
        _table(design.downsampled(scheme_of(a.bedfile), settings).orderBy("site"))


def main() -> None:
    spark = SparkSession.builder.appName("ampliframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, sys.argv[1:])
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
