"""Whole runs from the command line over small alignments."""

import json
import random
from pathlib import Path

import pytest

from ampliframe import __main__ as cli
from ampliframe.sources import bed


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A genome and two relatives, and the scheme over them."""
    rng, folder = random.Random(4), tmp_path_factory.mktemp("design")
    genome = [rng.choice("AACCGGTTT") for _ in range(700)]
    rows = []
    for k in range(3):
        own = list(genome)
        for at in rng.sample(range(len(own)), 4 * k):
            own[at] = rng.choice("ACGT")
        rows.append(f">g{k}\n{''.join(own)}\n")
    (folder / "x.fa").write_text("".join(rows))
    cli.run(spark, ["scheme-create", "--msa", str(folder / "x.fa"), "--output", str(folder / "out"), "--amplicon-size", "200", "--n-pools", "2"])
    return folder, genome


def test_scheme(spark, made):
    folder, genome = made
    scheme = bed.pairs(bed.read_primers(spark, str(folder / "out/primer.bed"))).orderBy("number").collect()
    assert scheme and all(180 <= r.r_start - r.f_start <= 220 for r in scheme)
    for pool in (0, 1):
        own = sorted((r.f_start, r.r_end) for r in scheme if r.pool == pool)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
    text = "".join(genome)
    flip = str.maketrans("ACGT", "TGCA")
    for r in scheme:
        assert any(text[: r.f_end].endswith(x.sequence) for x in r.f_cloud)
        assert any(text[r.r_start :].startswith(x.sequence[::-1].translate(flip)) for x in r.r_cloud)
    qc = json.loads((folder / "out/work/qc.json").read_text())["g0"]
    assert qc["n_amplicons"] == len(scheme) and 0 < qc["coverage"] <= 100
    assert len((folder / "out/amplicon.bed").read_text().splitlines()) == len(scheme)
    assert json.loads((folder / "out/config.json").read_text())["amplicon_size"] == 200
    assert (folder / "out/reference.fasta").read_text().replace("\n", "") == ">g0" + text
    with pytest.raises(SystemExit):
        cli.run(spark, ["scheme-create", "--msa", str(folder / "x.fa"), "--output", str(folder / "out")])


def test_panel(spark, made):
    folder, _ = made
    (folder / "r.bed").write_text("g0\t300\t320\tr\t5\n")
    cli.run(spark, ["panel-create", "--msa", str(folder / "x.fa"), "--output", str(folder / "panel"), "--amplicon-size", "200", "--region-bedfile", str(folder / "r.bed"), "--max-amplicons", "1"])
    (r,) = bed.pairs(bed.read_primers(spark, str(folder / "panel/primer.bed"))).collect()
    assert r.f_end < 320 and r.r_start > 300


def test_other_commands(spark, made, capsys):
    folder, _ = made
    primers, msa, config = str(folder / "out/primer.bed"), str(folder / "x.fa"), str(folder / "out/config.json")
    cli.run(spark, ["interactions", primers, "--threshold", "-4"])
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("pool\ta\tb\tscore") and len(lines) > 1 and all(float(x.split("\t")[3]) <= -4 for x in lines[1:])
    cli.run(spark, ["interactions", primers, "--threshold", "-4", "--text"])
    shown = capsys.readouterr().out
    assert shown.count("score: ") >= len(lines) - 1 and "3'-" in shown
    cli.run(spark, ["repair-mode", "--bedfile", primers, "--msa", msa, "--config", config, "--output", str(folder / "repair")])
    assert "PRESENT" in Path(folder, "repair/repair.tsv").read_text()
    assert bed.read_primers(spark, str(folder / "repair/primer.bed")).count() >= bed.read_primers(spark, primers).count()
    name = bed.read_primers(spark, primers).select("prefix").first().prefix
    cli.run(spark, ["replace-primerpair", f"{name}_1_LEFT_1", primers, msa, "--config", config, "--amplicon-size-max", "220", "--amplicon-size-min", "180", "--output", str(folder / "replace")])
    assert Path(folder, "replace/primer.bed").read_text().startswith("# PrimerPair Option: 1\n") and "OK\t" in capsys.readouterr().out
    cli.run(spark, ["replace-primerpair", f"{name}_2", primers, msa, "--config", config, "--amplicon-size-max", "220", "--amplicon-size-min", "180", "--output", str(folder / "best"), "--mode", "AddBest"])
    old, new = (bed.pairs(bed.read_primers(spark, x)).orderBy("number").collect() for x in (primers, str(folder / "best/primer.bed")))
    assert [r.number for r in new] == [r.number for r in old] and [a for a, b in zip(old, new) if a != b] == [old[1]]
    cli.run(spark, ["visualise-primer-mismatches", msa, primers, "--output", str(folder / "m.csv")])
    first = [r.split("\t") for r in Path(folder, "m.csv").read_text().splitlines()[1:]]
    assert first and all(r[3] == "0" for r in first if r[1] == "0")
    cli.run(spark, ["visualise-bedfile", primers, str(folder / "out/reference.fasta"), "--ref-id", "g0", "--output", str(folder / "b.json")])
    assert json.loads((folder / "b.json").read_text())["primers"]
    capsys.readouterr()
    cli.run(spark, ["downsample-existing-scheme", primers])
    assert capsys.readouterr().out.startswith("site\tseqs")
