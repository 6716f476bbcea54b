"""Goldens and brute force for the domain's operators."""

import gzip
import itertools
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ampliframe import bridge, errors
from ampliframe.config import Config
from ampliframe.functions import seq as S
from ampliframe.functions import thermo
from ampliframe.operators import alignment as A
from ampliframe.operators import digest, kmers
from ampliframe.operators import intervals as I
from ampliframe.plans import maintain, solver
from ampliframe.sources import bed, fasta, reports
from ampliframe.streaming import incremental


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


def test_scalars(spark):
    s = lambda x: F.lit(x)
    got = one(
        spark, rc=S.reverse_complement(s("ACGTN")), gap=S.complement(s("A-X")), gc=S.gc(s("ACACCTGTGCCTGTTAAACCATGGGGG")), homo=S.max_homopolymer(s("AAAACGGGGGGGGGGT")), none=S.max_homopolymer(s("")),
        amb=S.expand(s("ATGB")), no=S.expand(s("AN")), every=S.expand(s("AN"), with_n=True), near=F.size(S.neighbours(s("ACGTACGTACGTACGTACG"))), ham=S.hamming(s("AACGT"), s("CGA")), iupac=S.iupac_hamming(s("RN"), s("YA")),
        cigar=S.pairing(s("ACGN"), s("TGGA")), start=S.same_start(s("ACGT"), s("ACG")), name=S.chrom_name(s("a/b-c")), tm=thermo.melting(s("AGCGTGGTTATTGGATGGGTTTG")),
    )
    assert (got["rc"], got["gap"], got["homo"], got["none"]) == ("NACGT", "T-X", 10, 0)
    assert got["gc"] == 55.6 and got["amb"] == ["ATGC", "ATGG", "ATGT"] and got["no"] is None and len(got["every"]) == 4
    assert (got["near"], got["ham"], got["iupac"], got["cigar"], got["start"], got["name"]) == (58, 1, 1, "||. ", True, "a_b_c")
    assert got["tm"] == pytest.approx(thermo.tm_of("AGCGTGGTTATTGGATGGGTTTG"))


def test_dimers():
    clean, bad = ("AGCGTGGTTATTGGATGGGTTTG", "AGCAAATCTTTACTAAAAAAAATTTACCTT"), ("TGGAAATACCCACAAGTTAATGGTTTAAC", "ACACCTGTGCCTGTTAAACCAT")
    assert not thermo.interacts([clean[0]], [clean[1]], -26) and thermo.interacts([bad[0]], [bad[1]], -26)
    assert thermo.interacts([clean[0], bad[0]], [clean[1], bad[1]], -26)


def test_alignment(spark):
    rows = spark.createDataFrame([("c", 0, "-AC-GT"), ("c", 1, "AAC--"), ("c", 2, "RNCA")], "chrom string, row long, seq string")
    cells = bridge.cells(rows)
    hist = A.histogram(rows)
    assert {(r.col, r.base): r.n for r in hist.collect()} == {(r.col, r.base): r["count"] for r in cells.groupBy("col", "base").count().collect()}
    assert hist.where("base = ''").agg(F.sum("n")).first()[0] == 1 + 2
    cols = A.per_column(rows)
    assert {r.col: (r.gaps, r.ends) for r in cols.collect()}[3] == (1, 1)
    assert [r.base for r in A.consensus(rows).orderBy("col").collect()] == ["A", "A", "C", "A", "G", "T"]
    assert A.reference(rows).first().reference == "ACGT"
    mapped = A.mapping(rows)
    assert [r.ref_pos for r in mapped.orderBy("col").collect()] == [None, 0, 1, None, 2, 3]
    inverse = A.ref_to_msa(mapped)
    assert {r.ref_pos: r.col for r in inverse.collect()} == {0: 1, 1: 2, 2: 4, 3: 5, 4: 6}
    assert [(r.ref_pos, r.fixed_col) for r in A.ends_on_gap(inverse).collect()] == [(2, 3)]
    assert incremental.merge(hist, rows).agg(F.sum("n")).first()[0] == 2 * cells.count()


def test_columns_by_blocks(spark, monkeypatch):
    """Counts and consensus when a task holds few small blocks, as by plain loops."""
    monkeypatch.setattr(A, "BLOCK", 4)
    monkeypatch.setattr(A, "HELD", 2)
    rng = random.Random(2)
    rows = [(rng.choice("ab"), k, "".join(rng.choice("ACGTRYN-") for _ in range(rng.randint(1, 19)))) for k in range(30)]
    df = spark.createDataFrame(rows, "chrom string, row long, seq string").repartition(3)
    want = {(r.chrom, r.col, r.base): r["count"] for r in bridge.cells(df).groupBy("chrom", "col", "base").count().collect()}
    assert {(r.chrom, r.col, r.base): r.n for r in A.histogram(df).collect()} == want
    votes = {}
    for r in bridge.cells(df).orderBy("row").collect():
        own = votes.setdefault((r.chrom, r.col), {})
        for b in S.IUPAC.get(r.base, ""):
            own[b] = own.get(b, 0) + 1
    assert {(r.chrom, r.col): r.base for r in A.consensus(df).collect()} == {k: max(v, key=v.get) if v else "N" for k, v in votes.items()}


def test_scans_by_blocks(spark):
    """Running values do not depend on the blocks."""
    from ampliframe.operators.scans import scan

    rng = random.Random(5)
    df = spark.createDataFrame([(k % 3, rng.randrange(500), i, rng.randrange(100)) for i, k in enumerate(range(300))], "key int, at int, tie int, v int")
    wanted = {"m": ("max_before", F.col("v")), "s": ("sum_before", F.col("v")), "p": ("lag", F.col("v")), "n": ("lead", F.col("v"))}
    one, many = ({(r.key, r.at, r.tie): (r.m, r.s, r.p, r.n) for r in scan(df, "key", ["at", "tie"], width, **wanted).collect()} for width in (10**6, 7))
    assert one == many and len(one) == 300
    spans = spark.createDataFrame([(i % 2, a := rng.randrange(300), a + rng.randrange(9)) for i in range(80)], "msa int, start int, stop int")
    covered = {(m, c) for m, a, b in map(tuple, spans.collect()) for c in range(a, b)}
    got = I.merged(spans, "msa").collect()
    assert {(r.msa, c) for r in got for c in range(r.start, r.stop)} == covered and sum(r.stop - r.start for r in got) == len(covered)
    sizes = spark.createDataFrame([(0, 320), (1, 320), (2, 9)], "msa int, size int")
    bare = {(r.msa, c) for r in I.uncovered(spans, sizes).collect() for c in range(r.start, r.stop)}
    assert bare == {(m, c) for m, n in ((0, 320), (1, 320), (2, 9)) for c in range(n)} - covered
    ring = I.around_origin(spark.createDataFrame([(0, 10, 20)], "msa int, start int, stop int"), sizes).orderBy("msa").collect()
    assert [(r.msa, r.start, r.stop) for r in ring] == [(0, 20, 330), (1, 0, 320), (2, 0, 9)]


def test_streaming_counts(spark, tmp_path):
    """The counts of a stream's rows are those of all of them at once."""
    rows = [("c", k, "ACG-TN"[k % 3 :] + "A" * (k % 4)) for k in range(20)]
    df = spark.createDataFrame(rows, "chrom string, row long, seq string")
    for k in range(2):
        df.where(F.col("row") % 2 == k).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.counts(stream).writeStream.outputMode("complete").format("memory").queryName("arriving").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("arriving").collect())) == sorted(map(tuple, A.histogram(df).collect()))


def test_forward_gate_and_early_ends():
    """A gap behind the last base of a forward primer counts, one under it doesn't; N in the first slice ends nothing early."""
    c = Config(primer_size_min=4, min_base_freq=0.4, primer_tm_min=-300)
    rows = [list("ACGTACGTAC"), list("ACGTACGTAC"), list("ACGTA-GTAC"), list("ACGNACGTAC")]
    a = digest.Alignment(rows, 0, 10, c)
    assert a.digest(5, True) == {"CGTA": 2.0, "GAP_ON_SET_BASE": 1.0, "CONTAINS_INVALID_BASE": 1.0} and a.digest(6, True)["GTAC"] == 2.0
    assert "GAP_ON_SET_BASE" not in a.digest(6, True)
    strict = Config(primer_size_min=4, primer_tm_min=-300, ignore_n=True)
    b = digest.Alignment([list("ACGTACGTAC"), list("ACGNACGTAC")], 0, 10, strict)
    assert b.digest(6, True) == {"GTAC": 1.0, "CONTAINS_INVALID_BASE": 1.0}
    twice = digest.Alignment([rows[0], rows[2], rows[3]], 0, 10, c, [2, 1, 1])
    assert all(a.digest(k, d) == twice.digest(k, d) for k in range(4, 10) for d in (True, False))


def test_annealing_checks():
    s = "AGCGTGGTTATTGGATGGGTTTG"
    bound = thermo.annealed_of(s)
    assert digest.check(s, Config(use_annealing=True, primer_annealing_prop=bound)) == "PASS"
    assert digest.check(s, Config(use_annealing=True, primer_annealing_prop=bound - 6)) == "HIGH_ANNEALING"
    assert digest.check(s, Config(use_annealing=True, primer_annealing_prop=bound + 6)) == "LOW_ANNEALING"


def test_dimers_in_batches():
    """Batches of any lengths give each pair's own lowest score; hairpins the same."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(3, 30))) for _ in range(60)]
    n = np.arange(30)
    low = thermo.lowest_scores(*thermo.coded(seqs), n, n + 30)
    assert low.tolist() == pytest.approx([thermo.dimer_scores(a, b).min() for a, b in zip(seqs[:30], seqs[30:])])
    f, r = pa.array([seqs[k : k + k % 3 + 1] for k in range(20)]), pa.array([seqs[k + 20 : k + 21 + k % 2] for k in range(20)])
    assert thermo.clouds_bind(f, r, -12).tolist() == [any(thermo.dimer_scores(a, b).min() <= -12 for a in x for b in y) for x, y in zip(f.to_pylist(), r.to_pylist())]
    assert thermo.hairpin_structure("GGGGCCCTTTTTGGGCCCC") == "(((((((.....)))))))" and thermo.hairpin_structure("AAAAAAAA") == ""
    assert thermo.hairpin_tms(seqs).tolist() == [thermo.hairpin_tm(s) for s in seqs]


def test_kmers(spark):
    rows = spark.createDataFrame([("c", 0, "AC-GTRA"), ("c", 1, "NACG")], "chrom string, row long, seq string")
    got = {(r.kmer, r.col) for r in kmers.index(rows, 3).collect()}
    assert got == {("ACG", 0), ("CGT", 1), ("GTA", 3), ("GTG", 3), ("TAA", 4), ("TGA", 4), ("ACG", 1)}
    probes = spark.createDataFrame([("CGT",)], "kmer string")
    assert {(r.col, r.strand) for r in kmers.matches(probes, kmers.index(rows, 3)).collect()} == {(1, "+"), (0, "-"), (1, "-")}


def test_kmers_by_brute_force(spark, monkeypatch):
    """packed counts and filtered searches, over gaps, codes of two and three bases, N, copies and chunks, by a plain
    walk; neither makes the whole index into rows."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ACGT" * 6 + "-NRYV") for _ in range(rng.randrange(60))) for _ in range(40)]
    data = [("ab"[i % 2] if i % 9 else None, i, t) for i, t in enumerate([*texts, *texts[:9], "", "ACG", "RYRYRYRYRYRY", "-" * 30])]
    rows = spark.createDataFrame(data, "chrom string, row long, seq string").repartition(3)
    monkeypatch.setattr(kmers, "CHUNK", 100)
    for k in (3, 11):
        want = set()
        for c, _, t in data:
            cells = [(x, i) for i, x in enumerate(t) if x != "-"]
            for u in range(len(cells) - k + 1):
                for w in itertools.product(*(S.IUPAC.get(x, "") for x, _ in cells[u : u + k])):
                    want.add(("".join(w), c, cells[u][1]))
        assert {tuple(r) for r in kmers.index(rows, k).collect()} == want
        got = {r.chrom: (r.sites, r.kmers, r.cols) for r in kmers.counts(rows, k).collect()}
        assert got == {c: (len(own), len({x[0] for x in own}), len({x[2] for x in own})) for c in ("a", "b", None) if (own := [x for x in want if x[1] == c])}
        some = sorted({x[0] for x in want})[::7][:20]
        probes = spark.createDataFrame([(x,) for x in some], "kmer string")
        for fuzzy in (False, True):
            plain = kmers.matches(probes, kmers.index(rows, k), fuzzy)
            assert sorted(map(str, kmers.found(probes, rows, k, fuzzy).collect())) == sorted(map(str, plain.collect()))
    made = kmers._sites(rows, 11, kmers._table(probes)).count()
    assert made < len(want) / 5


def test_ranges(spark):
    rng, c = random.Random(3), Config(amplicon_size=100)
    f = [(rng.randrange(2), x := rng.randrange(2000), x + 20) for _ in range(200)]
    r = [(rng.randrange(2), rng.randrange(2000)) for _ in range(200)]
    got = I.range_pairs(spark.createDataFrame(f, "msa int, f_start int, f_end int"), spark.createDataFrame(r, "msa int, r_start int"), c)
    assert sorted(map(tuple, got.select("msa", "f_start", "r_start").collect())) == sorted((m, a, b) for m, a, _ in f for n, b in r if m == n and a + 90 <= b <= a + 110)
    spans = spark.createDataFrame([(0, 10, 200), (0, 150, 160), (0, 200, 250)], "msa int, start int, stop int")
    size = spark.createDataFrame([(0, 300), (1, 5)], "msa int, size int")
    assert {x.msa: x.coverage for x in I.coverage(spans, size).collect()} == {0: 80.0, 1: 0.0}
    assert sorted(map(tuple, I.gaps(spans, size).collect())) == [(0, 0, 10), (0, 250, 299), (1, 0, 4)]
    assert json.loads(reports.qc(spans, size))["0"] == {"coverage": 80.0, "n_amplicons": 3, "n_gaps": 2}
    spans = spans.withColumn("pool", F.lit(0))
    free = I.clear_of(spark.createDataFrame([(0, 0, 0, 10), (0, 0, 5, 11), (0, 1, 5, 11)], "msa int, pool int, start int, stop int"), spans.select("msa", "pool", "start", "stop"))
    assert sorted(map(tuple, free.collect())) == [(0, 0, 0, 10), (0, 1, 5, 11)]


def test_files(spark, tmp_path):
    for text, fault in ((">a\nAC\n>b\nACG\n", errors.UnequalLengths), (">a\nAC\n>a\nAG\n", errors.RepeatedName), (">a\nA.\n", errors.NotABase), ("ACGT\n", errors.NoRecords)):
        (tmp_path / "x.fa").write_text(text)
        with pytest.raises(fault):
            fasta.read(spark, str(tmp_path / "x.fa"))
    (tmp_path / "x.fa").write_text(">a/1-3 x\nac\ng\n>b\nA-N\n")
    rows = fasta.read(spark, str(tmp_path / "x.fa"))
    assert [(r.row, r.name, r.seq) for r in rows.orderBy("row").collect()] == [(0, "a_1_3", "ACG"), (1, "b", "A-N")]
    text = "# artic-bed-version v3.0\nc\t10\t13\tu_1_LEFT_1\t1\t+\tACG\nc\t90\t92\tu_1_RIGHT_1\t1\t-\tGG\nc\t90\t93\tu_1_RIGHT_2\t1\t-\tGGA\n"
    (tmp_path / "p.bed").write_text(text)
    pairs = bed.pairs(bed.read_primers(spark, str(tmp_path / "p.bed")))
    assert bed.primer_text(pairs) == text
    assert tuple(bed.amplicons(pairs).first()) == ("c", 10, 93, "u_1", 1) and tuple(bed.amplicons(pairs, trimmed=True).first())[1:3] == (13, 90)
    (tmp_path / "r.bed").write_text("# x\n\nc\t1\t9\tr\t3\t\nc\t2\t9\tr\t3\tg\n")
    assert [r.group for r in bed.read_regions(spark, str(tmp_path / "r.bed")).collect()] == [None, "g"]
    points = spark.createDataFrame([("c", 0, 0.5)], "chrom string, col int, value double")
    assert json.loads(gzip.decompress(reports.packed(reports.plot_data(gc=points)))) == {"c": {"gc": [[0, 0.5]]}}


def test_config():
    c = Config.of(n_pools="3", circular="True", unknown=1, amplicon_size=1000, min_overlap=None)
    assert (c.n_pools, c.circular, c.amplicon_size_min, c.amplicon_size_max, c.min_overlap) == (3, True, 900, 1100, 10)
    assert Config(high_gc=True).primer_gc_max == 65 and json.loads(c.to_json())["n_pools"] == 3


def test_digest_walks(spark):
    seq = "CCAATGGTGCAAAAGGTATAATCATTAATGTCAAAGGTAACGCGGAGTCATGCCAGATGATT"
    a = digest.Alignment([list(seq)] * 2, 0, len(seq), Config())
    right = digest.Alignment([list(seq)] * 2, 0, len(seq), Config()).digest(10, forward=False)
    (s,) = right
    assert right[s] == 2 and seq.startswith(s, 10) and thermo.tm_of(s) >= 59.5 > thermo.tm_of(s[:-1])
    (s,) = a.digest(50, forward=True)
    assert seq[:50].endswith(s) and thermo.tm_of(s) >= 59.5 > thermo.tm_of(s[1:])
    assert a.digest(10, forward=True) == {"WALKS_OUT": -1.0} and a.digest(50, forward=False) == {"WALKS_OUT": -1.0}
    rows = spark.createDataFrame([("m", k, seq, 0, 0) for k in range(2)], "msa string, row int, seq string, lead int, tail int")
    blocks = {(r.direction, r.col): (r.status, tuple(r.seqs)) for r in digest.digest(rows, block=7).collect()}
    whole = {(r.direction, r.col): (r.status, tuple(r.seqs)) for r in digest.digest(rows, block=1000).collect()}
    assert blocks == whole and len(whole) == 2 * (len(seq) - 19)


def test_solvers(spark):
    pairs = [("m", x, x + 20, x + 370, x + 390, []) for x in range(0, 2000, 10)]
    df = spark.createDataFrame(pairs, "msa string, f_start int, f_end int, r_start int, r_end int, seqs array<string>")
    got = solver.solve(df).collect()
    spans = I.merged(spark.createDataFrame([(r.msa, r.f_end, r.r_start) for r in got], "msa string, start int, stop int"), "msa").collect()
    assert len(spans) == 1 and spans[0].stop - spans[0].start > 1900
    for p in (0, 1):
        own = sorted((r.f_start, r.r_end) for r in got if r.pool == p)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
    wanted = spark.createDataFrame([("m", 500, 600, 5.0)], "msa string, start int, stop int, score double")
    panel = solver.solve_panel(df.withColumn("gc_diff", F.lit(0.0)), wanted, most=1).collect()
    assert len(panel) == 1 and panel[0].f_end <= 500 and panel[0].r_start >= 600
    scheme = solver.solve(df)
    chosen = {r.number: r for r in got}
    checked = {(r.f_start, r.r_end): r.status for r in maintain.replacements(df, scheme, [], "m", 2).collect()}
    others = [(r.f_start, r.r_end) for r in got if r.pool == chosen[2].pool and r.number != 2]
    assert checked and all((s == "OVERLAP") == any(x < e and f < y for x, y in others) for (f, e), s in checked.items()) and "OK" in checked.values()
    cloud = {"AGCGTGGTTATTGGATGGGTTTG": 90.0, "AGCGTGGTTATTGGATGGGTTTA": 10.0}
    assert solver.downsample(cloud) == ["AGCGTGGTTATTGGATGGGTTTG"]


def test_panel_limits(spark):
    """Caps of alignments and groups, seeds, and the choice by brute force over whole positions."""
    rng = random.Random(9)
    pairs = [(m, x, x + 20, x + 120 + rng.randrange(20), x + 160, [], rng.choice([0.0, 0.1])) for m in "ab" for x in range(0, 600, 7)]
    df = spark.createDataFrame(pairs, "msa string, f_start int, f_end int, r_start int, r_end int, seqs array<string>, gc_diff double")
    pieces = [("a", 100, 140, 3.0), ("a", 200, 260, 1.0), ("a", 300, 340, 2.0), ("b", 50, 500, 1.0)]
    wanted = spark.createDataFrame(pieces, "msa string, start int, stop int, score double")
    got = solver.solve_panel(df, wanted, most=6).collect()
    left = {(m, c): s for m, a, b, s in pieces for c in range(a, b)}
    covered = set()
    for r in got:
        best = 0
        taken = [(x.f_start, x.r_end) for x in got[: got.index(r)] if x.msa == r.msa]
        for m, fs, fe, rs, re_, _, off in pairs:
            if m == r.msa and sum(any(x < re_ and fs < y for x, y in [t]) for t in taken) < 2:
                inside = [(m, c) for c in range(fe, rs)]
                plain = sum(left.get(k, 0) for k in inside if k not in covered) * (1 - off)
                half = any(k in covered for k in inside) and not all(k in covered for k in inside)
                fits = any(all(not (x.f_start < re_ and fs < x.r_end) for x in got[: got.index(r)] if x.msa == m and x.pool == p) for p in (0, 1))
                if fits and int(plain + 1e-6) > 0:
                    best = max(best, int((10 if half else 1) * plain + 1e-6))
                if (fs, fe, rs) == (r.f_start, r.f_end, r.r_start):
                    mine = int((10 if half else 1) * plain + 1e-6)
        assert mine == best
        covered |= {(r.msa, c) for c in range(r.f_end, r.r_start)}
    assert {m: sum(r.msa == m for r in solver.solve_panel(df, wanted, most_msa=1).collect()) for m in "ab"} == {"a": 1, "b": 1}
    regions = spark.createDataFrame([("a", 100, 140, "g"), ("a", 200, 260, "g"), ("a", 300, 340, "h")], "msa string, start int, stop int, group string")
    few = solver.solve_panel(df.where("msa = 'a'"), wanted, regions=regions, most_group=0).collect()
    assert all(not (r.f_start <= 260 and r.r_end >= 100) for r in few[1:]) or len(few) <= 2
    cloud = [("AC", None)]
    seeds = spark.createDataFrame([("a", 1, 1, 90, 110, 230, 250, cloud, cloud)], "chrom string, number int, pool int, f_start int, f_end int, r_start int, r_end int, f_cloud array<struct<sequence:string,count:double>>, r_cloud array<struct<sequence:string,count:double>>")
    first = solver.solve_panel(df, wanted, most=2, seeds=seeds).collect()[0]
    assert (first.step, first.pool, first.f_start) == ("given", 1, 90)


def test_sites_of_a_large_bucket(monkeypatch):
    """Counted in parts, none of which sorts many more than SITES sites."""
    rng = np.random.default_rng(3)
    rows, most = ["".join(rng.choice(list("ACGT"), 3000)) for _ in range(8)], []
    rows += rows[:2]
    walks = [x for t in rows for x in kmers.walked([t], 19)]
    data = pa.chunked_array([[kmers._packed(key, col, 19) for _, col, key in walks]], pa.binary())
    want = {(int(a), int(b)) for _, col, key in walks for a, b in zip(key, col)}
    monkeypatch.setattr(kmers, "SITES", 4000)
    monkeypatch.setattr(kmers.np, "concatenate", lambda x, *a, f=np.concatenate, **b: most.append(len(f(x, *a, **b))) or f(x, *a, **b))
    assert kmers.distinct_sites(data, 19) == (len(want), len({a for a, _ in want}))
    assert max(most) < 5000 < sum(len(key) for _, _, key in walks)


def test_panel_leaves_out_pairs_without_score(spark):
    """The task that chooses gets no pair that nothing wanted lies near, and each whose insert has a wanted column."""
    pairs = [("m", x, x + 20, x + 120, x + 140, ["AC"]) for x in range(-60, 60000, 7)]
    df = spark.createDataFrame(pairs, "msa string, f_start int, f_end int, r_start int, r_end int, seqs array<string>")
    pieces = [("m", 3, 4, 1.0), ("m", 1535, 1537, 2.0), ("m", 9000, 9100, 0.0), ("m", 30000, 30700, 1.0), ("x", 5000, 5100, 1.0)]
    wanted = spark.createDataFrame(pieces, "msa string, start int, stop int, score double")
    left = {r.f_start for r in solver.wanted_pairs(df, wanted).collect()}
    need = {p[1] for p in pairs if any(m == "m" and s > 0 and max(a, p[2]) < min(b, p[3]) for m, a, b, s in pieces)}
    assert need <= left and len(left) < 500
    assert [r.f_start for r in solver.solve_panel(df.where("f_start > 40000"), wanted).collect()] == []


def test_misprimes(spark):
    """A pair whose primer binds elsewhere within the product size of one in the pool goes to another pool or not at all."""
    p = lambda x, hits=(): solver.Pair("m", x, x + 20, x + 100, x + 120, (), hits=hits)
    state = solver.Pools(Config(mismatch_product_size=50))
    state.add(p(0, (("m", 700, "+", True), ("m", 900, "+", False))), 0, "x")
    assert state.verdict(p(300, (("m", 740, "-", True),)), 0) == "MISPRIMING" and state.verdict(p(300, (("m", 740, "-", True),)), 1) == "OK"
    assert [state.verdict(p(300, (("m", c, s, True),)), 0) for c, s in ((750, "-"), (700, "-"), (740, "+"), (920, "-"))] == ["OK"] * 4
    state.drop_last()
    assert state.verdict(p(300, (("m", 740, "-", True),)), 0) == "OK"
    assert solver.Pools(Config()).verdict(p(300, (("m", 740, "-", True),)), 0) == "OK"


def test_texts(spark):
    s = F.lit
    got = one(spark, t=S.alignment_text(s("ACGT"), s("ACGT"), s(-1), s(-3.456)), m=S.match_text(s("p"), s("ACGT"), s("TTACCT")), g=S.mean_gc_off(F.array(s("GC"), s("AT"))))
    assert got["t"] == "score: -3.46\n5'-ACGT-3' >\n" + got["t"].split("\n")[2] + "\n 3'-TGCA-5' \n"
    assert got["m"] == "5'ACGT: p<br>5'||.|<br>5'ACCT" and got["g"] == 0.5


def test_region_sets(spark):
    regions = spark.createDataFrame([("m", 500, 510, "g"), ("m", 2000, 2010, "g"), ("m", 3000, 3010, "h"), ("m", 4000, 4010, None)], "msa string, start int, stop int, group string")
    sizes = spark.createDataFrame([("m", 2300)], "msa string, size int")
    near = {(r.direction, r.start, r.stop) for r in I.near_regions(regions.where("start < 2500"), sizes, Config(amplicon_size=400)).collect()}
    assert near == {("LEFT", 60, 510), ("LEFT", 1560, 2010), ("RIGHT", 500, 949), ("RIGHT", 2000, 2300)}
    touched = I.same_group(regions, spark.createDataFrame([("m", 510, 520)], "msa string, start int, stop int"))
    assert {r.start for r in touched.collect()} == {500, 2000}
    clear = I.clear_of_regions(spark.createDataFrame([("m", 480, 500), ("m", 480, 499)], "msa string, start int, stop int"), regions)
    assert [r.stop for r in clear.collect()] == [499]
    names = spark.createDataFrame([("a", 3)], "chrom string, msa_index int")
    assert {r.chrom: r.msa_index for r in I.msa_index(spark.createDataFrame([("a",), ("b",)], "chrom string"), names).collect()} == {"a": 3, "b": -1}
    assert [tuple(r) for r in I.tally(spark.createDataFrame([("x",), ("y",), ("y",)], "status string"), "status").collect()] == [("y", 2), ("x", 1)]


def test_extra_primers(spark, tmp_path):
    line = "c\t10\t33\tu_1_LEFT_1\t3\t+\tAGCGTGGTTATTGGATGGGTTTG\nc\t90\t95\tu_1_RIGHT_1\t3\t-\tGGATT\n"
    (tmp_path / "x.bed").write_text(line)
    with pytest.raises(errors.InputError):
        bed.read_extra(spark, str(tmp_path / "x.bed"), Config(), strict_fix=True)
    pairs, note = bed.read_extra(spark, str(tmp_path / "x.bed"), Config())
    assert pairs.count() == 1 and "outside range" in note


def test_repair(spark):
    found = spark.createDataFrame([("s", 0, "AGCGTGGTTATTGGATGGGTTTG", 5), ("s", 0, "AAAAAAAAAAAAAAAAAAAAAAAA", 5)], "site string, pool int, seq string, count int")
    scheme = spark.createDataFrame([("s", 0, "AGCGTGGTTATTGGATGGGTTTGA")], "site string, pool int, seq string")
    assert {r.seq[0:2]: r.status for r in maintain.repair(found, scheme).collect()} == {"AG": "PRESENT", "AA": "LOW_GC"}
