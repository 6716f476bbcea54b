"""Primer candidates at every column of an alignment: walks from each anchor until the melting temperature is reached.

An alignment is dealt by blocks of columns with enough neighbours on either side, so that blocks are independent; within
a block rows are walked in Python, as ambiguity codes branch and each branch stops for itself.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import seq as S
from ..functions import thermo

#: Statuses of a walk that fails, worst first.
ERRORS = ("CONTAINS_INVALID_BASE", "GAP_ON_SET_BASE", "WALKS_OUT", "WALK_TO_FAR", "AMB_FAIL")


def spread(s: str) -> list[str] | None:
    out = [""]
    for c in s:
        if c not in S.IUPAC:
            return None
        out = [p + x for p in out for x in S.IUPAC[c]]
    return sorted(set(out))


class Alignment:
    """Columns [offset, offset + width) of an alignment of total columns; cells are bases, '-' or '' at unsequenced ends.

    Equal rows come once, with their number in weights, in the order of the first of each.
    """

    def __init__(self, rows: list[list[str]], offset: int, total: int, c: Config, weights: list[int] | None = None):
        self.rows, self.offset, self.total, self.c = rows, offset, total, c
        self.weights = weights or [1] * len(rows)
        self._tm: dict[str, float] = {}
        self._common: dict[int, str] = {}

    def cell(self, row: int, col: int) -> str:
        return self.rows[row][col - self.offset]

    def common(self, col: int) -> str:
        if col not in self._common:
            n: Counter = Counter()
            for r, w in enumerate(self.weights):
                if x := self.cell(r, col):
                    n[x] += w
            self._common[col] = min(n, key=lambda b: (-n[b], b)) if n else "-"
        return self._common[col]

    def enough(self, s: str) -> bool:
        if s not in self._tm:
            self._tm[s] = thermo.tm_of(s, self.c) if s else -273.15
        return self._tm[s] >= self.c.primer_tm_min

    def walk(self, row: int, left: int, right: int, s: str, forward: bool) -> list[str]:
        """Sequences and statuses that extending s gives: to the left for a forward primer that ends before right, to the
        right for a reverse primer that starts at left."""
        done: list[str] = []
        todo = [(left if forward else right, s)]
        while todo:
            at, s = todo.pop()
            out_of = at <= 0 or right <= 0 if forward else at >= self.total - 1 or left >= self.total - 1
            if forward and out_of:  # a forward walk looks at the border before the temperature
                done.append("WALKS_OUT")
            elif self.enough(s):
                done.append(s)
            elif out_of:
                done.append("WALKS_OUT")
            elif (right - at if forward else at - left) >= self.c.primer_max_walk:
                done.append("WALK_TO_FAR")
            else:
                col = at - 1 if forward else at
                base = self.cell(row, col)
                if base == "":  # an unsequenced end takes the column's common base; rightward that of the next column
                    base = self.common(col if forward else col + 1)
                longer = (base + s if forward else s + base).replace("-", "")
                more = spread(longer)
                if more is None:
                    done.append("CONTAINS_INVALID_BASE")
                else:
                    todo += [(at - 1 if forward else at + 1, x) for x in reversed(more)]
        return done

    def digest(self, col: int, forward: bool) -> dict[str, float]:
        """Weights of sequences and statuses over the rows at one anchor column."""
        c, n = self.c, sum(self.weights)
        size = c.primer_size_min
        if not forward and col + size >= self.total:
            return {"WALKS_OUT": -1.0}
        gaps = sum(w for r, w in enumerate(self.weights) if self.cell(r, col) == "-") if col < self.total else 0
        if gaps / n > c.min_base_freq:
            return {"GAP_ON_SET_BASE": -1.0}
        if forward and col - size < 0:
            return {"WALKS_OUT": -1.0}
        left, right = (col - size, col) if forward else (col, col + size)
        total: Counter = Counter()
        for r, w in enumerate(self.weights):
            if col < self.total and self.cell(r, col) == "-":  # for a forward primer, the column behind its last base
                total["GAP_ON_SET_BASE"] += w
                continue
            s = "".join(self.cell(r, k) for k in range(left, right)).replace("-", "")
            if not s:
                continue
            start = spread(s)
            if start is None:  # a base without meaning counts as such, and ends nothing early
                total["CONTAINS_INVALID_BASE"] += w
                continue
            found = [x for s in start for x in self.walk(r, left, right, s, forward)]
            if c.min_base_freq == 0 and any(x in ERRORS for x in found):
                return {min((x for x in found if x in ERRORS), key=ERRORS.index): -1.0}
            for x in dict.fromkeys(found):
                total[x] += w / len(found)
        return dict(total)


def resolve(total: dict[str, float], forward: bool, c: Config) -> tuple[str, list[str], list[float]]:
    """Status, sequences and weights of an anchor: rare ones dropped, any error left fails it, then temperature checks.

    Whether a cloud binds itself is asked of many anchors at once (see dimers)."""
    errors = [k for k, v in total.items() if v == -1.0]
    if errors:
        return errors[0], [], []
    every = sum(total.values())
    kept = {k: v for k, v in total.items() if every and v / every > c.min_base_freq and not (c.ignore_n and k == "CONTAINS_INVALID_BASE")}
    bad = [k for k in kept if k in ERRORS]
    if bad:  # the first that was met
        return bad[0], [], []
    if not kept:
        return "NO_SEQS", [], []
    if not forward:
        kept = {k[::-1].translate(str.maketrans("ACGT", "TGCA")): v for k, v in kept.items()}
    for s in kept:
        status = check(s, c)
        if status != "PASS":
            return status, [], []
    seqs = sorted(kept)
    return "PASS", seqs, [kept[s] for s in seqs]


def dimers(resolved: list[tuple[str, list[str], list[float]]], c: Config) -> list[tuple[str, list[str], list[float]]]:
    """The anchors, with DIMER_FAIL for those whose cloud binds itself."""
    clouds = pa.array([r[1] for r in resolved], pa.list_(pa.string()))
    bound = thermo.clouds_bind(clouds, clouds, c.dimer_score)
    return [("DIMER_FAIL", [], []) if b else r for r, b in zip(resolved, bound.tolist())]


def check(s: str, c: Config, hairpin: bool = False) -> str:
    gc = round(100 * sum(x in "GC" for x in s) / len(s), 1)
    tm, run, longest = thermo.tm_of(s, c), 1, 1
    for a, b in zip(s, s[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    if c.use_annealing:
        bound = thermo.annealed_of(s, c)
        heat = ((bound > c.primer_annealing_prop + 5, "HIGH_ANNEALING"), (bound < c.primer_annealing_prop - 5, "LOW_ANNEALING"))
    else:
        heat = ((tm > c.primer_tm_max + 2, "HIGH_TM"), (tm < c.primer_tm_min, "LOW_TM"))
    for bad, name in ((gc > c.primer_gc_max, "HIGH_GC"), (gc < c.primer_gc_min, "LOW_GC"), (len(s) > c.primer_size_max, "TO_LONG"), *heat, (longest > c.primer_homopolymer_max, "MAX_HOMOPOLY")):
        if bad:
            return name
    return "HAIRPIN" if hairpin and thermo.hairpin_tm(s, c) > c.primer_hairpin_th_max else "PASS"


def digest(rows: DataFrame, c: Config = Config(), block: int = 512, only: DataFrame | None = None) -> DataFrame:
    """msa, direction, col, status, seqs, weights for every column of aligned rows (msa, row, seq, lead, tail), or for those
    in the runs only (msa, direction, start, stop), of which there are few; blocks without one are not walked.

    Every row is cut into blocks of columns with a margin as wide as a walk. Equal pieces, of which most genomes have many,
    become one with their number before the one shuffle; a group is one block of one alignment.
    """
    runs: dict[str, list[tuple[bool, int, int]]] = {}
    some = only is not None
    for r in only.toLocalIterator() if only is not None else ():
        runs.setdefault(r.msa, []).append((r.direction == "LEFT", r.start, r.stop))
    margin = c.primer_max_walk + c.primer_size_min + 2
    total = rows.groupBy("msa").agg(F.max(F.length("seq")).alias("total"))
    wide = rows.join(total, "msa").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / block))))
    if only is not None:
        blocks = only.select("msa", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))).alias("block")).distinct()
        wide = wide.join(blocks, ["msa", "block"], "left_semi")
    low = F.greatest(F.col("block") * block - margin, F.lit(0))
    high = F.least((F.col("block") + 1) * block + margin, "total")
    piece = F.expr("substring(seq, cast(greatest(block * {0} - {1}, 0) as int) + 1, cast(least((block + 1) * {0} + {1}, total) - greatest(block * {0} - {1}, 0) as int))".format(block, margin))
    # where the piece's sequenced cells begin and end
    first, last = (F.least(F.greatest(x - low, F.lit(0)), high - low).cast("int") for x in (F.col("lead"), F.length("seq") - F.col("tail")))
    cut = wide.select("msa", "block", "row", "total", low.cast("int").alias("low"), high.cast("int").alias("high"), piece.alias("piece"), first.alias("first"), last.alias("last"))
    cut = cut.groupBy("msa", "block", "total", "low", "high", "piece", "first", "last").agg(F.min("row").alias("row"), F.count("*").alias("n"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        low, high, total = int(pdf.low.iloc[0]), int(pdf.high.iloc[0]), int(pdf.total.iloc[0])
        cells = []
        for p in pdf.itertuples():
            text = p.piece.ljust(high - low, "-")
            cells.append(["" if k < p.first or k >= p.last else x for k, x in enumerate(text)])
        a = Alignment(cells, low, total, c, pdf.n.tolist())
        first = int(key[1]) * block
        cols = range(first, min(first + block, total))
        at = [(col, forward) for col in cols for forward in (True, False) if (col >= c.primer_size_min if forward else col < total - c.primer_size_min)]
        if some:
            own = runs.get(key[0], [])
            at = [(col, forward) for col, forward in at if any(d == forward and lo <= col < hi for d, lo, hi in own)]
        found = dimers([resolve(a.digest(col, forward), forward, c) for col, forward in at], c)
        out = [(key[0], "LEFT" if forward else "RIGHT", col, *r) for (col, forward), r in zip(at, found)]
        return pd.DataFrame(out, columns=["msa", "direction", "col", "status", "seqs", "weights"])

    return cut.groupBy("msa", "block").applyInPandas(run, "msa string, direction string, col int, status string, seqs array<string>, weights array<double>")


def remapped(found: DataFrame, mapped: DataFrame) -> DataFrame:
    """Candidates at reference positions: those on a mapped column whose primers stay inside the alignment's columns."""
    size = F.array_max(F.transform("seqs", lambda s: F.length(s)))
    width = mapped.groupBy(F.col("chrom").alias("msa")).agg((F.max("col") + 1).alias("_width"))
    p = found.where("status = 'PASS'").join(mapped.select(F.col("chrom").alias("msa"), "col", "ref_pos"), ["msa", "col"]).where("ref_pos IS NOT NULL").join(width, "msa")
    p = p.withColumns({"start": F.when(F.col("direction") == "LEFT", F.col("ref_pos") - size).otherwise(F.col("ref_pos")), "stop": F.when(F.col("direction") == "LEFT", F.col("ref_pos")).otherwise(F.col("ref_pos") + size)})
    return p.where((F.col("start") >= 0) & (F.col("stop") < F.col("_width"))).drop("_width")
