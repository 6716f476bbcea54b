"""Statistics and coordinates of alignments, from rows (chrom, row, seq).

Cells are bases, gaps, or '' where an end was not sequenced. Cells beyond a row's end are not counted one by one: column counts
take the rows of the alignment as their total, so that they count as '' without being rows.

Cells never become rows of a table. Each task adds up its rows' bytes in numpy, in blocks of columns of which it holds a
bounded number, and hands out a row for each column; one shuffle by column adds these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from .scans import scan

#: Columns in a block, and blocks that a task holds before it hands them out.
BLOCK, HELD = 1 << 14, 64
BASES = "ACGTRYSWKMBDHVN-"
ENDS = len(BASES)
_CODE = np.full(256, ENDS - 2, np.uint8)  # any other character is as little a base as N
_CODE[np.frombuffer(BASES.encode(), np.uint8)] = np.arange(ENDS)


def _summed(rows: DataFrame, kind: str, fresh: Callable, add: Callable, give: Callable) -> DataFrame:
    """Rows (chrom, col, ...) of kind that each task makes of its rows: fresh() makes a block, add(block, first, codes, row)
    adds a row's codes of the block's columns from first on, give(block) lists the columns to hand out and their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], object] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (chrom, b), block in held.items():
                at, values = give(block)
                columns = [pa.array([chrom] * len(at), pa.string()), pa.array((at + b * BLOCK).astype(np.int32)), *map(pa.array, values)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in kind.split(", ")])
            held.clear()

        for batch in batches:
            for chrom, row, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = _CODE[np.frombuffer(seq.as_py().encode("ascii", "replace"), np.uint8)]
                bare = np.flatnonzero(x != ENDS - 1)
                x[: bare[0] if len(bare) else len(x)] = ENDS
                if len(bare):
                    x[bare[-1] + 1 :] = ENDS
                for b in range(0, -(-len(x) // BLOCK)):
                    if (chrom, b) not in held:
                        if len(held) >= HELD:
                            yield from out()
                        held[chrom, b] = fresh()
                    add(held[chrom, b], x[b * BLOCK : (b + 1) * BLOCK], row)
        yield from out()

    return rows.select(F.col("chrom").cast("string"), F.col("row").cast("long"), "seq").mapInArrow(run, kind)


def _counts(rows: DataFrame, kind: str, give: Callable) -> DataFrame:
    """Counts of codes by column."""
    wide, places = ENDS + 1, np.arange(BLOCK) * (ENDS + 1)

    def add(block: np.ndarray, codes: np.ndarray, row: int) -> None:
        block[places[: len(codes)] + codes] += 1

    return _summed(rows, kind, lambda: np.zeros(BLOCK * wide, np.int64), add, lambda block: give(block.reshape(BLOCK, wide)))


def histogram(rows: DataFrame) -> DataFrame:
    """chrom, col, base, n of the stored cells."""
    names = np.array([*BASES, ""], object)

    def give(block: np.ndarray):
        at, code = np.nonzero(block)
        return at, (names[code], block[at, code])

    return _counts(rows, "chrom string, col int, base string, n long", give).groupBy("chrom", "col", "base").agg(F.sum("n").alias("n"))


def heights(rows: DataFrame) -> DataFrame:
    """chrom, height: the rows of each alignment."""
    return rows.groupBy("chrom").agg(F.count("*").alias("height"))


def most_common(hist: DataFrame) -> DataFrame:
    """The most common base of each column, '' aside; ties go to the first in sort order, and a gap may win."""
    return hist.where("base != ''").groupBy("chrom", "col").agg(F.min_by("base", F.struct(-F.col("n"), "base")).alias("base"))


def per_column(rows: DataFrame) -> DataFrame:
    """One row for each column: counts of A, C, G, T, gaps, '' and the alignment's height; one shuffle on (chrom, col)."""

    def give(block: np.ndarray):
        stored = block.sum(1)
        at = np.flatnonzero(stored)
        return at, (*(block[at, k] for k in range(4)), block[at, ENDS - 1], block[at, ENDS], stored[at])

    names = ("a", "c", "g", "t", "gaps", "ends", "stored")
    found = _counts(rows, "chrom string, col int, " + ", ".join(f"{x} long" for x in names), give)
    cols = found.groupBy("chrom", "col").agg(*(F.sum(x).alias(x) for x in names))
    return cols.join(heights(rows), "chrom").withColumn("ends", F.col("ends") + F.col("height") - F.col("stored"))


def gap_gate(columns: DataFrame, min_freq: float = 0.0) -> DataFrame:
    """Whether a column's share of gaps, of all rows, is over min_freq: no primer may end there."""
    freq = F.col("gaps") / F.col("height")
    return columns.select("chrom", "col", F.round(freq, 6).alias("gap_freq"), (freq > min_freq).alias("gapped"))


def entropy(columns: DataFrame) -> DataFrame:
    """Shannon entropy of the plain bases; 0 where there are none."""
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    part = lambda b: F.when(F.col(b) > 0, -(F.col(b) / total) * F.log2(F.col(b) / total)).otherwise(F.lit(0.0))
    return columns.select("chrom", "col", F.round(F.abs(part("a") + part("c") + part("g") + part("t")), 6).alias("entropy"))


def probabilities(hist: DataFrame) -> DataFrame:
    """Shares of the bases with ambiguity codes spread over what they stand for; N and gaps count nowhere."""
    spread = hist.select("chrom", "col", F.explode(S.bases_of(F.col("base"))).alias("base"), "n").where("base != 'N'")
    found = spread.groupBy("chrom", "col", "base").agg(F.sum("n").alias("n"))
    return found.select("chrom", "col", "base", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("chrom", "col")), 6).alias("prob"))


def occupancy(columns: DataFrame) -> DataFrame:
    return columns.select("chrom", "col", (1 - (F.col("gaps") + F.col("ends")) / F.col("height")).alias("value"))


def reduced(points: DataFrame) -> DataFrame:
    """Of each chrom's points (col, value), the first, the last, and those that differ from a neighbour; then rounded."""
    p = scan(points, "chrom", ["col"], _p=("lag", F.col("value")), _n=("lead", F.col("value")))
    stays = F.col("_p").isNull() | F.col("_n").isNull() | (F.col("_p") != F.col("value")) | (F.col("_n") != F.col("value"))
    return p.where(stays).select("chrom", "col", F.round("value", 4).alias("value"))


def gc_bins(columns: DataFrame, width: int = 30) -> DataFrame:
    """Share of G and C in blocks of columns over all rows; a base that a block lacks counts as one."""
    size = columns.groupBy("chrom").agg((F.max("col") + 1).alias("width"))
    bins = columns.groupBy("chrom", (F.floor(F.col("col") / width) * width).cast("int").alias("col")).agg(*(F.sum(b).alias(b) for b in "acgt"))
    one = lambda b: F.greatest(F.col(b), F.lit(1))
    value = (one("g") + one("c")) / (one("a") + one("c") + one("g") + one("t"))
    return bins.join(size, "chrom").where(F.col("col") < F.col("width") - width).select("chrom", "col", F.round(value, 2).alias("value"))


_SPREAD = [np.array(["ACGT".index(x) for x in S.IUPAC.get(b, "")], np.int64) for b in [*BASES, ""]]
NEVER = (1 << 63) - 1


def consensus(rows: DataFrame) -> DataFrame:
    """The consensus base of each column: ambiguity codes spread, N dropped, ties to the first seen in row order."""

    def add(block: tuple, codes: np.ndarray, row: int) -> None:
        votes, first, seen = block
        seen[: len(codes)] = True
        for code in np.unique(codes).tolist():
            at = np.flatnonzero(codes == code)
            for k, base in enumerate(_SPREAD[code].tolist()):
                votes[at, base] += 1
                first[at, base] = np.minimum(first[at, base], row * 4 + k)

    def give(block: tuple):
        votes, first, seen = block
        at = np.flatnonzero(seen)
        return at, (*(votes[at, k] for k in range(4)), *(first[at, k] for k in range(4)))

    names = [*(f"n{b}" for b in "ACGT"), *(f"f{b}" for b in "ACGT")]
    fresh = lambda: (np.zeros((BLOCK, 4), np.int64), np.full((BLOCK, 4), NEVER), np.zeros(BLOCK, bool))
    found = _summed(rows, "chrom string, col int, " + ", ".join(f"{x} long" for x in names), fresh, add, give)
    sums = found.groupBy("chrom", "col").agg(*(F.sum(x).alias(x) for x in names[:4]), *(F.min(x).alias(x) for x in names[4:]))
    best = F.array_min(F.array(*(F.struct((-F.col(f"n{b}")).alias("n"), F.col(f"f{b}").alias("f"), F.lit(b).alias("b")) for b in "ACGT")))
    return sums.select("chrom", "col", F.when(best["n"] < 0, best["b"]).otherwise("N").alias("base"))


def reference(rows: DataFrame) -> DataFrame:
    """The first row of each alignment without gaps."""
    first = rows.groupBy("chrom").agg(F.min_by("seq", "row").alias("seq"))
    return first.select("chrom", F.regexp_replace("seq", "-", "").alias("reference"))


def first_rows(rows: DataFrame) -> DataFrame:
    """chrom, row, seq of each alignment's first row."""
    return rows.groupBy("chrom").agg(F.min("row").alias("row"), F.min_by("seq", "row").alias("seq"))


def mapping(rows: DataFrame) -> DataFrame:
    """chrom, col, ref_pos (null in gaps) by the first row: a running count of its bases, made where the row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chrom, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = np.frombuffer(seq.encode("ascii", "replace"), np.uint8) != ord("-")
                at = np.cumsum(base) - 1
                for lo in range(0, len(at), 1 << 20):
                    part = slice(lo, lo + (1 << 20))
                    columns = [pa.array([chrom] * len(at[part]), pa.string()), pa.array(np.arange(lo, lo + len(at[part]), dtype=np.int32)), pa.array(at[part].astype(np.int32), mask=~base[part])]
                    yield pa.RecordBatch.from_arrays(columns, ["chrom", "col", "ref_pos"])

    return first_rows(rows).select(F.col("chrom").cast("string"), "seq").mapInArrow(run, "chrom string, col int, ref_pos int")


def ref_to_msa(mapped: DataFrame) -> DataFrame:
    """The inverse map, with one entry past the end for exclusive ends."""
    found = mapped.where("ref_pos IS NOT NULL").select("chrom", "ref_pos", "col")
    past = found.groupBy("chrom").agg((F.max("ref_pos") + 1).alias("ref_pos"), (F.max("col") + 1).alias("col"))
    return found.unionByName(past)


def ends_on_gap(inverse: DataFrame) -> DataFrame:
    """Reference positions whose exclusive end lies behind a gap, and the end without the gap."""
    last = inverse.select("chrom", (F.col("ref_pos") + 1).alias("ref_pos"), (F.col("col") + 1).alias("fixed_col"))
    return inverse.join(last, ["chrom", "ref_pos"]).where("col != fixed_col").select("chrom", "ref_pos", "col", "fixed_col")
