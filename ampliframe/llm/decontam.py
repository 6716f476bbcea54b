"""Operator 7, benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, of any script, of the lower-cased text. Seeds are runs of MATCH words whose rolling Karp-Rabin hashes are equal in a document and in a benchmark item. For a document and an
item that share seeds, the longest common run without marked words is marked in both, again and again, until no run of
MATCH unmarked words is left. The marked share of the item's words is its coverage; order plays no part, so passages
that were cut up and moved are caught. At LEAST coverage the document is contaminated.

The benchmark is the side that is held in memory: it is read in blocks of BLOCK_BYTES of text, each block's seeds are
sent to the executors and all documents are read against it. A block has a fixed bound whatever the benchmark's size, and
documents are never shuffled.

An item of fewer words than MATCH is no evidence of a copy (an item "yes" would condemn every text with the word): it matches
nothing.

Defined cases: null or empty documents and items match nothing; equal items each get their row; a passage that a document
repeats counts once; ties among longest matches go to the first in the document, then in the item; an empty benchmark or
table finds nothing; rows with equal or null doc_id are judged each; a text of any length is compared whole; other columns
are carried along by clean, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MATCH = 5
LEAST = 0.8
BLOCK_BYTES = 16 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc_id long, item_id long, item_words int, covered_words int, tiles int, coverage double"


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n words, from the words' hashes; the last n - 1 places are cut off."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:m].copy()
        for k in range(1, n):
            out = out * BASE + h[k : k + m]
    return common.mix(out)


def runs_within(cut: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of the places of rolling(), those whose run lies in one text."""
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    return np.flatnonzero(owner[: max(total - n + 1, 0)] == owner[n - 1 :]) if total >= n else np.zeros(0, np.int64)


def tile(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seeds (document place, item place) of n words: tiles (i, j, length), longest first."""
    tiles = []
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    while len(i):
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
        start = np.flatnonzero(new)
        length = np.diff(start, append=len(i))
        top = np.flatnonzero(length == length.max())
        best = top[np.lexsort((i[start[top]], j[start[top]]))[0]]
        a, b, size = int(i[start[best]]), int(j[start[best]]), int(length[best]) + n - 1
        tiles.append((a, b, size))
        free = ((i + n <= a) | (i >= a + size)) & ((j + n <= b) | (j >= b + size))
        i, j = i[free], j[free]
    return tiles


class Index:
    """A block of benchmark items: sorted seeds and, for each, its items and places."""

    def __init__(self, items: list[tuple[int, bytes]]):
        at = np.zeros(len(items) + 1, np.int64)
        np.cumsum([len(t) + 1 for _, t in items], out=at[1:])
        _, _, h, cut = common.word_rows(b"\n".join(t for _, t in items), at, common.ALNUM)
        self.ids, self.sizes = [x for x, _ in items], np.diff(cut)
        self.seeds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        n, place = MATCH, runs_within(cut, MATCH, len(h))
        owner = np.searchsorted(cut, place, "right") - 1
        if len(place):
            key = rolling(h, n)[place]
            order = np.argsort(key, kind="stable")
            distinct, first = np.unique(key[order], return_index=True)
            self.seeds.append((n, distinct, np.append(first, len(order)), owner[order], (place - cut[owner])[order]))

    def matches(self, buf: bytes, at: np.ndarray, least: float) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, item's words, covered words, tiles) at least coverage."""
        _, _, h, cut = common.word_rows(buf, at, common.ALNUM)
        for n, keys, first, owner, place in self.seeds:
            key, inside = rolling(h, n), runs_within(cut, n, len(h))
            if not len(inside):
                continue
            k = np.minimum(np.searchsorted(keys, key[inside]), len(keys) - 1)
            hit = np.flatnonzero(keys[k] == key[inside])
            if not len(hit):
                continue
            spot, k = inside[hit], k[hit]
            text = np.searchsorted(cut, spot, "right") - 1
            ends = np.searchsorted(text, np.arange(len(cut)))
            for t in np.unique(text):
                lo, hi = ends[t], ends[t + 1]
                many = first[k[lo:hi] + 1] - first[k[lo:hi]]
                i = np.repeat(spot[lo:hi] - cut[t], many)
                flat = np.repeat(first[k[lo:hi]] - (np.cumsum(many) - many), many) + np.arange(len(i))
                item, j = owner[flat], place[flat]
                order = np.argsort(item, kind="stable")
                items, begin = np.unique(item[order], return_index=True)
                for x, a, b in zip(items, begin, np.append(begin[1:], len(order))):
                    size = int(self.sizes[x])
                    own = order[a:b]
                    # an upper bound first: item words that any seed touches
                    touched = np.zeros(size + 1, np.int64)
                    np.add.at(touched, j[own], 1)
                    np.add.at(touched, j[own] + n, -1)
                    if (np.cumsum(touched)[:size] > 0).sum() < least * size:
                        continue
                    tiles = tile(i[own], j[own], n)
                    covered = sum(x[2] for x in tiles)
                    if covered >= least * size:
                        yield int(t), int(x), size, covered, len(tiles)


def blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[Index]:
    held, size = [], 0
    for r in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        t = common.plain(r.text).encode("utf-8", "surrogatepass")
        held.append((r.item_id, t))
        size += len(t)
        if size >= limit:
            yield Index(held)
            held, size = [], 0
    if held:
        yield Index(held)


def find(spark: SparkSession, docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """A row of FOUND for each contaminated document and item."""
    found = spark.createDataFrame([], FOUND)
    for index in blocks(items):
        sent = spark.sparkContext.broadcast(index)

        def run(rows, sent=sent):
            x = sent.value
            for batch in rows:
                ids = batch.column(0).to_pylist()
                for lo, _, buf, at in common.batches(batch.column(1), lower=True):
                    out = [(ids[lo + t], x.ids[k], size, covered, tiles, covered / size) for t, k, size, covered, tiles in x.matches(buf, at, least)]
                    if out:
                        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [f.split()[0] for f in FOUND.split(", ")])

        found = found.union(docs.select("doc_id", "text").mapInArrow(run, FOUND))
    return found


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without the contaminated ones; one filter for each block, no join."""
    for index in blocks(items):
        sent = spark.sparkContext.broadcast(index)

        def keep(buf, at, sent=sent):
            ok = np.ones(len(at) - 1, bool)
            ok[[m[0] for m in sent.value.matches(buf, at, least)]] = False
            return [ok]

        docs = common.appended(docs, "keep boolean", keep, only=True, lower=True)
    return docs


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return clean(spark, docs, common.table(spark, sf_dir, "benchmark"))
