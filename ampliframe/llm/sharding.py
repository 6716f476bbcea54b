"""Operator 4, sharding by a Hilbert curve.

Several metadata dimensions (source, lang and the text's size) are quantised to BITS bits each, the rows are sorted by
the curve index of their cell, and the sorted run is cut into shards whose row counts are at most one apart. Rows that
are near in all dimensions share a shard, so a reader who filters on any of them opens few files.

write_shards puts each shard into a folder of its own, from rows that lie in curve order already; a reader that filters on a
dimension opens the files whose footers' bounds allow it.

Defined cases: null metadata fall into cell 0 of their dimension; a null text has size 16 and CRC 0; ties on the curve
are ordered by doc_id (null first), then size and CRC, and rows equal in these may take either of their slots; an empty
table gives an empty result; a text of any length counts whole; columns other than those named are carried along, whatever
their names, but the names this operator adds (size, text_crc32, law, shard, slot, grown_shard) replace columns of the same
name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS = 40
BITS = 5
OVERHEAD = 16
DIMENSIONS = ("source", "lang")


def hilbert(cells: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of points with len(cells) coordinates of so many bits (Skilling's transpose)."""
    x = [c.astype(np.int64).copy() for c in cells]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ t) >> b) & 1)
    return index


def curve_index(*cells):
    @F.pandas_udf("int")
    def index(*c: pd.Series) -> pd.Series:
        return pd.Series(hilbert([s.to_numpy() for s in c]).astype(np.int32))

    return index(*cells)


def quantised(docs: DataFrame) -> list:
    """A cell number per dimension: hashed for names, by the logarithm of the size for texts."""
    top = (1 << BITS) - 1
    names = [F.when(F.col(c).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(top))) if c in docs.columns else F.lit(0) for c in DIMENSIONS]
    log = F.floor(F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1.0)) * 1.25)
    return [c.cast("int") for c in (*names, F.least(log, F.lit(top)))]


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """docs (or of it the columns keep) with size, text_crc32, law, shard, slot, grown_shard.

    One shuffle by ranges of (curve index, doc_id): no task holds more than a slice of any cell, however full. The rank
    of a row is its place in its slice plus the rows of the slices before; only the slices' counts are summed up.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    scratch = common.Scratch(spark, "shards")
    rows = docs.select(
        common.row_of(keep).alias("row"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        curve_index(*quantised(docs)).alias("curve"),
        F.col("doc_id").alias("id"),
    )
    placed, total = common.ranked(spark, rows, ["curve", "id", "size", "text_crc32"], scratch, "placed")
    small, extra = divmod(total, shards)
    rank = F.col("rank")
    head = F.lit(extra * (small + 1))
    part = F.when(rank < head, F.floor(rank / (small + 1))).otherwise(extra + F.floor((rank - head) / max(small, 1)))
    slot = F.when(rank < head, rank % (small + 1)).otherwise((rank - head) % max(small, 1))
    return placed.select(*common.unpacked("row", keep), "size", "text_crc32", F.lit("rows").alias("law"), part.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder of Parquet for each shard. The rows of shard() lie in slices of the curve, so that each task writes the few
    shards that its slice meets: no shuffle, and no task that holds a whole shard."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, common.table(spark, sf_dir, "documents"), keep=["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return shard(spark, docs)
