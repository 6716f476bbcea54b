"""Shared pieces of the training-data operators: scratch tables, sessions' settings, vectorised words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
SEGMENT = 1 << 20
#: Bytes of a batch of rows for Python in the pipeline's stages.
BATCH = 1 << 21

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and
    executors are threads of the driver, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="ampliframe-")
        shared_dir.own = path
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Spark deletes the shuffle files of each query that ends in here, which else stay until the driver's JVM happens to
    collect its garbage. Only for queries that are run once: what is read again would be shuffled again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of about BATCH bytes, where the session doesn't set another size: batches of
    10,000 whole texts keep tens of MB in an executor's JVM, outside its heap, and in each Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in getattr(spark.conf, "getAll", {}):
        spark.conf.set(name, str(BATCH))


class Scratch:
    """Tables written to the shared folder in place of cached data, so that a lost executor loses nothing.

    Results are read from them lazily, so they stay until they are dropped or the driver ends, which deletes the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with shuffles_dropped(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free(taken: list[str], *names: str) -> list[str]:
    """names, each with as many underscores behind it as it takes to be none of taken, in any case of letters."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


class Salted:
    """A join of many rows with few for each key, where one key may have a large share of the many.

    Keys with more than a MOST-th part of the many rows, and LEAST rows, are hot: MOST keys at most, so that their table can
    be broadcast. The rows of a hot key are dealt over several tasks by a hash of the columns by, and the other side's row
    goes to each of them.
    """

    LEAST, MOST = 256, 4096

    def __init__(self, many: DataFrame, keys: list[str], by: list[str], counts: DataFrame | None = None):
        """counts: keys and _rows, where these are known, of at least the keys that the other side has."""
        self.many, self.keys, self.by = many, keys, by
        if counts is None:
            counts = many.groupBy(*keys).agg(F.count("*").alias("_rows"))
        limit = max(self.LEAST, many.count() // self.MOST)
        hot = counts.where(F.col("_rows") > limit).select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_cuts"))
        with shuffles_dropped(many.sparkSession):
            rows = hot.take(self.MOST)
        self.hot = F.broadcast(many.sparkSession.createDataFrame(rows, hot.schema)) if rows else None

    def join(self, few: DataFrame, how: str = "inner", many: DataFrame | None = None) -> DataFrame:
        """many (or a table of its keys) with few; few has the same names for the keys."""
        many = self.many if many is None else many
        if self.hot is None:
            return many.join(few, self.keys, how)
        cuts = F.coalesce("_cuts", F.lit(1))
        left = many.join(self.hot, self.keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*self.by), cuts)).drop("_cuts")
        right = few.join(self.hot, self.keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), cuts.cast("long") - 1))).drop("_cuts")
        return left.join(right, [*self.keys, "_salt"], how).drop("_salt")


def row_of(columns: list[str]) -> Column:
    """All columns as one struct: beside it, names of an operator's own can't clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in columns))


def unpacked(row: str, columns: list[str]) -> list[Column]:
    """The columns of a struct made by row_of."""
    return [F.col(f"{row}.`{c}`").alias(c) for c in columns]


def ranked(spark: SparkSession, rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """rows with rank, their place from 0 in the order, and how many they are.

    One shuffle by ranges; a row's rank is its place in its slice and the rows of the slices before. Only the slices' counts
    come to the driver.
    """
    sliced = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = scratch.keep(sliced.withColumns({"_slice": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)
    before, total = {}, 0
    for part, n in sorted(placed.groupBy("_slice").count().collect()):  # one row for each slice
        before[part], total = total, total + n
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "_slice int, _before long")  # the same
    return placed.join(F.broadcast(starts), "_slice").withColumn("rank", F.col("_before") + F.col("_place")).drop("_slice", "_place", "_before"), total


def once_each(rows: DataFrame, key: str) -> DataFrame:
    """rows without those whose long key a row before has in the same partition: what is left of a key, however many rows
    it has, is a row for each partition. Rows without a key all stay."""
    at = rows.columns.index(key)

    def run(batches):
        seen = set()
        for batch in batches:
            new = []
            for k in batch.column(at).to_pylist():
                new.append(k is None or k not in seen)
                seen.add(k)
            yield batch.filter(pa.array(new, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: str = "text"):
    """Number of words of a text column, 0 for null, as a native column."""
    return F.coalesce(F.size(F.filter(F.split(F.col(text), BLANK), lambda w: w != "")), F.lit(0)).cast("long")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def _symbols() -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    t[65:91] = t[97:123]
    return t


SYMBOL = _symbols()
_place = [mix(np.arange(1, 1025, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)]


def _places(n: int) -> np.ndarray:
    if len(_place[0]) < n:
        _place[0] = mix(np.arange(1, 2 * n + 1, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)
    return _place[0]


def words_of(buf: bytes, space: np.ndarray = SPACE, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes (ASCII letters lower-cased) of the words of buf; memory follows SEGMENT, not buf.

    A hash is a sum of byte values times place values, finalised with the length; words are cut at bytes in space, and
    between neighbours of kinds 1 and 2.
    """
    a = np.frombuffer(buf, np.uint8)
    starts, ends, hashes = [], [], []
    lo, n = 0, len(a)
    while lo < n:
        hi = min(n, lo + SEGMENT)
        while hi < n:
            k = np.flatnonzero(space[a[hi : hi + 4096]])
            if len(k):
                hi += int(k[0])
                break
            hi = min(n, hi + 4096)
        b = a[lo:hi]
        at = np.flatnonzero(~space[b])
        if len(at):
            first = np.empty(len(at), bool)
            first[0] = True
            np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
            if kinds is not None:
                k = kinds[b[at]]
                first[1:] |= k[1:] + k[:-1] == 3
            w = np.flatnonzero(first)
            size = np.diff(w, append=len(at))
            place = np.arange(len(at)) - np.repeat(w, size)
            with np.errstate(over="ignore"):
                h = np.add.reduceat(SYMBOL[b[at]] * _places(int(size.max()))[place], w)
                h = mix(h + size.astype(_U) * _U(0x9E3779B97F4A7C15))
            starts.append(at[w] + lo)
            ends.append(at[w] + size + lo)
            hashes.append(h)
        lo = hi
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, _U)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def runs(column, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Runs of rows of an Arrow text column that hold about limit bytes: first row, end row."""
    size = pc.cumulative_sum(pc.add(pc.fill_null(pc.binary_length(column), 0), 1).cast(pa.int64())).to_numpy() if len(column) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(size):
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit)) + 1
        yield lo, min(hi, len(size))
        lo = hi


def batches(column, limit: int = SEGMENT, lower: bool = False) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of rows of an Arrow text column: first row, end row, their bytes joined by line ends, each text's start.

    A run ends once it holds limit bytes, so memory follows the longest text and not the batch. Null texts are empty.
    """
    rows, held, lo = [], 0, 0
    for i, x in enumerate(column):
        t = x.as_py()
        if lower and t is not None:
            t = plain(t)
        t = b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t
        rows.append(t)
        held += len(t) + 1
        if held >= limit:
            yield lo, i + 1, *_joined(rows)
            rows, held, lo = [], 0, i + 1
    if rows:
        yield lo, lo + len(rows), *_joined(rows)


def plain(t: str) -> str:
    """t in lower case, with blanks for punctuation beyond ASCII."""
    t = t.lower()
    return t if t.isascii() else PUNCTUATION.sub(" ", t)


def _joined(rows: list[bytes]) -> tuple[bytes, np.ndarray]:
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in rows], out=at[1:])
    return b"\n".join(rows), at


def word_rows(buf: bytes, at: np.ndarray, space: np.ndarray = SPACE, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words_of a run, and cut: row i's words are cut[i]:cut[i+1]."""
    s, e, h = words_of(buf, space, kinds)
    return s, e, h, np.searchsorted(s, at)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


#: Bytes that end a word: all but ASCII letters, and digits, and the bytes of other characters.
LETTERS = np.ones(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = False
ALNUM = LETTERS.copy()
ALNUM[48:58] = False
#: Punctuation and blanks beyond ASCII.
PUNCTUATION = re.compile("[\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb-\u00bf\u2000-\u206f\u3000-\u3003\u3008-\u3011\uff01-\uff0f]")


def appended(docs: DataFrame, made: str, fn, only: bool = False, lower: bool = False) -> DataFrame:
    """docs with the columns made (a DDL string), which fn gives for each run of texts; no shuffle.

    fn(buf, at) returns a list of columns, one value for each text of the run. With only, made is one boolean that says
    which rows stay, and is not appended. Columns of docs that made names again are replaced.
    """
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(made)
    keep = docs.columns if only else [c for c in docs.columns if c not in fields.names]
    text = docs.columns.index("text")
    schema = docs.schema if only else StructType([docs.schema[c] for c in keep] + list(fields))
    at_columns = [docs.columns.index(c) for c in keep]

    def run(rows):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in rows:
            for lo, hi, buf, at in batches(batch.column(text), lower=lower):
                new = [pa.array(c, t) for c, t in zip(fn(buf, at), types)]
                part = batch.slice(lo, hi - lo)
                if only:
                    yield part.filter(new[0])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(i) for i in at_columns] + new, names=keep + fields.names)

    return docs.mapInArrow(run, schema)
