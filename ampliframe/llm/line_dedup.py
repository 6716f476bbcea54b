"""Operator 1, line dedup by a deletion-neighbourhood join.

Lines are the parts of a text between line feeds, without white space at their ends; lines without a word are left alone.
A line is dropped if an earlier line lies within one edit of a code point; lines of under near_length code points must be
equal for that (with near_length 0, one edit counts for lines of any length). The order of lines is that of (doc_id, hash
of the text, line number).

1. One pass over the texts hashes every line (128 bits) and its block keys, by running sums over whole batches; equal lines
   become one row with their first place.
2. If two lines are one edit apart, all of them but one of BLOCKS blocks agree. Every distinct line has the hashes of itself
   without each block; a line that shares none has no partner. The same with FINE blocks follows for those that do.
3. What is left emits its whole deletion neighbourhood: each line without one code point, with the place (lines that
   share it differ there at most) and without (to meet the shorter line itself). Only the earliest line of each key comes
   back to the others, so that no key's lines are paired with each other.
4. The edit distance of each line and its earliest neighbour is verified on the texts.

A document is known by (doc_id, hash of its text), so rows of equal or null doc_id are documents of their own; rows equal in
both are copies, of which one (any) keeps the lines and the others drop them all.

Defined cases: a null or empty text has no lines; null doc_id comes first in the order; ties are broken by the hash of the
text; a line or a text of any length is handled whole, in memory of its own size; an empty table gives an empty result; other
columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NEAR_LENGTH = 10
BLOCKS = 4
FINE = 32
NO_ID = -(1 << 63)
BITS = 1 << 23
PLACE = ["id", "h", "line_no"]
#: One match for each line with a word.
LINES = r"[^\x20\x09-\x0D][^\n]*"


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _hash() -> Column:
    return F.xxhash64("text")


_symbol = common.mix(np.arange(1 << 14, dtype=np.uint64) + np.uint64(0xC0DE))
_back: list[np.ndarray] = [common.mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)]


def _from_end(n: int) -> np.ndarray:
    if len(_back[0]) < n:
        _back[0] = common.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    return _back[0]


def signatures(texts: list[str], blocks: int) -> tuple[np.ndarray, ...]:
    """Of all lines with a word of texts: text, line number, length, the two halves of the hash, and block keys.

    A line's block keys are the hashes of it without each of its blocks, as the shorter of two lines and as the longer.
    Sums of code points' values, weighted by the place from the line's start and from its end, give every one of them.
    """
    texts = texts or [""]
    a = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin_of = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    feeds = np.flatnonzero(a == 10)
    starts, ends = np.concatenate([[0], feeds + 1]), np.append(feeds, len(a))
    text = np.searchsorted(begin_of, starts, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(starts, begin_of)[text]
    word = np.flatnonzero(~((a == 32) | ((a >= 9) & (a <= 13))))
    i, j = np.searchsorted(word, starts), np.searchsorted(word, ends)
    on = np.flatnonzero(i < j)
    text, number, begin = text[on], number[on], word[i[on]]
    n = word[j[on] - 1] + 1 - begin
    if not len(on):
        z = np.zeros(0, np.uint64)
        return text, number, n, z, z, np.zeros((0, 2 * blocks), np.uint64)
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    c = a[place + np.repeat(begin, n)]
    value = _symbol[np.minimum(c, len(_symbol) - 1)]
    far = np.flatnonzero(c >= len(_symbol) - 1)
    with np.errstate(over="ignore"):
        value[far] = common.mix(c[far].astype(np.uint64) + np.uint64(0xC0DE))
        longest = int(n.max())
        head, tail = np.zeros(len(c) + 1, np.uint64), np.zeros(len(c) + 1, np.uint64)
        np.cumsum(value * common._places(longest)[place], out=head[1:])
        np.cumsum(value * _from_end(longest)[np.repeat(n - 1, n) - place], out=tail[1:])
        size = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        one = common.mix(head[first + n] - head[first] + size)
        two = common.mix(tail[first + n] - tail[first] + size)
        keys = np.empty((len(n), 2 * blocks), np.uint64)
        for k, m in enumerate((n, n - 1)):
            for b in range(blocks):
                left, right = b * m // blocks, m - (b + 1) * m // blocks
                both = common.mix(head[first + left] - head[first]) + tail[first + n] - tail[first + n - right]
                keys[:, k * blocks + b] = common.mix(both + (m * blocks + b).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return text, number, n, one, two, keys


def _lists(keys: np.ndarray, near: np.ndarray) -> pa.Array:
    """Arrow lists of the rows of keys, empty where near is false."""
    offsets = np.concatenate([[0], np.cumsum(near * keys.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(common.signed(keys[near].ravel())))


def lines_of(docs: DataFrame, near_length: int = NEAR_LENGTH) -> DataFrame:
    """id, h, line_no, one, two, keys of all lines with a word."""
    names = [*PLACE, "one", "two", "keys"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in common.runs(batch.column(2)):
                texts = [x or "" for x in batch.column(2).slice(lo, hi - lo).to_pylist()]
                text, number, n, one, two, keys = signatures(texts, BLOCKS)
                columns = [pa.array(ids[lo + text]), pa.array(hashes[lo + text]), pa.array(number.astype(np.int32)), pa.array(common.signed(one)), pa.array(common.signed(two)), _lists(keys, n >= near_length)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(_id().alias("id"), _hash().alias("h"), "text").mapInArrow(run, "id long, h long, line_no int, one long, two long, keys array<long>")


def _partnered(keys: DataFrame) -> DataFrame:
    """one (the lines' first hash) of rows (one, key) whose key another line has, too."""
    many = keys.groupBy("key").agg(F.min("one").alias("lo"), F.max("one").alias("hi")).where("lo < hi").select("key")
    return keys.join(many, "key").select("one").distinct()


def _running(line: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Prefix sums that give the hash of the line with a run of code points left out: head[i] + tail[j]."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c)
    with np.errstate(over="ignore"):
        v = common.mix(c + np.uint64(0xC0DE))
        p = common._places(n + 1)
        head = np.zeros(n + 1, np.uint64)
        np.cumsum(v * p[:n], out=head[1:])
        # tail[i]: the code points from i on, each one place further to the front
        tail = np.zeros(n + 1, np.uint64)
        if n > 1:
            moved = v[1:] * p[: n - 1]
            tail[1:n] = np.cumsum(moved[::-1])[::-1]
    return head, tail, n


def neighbourhood(line: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of the line without each code point, with its place and without, and the key of the line itself."""
    head, tail, n = _running(line)
    with np.errstate(over="ignore"):
        bare = common.mix(head[:n] + tail[1:] + np.uint64(n - 1) * np.uint64(0x9E3779B97F4A7C15))
        placed = common.mix(bare + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        own = common.mix(head[n:] + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15))
    return placed, np.unique(bare), own


def _emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """role 0: the line itself, 1: without a code point, 2: the same with its place; id, h, line_no, one: of the line."""
    for batch in rows:
        for i in range(batch.num_rows):
            placed, bare, own = neighbourhood(batch.column(4)[i].as_py())
            key = np.concatenate([own, bare, placed])
            role = np.repeat(np.array([0, 1, 2], np.int32), [1, len(bare), len(placed)])
            same = np.zeros(len(key), np.int64)
            at = [pa.array(same + batch.column(k)[i].as_py()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([at[0], at[1], at[2].cast(pa.int32()), at[3], pa.array(role), pa.array(common.signed(key))], [*PLACE, "one", "role", "key"])


def near_lines(spark: SparkSession, docs: DataFrame, distinct: DataFrame, scratch: common.Scratch) -> DataFrame:
    """one, two of each distinct line with an earlier line within one edit."""
    coarse = distinct.select("one", F.explode("keys").alias("key"))
    some = scratch.keep(distinct.join(_partnered(coarse), "one", "left_semi").select("one", "two", *PLACE), "some")
    # their texts, from the lines that a bit table of fixed size names
    words = some.select(F.col("one").bitwiseAND(BITS - 1).alias("_at")).groupBy(F.shiftright("_at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("bits")).collect()
    table = np.zeros(BITS // 64, np.int64)
    for r in words:
        table[r.word] = r.bits
    sent = spark.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool))
    names, kind = [*PLACE, "one", "two", "line", "fine"], "id long, h long, line_no int, one long, two long, line string, fine array<long>"

    def pick(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = sent.value
        for batch in rows:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in common.runs(batch.column(2)):
                texts = [x or "" for x in batch.column(2).slice(lo, hi - lo).to_pylist()]
                text, number, _, one, two, _ = signatures(texts, 0)
                at = np.flatnonzero(on[one & np.uint64(BITS - 1)])
                parts, found = {}, []
                for t, k in zip(text[at].tolist(), number[at].tolist()):
                    if t not in parts:
                        parts = {t: texts[t].split("\n")}
                    found.append(parts[t][k].strip("\x20\x09\x0a\x0b\x0c\x0d"))
                _, _, _, _, _, fine = signatures(found, FINE)
                columns = [pa.array(ids[lo + text[at]]), pa.array(hashes[lo + text[at]]), pa.array(number[at].astype(np.int32)), *(pa.array(common.signed(x[at])) for x in (one, two))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), _lists(fine, np.ones(len(at), bool))], names)

    texts = docs.select(_id().alias("id"), _hash().alias("h"), "text").mapInArrow(pick, kind)
    texts = scratch.keep(texts.join(some, ["one", "two", *PLACE], "left_semi").dropDuplicates(["one", "two"]), "texts")
    last = scratch.keep(texts.drop("fine").join(_partnered(texts.select("one", F.explode("fine").alias("key"))), "one", "left_semi"), "last")
    keys = last.select(*PLACE, "one", "line").repartition(common.partitions(spark), "one").mapInArrow(_emit, "id long, h long, line_no int, one long, role int, key long")
    keys = scratch.keep(keys, "keys")
    place = F.struct(*PLACE, "one")
    first = keys.groupBy("key").agg(F.min(F.when(F.col("role") == 0, place)).alias("own"), F.min(F.when(F.col("role") == 1, place)).alias("less"), F.min(F.when(F.col("role") == 2, place)).alias("same"), F.count("*").alias("n")).where("n > 1")
    partner = F.when(F.col("role") == 0, F.col("less")).when(F.col("role") == 1, F.col("own")).otherwise(F.col("same"))
    best = keys.join(first, "key").withColumn("to", partner).where(F.struct(*(f"to.{x}" for x in PLACE)) < F.struct(*PLACE)).groupBy(*PLACE, "one").agg(F.min("to").alias("to"))
    other = last.select(*(F.col(x).alias(f"to_{x}") for x in (*PLACE, "one")), F.col("line").alias("to_line"))
    pairs = last.join(best.select(*PLACE, "one", *(F.col(f"to.{x}").alias(f"to_{x}") for x in (*PLACE, "one"))), [*PLACE, "one"]).join(other, [f"to_{x}" for x in (*PLACE, "one")])
    return pairs.where(F.levenshtein("line", "to_line", 1).between(0, 1)).select("one", "two")


def kept_lines(spark: SparkSession, docs: DataFrame, near_length: int = NEAR_LENGTH) -> DataFrame:
    """id, h, kept (line numbers), near (lines first seen there that an earlier line is near to), of documents where a line
    is first seen."""
    scratch = common.Scratch(spark, "lines")
    first = lines_of(docs, near_length).groupBy("one", "two").agg(F.min(F.struct(*PLACE, "keys")).alias("at"))
    distinct = scratch.keep(first.select("one", "two", *(F.col(f"at.{x}").alias(x) for x in (*PLACE, "keys"))), "distinct")
    near = scratch.keep(near_lines(spark, docs, distinct, scratch), "near").withColumn("near", F.lit(True))
    judged = distinct.select("one", "two", *PLACE).join(near, ["one", "two"], "left")
    return judged.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.when(F.col("near").isNull(), F.col("line_no")))).alias("kept"), F.count("near").alias("near"))


def _placed(docs: DataFrame, payload: list[str], kept: DataFrame) -> DataFrame:
    """payload of all rows with kept and near; of rows equal in doc_id and text one has them, the others null.

    Copies within a partition are told apart there and get a key that meets nothing, so that a row that fills a third of the
    table comes to the join once for each partition and not in bulk.
    """
    i, h, k = common.free(payload, "_id", "_h", "_k")
    rows = docs.withColumns({i: _id(), h: _hash()}).select(*(F.col(f"`{c}`") for c in payload), i, h)
    at = len(payload)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, n = set(), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, hashes = batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()
            for r, key in enumerate(zip(ids, hashes)):
                if key in seen:
                    hashes[r] = int(common.signed(common.mix(np.array([n + 1], np.uint64)))[0])
                    n += 1
                seen.add(key)
            yield pa.RecordBatch.from_arrays([*batch.columns[: at + 1], pa.array(hashes, pa.int64())], schema=batch.schema)

    rows = rows.mapInArrow(apart, rows.schema)
    found = kept.select(F.col("id").alias(i), F.col("h").alias(h), F.struct("kept", "near").alias(k))
    first = F.row_number().over(Window.partitionBy(i, h).orderBy(F.lit(0))) == 1
    return rows.join(found, [i, h], "left").withColumn(k, F.when(first, F.col(k))).select(*(F.col(f"`{c}`") for c in payload), F.col(k).alias("judged"))


def dedup(spark: SparkSession, docs: DataFrame, near_length: int = NEAR_LENGTH) -> DataFrame:
    """docs with the dropped lines cut out of their texts."""
    (row,) = common.free([], "row")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), F.col("doc_id"), "text")
    found = _placed(own, [row, "text"], kept_lines(spark, docs, near_length))
    cut = F.expr(r"array_join(filter(split(text, '\n'), (x, i) -> array_contains(_kept, i) or x rlike '^[\\x20\\x09-\\x0D]*$'), '\n')")
    out = found.withColumn("_kept", F.coalesce("judged.kept", F.array().cast("array<int>"))).withColumn("_new", F.when(F.col("text").isNotNull(), cut))
    return out.select(*(F.col("_new").alias(c) if c == "text" else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns))


def op1_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(LINES)).cast("long")
    out = _placed(docs.select("doc_id", "text", lines.alias("n_lines")), ["doc_id", "n_lines"], kept_lines(spark, docs))
    return out.select("doc_id", "n_lines", F.coalesce(F.size("judged.kept"), F.lit(0)).cast("long").alias("n_kept"), F.coalesce("judged.near", F.lit(0)).cast("long").alias("n_near"))


#: The same with plain deletion neighbourhoods of all distinct lines.
OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, regexp_replace(parts[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), d AS (
  SELECT line, min((doc_id, line_no)) AS seen FROM l WHERE line <> '' GROUP BY line
), v AS (
  SELECT line, seen, p, substr(line, 1, p - 1) || substr(line, p + 1) AS v
  FROM (SELECT line, seen, unnest(range(1, length(line) + 1)) AS p FROM d WHERE length(line) >= 10)
), k AS (
  SELECT DISTINCT md5(v || ':' || p) AS k, line, seen, 'same' AS role FROM v
  UNION ALL SELECT DISTINCT md5(v), line, seen, 'less' FROM v
  UNION ALL SELECT md5(line), line, seen, 'own' FROM d WHERE length(line) >= 10
), f AS (
  SELECT k, min(seen) FILTER (role = 'own') AS own, min(seen) FILTER (role = 'less') AS less, min(seen) FILTER (role = 'same') AS same FROM k GROUP BY k HAVING count(*) > 1
), n AS (
  SELECT DISTINCT line FROM k JOIN f USING (k) WHERE (role = 'own' AND less < seen) OR (role = 'less' AND own < seen) OR (role = 'same' AND same < seen)
), s AS (
  SELECT seen[1] AS doc_id, count(*) FILTER (n.line IS NULL) AS n_kept, count(n.line) AS n_near FROM d LEFT JOIN n USING (line) GROUP BY 1
)
SELECT a.doc_id, a.n_lines, coalesce(s.n_kept, 0) AS n_kept, coalesce(s.n_near, 0) AS n_near
FROM (SELECT doc_id, count(*) FILTER (line <> '') AS n_lines FROM l GROUP BY doc_id) a LEFT JOIN s USING (doc_id)
"""
