"""Operator 5, near-duplicates by bottom-k sketches of one hash function.

A document's set is that of its N-word shingles. Equal sets form one class. Of each class's set the SKETCH smallest hash
values are retained, and ordered by how rarely they are retained (by a hashed count table of fixed size). The rarest of them
go into inverted lists. Sets of at most WHOLE values, and all their possible partners, are held whole by their sketches: they
list as many as an exact prefix filter asks for, n - ceil(0.8 n) + 1, so that a value that many short texts share makes no
list, and a pair's places in a list bound its overlap. Larger sets list PREFIX values. Classes that meet in a list, with
sizes, places and marks that allow it, are candidates; the union's sketch estimates their Jaccard index, and the full sets
confirm it. A class's mark has a bit of 128 for each of its MARKED smallest values, so that lists needn't carry sketches.

No list is expanded into its pairs. First each list pairs its members with PIVOTS members alone, which links the copies of
a hot group to each other through a few. Then only pairs of a list whose members are still in different components are
tried: those of lists of up to LONG members directly, by numpy beyond SHORT; the members of longer ones, and of those of which
more than MANY pairs a member may be linked, by an exact prefix filter of their full sets, in which a passage that all of
them share is common and thus lists nothing. Lists of that which are long again are compared in blocks of bounded bytes, by
counting shared values. Full sets are several times the text, and the share of documents in a list of a given length grows
with the corpus, so LONG is far above what all but the commonest values reach.

For larger sets, the values that only one of two has are the rarest, so they come first in its prefix. At worst one set lies
in the other and has LEAST per cent of its size: then a fifth of the larger set's SKETCH values lack a partner, and prefixes
overlap in none only if PREFIX of them do, and marks in less than COMMON bits only if 20 of MARKED values do: once in
10 ** 6 at most (binomial tails). The estimate fails less often. README gives recall against exact links.

Full sets are made anew from the texts of those documents that need them, chosen by a bit table of fixed size, so that
texts are never shuffled. Joins on lists, pivots and component roots deal hot keys over several tasks.

Defined cases: a null or empty text, or one without words, has an empty set and no links; a null doc_id has no links, no
component and is kept; rows with equal doc_id are one node with the sets of all; all ties go to the smaller doc_id; a text
of any length is taken whole, in memory of its own size; an empty table gives an empty result. As a stage, rows and not ids
are nodes: rows of equal or null doc_id are judged by their own texts, of rows equal in doc_id and text one stays, rows without words all stay, and other
columns are carried along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .decontam import rolling, runs_within

SKETCH = 64
PREFIX = 32
MARKED = 32
COMMON = 12
PIVOTS = 2
LEAST = 80
ESTIMATE = 50
BUCKETS = 1 << 18
BITS = 1 << 23
SHORT = 64
LONG = 4096
MANY = 16
#: Pairs that carry their sketches through one shuffle.
SLICE = 1 << 22
#: Sets up to this size have partners of at most SKETCH values.
WHOLE = SKETCH * LEAST // 100
#: Values of members and of queries that one task compares.
BLOCK = 1 << 16
QUERIES = 1 << 18
FACTS = ["n", "b", "m0", "m1"]


def prefix_of(n: np.ndarray) -> np.ndarray:
    """How many of a set's n values, rarest first, must be listed so that no link is missed."""
    return n + (n * LEAST) // -100 + 1


def sets_of(buf: bytes, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's set, as ascending signed hashes of its distinct n-word shingles, or of all its words if these are fewer."""
    _, _, h, cut = common.word_rows(buf, at)
    inside = runs_within(cut, n, len(h))
    values = common.signed(rolling(h, n)[inside])
    ends = np.searchsorted(inside, cut)
    out = []
    for t, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
        size = cut[t + 1] - cut[t]
        if 0 < size < n:
            own = h[cut[t] : cut[t + 1]]
            out.append(common.signed(common.mix(rolling(own, len(own)) + np.uint64(len(own)))))
        else:
            out.append(np.unique(values[lo:hi]))
    return out


def sketches(docs: DataFrame, n: int, carry: str | None = None) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, its sketch, and the long column carry."""

    def run(rows):
        for batch in rows:
            for lo, hi, buf, at in common.batches(batch.column(1), common.SEGMENT // 4):
                sets = sets_of(buf, at, n)
                u = [s.view(np.uint64) for s in sets]
                one = np.array([x.sum(dtype=np.uint64) for x in u], np.uint64)
                two = np.array([common.mix(x ^ np.uint64(0xA5A5_5A5A_1234_4321)).sum(dtype=np.uint64) for x in u], np.uint64)
                least = [s[:SKETCH] for s in sets]
                offsets = np.cumsum([0, *map(len, least)]).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(least)))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(common.signed(one)), pa.array(common.signed(two)), sketch]
                yield pa.RecordBatch.from_arrays([*columns, *(c.slice(lo, hi - lo) for c in batch.columns[2:])], [f.split()[0] for f in kind.split(", ")])

    kind = "doc_id long, n_shingles long, one long, two long, sketch array<long>" + (f", {carry} long" if carry else "")
    return docs.select(F.col("doc_id").cast("long"), "text", *([carry] if carry else [])).mapInArrow(run, kind)


def _bits(spark: SparkSession, ids: DataFrame):
    """A bit table of BITS bits of the ids of one column, made by Spark: at most BITS / 64 rows come to the driver."""
    at = F.xxhash64(F.col(ids.columns[0])).bitwiseAND(BITS - 1)
    one = F.expr("shiftleft(1L, cast(_at & 63 as int))")
    with common.shuffles_dropped(spark):
        words = ids.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    table = np.zeros(BITS // 64, np.int64)
    for r in words:
        table[r.word] = r.bits
    return spark.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool))


def full_sets(spark: SparkSession, docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """doc_id and set of at least the documents in ids (one column)."""
    sent = _bits(spark, ids)

    def run(rows):
        for batch in rows:
            batch = batch.filter(pa.array(sent.value[batch.column(2).to_numpy()]))
            for lo, hi, buf, at in common.batches(batch.column(1), common.SEGMENT // 4):
                sets = sets_of(buf, at, n)
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["doc_id", "set"])

    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.select("doc_id", "text", F.xxhash64("doc_id").bitwiseAND(BITS - 1).alias("at")).mapInArrow(run, "doc_id long, set array<long>")


def _counts(spark: SparkSession, found: DataFrame):
    """Sums of n by bucket (bucket, n), as a table of fixed size for all tasks."""
    counts = np.zeros(BUCKETS, np.int64)
    with common.shuffles_dropped(spark):
        sums = found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows at most
    for b, c in sums:
        counts[b] = c
    return spark.sparkContext.broadcast(counts)


def _ranked(flat: np.ndarray, cut: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of lists flat[cut[i]:cut[i+1]], each list's rarest first: order, owner, place (from 1)."""
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    order = np.lexsort((flat, counts[flat & (BUCKETS - 1)], owner))
    return order, owner, np.arange(len(flat)) - cut[owner] + 1


def postings(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """v, rep, n, b, m0, m1: a row for each value that a class lists; b: the most that classes with v as their rarest common
    value can share, for sets held whole; m0, m1: the mark."""
    sent = _counts(spark, classes.select(F.explode("sketch").alias("v")).groupBy(F.col("v").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).agg(F.count("*").alias("n")))

    def run(rows):
        for batch in rows:
            reps, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sketch = batch.column(2)
            flat, cut = sketch.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sketch.value_lengths().to_numpy())])
            order, whose, place = _ranked(flat, cut, sent.value)
            listed = place <= np.where(sizes <= WHOLE, prefix_of(sizes), PREFIX)[whose]
            owner, v, bound = whose[listed], flat[order[listed]], sizes[whose[listed]] - place[listed] + 1
            # sketches are ascending, so that their high bits say little: bits of the middle of the first MARKED of each
            at, bit = np.flatnonzero(place <= MARKED), (flat.view(np.uint64) >> np.uint64(24)) & np.uint64(127)
            marks = []
            for half in (0, 1):
                mark = np.zeros(len(reps), np.uint64)
                on = (bit[at] >> np.uint64(6)) == half
                np.bitwise_or.at(mark, whose[at][on], np.uint64(1) << (bit[at][on] & np.uint64(63)))
                marks.append(pa.array(common.signed(mark[owner])))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(reps[owner]), pa.array(sizes[owner]), pa.array(bound), *marks], ["v", "rep", *FACTS])

    return classes.select("rep", "n", "sketch").mapInArrow(run, "v long, rep long, n long, b long, m0 long, m1 long")


def _places_allow(n: Column, m: Column, b: Column, c: Column) -> Column:
    """Sets of n and m values that can share b and c at most may be linked."""
    return (100 * F.least(n, m) >= LEAST * F.greatest(n, m)) & ((100 + LEAST) * F.least(b, c) >= LEAST * (n + m))


def _may_link(x, y) -> Column:
    """Sizes, places and marks (facts of two members, by name) allow the link; sets of less than MARKED values have no say by
    their marks, and those beyond their sketches none by their places."""
    n, m = x("n"), y("n")
    whole = F.greatest(n, m) <= SKETCH
    sizes = _places_allow(n, m, F.when(whole, x("b")).otherwise(n), F.when(whole, y("b")).otherwise(m))
    both = F.bit_count(x("m0").bitwiseAND(y("m0"))) + F.bit_count(x("m1").bitwiseAND(y("m1")))
    return sizes & ((F.least(n, m) < MARKED) | (both >= COMMON))


def _beside(pairs: DataFrame, values: DataFrame, name: str, to: tuple[str, str]) -> DataFrame:
    """pairs (a, b), a written table, with the column name of values (key, name) for a and for b."""
    sides = [values.select(F.col(values.columns[0]).alias(x), F.col(name).alias(y)) for x, y in zip("ab", to)]
    half = common.Salted(pairs, ["a"], ["b"]).join(sides[0])
    # the pairs of a hot b are those of a hot pivot, whose own values a pair need not carry
    return common.Salted(pairs, ["b"], ["a"]).join(sides[1], many=half)


def likely(classes: DataFrame, pairs: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """Of pairs (a, b), a written table, those whose union's sketch lets them pass, as a written table; SLICE pairs or so at a
    time, as each carries a sketch."""
    slices = max(-(-pairs.count() // SLICE), 1)
    done = None
    for k in range(slices):
        own = pairs if slices == 1 else pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k)
        part = scratch.keep(_likely(classes, own), f"{name}-{k}")
        done = part if done is None else done.union(part)
    return done


def _likely(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, SKETCH)
    passed = 100 * F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")) >= ESTIMATE * F.size("u")
    sent = _bits(classes.sparkSession, pairs.select("a").union(pairs.select("b")))

    def run(rows):  # only sketches that pairs may need are shuffled
        for batch in rows:
            yield batch.select(["rep", "sketch"]).filter(pa.array(sent.value[batch.column(2).to_numpy()]))

    some = classes.select("rep", "sketch", F.xxhash64("rep").bitwiseAND(BITS - 1).alias("at")).mapInArrow(run, "rep long, sketch array<long>")
    return _beside(pairs, some, "sketch", ("sa", "sb")).withColumn("u", union).where(passed).select("a", "b").distinct()


def linked(i, x, y):
    """Whether sets of x and y members with i in common are linked; columns or arrays."""
    return (100 * i >= LEAST * (x + y - i)) & (i > 0)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), a written table, those that the full sets confirm."""
    both = _beside(pairs, sets.select("doc_id", "set"), "set", ("x", "y")).withColumn("i", F.size(F.array_intersect("x", "y")))
    return both.where(linked(F.col("i"), F.size("x"), F.size("y"))).select("a", "b").distinct()


def group_links(table: pa.Table) -> pa.Table:
    """Links between the queries and the members of one block of a hot group, counted through the block's own inverted lists.

    Columns: query (boolean), rep, root, set. Of the links of two roots one is given, and none that others imply, so that
    there are less of them than roots. The work is that of the values which members share.
    """
    query = table.column("query").to_numpy(zero_copy_only=False)
    rep = table.column("rep").to_numpy()
    root = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
    sets = table.column("set").combine_chunks()
    flat, cut = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
    base = np.flatnonzero(~query)
    own = np.concatenate([flat[cut[i] : cut[i + 1]] for i in base]) if len(base) else flat[:0]
    sizes = (cut[1:] - cut[:-1])[base]
    owner = np.repeat(np.arange(len(base)), sizes)
    order = np.argsort(own, kind="stable")
    values, first = np.unique(own[order], return_index=True)
    first, owner = np.append(first, len(own)), owner[order]
    a, b = [], []
    for q in np.flatnonzero(query):
        if not len(values) or (root[base] == root[q]).all():
            continue
        mine = flat[cut[q] : cut[q + 1]]
        k = np.minimum(np.searchsorted(values, mine), len(values) - 1)
        k = k[values[k] == mine]
        lo, many = first[k], first[k + 1] - first[k]
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        shared = np.bincount(owner[at], minlength=len(base))
        hit = base[linked(shared, len(mine), sizes) & (root[base] != root[q])]
        for h in hit:
            if root[h] != root[q]:
                a.append(min(int(rep[h]), int(rep[q])))
                b.append(max(int(rep[h]), int(rep[q])))
                root[root == root[h]] = root[q]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def hot_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members of different roots in groups (g, rep, root, n), without making pairs into rows.

    A group is dealt in blocks of about BLOCK values of members by about QUERIES values of those outside its main root g.
    """
    outside = F.sum(F.when(F.col("root") != F.col("g"), F.col("n")).otherwise(0))
    size = groups.groupBy("g").agg(F.count("*").alias("_rows"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.ceil((outside + 1) / QUERIES).cast("int").alias("cuts"))
    all_rows = common.Salted(groups, ["g"], ["rep"], size.select("g", "_rows")).join(size.drop("_rows"))
    block, cut = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("cuts")).cast("int")
    members = all_rows.withColumn("block", block).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("query", F.lit(False))
    queries = all_rows.where("root != g").withColumn("cut", cut).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(True))
    cols = ["g", "block", "cut", "query", "rep", "root"]
    dealt = members.select(cols).union(queries.select(cols)).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    return dealt.groupBy("g", "block", "cut").applyInArrow(group_links, "a long, b long").distinct()


def _split(listed: DataFrame, hot: common.Salted | None = None) -> DataFrame:
    """listed (v, root, ...) of lists with more than one root, with every (members) and g (the root of most)."""
    size = listed.groupBy("v", "root").agg(F.count("*").alias("n"))
    some = size.groupBy("v").agg(F.sum("n").alias("every"), F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("g")).where("roots > 1").drop("roots")
    return (hot or common.Salted(listed, ["v"], ["rep"])).join(some, many=listed)


def _pairs(listed: DataFrame, allowed) -> DataFrame:
    """a, b of lists' members of different roots that allowed lets pass; lists are short, so that one shuffle brings each
    together, and pairs that don't pass never become rows."""
    lists = listed.groupBy("v").agg(F.collect_list(F.struct(*(c for c in listed.columns if c != "v"))).alias("l"))

    def met(x: Column) -> Column:
        others = F.filter("l", lambda y: (x["root"] < y["root"]) & allowed(lambda c: x[c], lambda c: y[c]))
        return F.transform(others, lambda y: F.struct(F.least(x["rep"], y["rep"]).alias("a"), F.greatest(x["rep"], y["rep"]).alias("b")))

    return lists.select(F.explode(F.flatten(F.transform("l", met))).alias("p")).select("p.a", "p.b").distinct()


def list_pairs(table: pa.Table) -> pa.Table:
    """a, b, hot: as _pairs with _may_link, for one list (rep, root, n, b, m0, m1). Of a list with more than MANY such pairs a
    member, rep and root of its members in place of pairs, as hot."""
    order = np.argsort(table.column("n").to_numpy(), kind="stable")
    rep, root, n, b = (table.column(c).to_numpy()[order] for c in ("rep", "root", "n", "b"))
    m0, m1 = (table.column(c).to_numpy().view(np.uint64)[order] for c in ("m0", "m1"))
    ends = np.searchsorted(n, 100 * n // LEAST, "right")
    found, total = [], 0
    for lo in range(0, len(rep), SHORT):
        x, y = slice(lo, min(lo + SHORT, len(rep))), slice(lo, int(ends[min(lo + SHORT, len(rep)) - 1]))
        i, j = np.arange(x.start, x.stop)[:, None], np.arange(y.start, y.stop)[None, :]
        may = (i < j) & (root[x, None] != root[None, y]) & (100 * n[x, None] >= LEAST * n[None, y])
        i, j = np.nonzero(may)
        i, j = i + lo, j + lo
        whole = n[j] <= SKETCH
        may = (100 + LEAST) * np.minimum(np.where(whole, b[i], n[i]), np.where(whole, b[j], n[j])) >= LEAST * (n[i] + n[j])
        may &= (n[i] < MARKED) | (np.bitwise_count(m0[i] & m0[j]).astype(np.int64) + np.bitwise_count(m1[i] & m1[j]) >= COMMON)
        found.append((rep[i[may]], rep[j[may]]))
        total += int(may.sum())
        if total > MANY * len(rep):
            return pa.table({"a": rep, "b": root, "hot": np.ones(len(rep), bool)})
    one, two = (np.concatenate(c) for c in zip(*found))
    return pa.table({"a": np.minimum(one, two), "b": np.maximum(one, two), "hot": np.zeros(len(one), bool)})


def prefix_links(spark: SparkSession, members: DataFrame, sets: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Links (a, b) between members (rep, root) of different roots, by an exact prefix filter of their full sets."""
    held = scratch.keep(members.join(sets.withColumnRenamed("doc_id", "rep"), "rep"), "held")

    def count(rows):
        total = np.zeros(BUCKETS, np.int64)
        for batch in rows:
            total += np.bincount(batch.column(0).flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sent = _counts(spark, held.select("set").mapInArrow(count, "bucket int, n long"))

    def run(rows):
        for batch in rows:
            rep, root, flat = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy()
            cut = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            n = np.diff(cut)
            order, owner, place = _ranked(flat, cut, sent.value)
            on = place <= prefix_of(n)[owner]
            owner = owner[on]
            yield pa.RecordBatch.from_arrays([pa.array(flat[order[on]]), pa.array(rep[owner]), pa.array(root[owner]), pa.array(n[owner]), pa.array(n[owner] - place[on] + 1)], ["v", "rep", "root", "n", "b"])

    listed = scratch.keep(held.select("rep", "root", "set").mapInArrow(run, "v long, rep long, root long, n long, b long"), "listed")
    split = scratch.keep(_split(listed), "split")
    pairs = scratch.keep(_pairs(split.where(F.col("every") <= SHORT).drop("every", "g"), lambda x, y: _places_allow(x("n"), y("n"), x("b"), y("b"))), "hot-pairs")
    # long lists of one main root are mostly of the same members: one group
    groups = scratch.keep(split.where(F.col("every") > SHORT).select("g", "rep", "root", "n").distinct(), "groups")
    return confirmed(pairs, sets).union(hot_links(groups, sets)).distinct()


def components(edges: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """node, root: for each node of edges (a, b) the smallest node that it reaches.

    Every node takes the smallest label among its own and its neighbours' and then its label's label, until none changes.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
    both = scratch.keep(both, f"{name}-both")
    labels = scratch.keep(both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("root")), f"{name}-0")
    ends, k = common.Salted(both, ["to"], ["node"]), 0
    while True:
        k += 1
        near = ends.join(labels.select(F.col("node").alias("to"), "root")).groupBy("node").agg(F.min("root").alias("near"))
        new = scratch.keep(labels.join(near, "node").select("node", F.least("root", "near").alias("near"), F.col("root").alias("old")), f"{name}-{k}-near")
        jump = common.Salted(new, ["near"], ["node"]).join(labels.select(F.col("node").alias("near"), F.col("root").alias("far")), "left")
        new = scratch.keep(jump.select("node", F.least("near", "far").alias("root"), (F.least("near", "far") < F.col("old")).alias("moved")), f"{name}-{k}")
        changed = new.where("moved").limit(1).count()
        labels = new.drop("moved")
        scratch.drop(f"{name}-{k - 1}")
        scratch.drop(f"{name}-{k}-near")
        if not changed:
            return labels


def link(spark: SparkSession, docs: DataFrame, n: int = 5, carry: str | None = None, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document, and the long column carry."""
    common.small_batches(spark)
    scratch = scratch or common.Scratch(spark, "near")
    rows = scratch.keep(sketches(docs, n, carry), "sketches")
    known = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    key = [F.col("one"), F.col("two"), F.col("n_shingles").alias("n")]
    classes = scratch.keep(known.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.count("*").alias("_rows")), "classes")
    rows = scratch.keep(rows.drop("sketch"), "rows")  # classes have the sketches
    scratch.drop("sketches")
    listed = scratch.keep(postings(spark, classes), "postings")
    shared = listed.groupBy("v").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("_rows")).where("lo < hi")
    shared = scratch.keep(shared.select("v", "_rows"), "shared")
    hot = common.Salted(listed, ["v"], ["rep"], shared)
    active = scratch.keep(hot.join(shared.select("v")), "active")
    scratch.drop("postings")

    # 1: each list's members with PIVOTS of them: the smallest, and those of smallest hash
    order = [F.col("rep"), *(F.xxhash64("rep", F.lit(k)) for k in range(1, PIVOTS))]
    me = F.struct("rep", *FACTS)
    picked = active.groupBy("v").agg(*(F.min_by(me, o).alias(f"p{k}") for k, o in enumerate(order)))
    pivots = picked.select("v", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("p"))
    pivots = pivots.select("v", F.col("p.rep").alias("rep2"), *(F.col(f"p.{c}").alias(f"{c}2") for c in FACTS))
    star = hot.join(pivots, many=active).where((F.col("rep") != F.col("rep2")) & _may_link(F.col, lambda c: F.col(f"{c}2")))
    star = scratch.keep(star.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct(), "met")
    star = likely(classes, star, scratch, "star")
    sets = scratch.keep(full_sets(spark, docs, star.select("a").union(star.select("b")), n), "star-sets")
    links = scratch.keep(confirmed(star, sets), "star-links")
    scratch.drop("star-sets")
    roots = components(links, scratch, "first")

    # 2: of each list's members in different components, those pairs that are left
    placed = active.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    placed = scratch.keep(_split(placed, hot), "placed")
    longer = placed.where((F.col("every") > SHORT) & (F.col("every") <= LONG)).select("v", "rep", "root", *FACTS)
    longer = scratch.keep(longer.groupBy("v").applyInArrow(list_pairs, "a long, b long, hot boolean"), "longer")
    rest = _pairs(placed.where(F.col("every") <= SHORT).drop("every", "g"), _may_link).union(longer.where("NOT hot").drop("hot"))
    rest = scratch.keep(rest.distinct().join(star, ["a", "b"], "left_anti"), "left")
    rest = likely(classes, rest, scratch, "rest")
    members = placed.where(F.col("every") > LONG).select("rep", "root").union(longer.where("hot").select(F.col("a").alias("rep"), F.col("b").alias("root")))
    members = scratch.keep(members.distinct(), "members")
    sets = scratch.keep(full_sets(spark, docs, rest.select("a").union(rest.select("b")).union(members.select("rep")), n), "rest-sets")
    more = scratch.keep(confirmed(rest, sets).union(prefix_links(spark, members, sets, scratch)), "more")
    scratch.drop("rest-sets", "held", "listed", "split", "hot-pairs", "groups", "active", "placed", "met", "left", "longer", "members")
    roots = components(links.union(more), scratch, "last")

    scratch.drop("first-both", "last-both")
    rooted = classes.select("one", "two", F.col("n").alias("n_shingles"), "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("one", "two", "n_shingles", F.coalesce("root", "rep").alias("root"))
    out = common.Salted(rows, ["one", "two", "n_shingles"], ["doc_id"], classes.select("one", "two", F.col("n").alias("n_shingles"), "_rows")).join(rooted, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), *([carry] if carry else []))


def op5_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark, common.table(spark, sf_dir, "documents"), n=2)


def keep_one(spark: SparkSession, docs: DataFrame, n: int = 5) -> DataFrame:
    """One document of each component: that of the smallest doc_id (null last), or of the smallest hash among such.

    A row with words is known by the hash of its doc_id and text; of rows equal in these one is left. Others all stay.
    """
    scratch = common.Scratch(spark, "one")
    (key,) = common.free(docs.columns, "_key")
    named = docs.withColumn(key, F.when(F.col("text").rlike(common.WORD), F.xxhash64("doc_id", "text")))
    found = scratch.keep(link(spark, named.select(F.col(key).alias("doc_id"), "text", F.col("doc_id").cast("long").alias("name")), n, "name").where("component_id IS NOT NULL"), "linked")
    by = F.struct(F.col("name").isNull(), "name", "doc_id")
    first = found.groupBy("component_id").agg(F.min(by).alias("first"), F.count("*").alias("n")).where("n > 1").select("component_id", F.col("first.doc_id").alias("first"))
    judged = common.Salted(found.select("component_id", "doc_id"), ["component_id"], ["doc_id"]).join(first)
    dropped = scratch.keep(judged.where(F.col("doc_id") != F.col("first")).select(F.col("doc_id").alias(key)).distinct(), "dropped")
    repeated = scratch.keep(found.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key), "repeated")
    if repeated.limit(1).count():
        thin = common.once_each(named, key)
        some, (k,) = thin.join(repeated, key, "left_semi"), common.free(named.columns, "_k")
        some = some.withColumn(k, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))).where(F.col(k) == 1).drop(k)
        named = thin.join(repeated, key, "left_anti").unionByName(some)
    return named.join(dropped, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return keep_one(spark, docs)


#: All shared shingles counted, and components by closure.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (min(na.n) + min(nb.n) - count(*))
), c AS (
  SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x
), m AS (
  SELECT x, min(y) AS y FROM c GROUP BY x
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m.y, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.x = w.doc_id
"""
