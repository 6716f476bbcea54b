"""Operator 9, toxicity by maximum-scoring segments.

Tokens are runs of letters, of any script, in lower case. From labelled documents each token gets the log-odds of toxic against clean text,
shrunk by one pseudo-token dealt by the two kinds' sizes. Tokens score these if they are large (FLOOR) and if a G-test of
their documents (how many toxic and how many clean ones have the token) reaches Z squared, the evidence of Z standard errors;
all others cost a little. The test needs no clean document with the token, and a token often repeated in one document counts
once. FLOOR keeps out common words that toxic documents have more often only because they are longer.

In a text, the linear-time scan of Ruzzo and Tompa finds all maximal segments. Segment scores of random text have an
extreme-value law: with lambda from the clean token frequencies and K counted on clean documents, a segment of score S in n
tokens has E = K n exp(-lambda S). A document's evidence is the sum over its segments of -ln(1 - exp(-E)), and a logistic
curve fitted on the labelled documents turns it into a score.

TRAIN_ROWS bounds the labelled rows that are used (those of smallest hash of doc_id) and LEXICON the tokens that score.

Defined cases: a null or empty text has no evidence and the score of such; with no label, or labels of one class, every
score is 0.5 or that class's share; several labels of one doc_id count as their maximum, null labels not at all; rows of
equal or null doc_id are scored each by their own text; ties among tokens go to the smaller key; a text of any length is
scored whole, in memory of its own size; an empty table gives an empty result; other columns stay as they are, but a column
named score is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRAIN_ROWS = 20_000
LEXICON = 50_000
Z = 4.0
FLOOR = 2.0
COST = 0.02
LIMIT = 0.7
MOST = 40.0
SUMS = ("bad", "good", "bad_docs", "good_docs")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def sample_of(labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """At most train_rows of (doc_id, toxic), none held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    return known.groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)


def segments(at: np.ndarray, value: np.ndarray, cost: float = COST) -> list[tuple[float, int, int]]:
    """All maximal segments (score, first token, last token) of a text in which token at[i] scores value[i] and every
    other token -cost; linear time, over the scoring tokens only."""
    out: list[list[float]] = []  # score's left and right running sums, first, last
    total, last = 0.0, -1
    for p, v in zip(at.tolist(), value.tolist()):
        total -= cost * (p - last - 1)
        last = p
        if v <= 0:
            total += v
            continue
        new = [total, total + v, p, p]
        total += v
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= new[0]:
                j = int(out[j][4])
            if j < 0 or out[j][1] >= new[1]:
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
        out.append([*new, j])
    return [(s[1] - s[0], int(s[2]), int(s[3])) for s in out]


class Model:
    def __init__(self, keys: np.ndarray, values: np.ndarray, rate: float = 1.0, k: float = 0.1, curve: tuple[float, float] = (0.0, 0.0)):
        self.keys, self.values, self.rate, self.k, self.curve = keys, values, rate, k, curve

    def passages(self, buf: bytes, at: np.ndarray):
        """For each text of a run: tokens, and its segments."""
        _, _, h, cut = common.word_rows(buf, at, common.LETTERS)
        if not len(self.keys):
            return [(int(b - a), []) for a, b in zip(cut[:-1], cut[1:])]
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[i] == h)
        value, ends = self.values[i[hit]], np.searchsorted(hit, cut)
        return [(int(cut[r + 1] - cut[r]), segments(hit[lo:hi] - cut[r], value[lo:hi]) if hi > lo else []) for r, (lo, hi) in enumerate(zip(ends[:-1], ends[1:]))]

    def evidence(self, n: int, found: list) -> float:
        total = 0.0
        for s, _, _ in found:
            e = self.k * max(n, 1) * math.exp(-self.rate * s)
            total += MOST if e < 1e-17 else -math.log(-math.expm1(-e))
        return min(total, MOST)

    def scores(self, buf: bytes, at: np.ndarray) -> list[np.ndarray]:
        x = np.array([self.evidence(*p) for p in self.passages(buf, at)])
        return [1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * x, -40, 40)))]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    scratch = common.Scratch(spark, "toxic")
    sample = scratch.keep(sample_of(labels, train_rows), "sample")  # train_rows rows at most, so that it can be broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = joined.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("_toxic").cast("int").alias("toxic"))  # rows of one id: one
    train = scratch.keep(one.select("text", "toxic").repartition(common.partitions(spark)), "train")

    def count(rows):
        for batch in rows:
            toxic = np.array(batch.column(1).to_pylist()) > 0
            for lo, hi, buf, at in common.batches(batch.column(0), lower=True):
                _, _, h, cut = common.word_rows(buf, at, common.LETTERS)
                keys, which = np.unique(h, return_inverse=True)
                mark = np.repeat(toxic[lo:hi], np.diff(cut))
                bad = np.bincount(which, mark, len(keys)).astype(np.int64)
                every = np.bincount(which, minlength=len(keys))
                text = np.repeat(np.arange(hi - lo), np.diff(cut))
                once = np.unique(which * (hi - lo) + text)  # each token once a text
                bad_docs = np.bincount(once // (hi - lo), toxic[lo:hi][once % (hi - lo)], len(keys)).astype(np.int64)
                all_docs = np.bincount(once // (hi - lo), minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(keys)), *map(pa.array, (bad, every - bad, bad_docs, all_docs - bad_docs))], ["key", *SUMS])

    kind = ", ".join(["key long", *(f"{x} long" for x in SUMS)])
    counts = scratch.keep(train.mapInArrow(count, kind).groupBy("key").agg(*(F.sum(x).alias(x) for x in SUMS)), "counts")
    bad, good = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    if not bad or not good:
        share = train.agg(F.avg("toxic")).first()[0]
        share = 0.5 if share is None else min(max(share, 0.01), 0.99)
        return Model(np.zeros(0, np.uint64), np.zeros(0), curve=(math.log(share / (1 - share)), 0.0))
    q = bad / (bad + good)  # one pseudo-token of either kind's share: a token of no evidence has value 0
    toxic_docs, clean_docs = train.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    found = counts.withColumn("value", F.log((F.col("bad") + q) / bad) - F.log((F.col("good") + 1 - q) / good)).withColumn("g", _evidence_of(toxic_docs, clean_docs))
    found = found.where((F.col("g") >= Z * Z) & (F.abs("value") >= FLOOR)).orderBy(F.col("g").desc(), "key").limit(LEXICON).select("key", "value", "good").collect()
    keys = np.array([r.key for r in found], np.int64).view(np.uint64)
    order = np.argsort(keys)
    values = np.array([r.value for r in found])[order]
    freq = np.array([r.good + 0.5 for r in found])[order] / (good + 1)
    model = Model(keys[order], values, _rate(values, freq))
    model.k, model.curve = _calibrate(train, model, good)
    return model


def _evidence_of(toxic_docs: int, clean_docs: int) -> Column:
    """G of the table of toxic and clean documents with a token and without it."""
    of, have = {"bad_docs": float(toxic_docs), "good_docs": float(clean_docs)}, F.col("bad_docs") + F.col("good_docs")
    total, g = toxic_docs + clean_docs, F.lit(0.0)
    for name, n in of.items():
        for seen, all_seen in ((F.col(name), have), (n - F.col(name), total - have)):
            g += F.when(seen > 0, 2 * seen * F.log(seen * total / (all_seen * n))).otherwise(0.0)
    return g


def _rate(values: np.ndarray, freq: np.ndarray) -> float:
    """The positive lambda with sum of frequency times exp(lambda times score) equal to 1."""
    rest = max(1 - freq.sum(), 0.0)
    mean = lambda x: freq @ np.exp(np.minimum(x * values, 700.0)) + rest * math.exp(-x * COST) if len(values) else 0.0
    lo, hi = 1e-4, 50.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
    return lo


def _calibrate(train: DataFrame, model: Model, good: int) -> tuple[float, tuple[float, float]]:
    """K, and the logistic curve from evidence to label; the rows are bounded by the sample."""
    level = 2.0 / model.rate

    def over(rows):
        for batch in rows:
            toxic = batch.column(1).to_pylist()
            for lo, hi, buf, at in common.batches(batch.column(0), lower=True):
                n = sum(x[0] >= level for t, (_, found) in zip(toxic[lo:hi], model.passages(buf, at)) if not t for x in found)
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    above = train.mapInArrow(over, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model.k = (above + 0.5) / (good * math.exp(-model.rate * level))

    def weigh(rows):
        for batch in rows:
            for lo, hi, buf, at in common.batches(batch.column(0), lower=True):
                x = [model.evidence(*p) for p in model.passages(buf, at)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(x, pa.float64())], ["toxic", "x"])

    rows = train.mapInArrow(weigh, "toxic int, x double").toArrow()  # two numbers for each row of the sample
    x, y = rows.column("x").to_numpy(), (rows.column("toxic").to_numpy() > 0).astype(float)
    a = b = 0.0
    for _ in range(50):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum() - 1e-2 * a, ((y - p) * x).sum() - 1e-2 * b])
        h = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        da, db = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + da, b + db
    return model.k, (float(a), max(float(b), 0.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score."""
    return common.appended(docs, "score double", model.scores, lower=True)


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(spark, docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under LIMIT."""
    common.small_batches(spark)
    model = fit(spark, docs, common.table(spark, sf_dir, "labels"))
    return common.appended(docs, "keep boolean", lambda buf, at: [model.scores(buf, at)[0] < LIMIT], only=True, lower=True)
