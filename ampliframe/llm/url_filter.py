"""Operator 3, a URL filter of gradient-boosted trees on lexical features; native.

Rules (host, path, verdict) judge the URLs that they fit. The trees are trained on those URLs, labelled by their rule's
verdict, and judge the rest. Trees are grown by histograms: a feature takes a few binned values, and one aggregation for
each level gives every node's gradient sums by feature and bin, a table whose size is that of the model and not of the
data; the driver picks the splits. The finished trees are one SQL expression.

Of a URL's names (the host's suffix, the path's first part and its ending) the labelled sample gives statistics: how many
labelled URLs have the name, and their smoothed share of block; a name that it lacks has the sample's share. A URL of the
sample has the statistics of the others' half, so that its own label is not among its features. Numeric features are binned
by their quantiles in the sample, and splits are written as their bounds.

TRAIN_ROWS bounds the labelled sample (the rows of smallest hash of page_id, of labelled URLs only); every URL is scored.
With no labelled URL or one class alone, the verdict is that of the class, or allow.

Defined cases: a null URL, or one without ://, has an empty host and path and is judged by the trees like any other; a URL of
any length is judged whole; rows with equal or null page_id keep a row each; equal URLs have equal scores, and ties among
splits go to the first feature and the lowest bound; an empty table gives an empty result; columns other than page_id and url
are left out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: host, path, verdict
RULES = (("com", "en/", "block"), ("example.com", "en/7", "allow"), ("net", "de/", "allow"), ("example.net", "de/8", "block"), ("org", "es/", "block"))
TRAIN_ROWS = 20_000
TREES = 10
DEPTH = 4
RATE = 0.4
L2 = 1.0
BINS = 16
#: Labelled URLs' worth of the sample's share that a name's share is smoothed with.
SMOOTH = 5.0


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host with ASCII letters lower-cased, and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(F.col(url), F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)([^?#]*)", 0)
    host = F.regexp_extract(rest, r"(?s)^[^/]*", 0)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host/path, and its verdict; null where none does."""
    table = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("v")) for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1]))))
    fits = lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, F.concat(F.lit("/"), r["p"]))
    best = F.try_element_at(F.filter(table, fits), F.lit(-1)) if rules else F.lit(None).cast("struct<h string, p string, v string>")
    return F.concat(best["h"], F.lit("/"), best["p"]), best["v"]


def features(url: Column) -> dict[str, Column]:
    """Lexical features as numbers."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    chars = F.split(F.lower(u), "")
    counted = F.transform(F.array_distinct(chars), lambda c: F.length(u) - F.length(F.replace(F.lower(u), c, F.lit(""))))
    entropy = F.aggregate(F.filter(counted, lambda k: k > 0), F.lit(0.0), lambda s, k: s - k / n * F.log2(k / n))
    host, path = F.regexp_extract(u, r"://([^/?#]*)", 1), F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1)
    count = lambda pattern, of=u: F.length(of) - F.length(F.regexp_replace(of, pattern, ""))
    raw = {
        "length": F.length(u), "host_length": F.length(host), "depth": count("/", path), "dots": count(r"\.", host), "hyphens": count("-", host),
        "digit_ratio": count("[0-9]") / n, "entropy": F.round(entropy, 6), "parameters": F.when(F.contains(u, F.lit("?")), count("&") + 1).otherwise(0), "fragment": count("#"),
    }
    return {k: v.cast("double") for k, v in raw.items()}


def names(url: Column) -> dict[str, Column]:
    """Parts of a URL that have statistics."""
    u = F.coalesce(url, F.lit(""))
    host, path = F.lower(F.regexp_extract(u, r"://([^/?#]*)", 1)), F.lower(F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1))
    return {"suffix": F.regexp_extract(host, r"([^.]*)$", 1), "section": F.regexp_extract(path, r"^/([^/]*)", 1), "ending": F.regexp_extract(path, r"(\.[a-z0-9]{1,5}|/)$", 1)}


STATED = ("suffix", "section", "ending")


def statistics(sample: DataFrame, name: str) -> DataFrame:
    """name, fold, seen and blocked: labelled URLs with a name, in either half of the sample and (fold null) in all; TRAIN_ROWS
    names at most."""
    found = sample.groupBy(name, "_fold").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    other = found.select(name, (1 - F.col("_fold")).alias("_fold"), "n", "ones")  # what a row of one half may know
    every = found.groupBy(name).agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).select(name, F.lit(-1).alias("_fold"), "n", "ones")
    return other.unionByName(every)


def stated(rows: DataFrame, tables: dict[str, DataFrame], share: float) -> DataFrame:
    """rows (the names, _fold) with two features of each name."""
    for name, found in tables.items():
        rows = rows.join(F.broadcast(found), [name, "_fold"], "left").withColumns({
            f"{name}_share": (F.coalesce("ones", F.lit(0)) + SMOOTH * share) / (F.coalesce("n", F.lit(0)) + SMOOTH), f"{name}_seen": F.log2(F.coalesce("n", F.lit(0)) + 1.0),
        }).drop("n", "ones")
    return rows


def _goes_left(feature: str, at: float) -> Column:
    return F.col(feature) <= F.lit(at)


def _leaf(tree: dict, node: int, value) -> Column:
    if node not in tree:
        return value(node)
    feature, at = tree[node]
    return F.when(_goes_left(feature, at), _leaf(tree, 2 * node, value)).otherwise(_leaf(tree, 2 * node + 1, value))


def bounds(labelled: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """The distinct quantiles of each feature, but for its largest value: a row for all."""
    steps = [k / BINS for k in range(1, BINS)]
    found = labelled.agg(*(F.percentile_approx(x, steps, 10_000).alias(x) for x in features), *(F.max(x).alias(f"{x}_most") for x in features)).first()
    return {x: sorted({v for v in found[x] or [] if v < found[f"{x}_most"]}) for x in features}


def train(labelled: DataFrame, features: list[str], scratch: common.Scratch) -> tuple[float, list]:
    """Base score and trees [(splits, leaf values)] from a bounded table of features and label 0/1 (1: block)."""
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n or ones in (0, n):
        return (9.0 if ones else -9.0), []
    at = bounds(labelled, features)
    under = lambda x: F.size(F.filter(F.array(*map(F.lit, at[x])).cast("array<double>"), lambda e: e < F.col(x)))
    bins = [under(x).alias(f"bin_{x}") for x in features]
    # equal rows are one row with a weight: the lexical bins repeat a lot
    data = scratch.keep(labelled.select(*features, *bins, "label").groupBy(*features, *(f"bin_{x}" for x in features), "label").agg(F.count("*").cast("double").alias("weight")), "train")
    base, trees = math.log(ones / (n - ones)), []
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-score(base, trees)))
        rows = data.withColumns({"_g": F.col("weight") * (F.col("label") - p), "_h": F.col("weight") * p * (1 - p)})
        splits: dict[int, tuple[str, float]] = {}
        sums: dict[int, tuple[float, float]] = {}
        for level in range(DEPTH):
            node = _leaf(splits, 1, lambda k: F.lit(k))
            each = F.posexplode(F.array(*(f"bin_{x}" for x in features))).alias("_f", "_b")
            found = rows.select(node.alias("_node"), "_g", "_h", each).groupBy("_node", "_f", "_b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect()
            best: dict[int, tuple[float, str, float]] = {}
            by: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
            for r in found:  # at most nodes x features x BINS rows
                by.setdefault((r._node, r._f), {})[r._b] = (r.g, r.h)
            for (k, f), hist in sorted(by.items()):
                all_g, all_h = (sum(v[i] for _, v in sorted(hist.items())) for i in (0, 1))
                sums[k] = (all_g, all_h)
                run_g = run_h = 0.0
                for b, (g, h) in sorted(hist.items())[:-1]:
                    run_g, run_h = run_g + g, run_h + h
                    rest = all_h - run_h
                    if run_h > 1e-6 and rest > 1e-6:
                        gain = run_g**2 / (run_h + L2) + (all_g - run_g) ** 2 / (rest + L2) - all_g**2 / (all_h + L2)
                        if gain > best.get(k, (1e-6,))[0] + 1e-9:
                            best[k] = (gain, features[f], at[features[f]][b])
                            sums[2 * k], sums[2 * k + 1] = (run_g, run_h), (all_g - run_g, rest)
            new = {k: (f, b) for k, (_, f, b) in best.items() if k >= 1 << level}
            if not new:
                break
            splits |= new
        trees.append((splits, {k: RATE * g / (h + L2) for k, (g, h) in sums.items() if k not in splits}))
    return base, trees


def score(base: float, trees: list) -> Column:
    """The log-odds of block, from feature columns."""
    return reduce(lambda a, t: a + _leaf(t[0], 1, lambda k: F.lit(float(t[1].get(k, 0.0)))), trees, F.lit(float(base)))


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every page."""
    host, path = parts()
    scratch = common.Scratch(spark, "urls")
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("_ruled"))
    made, own = features(F.col("url")), names(F.col("url"))
    sample = rows.where(F.col("rule").isNotNull()).orderBy(F.xxhash64("page_id"), "url").limit(train_rows)
    fold = F.pmod(F.xxhash64("page_id", "url", F.lit("fold")), F.lit(2)).cast("int")
    sample = scratch.keep(sample.select(*(v.alias(k) for k, v in (made | own).items()), (F.col("_ruled") == "block").cast("int").alias("label"), fold.alias("_fold")), "sample")
    share = sample.agg(F.avg("label")).first()[0] or 0.0
    tables = {x: scratch.keep(statistics(sample, x), f"names-{x}") for x in STATED}
    every = [*made, *(f"{x}_{y}" for x in STATED for y in ("share", "seen"))]
    base, trees = train(stated(sample, tables, share).select(*every, "label"), every, scratch)
    used = {f for splits, _ in trees for f, _ in splits.values()}  # no other feature is computed
    scored = rows.select("page_id", "host", "path", "rule", "_ruled", *(v.alias(k) for k, v in made.items() if k in used), *(v.alias(k) for k, v in own.items()), F.lit(-1).alias("_fold"))
    scored = stated(scored, {k: v for k, v in tables.items() if {f"{k}_share", f"{k}_seen"} & used}, share)
    chance = 1 / (1 + F.exp(-score(base, trees)))
    scored = scored.select("page_id", "host", "path", "rule", "_ruled", chance.alias("block_score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")


def op3_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, common.table(spark, sf_dir, "pages"))
