"""Operator 6, quality rules: one Spark projection made from a table of thresholds, without user functions.

METRICS names the measures of a text; RULES bounds them. Both are expressions over one row, so a text is judged where it
is read, with no shuffle; rules can be changed or added as data.

Defined cases: a null text is an empty one; an empty text has no words and fails the base; ratios with an empty
denominator are 0; texts of any length are judged whole, repeated windows being found by sorting their hashes; each row
is judged for itself, so repeated rows, ties and null or equal doc_id change nothing; an empty table gives an empty result;
other columns are carried along, whatever their names, but those that this operator adds replace columns of the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Frequent short words of the four languages of the corpus; fixed values.
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "le", "la", "les", "de", "et", "des", "que", "en", "der", "die", "und", "das", "von", "zu", "el", "los", "las", "y", "un", "se")
#: measure, least, most; a text is kept if every measure lies within. None: no bound.
RULES = (
    ("mean_word_length", 2.0, 20.0),
    ("symbol_ratio", None, 0.05),
    ("same_word_ratio", None, 0.3),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
)


def _base(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, common.BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    return docs.select(common.row_of(docs.columns).alias("row"), text.alias("_text"), words.alias("_w"), lines.alias("_l")).withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate("_text", BLANKS, "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "_lines": F.size("_l"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_same": F.size(F.filter("_w", lambda w, i: (w == F.get("_w", i - 1)).eqNullSafe(True))),
        "_stops": F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))),
        "_h": F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - WINDOW + 1, F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get("_w", i + k) for k in range(1, WINDOW)))),
    })


def _repeat_words() -> Column:
    """Words in windows found twice or more: sort (hash, place), keep places whose neighbour has their hash, add spans."""
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def found(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
        step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["to"], i)).alias("n"), (i + WINDOW).alias("to"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    # a lambda binds the sorted pairs once
    once = F.element_at(F.transform(F.array(pairs), found), 1)
    return F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0)).otherwise(once).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the measures that RULES names."""
    d = _base(docs).withColumn("n_repeat_words", _repeat_words())
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    d = d.withColumns({
        "mean_word_length": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "word_chars"),
        # one more stop word than there are, so that a short text is not judged by their absence
        "stop_word_ratio": F.when(F.col("n_words") > 0, (F.col("_stops") + 1) / F.col("n_words")).otherwise(F.lit(0.0)),
        "same_word_ratio": ratio("_same", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "_lines"),
    })
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_length", "symbol_ratio", "stop_word_ratio", "same_word_ratio", "dup_line_ratio"]
    return d.select(*common.unpacked("row", [c for c in docs.columns if c not in added]), *added)


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression."""
    bounds = [F.col(m) >= low for m, low, _ in rules if low is not None] + [F.col(m) <= high for m, _, high in rules if high is not None]
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measure(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(m for m, _, _ in RULES))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), g AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
), x AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g
), p AS (
  SELECT r, count(DISTINCT i + k) AS n FROM x, (SELECT unnest(range(0, 5)) AS k) WHERE x.n > 1 GROUP BY r
), m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(l) AS lines,
    len(list_filter(w, lambda x: lower(x) IN (STOPS))) AS stops, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS same
  FROM w LEFT JOIN p USING (r)
), q AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_length, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN same / n_words ELSE 0.0 END AS same_word_ratio, CASE WHEN n_words > 0 THEN (stops + 1) / n_words ELSE 0.0 END AS stop_word_ratio,
    CASE WHEN lines > 0 THEN n_dup_lines / lines ELSE 0.0 END AS dup_line_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND RULES AS kept,
  mean_word_length::DOUBLE AS mean_word_length, symbol_ratio::DOUBLE AS symbol_ratio, same_word_ratio::DOUBLE AS same_word_ratio, stop_word_ratio::DOUBLE AS stop_word_ratio, dup_line_ratio::DOUBLE AS dup_line_ratio
FROM q
""".replace("STOPS", ", ".join(f"'{w}'" for w in STOP_WORDS)).replace("RULES", " AND ".join([f"{m} >= {a}" for m, a, _ in RULES if a is not None] + [f"{m} <= {b}" for m, _, b in RULES if b is not None]))
