"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing and sharding, each a table that is written and read again.

Every stage works on all rows that the one before kept, and all but the last return the columns of documents. Defined cases:
null or empty texts are clean, have no duplicates, leak nothing and are mixed with size 0 (so they are taken as often as
their hash says); rows of equal or null doc_id are judged each by their own text, and of rows equal in doc_id and text one
stays; ties go to the smaller doc_id; texts of any length are handled whole; empty tables give empty results; other columns
are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ampliframe.llm import common, decontam, minhash, mixing, sharding, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_dedup", minhash.stage),
    ("decontamination", decontam.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: The stages fit models and sketch sets, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scratch = common.Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
