"""The corpus pipeline: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return documents
with the columns that they came with, whatever their names. Stages decide by row: a row's doc_id may be null, or stand for
several rows. An empty table gives an empty table at every stage; what else odd rows come to is said at each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookline.llm import exact_dedup, mixing, packing, quality, simhash
from brookline.llm.common import table, unused, written
from brookline.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    A null or empty text is scored as one without words; rows that repeat are scored alike; a row with a null doc_id is
    scored, but not learnt from; without a positive label every score is 0.5, which is below the threshold."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    name = unused("quality_score", docs.columns)
    return quality.score(docs, model, name=name).where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key per row and that column's name; written, so that every reading has the same keys."""
    key = unused("row_key", docs.columns)
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts: the one with the most code points, of those the smallest doc_id (null last), of
    those any one. A null text counts as empty, and all empty texts as equal."""
    rows, key = numbered(docs)
    keep = exact_dedup.exact_dedup(rows).where("kept").select(F.col("text_sha256").alias("sha"), "keep_id").distinct()
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "").cast("binary"), 256)
    named = rows.select(F.col(key).alias("key"), "doc_id", sha.alias("sha"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    mine = named.join(keep, "sha").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = mine.groupBy("sha").agg(F.min(F.struct(-F.col("n"), "key"))["key"].alias(key)).select(key)
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id (null last), of those any one. Null, empty and
    blank texts are near copies of each other, and of whatever has a fingerprint within two bits of zero."""
    rows, key = numbered(docs)
    groups = simhash.simhash_groups(rows, id_col=key).select(F.col("doc_id").alias("key"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"]
    kept = rows.select(F.col(key).alias("key"), "doc_id").join(groups, "key").groupBy("component_id").agg(first.alias(key)).select(key)
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the raked mixture samples.

    Null sources and languages are groups of their own; a null or empty text counts as one token; rows of one doc_id (or
    of none) are drawn alike, each by its own cell's probability. Columns topic, tokens, probability and sampled that
    documents came with keep their values."""
    rows, key = numbered(docs)
    drawn = mixing.mix(rows.select(key, "doc_id", "text", "lang", "source")).where("sampled").select(key)
    return rows.join(drawn, key, "left_semi").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences. A null or empty text is the end id alone; rows that repeat are packed each."""
    return packing.pack(docs, vocabulary(packing.VOCABULARY))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
