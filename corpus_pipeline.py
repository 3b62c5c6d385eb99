"""A training corpus from documents: each stage takes the documents that the last one kept.

Counted as part of the subpackage llm. ``run`` writes the documents of each stage as a table in the shared folder and
reads them again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from stocktake.llm.common import stored, table


#: So many keys of repeated rows are broadcast at most.
BROADCAST_KEYS = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut. Texts without words score 0 and stay."""
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).where(F.col("score") < toxicity.CUT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that similar texts join, the one with the smallest id (null ids last). Documents without words all stay.

    Rows are told apart by their id, text and other columns; of rows equal in all of them one stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text"), F.xxhash64(F.lit(0), *rest).alias("rest"))
    docs = docs.withColumn("__key", key)
    found = jaccard_join.join_similar(docs, "__key").where("n_shingles > 0").groupBy("id").agg(F.bool_or(F.col("component_id") != F.col("id")).alias("gone"), F.count("*").alias("n"))
    found = stored(found.where("gone OR n > 1").select(F.col("id").alias("__id"), "gone"))
    twice = found.where("NOT gone")
    # Rows that go or repeat are looked up; the others need no partner. Repeated ones are few as a rule, and then they travel, not the texts.
    once = docs.join(found, F.col("__key") == F.col("__id"), "left_anti").select(*columns)
    again = docs.join(F.broadcast(twice) if twice.count() <= BROADCAST_KEYS else twice, F.col("__key") == F.col("__id"), "left_semi").select(*columns).distinct()
    return once.unionByName(again)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("leak_items IS NULL").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not, once or twice."""
    return mixing.take(docs)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with slot, shard and shard_name; copies of a document share a shard."""
    return sharding.assign_shards(docs, "doc_id", spread=["source", "lang", "n_chars"])


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", place),
]

#: Training a network and rounding at random have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
