"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a share of words; a document's copies are its source's target over its source's size, which is
fractional. Pivotal rounding takes two documents with a fraction, and moves words between them, by a fair random choice of the
direction, until one of the two has a whole number of copies; the other goes on to meet the next. Each move
keeps the words of the pair and every document's expectation. Documents are rounded in buckets; what remains of a
bucket, one document at most, meets other buckets' remainders in the next level of a reduction tree.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, stored, table, tasks

#: Fixed values of the query.
WEIGHTS, SHARE, MOST_COPIES = (3.0, 1.0, 2.0), 1.5, 2
#: Documents in a bucket of the first level, and remainders in a bucket of the later ones (a mean, by hash).
BUCKET, FAN_IN = 4096, 1024
#: Source tables of at most so many rows are broadcast.
BROADCAST_SOURCES = 100_000
EXACT = 1e-9


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with rank: the place of each source by code point, null last. Sorted by ranges, so no task gets all sources."""
    parts = cut(sources.repartitionByRange(tasks(sources.sparkSession), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("inside", inside).join(F.broadcast(before.select("part", "before")), "part").select("source", "source_size", "n_docs", (F.col("before") + F.col("inside")).alias("rank"))


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs): ``share`` of all words by weight, none above ``most`` times its source.

    Sources at their limit keep it and the rest is shared again by weight, until none is above: each round needs two sums.
    """
    sources = ranked(sources)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    sources = cut(sources.select("source", "source_size", "n_docs", weight.alias("weight"), (F.col("source_size") * float(most)).alias("limit")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, seen = 0.0, -1
    while True:
        full = F.col("limit") <= level * F.col("weight") if seen >= 0 else F.lit(False)
        r = sources.agg(F.count_if(full).alias("full"), F.sum(F.when(full, F.col("limit"))).alias("kept"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if r["full"] == seen or not r["open"]:
            break
        seen, level = r["full"], (share * total - (r["kept"] or 0.0)) / r["open"]
    return sources.select("source", "source_size", "n_docs", F.least("limit", F.lit(level) * F.col("weight")).alias("target"))


def pivot(sizes: Sequence[int], parts: list[float], rng: random.Random) -> None:
    """Round ``parts`` (fractions of ``sizes``) in place until one fraction is left at most."""
    i = -1
    for j in range(len(parts)):
        if not EXACT < parts[j] < 1 - EXACT:
            parts[j] = float(round(parts[j]))
            continue
        if i >= 0:
            a, b = sizes[i] * parts[i], sizes[j] * parts[j]
            to_i, to_j = min(sizes[i] - a, b), min(sizes[j] - b, a)
            move = to_i if rng.random() * (to_i + to_j) < to_j else -to_j
            parts[i], parts[j] = (a + move) / sizes[i], (b - move) / sizes[j]
            for k in (i, j):
                if not EXACT < parts[k] < 1 - EXACT:
                    parts[k] = float(round(parts[k]))
        if 0 < parts[j] < 1:
            i = j
        elif i >= 0 and not 0 < parts[i] < 1:
            i = -1


def round_level(rows: DataFrame, seed: int) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: what is left at the end is among the small ones, so little is left to chance.
        pdf = pdf.sort_values(["size", "order"], ascending=[False, True], kind="stable")
        parts = pdf["part"].tolist()
        pivot(pdf["size"].tolist(), parts, random.Random(f"{seed} {pdf['bucket'].iloc[0]} {pdf['order'].iloc[0]}"))
        return pdf.assign(part=parts)

    return cut(rows.groupBy("source", "bucket").applyInPandas(one, rows.schema))


def mix_copies(sized: DataFrame, targets: DataFrame, seed: int = 0, bucket: int = BUCKET, fan_in: int = FAN_IN) -> DataFrame:
    """``sized`` (key, source, size, m equal rows) with source_size, target and copies (whole, for the m rows together)."""
    small = targets.count() <= BROADCAST_SOURCES
    goal = targets.withColumnRenamed("source", "of")
    rows = sized.join(F.broadcast(goal) if small else goal, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    copies = F.when(F.col("source_size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("copies", copies).withColumn("base", F.floor(F.col("copies") + EXACT))
    rows = rows.withColumn("part", F.when(F.col("size") > 0, F.greatest(F.col("copies") - F.col("base"), F.lit(0.0))).otherwise(0.0))
    order = F.xxhash64(F.lit(seed), "key")
    rows = rows.select("key", "source", "size", "m", "source_size", "target", "n_docs", "base", "part", order.alias("order"))
    rows = rows.withColumn("bucket", F.pmod("order", F.ceil(F.col("n_docs") / bucket)))
    open_ = (F.col("part") > EXACT) & (F.col("part") < 1 - EXACT)
    whole = rows.where(~open_)
    left = rows.where(open_)
    buckets = targets.agg(F.max("n_docs")).first()[0] or 0
    buckets = -(-buckets // bucket)
    done = []
    while True:
        state = round_level(left, seed)
        done.append(state.where(~open_))
        left = state.where(open_)
        if buckets <= 1:
            break
        buckets = -(-buckets // fan_in)
        left = left.withColumn("bucket", F.floor(F.col("bucket") / fan_in))
    # One document of a source is left; it is taken with its fraction's probability.
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(1 << 30)) / float(1 << 30)
    done.append(left.withColumn("part", F.when(chance < F.col("part"), 1.0).otherwise(0.0)))
    for part in done:
        whole = whole.unionByName(part)
    return whole.select("key", "source", "size", "m", "source_size", "target", (F.col("base") + F.round("part").cast("long")).alias("copies"))


def sized_keys(docs: DataFrame, key: Sequence[str], source: str, text: str) -> DataFrame:
    """Equal rows as one: key (struct of ``key``), source, size, m."""
    own = docs.select(F.struct(*key).alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return stored(own.groupBy("key", "source", "size").agg(F.count("*").alias("m")))


def mix(docs: DataFrame, key: Sequence[str], source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """(key, source, size, m, source_size, target, copies) for each distinct (key, source, size) of ``docs``.

    ``copies`` is how often the mix takes the m rows that are equal in these, together; at most twice each. A null or
    empty text has size 0, counts for nothing and is taken 0 or more times; a null source is a source. A run over the same
    rows, in whatever order, gives the same copies. An empty frame gives an empty one.
    """
    sized = sized_keys(docs, key, source, text)
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n_docs"))
    return mix_copies(sized, source_targets(per), seed)


def share_of(copies: str, m: str, i: str) -> Column:
    """Of ``copies`` taken of ``m`` equal rows, those of row ``i``, from 0."""
    return F.floor(F.col(copies) / F.col(m)) + F.when(F.col(i) < F.col(copies) % F.col(m), 1).otherwise(0)


def take(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: rows of ``docs`` (with doc_id, source and text), each as often as it is taken, twice at most.

    Rows of one id, text and source are taken together as often as ``mix`` says, dealt evenly, whatever else they differ in. Columns must be of
    types that can be grouped. An empty frame gives an empty one.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    taken = mix(keyed.select("doc_id", F.col("__hash").alias("hash"), "source", "text"), ["doc_id", "hash"], seed=seed)
    taken = taken.where("copies > 0").select(F.col("key.doc_id").alias("__id"), F.col("key.hash").alias("__of"), F.col("source").alias("__source"), F.col("copies").alias("__copies"), F.col("m").alias("__m"))
    met = keyed.join(taken, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__of")) & F.col("source").eqNullSafe(F.col("__source")))
    times = lambda df, n: df.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*cols)
    single = times(met.where("__m = 1"), F.col("__copies"))
    # Rows that repeat are numbered by runs of equal ones; the first copies % m of them are taken once more than the others.
    again = met.where("__m > 1").groupBy(*cols, "__hash", "__copies", "__m").agg(F.count("*").alias("__c"))
    w = Window.partitionBy("doc_id", "__hash", "source").orderBy(*cols)
    before = F.sum("__c").over(w) - F.col("__c")
    extra = F.greatest(F.least(F.col("__copies") % F.col("__m") - F.col("__before"), F.col("__c")), F.lit(0))
    again = again.withColumn("__before", before).withColumn("__n", F.floor(F.col("__copies") / F.col("__m")) * F.col("__c") + extra).where("__n > 0")
    return single.unionByName(times(again, F.col("__n")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, ["doc_id"])
    rows = mixed.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int"))))
    return rows.select("key.doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * share_of("copies", "m", "i")).cast("long").alias("taken"))
