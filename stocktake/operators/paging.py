"""Pages of a long list that read their own range alone.

The list is stored once, dealt by ranges of its key, with an index of each range's first key and row count. A page looks up which ranges it
lies in, by the key that the page before ended with or by its first row's number, and reads these; nothing is sorted but them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions

#: Rows of a range, about.
ROWS = 50_000


def store_pages(rows: DataFrame, path: str, key: str, per_range: int = ROWS) -> None:
    """``rows`` by their ``key`` (unique, not null) as a list of pages at ``path``, in place of what was there."""
    spark = rows.sparkSession
    n = max(1, -(-rows.count() // per_range))
    ranged = rows.repartitionByRange(n, key).withColumn("range", F.spark_partition_id())
    before = versions.load(spark, path, "range")
    version = versions.commit(ranged, path, "range", before.select("range") if before is not None else None)
    index = versions.load(spark, path, "range", version=version).groupBy("range").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index/{version:012d}")


def index_of(spark: SparkSession, path: str) -> tuple[int, list]:
    """(version, ranges in order as (range, first key, rows)); as many as the list has ranges."""
    version = max((int(n) for n in versions.names_in(spark, f"{path}/index") if n.isdigit()), default=0)
    rows = spark.read.parquet(f"{path}/index/{version:012d}").collect() if version else []
    return version, sorted((r["range"], r["first"], r["n"]) for r in rows)


def covering(ranges: list, after: object | None, start: int, size: int) -> tuple[list[int], int]:
    """The ranges of ``size`` rows behind a key, or from row ``start`` on; and how many rows lie before the first of them."""
    at, before = 0, 0
    while at + 1 < len(ranges) and (ranges[at + 1][1] <= after if after is not None else before + ranges[at][2] <= start):
        before += ranges[at][2]
        at += 1
    # Of the first range some rows may lie before the page.
    chosen, held = [], 0 if after is not None else before - start
    for i, (number, _, n) in enumerate(ranges[at:]):
        chosen.append(number)
        held += n if after is None or i else 0
        if held >= size:
            break
    return chosen, before


def page_after(spark: SparkSession, path: str, key: str, after: object | None, size: int) -> DataFrame:
    """The ``size`` rows behind the key ``after``, or the first ones."""
    version, ranges = index_of(spark, path)
    chosen, _ = covering(ranges, after, 0, size)
    rows = versions.load(spark, path, "range", chosen, version).drop("range")
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(size)


def page_at(spark: SparkSession, path: str, key: str, start: int, size: int) -> DataFrame:
    """The ``size`` rows from the ``start``-th on, counted from 0."""
    version, ranges = index_of(spark, path)
    chosen, before = covering(ranges, None, start, size)
    return versions.load(spark, path, "range", chosen, version).drop("range").orderBy(key).offset(start - before).limit(size)
