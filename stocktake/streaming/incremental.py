"""Inventories that arrive as files: each micro-batch is matched against what a snapshot already knows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.snapshots import newest, reuse
from ..sources import versions

#: Paths of a snapshot are dealt to so many buckets; a bucket of so many runs is compacted.
BUCKETS, MOST_RUNS = 256, 8


def with_bucket(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A container's entries share their bucket."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))


def save_snapshot(rows: DataFrame, snapshot: str, buckets: int = BUCKETS) -> None:
    """Rows (path, entry_path, size, mtime, hashes) as further rows of a snapshot."""
    versions.commit(with_bucket(rows, buckets), snapshot, "bucket", folders=True)


def load_snapshot(spark: SparkSession, snapshot: str, of: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame | None:
    """A snapshot's rows, where ``of`` (path) is given only from the buckets of its paths: the others' files aren't read."""
    only = [r[0] for r in with_bucket(of.select("path"), buckets).select("bucket").distinct().collect()] if of is not None else None  # BUCKETS rows at most
    rows = versions.load(spark, snapshot, "bucket", only)
    return rows if rows is None else newest(rows.drop("bucket"))


def compact(spark: SparkSession, snapshot: str, most_runs: int = MOST_RUNS) -> list[int]:
    """Write the buckets of ``most_runs`` runs or more anew, without superseded rows; which they are."""
    held = versions.manifest(spark, snapshot, versions.last_version(spark, snapshot))
    worn = [] if held is None else [r["part"] for r in held.where("run IS NOT NULL").groupBy("part").count().where(F.col("count") >= most_runs).collect()]
    if worn:
        rows = versions.load(spark, snapshot, "bucket", worn)
        kept = newest(rows.drop("bucket")).join(rows.select("path", "bucket").distinct(), "path")
        versions.commit(kept, snapshot, "bucket", rows.select("bucket").distinct(), folders=True)
    return worn


def follow(spark: SparkSession, folder: str, schema: str, snapshot: str, checkpoint: str, hashes: tuple[str, ...], fingerprint: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> StreamingQuery:
    """Add fingerprints of new inventory rows (parquet files in ``folder``) to the ``snapshot``, which ``save_snapshot`` began, those that it has reused.

    State is the snapshot alone: a batch reads the buckets of its own paths and adds a run to them, buckets of many runs are compacted. A batch
    that runs again after a failure finds its rows known and adds none of them twice. Of a file that changed the newest row holds.
    """

    def batch(df: DataFrame, _: int) -> None:
        before = load_snapshot(spark, snapshot, df, buckets)
        _, fresh = reuse(df, before, hashes)
        rows = fingerprint(fresh).select(*before.columns)
        if not rows.isEmpty():
            save_snapshot(rows, snapshot, buckets)
            compact(spark, snapshot)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
