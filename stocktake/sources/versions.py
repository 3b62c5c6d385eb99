"""Stored tables in versions: readers see a whole version or the one before, whatever fails in between.

Rows lie in runs, in a bounded number of buckets of partitions (``data/run=<id>/__bucket=<n>``) and sorted by partition, so files don't grow with the number of partitions. A version is a manifest that says which run holds which partition. A writer adds a run, then a
manifest beside it, and at last gives that the next number by one rename, which fails if another writer was first; then the manifest is made anew from theirs.
Partitions that a writer doesn't touch stay where they are, however large the table is.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

#: Writers that find the next number taken try again so often.
TRIES = 20
#: Folders of a run. A partition's rows are in one of them.
BUCKETS = 64


def bucket(partition: Column) -> Column:
    return F.pmod(F.xxhash64(partition), F.lit(BUCKETS))


def hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, at = hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def last_version(spark: SparkSession, path: str) -> int:
    """The number of the newest version, 0 before the first."""
    return max((int(n) for n in names_in(spark, f"{path}/manifest") if n.isdigit()), default=0)


def publish(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder, where nothing is yet; False if something is."""
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(source), there, options)
    except Exception as e:  # noqa: BLE001
        if "FileAlreadyExistsException" in str(e) or "already exists" in str(e):
            return False
        raise
    return True


def manifest(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """(run, part, shape) of a version: a row for each run and partition, and one without a run; shape is the rows' schema."""
    return spark.read.parquet(f"{path}/manifest/{version:012d}") if version else None


def commit(rows: DataFrame, path: str, partition: str, replaced: DataFrame | None = None, folders: bool = False) -> int:
    """Add ``rows`` to the table, without what the partitions ``replaced`` (a column named like ``partition``) held before; the version's number.

    ``folders``: a folder for each partition, for a column that is a bucket itself. A table is written one way or the other throughout.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    rows = rows.select(*[c for c in rows.columns if c != partition], partition)
    if folders:
        rows.write.partitionBy(partition).parquet(f"{path}/data/run={run}")
    else:
        dealt = rows.withColumn("__bucket", bucket(F.col(partition)))
        dealt.hint("rebalance", "__bucket").sortWithinPartitions("__bucket", partition).write.partitionBy("__bucket").parquet(f"{path}/data/run={run}")
    shape = rows.schema.json()
    added = spark.read.schema(rows.schema).parquet(f"{path}/data/run={run}").select(F.lit(run).alias("run"), F.col(partition).alias("part")).distinct()
    gone = replaced.select(F.col(partition).alias("gone")).distinct() if replaced is not None else None
    for _ in range(TRIES):
        version = last_version(spark, path)
        before = manifest(spark, path, version)
        parts = added
        if before is not None:
            kept = before.where("run IS NOT NULL").select("run", "part")
            if gone is not None:
                kept = kept.join(F.broadcast(gone), F.col("part").eqNullSafe(F.col("gone")), "left_anti")
            parts = kept.unionByName(added)
        head = spark.range(1).select(F.lit(None).cast("string").alias("run"), F.lit(None).cast(added.schema["part"].dataType).alias("part"))
        draft = f"{path}/manifest/_draft-{uuid.uuid4().hex}"
        parts.unionByName(head).withColumn("shape", F.lit(shape)).coalesce(1).write.parquet(draft)
        if publish(spark, draft, f"{path}/manifest/{version + 1:012d}"):
            return version + 1
        fs, at = hadoop(spark, draft)
        fs.delete(at, True)
    raise RuntimeError(f"{path}: other writers were first {TRIES} times")


def load(spark: SparkSession, path: str, partition: str, only: Sequence | None = None, version: int | None = None) -> DataFrame | None:
    """The table's rows, of some partitions where ``only`` names them (their buckets' folders alone are read); None before the first version."""
    held = manifest(spark, path, last_version(spark, path) if version is None else version)
    if held is None:
        return None
    shape = StructType.fromJson(json.loads(held.select("shape").first()[0]))
    held = held.where("run IS NOT NULL")
    held = held.where(F.col("part").isin(*only)) if only else held.limit(0) if only is not None else held
    runs = [r["run"] for r in held.select("run").distinct().collect()]  # a few for each version since the last compaction
    if not runs:
        return spark.createDataFrame([], shape)
    full = StructType(shape.fields).add("run", StringType()).add("__bucket", LongType())
    rows = spark.read.schema(full).option("basePath", f"{path}/data").parquet(*[f"{path}/data/run={r}" for r in runs])
    if only:
        rows = rows.where(F.col(partition).isin(*only))
        # A run with a folder for each partition has no bucket.
        rows = rows.where(F.col("__bucket").isNull() | F.col("__bucket").isin(*[bucket(F.lit(v).cast(shape[partition].dataType)) for v in only]))
    # The manifest has a row for each run and partition.
    held = held.select(F.col("run").alias("__run"), F.col("part").alias("__part"))
    return rows.join(held, (F.col("run") == F.col("__run")) & F.col(partition).eqNullSafe(F.col("__part")), "left_semi").select(*shape.fieldNames())


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than_s: float = 86_400.0) -> None:
    """Delete all but the ``keep`` newest versions, and runs that none of these has and that no writer of the last ``older_than_s`` seconds can still be at."""
    numbers = sorted(int(n) for n in names_in(spark, f"{path}/manifest") if n.isdigit())
    kept = numbers[-keep:]
    held: set[str] = set()
    for n in kept:
        held |= {r["run"] for r in manifest(spark, path, n).where("run IS NOT NULL").select("run").distinct().collect()}
    fs, _ = hadoop(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    for n in numbers[:-keep]:
        fs.delete(at(f"{path}/manifest/{n:012d}"), True)
    for name in names_in(spark, f"{path}/data"):
        folder = at(f"{path}/data/{name}")
        if name.removeprefix("run=") not in held and fs.getFileStatus(folder).getModificationTime() / 1000 < time.time() - older_than_s:
            fs.delete(folder, True)
