"""Cutting lineage: tables that later steps read several times are written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local session may leave that unset, it gets a folder of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stocktake-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, for a table or an export that is read again."""
    return f"{shared_dir(spark)}/stocktake-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to a table in ``spark.checkpoint.dir`` and read from there.

    A plan that refers to a table k times holds its whole plan k times, so chains of such steps grow exponentially unless cut. A checkpoint would cut the plan but keep
    its estimate of bytes, and a join's is the product of both sides': a loop that joins a table with itself doubles its digits each round, until
    planning takes minutes and the driver's memory. A stored table's size is that of its files.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
