"""Small helpers that all training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in the whitespace tokenisation.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key of more than one in so many of the counted rows is hot; there are so many hot keys at most.
HOT = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset; it gets a folder of its own."""
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stocktake-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise by a reliable checkpoint; partitions and their order stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Materialise as a parquet table in the shared folder: columnar, so later readers take only what they use."""
    path = f"{shared_dir(df.sparkSession)}/stocktake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def row_key(*cols: str) -> Column:
    """Hash of whole column values, nulls included; identical rows share it."""
    return F.xxhash64(*[F.col(c) for c in cols])


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, rows: str = "n") -> DataFrame:
    """``left`` with the columns of ``right``, null where no row of it has the keys.

    ``right`` has one row for each key and says in ``rows`` how many rows of ``left`` have it. Hot keys are joined by a broadcast of
    HOT rows at most, and rows of ``left`` that are done with by then, or have a null key, are dealt by ``spread``: no key makes a large task.
    """
    values = [c for c in right.columns if c not in keys]
    least = (right.agg(F.sum(rows)).first()[0] or 0) / HOT
    named = lambda df, as_: df.select(*[F.col(k).alias(f"__{as_}_{k}") for k in keys], F.struct(*values).alias(f"__{as_}"))
    same = lambda as_: [F.col(k) == F.col(f"__{as_}_{k}") for k in keys]
    out = left.join(F.broadcast(named(right.where(F.col(rows) > least), "hot")), same("hot"), "left")
    done = F.col("__hot").isNotNull()
    for k in keys:
        done |= F.col(k).isNull()
    out = out.withColumn("__done", done).withColumn("__at", F.when(F.col("__done"), spread).otherwise(F.xxhash64(*keys)))
    cold = named(right.where(F.col(rows) <= least), "cold").withColumn("__to", F.xxhash64(*[f"__cold_{k}" for k in keys]))
    out = out.join(cold, [F.col("__at") == F.col("__to"), ~F.col("__done"), *same("cold")], "left")
    return out.select(*[F.col(f"`{c}`") for c in left.columns], F.coalesce("__hot", "__cold").alias("__met")).select(*[F.col(f"`{c}`") for c in left.columns], *[F.col("__met")[v].alias(v) for v in values])


def crc32_sql(number: str) -> str:
    """DuckDB SQL of the crc32 of an integer's decimal text: each digit is mixed in, then eight shifts by the polynomial 0xEDB88320."""
    steps = f"flatten(list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda d: list_concat([CAST(ascii(d) AS BIGINT)], list_resize(CAST([] AS BIGINT[]), 8, 256))))"
    step = "CASE WHEN x < 256 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce({steps}, lambda c, x: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"
