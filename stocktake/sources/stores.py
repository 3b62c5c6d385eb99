"""Stored tables: reports by system, inventories, normalised catalogs, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import versions

#: A stored catalog of another version is read anew.
FORMAT = 1


def save_report(audit: DataFrame, path: str) -> None:
    """The audit by system, as a new version; only systems that the frame holds are replaced."""
    versions.commit(audit, path, "system_id", audit.select("system_id").distinct())


def load_report(spark: SparkSession, path: str, system: int | str) -> DataFrame:
    """One system's rows; only its folders are read."""
    return versions.load(spark, path, "system_id", [system])


def remove_system(spark: SparkSession, path: str, system: int | str) -> None:
    """A system's report goes, as a new version."""
    rows = load_report(spark, path, system)
    versions.commit(rows.limit(0), path, "system_id", spark.createDataFrame([(system,)], StructType([rows.schema["system_id"]])))


def save_inventory(inventory: DataFrame, path: str) -> None:
    """The rows that could be read; markers of unreadable containers aren't kept."""
    (inventory.where("read_state = 'ok'") if "read_state" in inventory.columns else inventory).write.mode("overwrite").parquet(path)


def save_catalog(tables: dict[str, DataFrame], path: str, source: dict[str, object]) -> None:
    """Catalog tables in a new folder, then, by one rename, a manifest of what they were made from (size, mtime, layout modes); until then readers have the catalog before."""
    spark, run = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/data/{run}/{name}")
    draft = f"{path}/manifest/_draft-{run}"
    spark.createDataFrame([{k: str(v) for k, v in source.items()} | {"format": str(FORMAT), "run": run}]).write.json(draft)
    while not versions.publish(spark, draft, f"{path}/manifest/{versions.last_version(spark, path) + 1:012d}"):
        pass  # another writer was first, and the number after theirs is next


def load_catalog(spark: SparkSession, path: str, names: list[str], source: dict[str, object]) -> dict[str, DataFrame] | None:
    """The tables of the newest catalog, or None where what they were made from differs."""
    version = versions.last_version(spark, path)
    if not version:
        return None
    row = spark.read.json(f"{path}/manifest/{version:012d}").first().asDict()
    run = row.pop("run")
    if row != {k: str(v) for k, v in source.items()} | {"format": str(FORMAT)}:
        return None
    return {n: spark.read.parquet(f"{path}/data/{run}/{n}") for n in names}


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_notes(notes: DataFrame, path: str) -> None:
    notes.write.mode("overwrite").json(path)


def title_catalog(sets: DataFrame, path: str) -> None:
    """Title sets (set_name, members split by |) as a catalog in XML, sets by name without regard to case."""
    rom = F.transform(F.split("members", r"\|"), lambda m: F.struct(m.alias("_name"), F.lit(0).alias("_size")))
    sets.select(F.col("set_name").alias("_name"), rom.alias("rom")).orderBy(F.lower("_name")).write.mode("overwrite").format("xml").option("rowTag", "game").option("rootTag", "datafile").save(path)
