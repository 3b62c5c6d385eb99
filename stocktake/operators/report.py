"""The audit as a browser shows it: each row with what its set, its item and its file are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import embedded_checksum
from ..functions.paths import file_name, stem
from .families import base_ancestor
from .match import FILE, HASHES, ITEM

#: Columns of a set that its rows show as they are.
SET = ("description", "clone_of", "is_bios", "is_device", "has_disk", "has_samples", "year", "manufacturer", "disk_names", "device_refs", "cpu_chips", "audio_chips", "driver_status", "display_type", "display_rotate", "players", "coins")


def typed(df: DataFrame, names: tuple[str, ...], kind: str = "string") -> list:
    """Columns by name, null where ``df`` has none of that name."""
    return [F.col(n) if n in df.columns else F.lit(None).cast(kind).alias(n) for n in names]


def full_audit(matches: DataFrame, left: DataFrame, items: DataFrame, files: DataFrame, sets: DataFrame, suggested: DataFrame | None = None) -> DataFrame:
    """One row for each match and each leftover (with owner and flags), with its set's attributes, and expected and actual sizes and hashes.

    status is that of ``match.to_audit``. A match found elsewhere shows its container's name in found_elsewhere. A leftover shows its owner, the owner's description, whether it is redundant, and the set
    that ``suggested`` (path, suggested) names its container after. Flags of duplicates, base sets in no use, containers' own checksums and donors come from their operators (J31, J32, F15, J28).
    """
    about = sets.select("set_name", *typed(sets, SET)).dropDuplicates(["set_name"]).join(base_ancestor(sets).withColumnRenamed("base", "required_bios"), "set_name", "left")
    want = items.select(*ITEM, "dump_status", F.coalesce("optional", F.lit(False)).alias("is_optional"), *typed(items, ("merge_name",)), F.col("size").alias("expected_size"), *[c.alias(f"expected_{h}") for h, c in zip(HASHES, typed(items, HASHES), strict=True)])
    have = files.select(*FILE, F.col("size").alias("actual_size"), *[c.alias(f"actual_{h}") for h, c in zip(HASHES, typed(files, HASHES), strict=True)]).dropDuplicates(list(FILE))
    status = F.when(F.col("match_status") == "nodump", "unverifiable").when(F.col("match_status").isin("misnamed", "foundElsewhere"), "incorrect").when(F.col("match_status") == "hashMismatch", "badDump").otherwise(F.col("match_status"))
    rows = matches.join(want, list(ITEM)).withColumn("status", status)
    rows = rows.withColumn("found_elsewhere", F.when(F.col("match_status") == "foundElsewhere", file_name(F.col("path"))))
    own = rows.select("set_name", "item_name", "status", "dump_status", "is_optional", "merge_name", (F.coalesce("dump_status", F.lit("")) == "baddump").alias("is_bad_dump"), F.col("via_strip").alias("via_header"), "found_elsewhere", *FILE, "expected_size", *[f"expected_{h}" for h in HASHES])
    kind = F.when(F.col("owner").isNotNull(), "incorrect").when(F.col("nodump_name"), "unverifiable").when(F.col("known_container"), "surplusInArchive").otherwise("unknownFile")
    rest = left.withColumn("status", kind)
    owner = sets.select(F.col("set_name").alias("owner"), *[c.alias("owner_description") for c in typed(sets, ("description",))]).dropDuplicates(["owner"])
    rest = rest.join(owner, "owner", "left")
    rest = rest.join(suggested, "path", "left") if suggested is not None else rest.withColumn("suggested", F.lit(None).cast("string"))
    rest = rest.select(F.col("entry_name").alias("item_name"), "status", F.lit(False).alias("is_optional"), F.lit(False).alias("is_bad_dump"), F.lit(False).alias("via_header"), *FILE, F.col("owner").alias("required_by"), "owner_description", "redundant", "suggested")
    out = own.unionByName(rest, allowMissingColumns=True).join(about, "set_name", "left").join(have, list(FILE), "left")
    container = stem(F.col("path"))
    return out.withColumns({
        "is_disk": F.lit(False), "redundant": F.coalesce("redundant", F.lit(False)),
        "case_mismatch": F.coalesce((F.col("status") == "correct") & (F.lower(container) == F.lower("set_name")) & (container != F.col("set_name")), F.lit(False)),
        "name_checksum_mismatch": F.coalesce(embedded_checksum(F.col("entry_name")) != F.col("actual_crc32"), F.lit(False)),
    })
