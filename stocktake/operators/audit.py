"""The audit table: counters, rollups per set, filters, groupings.

An audit row has system_id, row_ord, set_name (null for a leftover), status, is_disk, is_optional, path and further flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import under

STATUSES = ("correct", "incorrect", "badDump", "missing", "unverifiable", "surplusInArchive", "unknownFile", "surplus", "duplicateSet")
SURPLUS = ("surplus", "surplusInArchive", "unknownFile")
SEVERITY = {"correct": 1, "incorrect": 2, "badDump": 3, "missing": 4}


def flag(df: DataFrame, name: str, default: bool = False) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def counters(audit: DataFrame, *by: str) -> DataFrame:
    """Seven counters in one pass; leftovers of all kinds count as surplus."""
    count = lambda name, *of: F.count_if(F.col("status").isin(*of)).alias(name)
    return audit.groupBy(*by).agg(count("correct", "correct"), count("incorrect", "incorrect"), count("bad_dump", "badDump"), count("missing", "missing"), count("unverifiable", "unverifiable"), count("surplus", *SURPLUS), count("duplicate", "duplicateSet"))


def worst_status(audit: DataFrame, *by: str) -> DataFrame:
    """The worst status of item rows, else of disk rows; null if no row has one of the four."""
    level = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    name = F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (v, k)])
    sev = F.try_element_at(level, F.col("status"))
    worst = F.coalesce(F.max(F.when(~F.col("is_disk"), sev)), F.max(F.when(F.col("is_disk"), sev)))
    return audit.groupBy(*by).agg(worst.alias("sev")).withColumn("worst", F.try_element_at(name, F.col("sev"))).drop("sev")


def rollup_status(where: Column, df: DataFrame) -> Column:
    """The status of a set from its rows ``where`` holds, as an aggregate; null without such rows."""
    any_ = lambda c: F.coalesce(F.bool_or(where & c), F.lit(False))
    is_ = lambda s: F.col("status") == s
    return (
        F.when(any_(is_("missing") & ~F.col("is_optional")), "missing").when(any_(is_("badDump")), "badDump").when(any_(is_("incorrect")), "incorrect").when(any_(is_("correct") & flag(df, "case_mismatch")), "incorrect")
        .when(any_(is_("correct")), "correct").when(any_(is_("unverifiable")), "unverifiable").when(any_(F.lit(True)), "correct")
    )


def set_rollup(audit: DataFrame) -> DataFrame:
    """(set_name, status): over all rows of a set."""
    sets = audit.where("set_name IS NOT NULL")
    return sets.groupBy("set_name").agg(rollup_status(F.lit(True), sets).alias("status"))


def item_rollup(audit: DataFrame) -> DataFrame:
    """(set_name, status): over a set's item rows, over its disk rows if it has no items."""
    sets = audit.where("set_name IS NOT NULL")
    return sets.groupBy("set_name").agg(F.coalesce(rollup_status(~F.col("is_disk"), sets), rollup_status(F.lit(True), sets)).alias("status"))


def completion(audit: DataFrame) -> DataFrame:
    """(set_name, completion): complete, fixable, partial or empty, by the rows that are required."""
    sets = audit.where("set_name IS NOT NULL").withColumn("items", F.max((~F.col("is_disk")).cast("int")).over(Window.partitionBy("set_name")) == 1)
    need = (F.col("is_disk") != F.col("items")) & ~F.col("is_optional")
    n = lambda s: F.count_if(need & (F.col("status") == s))
    out = F.when(F.count_if(need) == 0, "complete").when(n("missing") == F.count_if(need), "empty").when(n("missing") + n("badDump") > 0, "partial").when(n("incorrect") > 0, "fixable").otherwise("complete")
    return sets.groupBy("set_name").agg(out.alias("completion"))


def verified(audit: DataFrame) -> DataFrame:
    """Rows of sets of which every row is correct."""
    whole = audit.groupBy("set_name").agg(F.bool_and(F.col("status") == "correct").alias("ok")).where("ok AND set_name IS NOT NULL")
    return audit.join(whole, "set_name", "left_semi")


def with_completion(audit: DataFrame, kind: str) -> DataFrame:
    return audit.join(completion(audit).where(F.col("completion") == kind), "set_name", "left_semi")


def category(audit: DataFrame, name: str) -> DataFrame:
    """The named filters over the audit."""
    simple = {
        "allGames": F.lit(True), "byManufacturer": F.lit(True), "byYear": F.lit(True), "missingGames": F.col("status") == "missing", "incorrectGames": F.col("status") == "incorrect",
    }
    columns = {
        "originals": ("clone_of", lambda c: c.isNull()), "clones": ("clone_of", lambda c: c.isNotNull()), "biosFiles": ("is_bios", lambda c: c), "gamesWithCHD": ("has_disk", lambda c: c), "gamesWithSamples": ("has_samples", lambda c: c),
        "gamesWithBadDumps": ("dump_status", lambda c: c != "good"), "gamesWithNodump": ("dump_status", lambda c: c == "nodump"), "gamesRequiringBIOS": ("required_bios", lambda c: c.isNotNull()), "gamesWithDeviceRefs": ("device_refs", lambda c: c.isNotNull()),
        "unusedBiosFiles": ("orphaned_bios", lambda c: c), "filenameCRCMismatches": ("name_checksum_mismatch", lambda c: c), "zipCRCInconsistencies": ("container_checksum_mismatch", lambda c: c), "deviceMachines": ("is_device", lambda c: c),
    }
    if name in simple:
        return audit.where(simple[name])
    if name == "verifiedGames":
        return verified(audit)
    if name.endswith("Games") and (kind := name[: -len("Games")]) in ("complete", "fixable", "partial", "empty"):
        return with_completion(audit, kind)
    column, test = columns[name]
    return audit.where(test(F.col(column)))


def sets_in_root(audit: DataFrame, root: str) -> DataFrame:
    return audit.where(F.col("set_name").isNotNull() & under(F.col("path"), F.lit(root))).select("set_name").distinct()


def scoped(audit: DataFrame, root: str) -> DataFrame:
    """Rows under a root, and rows without a path of sets that live there."""
    here = sets_in_root(audit, root).withColumn("lives_here", F.lit(True))
    return audit.join(here, "set_name", "left").where(F.coalesce(under(F.col("path"), F.lit(root)), F.lit(False)) | (F.col("path").isNull() & F.col("lives_here"))).drop("lives_here")


def search(df: DataFrame, column: str, text: str) -> DataFrame:
    """A prefix without regard to case; with ``*`` or ``?``, a wildcard pattern anywhere."""
    import re

    if not set(text) & set("*?"):
        return df.where(F.lower(column).startswith(text.lower()))
    return df.where(F.col(column).rlike("(?i)" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in text)))


def rescan_summary(audit: DataFrame, root: str) -> DataFrame:
    """Counters over all rows of the sets that a rescanned root touches, and over leftovers without a path or under it."""
    touched = audit.join(sets_in_root(audit, root), "set_name", "left_semi")
    loose = audit.where(F.col("set_name").isNull() & (F.col("path").isNull() | under(F.col("path"), F.lit(root))))
    return counters(touched.unionByName(loose))


def by_toggles(audit: DataFrame, selected: list[str], unknown: bool) -> DataFrame:
    """Rows of sets whose status, over all their rows, is selected; leftovers by a switch of their own."""
    chosen = item_rollup(audit).where(F.col("status").isin(*selected)).select("set_name")
    rows = audit.join(chosen, "set_name", "left_semi")
    return rows.unionByName(audit.where("set_name IS NULL")) if unknown else rows


def status_counts(audit: DataFrame) -> DataFrame:
    """Sets by status; unknown containers count apart."""
    sets = item_rollup(audit).groupBy("status").agg(F.count("*").alias("n"))
    loose = audit.where("set_name IS NULL").agg(F.count_distinct("path").alias("n")).select(F.lit("unknownContainer").alias("status"), "n")
    return sets.unionByName(loose)


def majority_path(audit: DataFrame) -> DataFrame:
    """(set_name, path): where at least half of a set's rows with a path lie; of two such, the first."""
    n = audit.where("set_name IS NOT NULL AND path IS NOT NULL").groupBy("set_name", "path").agg(F.count("*").alias("n"))
    w = Window.partitionBy("set_name")
    best = n.withColumn("total", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "path")))
    return best.where("rank = 1 AND n * 2 >= total").select("set_name", "path")


def nodes(audit: DataFrame) -> DataFrame:
    """One row per set and kind (items, disks), and per leftover path: what a browser lists."""
    sets = audit.where("set_name IS NOT NULL").groupBy("set_name", "is_disk").agg(F.count("*").alias("n"), rollup_status(F.lit(True), audit).alias("status"), F.bool_and(F.col("status") == "missing").alias("gone"))
    disk = sets.where("is_disk").select("set_name", F.lit(True).alias("has_disk"))
    sets = sets.join(disk, "set_name", "left").where("is_disk OR NOT gone OR has_disk IS NULL")
    sets = sets.select(F.concat(F.when(F.col("is_disk"), "disk:").otherwise("set:"), F.col("set_name")).alias("node"), F.lit(False).alias("is_bucket"), "status", "n")
    loose = audit.where("set_name IS NULL").groupBy("path").agg(F.count("*").alias("n")).select(F.concat(F.lit("path:"), F.coalesce("path", F.lit(""))).alias("node"), F.lit(True).alias("is_bucket"), F.lit("unknownFile").alias("status"), "n")
    return sets.unionByName(loose)


def collection_report(systems: DataFrame, audit: DataFrame) -> DataFrame:
    """Counters of every system and, in the row without system_id, of all scanned ones; a system without rows is unscanned."""
    known = systems.select("system_id").where("system_id IS NOT NULL").distinct().join(audit.select("system_id", "status"), "system_id", "left")
    out = known.rollup("system_id").agg(F.count("status").alias("rows"), F.count_if(F.col("status") == "correct").alias("correct"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status").isin(*SURPLUS)).alias("surplus"))
    return out.withColumn("scanned", F.col("rows") > 0)


def unused_bases(audit: DataFrame) -> DataFrame:
    """Base sets that are present and that no present set needs (``required_bios`` is a comma-separated list)."""
    here = F.col("status") != "missing"
    needed = audit.where(here & F.col("required_bios").isNotNull()).select(F.explode(F.split("required_bios", r"\s*,\s*")).alias("name"))
    return audit.where(here & F.col("is_bios")).select(F.col("set_name").alias("name")).distinct().join(needed, "name", "left_anti")


def page(df: DataFrame, order: list[str], start: int, rows: int) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(rows)
