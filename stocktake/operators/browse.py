"""What a browser of the report lists: groupings, attributes, badges and one line of explanation for each node."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.paths import file_name
from .audit import majority_path, rollup_status

# Names of processors among component names, and the texts of badges and explanations.
PROCESSORS = (
    "z80", "z8400", "z84c0010", "z180", "m6502", "m6507", "m6509", "m65c02", "m6510", "n2a03", "m6800", "m6801", "m6803", "m6805", "m6809", "m6809e", "hd6309", "hd63701", "hd6301", "m68000",
    "m68010", "m68020", "m68030", "m68040", "scc68070", "i8080", "i8085", "i8086", "i8088", "i80186", "i80286", "v20", "v30", "v33", "v60", "v70", "i8035", "i8039", "i8048", "i8049", "i8051",
    "i8749", "mcs48", "mcs51", "tms9900", "tms9980", "tms9995", "tms32010", "tms32025", "tms34010", "tms34020", "arm", "arm7", "arm7500", "arm9", "sh1", "sh2", "sh4", "mips1", "mips3",
    "powerpc", "ppc403", "ppc601", "ppc602", "ppc603", "upd7810", "upd78c05", "upd78c11", "upd7801", "cop420", "cop410", "cop440", "h6280", "h83002", "h83007", "h83044", "pic16c54", "pic16c57",
    "pic16c58", "se3208", "e116t", "mn10200", "dsp16a", "adsp2100", "adsp2105", "adsp2115",
)
DISK_TEXTS = {"missing": "Missing", "incorrect": "Incorrect", "badDump": "Bad", "unverifiable": "Nodump (unverifiable)"}
SET_TEXTS = {"missing": "Incomplete (rom missing)", "badDump": "Bad (hash mismatch)", "unverifiable": "Ok (contains a nodump rom)"}
#: Categories that only a scan can answer; the bare catalog has none of them.
SCANNED = ("verifiedGames", "gamesWithBadDumps", "gamesWithNodump", "missingGames", "incorrectGames", "completeGames", "fixableGames", "partialGames", "emptyGames", "unusedBiosFiles", "filenameCRCMismatches", "zipCRCInconsistencies")


def filled(c: Column) -> Column:
    """Null for an empty text."""
    return F.when(c != "", c)


def browse_groups(sets: DataFrame, by: str) -> DataFrame:
    """(by, n_sets): distinct sets of each manufacturer, year or other attribute; without one, under null."""
    return sets.groupBy(filled(F.col(by)).alias(by)).agg(F.count_distinct("set_name").alias("n_sets"))


def catalog_category(sets: DataFrame, name: str, bases: DataFrame | None = None) -> DataFrame:
    """The named filter over the bare catalog, before any scan. ``bases`` (set_name, base) are the sets that need another set's base."""
    tests = {
        "originals": F.col("clone_of").isNull(), "clones": F.col("clone_of").isNotNull(), "biosFiles": F.col("is_bios"), "gamesWithCHD": F.col("has_disk"), "gamesWithSamples": F.col("has_samples"),
        "gamesWithDeviceRefs": F.coalesce(F.trim("device_refs"), F.lit("")) != "", "deviceMachines": F.col("is_device"),
    }
    if name in ("allGames", "byManufacturer", "byYear"):
        return sets
    if name == "gamesRequiringBIOS":
        return sets.join(bases.select("set_name").distinct(), "set_name", "left_semi")
    return sets.where(F.lit(False) if name in SCANNED else tests[name])


def with_attributes(sets: DataFrame, rows: DataFrame, columns: Sequence[str], order: str = "row_ord") -> DataFrame:
    """``sets`` with each of ``columns`` as the set's first row that has it says, else as the catalog says; an empty text is none."""
    first = [F.min_by(filled(F.col(c)), F.when(filled(F.col(c)).isNotNull(), F.col(order))).alias(f"__{c}") for c in columns]
    found = rows.where("set_name IS NOT NULL").groupBy("set_name").agg(*first)
    out = sets.join(found, "set_name", "left")
    return out.withColumns({c: F.coalesce(f"__{c}", filled(F.col(c))) for c in columns}).drop(*[f"__{c}" for c in columns])


def listed(c: Column) -> Column:
    """Trimmed parts of a comma-separated text; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def badge(kind: str, label: str, tooltip: Column, there: Column) -> Column:
    return F.when(there, F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), tooltip.alias("tooltip")))


def dependency_badges(base: Column, disks: Column, refs: Column, cpus: Column, sounds: Column, samples: Column) -> Column:
    """array<struct<kind, label, tooltip>>: base set, disks, hardware, samples. Without declared processors, component names that are known ones count as such."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    n = F.size(listed(disks))
    known = F.array(*[F.lit(p) for p in PROCESSORS])
    is_cpu = lambda x: F.array_contains(known, F.lower(x))
    guessed, other = F.filter(listed(refs), is_cpu), F.filter(listed(refs), lambda x: ~is_cpu(x))
    other = F.when(some(cpus), listed(refs)).otherwise(other)
    line = lambda label, text, there: F.when(there, F.concat(F.lit(label), text))
    hardware = F.concat_ws("\n", F.when(some(cpus), F.concat(F.lit("CPU: "), cpus)).otherwise(line("CPU: ", F.array_join(guessed, ", "), F.size(guessed) > 0)), line("Sound: ", sounds, some(sounds)), line("Other: ", F.array_join(other, ", "), F.size(other) > 0))
    return F.array_compact(F.array(
        badge("base", "BIOS", base, some(base)),
        badge("disk", "CHD", F.concat(n.cast("string"), F.when(n == 1, " disk: ").otherwise(" disks: "), disks), some(disks)),
        badge("hardware", "Hardware", hardware, some(refs) | some(cpus) | some(sounds)),
        badge("samples", "Samples", F.lit(""), F.coalesce(samples, F.lit(False))),
    ))


def detail_badges(driver: Column, kind: Column, rotate: Column, players: Column, coins: Column) -> Column:
    """array<struct<kind, label, tooltip>>: emulation, display, players."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    status = F.concat(F.lit("MAME driver status: "), F.when(driver.isin("good", "imperfect", "preliminary"), F.initcap(driver)).otherwise(driver))
    turned = F.when(rotate.isin("0", "180"), "Orientation: Horizontal").when(rotate.isin("90", "270"), "Orientation: Vertical")
    display = F.concat_ws("\n", turned, F.when(some(kind), F.concat(F.lit("Type: "), F.initcap(kind))))
    count = lambda c, word: F.when(c == "1", f"1 {word}").when(some(c), F.concat(c, F.lit(f" {word}s")))
    play = F.concat_ws("\n", count(players, "player"), F.when(coins == "0", "Free Play (no coin mechanism)").otherwise(count(coins, "coin slot")))
    return F.array_compact(F.array(badge("driver", "Emulation", status, some(driver)), badge("display", "Display", display, display != ""), badge("players", "Players", play, play != "")))


def owned_text(required_by: Column, satisfied: Column, redundant: Column, what: str) -> Column:
    """What a leftover that another set wants means."""
    return (
        F.when(satisfied, F.concat(F.lit(f"Duplicated {what}, not needed here (required by "), required_by, F.lit(")")))
        .when(redundant, F.concat(F.lit("Extra copy of unused content — "), required_by, F.lit(" still has no real copy")))
        .otherwise(F.concat(F.lit("Recognized content, but "), required_by, F.lit(" doesn't have it either")))
    )


def explanations(audit: DataFrame) -> DataFrame:
    """(node, text): the most specific thing that is wrong with each set, each set's disks, and each container of leftovers.

    ``audit`` has set_name, status, is_disk, is_optional, path, row_ord, and of leftovers misnamed_for (the set whose files the container holds),
    required_by (what wants the content), satisfied (that has it) and redundant, and of items found elsewhere elsewhere_name (the container's name).
    """
    own = lambda c: F.coalesce(c, F.lit(False))
    wanted = F.struct("row_ord", "required_by", own(F.col("satisfied")).alias("satisfied"), own(F.col("redundant")).alias("redundant"))
    first_wanted = F.min(F.when((F.col("status") == "incorrect") & F.col("required_by").isNotNull(), wanted))
    has = lambda *of: F.bool_or(F.col("status").isin(*of))
    rows = audit.where("set_name IS NOT NULL")
    per = rows.groupBy("set_name", "is_disk").agg(
        rollup_status(F.lit(True), audit).alias("status"), first_wanted.alias("w"), F.bool_or((F.col("status") == "incorrect") & F.col("required_by").isNull()).alias("own_problem"),
        F.count_distinct("elsewhere_name").alias("places"), F.min("elsewhere_name").alias("place"), has("unknownFile").alias("unknown"), has("surplus", "surplusInArchive").alias("extra"),
    )
    place = majority_path(rows.where("NOT is_disk AND required_by IS NULL AND elsewhere_name IS NULL")).select("set_name", file_name(F.col("path")).alias("actual"))
    expected = F.concat("set_name", F.lit(".zip"))
    disk = None
    for status, text in DISK_TEXTS.items():
        disk = F.when(F.col("status") == status, text) if disk is None else disk.when(F.col("status") == status, text)
    disk = disk.otherwise("Correct")
    fine = F.when(F.col("unknown"), "Unknown file in archive").when(F.col("extra"), "Extra file in archive").otherwise("Ok")
    wrong = (
        F.when(F.col("actual") != expected, "Bad file name")
        .when(F.col("actual").isNull() & (F.col("places") == 1) & (F.col("place") != expected), F.concat(F.lit("Bad file name — rename "), "place", F.lit(" to "), expected))
        .when(F.col("own_problem") | F.col("w").isNull(), "Rom need fix").otherwise(owned_text(F.col("w.required_by"), F.col("w.satisfied"), F.col("w.redundant"), "file"))
    )
    text = F.when(F.col("is_disk"), disk).when(F.col("status") == "incorrect", wrong)
    for status, words in SET_TEXTS.items():
        text = text.when(F.col("status") == status, words)
    sets = per.join(place, "set_name", "left").select(F.concat(F.when(F.col("is_disk"), "disk:").otherwise("set:"), "set_name").alias("node"), text.otherwise(fine).alias("text"))
    loose = audit.where("set_name IS NULL").groupBy("path").agg(F.min_by("misnamed_for", F.when(F.col("misnamed_for").isNotNull(), F.col("row_ord"))).alias("misnamed_for"), first_wanted.alias("w"))
    bucket = F.when(F.col("misnamed_for").isNotNull(), F.concat(F.lit("Bad file name — rename to "), "misnamed_for", F.lit(".zip"))).when(F.col("w").isNull(), "Unknown game").otherwise(owned_text(F.col("w.required_by"), F.col("w.satisfied"), F.col("w.redundant"), "archive"))
    return sets.unionByName(loose.select(F.concat(F.lit("path:"), F.coalesce("path", F.lit(""))).alias("node"), bucket.alias("text")))


def display_title(description: Column, name: Column) -> Column:
    """A set's description, unless that is only a serial number or empty."""
    return F.when(description.startswith("Game ID: WUP-") & (name != ""), name).otherwise(F.coalesce(filled(description), name))


def nodes_in_order(nodes: DataFrame) -> DataFrame:
    """Nodes by the lower-cased name of their file or set, and then by themselves."""
    shown = file_name(F.regexp_replace("node", "^(set|disk|path):", ""))
    return nodes.orderBy(F.lower(shown), "node")


def titles_in_order(sets: DataFrame) -> DataFrame:
    """Title sets by name without regard to case; their members already come by kind and name."""
    return sets.orderBy(F.lower("set_name"), "base_id")


def declared_sizes(items: DataFrame) -> DataFrame:
    """(set_lc, declared): bytes that each set's items have together, sets of one name in any case as one."""
    return items.groupBy(F.lower("set_name").alias("set_lc")).agg(F.sum("size").alias("declared"))


def state_tally(files: DataFrame, state: str = "state") -> DataFrame:
    """(encrypted, unflagged, total) of files whose header says a state; files without one don't count."""
    return files.where(F.col(state).isNotNull()).agg(F.count_if(F.col(state) == "encrypted").alias("encrypted"), F.count_if(F.col(state) == "decryptedFlagMissing").alias("unflagged"), F.count("*").alias("total"))


def available_updates(audit: DataFrame) -> DataFrame:
    """(n): missing items of no size that are updates by their name: newer updates than the collection has."""
    kind = names.title_kind(names.title_id(F.col("item_name")))
    return audit.where((F.col("status") == "missing") & (F.col("expected_size") == 0) & (kind == "update")).agg(F.count("*").alias("n"))


def case_mismatch(container: Column, set_name: Column) -> Column:
    """A container named like its set but for the case."""
    return (F.lower(container) == F.lower(set_name)) & (container != set_name)


def title_texts(files: DataFrame) -> DataFrame:
    """(base_id, text) of files (file_name, present): the newest update that is missing, or the newest one there is, and how many extras there are."""
    from .titles import title_files

    own = title_files(files.select("file_name")).where("tid IS NOT NULL").dropDuplicates(["file_name"]).join(files, "file_name")
    update = F.col("kind") == "update"
    newest = lambda there: F.max(F.when(update & (F.col("present") == there), F.coalesce("version", F.lit(0))))
    n = own.groupBy("base_id").agg(newest(True).alias("have"), newest(False).alias("lacks"), F.count_if((F.col("kind") == "dlc") & F.col("present")).alias("extras"))
    number = lambda v: F.when((F.col(v) > 0) & (F.col(v) % 65536 == 0), F.floor(F.col(v) / 65536).cast("string")).otherwise(F.concat(F.lit("v"), F.col(v).cast("string")))
    first = F.when(F.col("lacks").isNotNull(), F.concat(F.lit("Update "), number("lacks"), F.lit(" available ("), F.when(F.col("have").isNull(), "none installed").otherwise(F.concat(F.lit("have "), number("have"))), F.lit(")"))).when(F.col("have").isNotNull(), names.title_label(F.lit("update"), F.col("have")))
    text = F.concat_ws(" · ", first, F.when(F.col("extras") > 0, F.concat(F.col("extras").cast("string"), F.lit(" DLC"))))
    return n.select("base_id", filled(text).alias("text"))


def last_wins(df: DataFrame, key: Sequence[str], *order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))).where("__r = 1").drop("__r")
