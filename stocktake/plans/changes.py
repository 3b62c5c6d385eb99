"""Change plans: rows of (op, group_id, step, source, source_entry, target, target_entry). Nothing is carried out.

A row's target must be free: plans pass ``reservation.granted``, which leaves out targets that a file keeps, and of two rows to one target all but the
first. ``reservation.reserve`` gives the refused rows as well, with a reason, and takes the rows of several plans together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension, file_name, folder, keep_layout_extension, os_junk, protected, safe_component, stem, under, with_case
from ..lineage import cut
from ..operators.match import HASHES, ITEM, hash_rows, shared_hashes
from .reservation import COLUMNS, granted, place, reserve


def plan(df: DataFrame, op: str, group: Column, source: Column, target: Column, source_entry: Column | None = None, target_entry: Column | None = None, step: int = 0) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.lit(op).alias("op"), group.cast("string").alias("group_id"), F.lit(step).alias("step"), source.cast("string").alias("source"), (source_entry if source_entry is not None else none).alias("source_entry"), target.cast("string").alias("target"), (target_entry if target_entry is not None else none).alias("target_entry"))


def rename_containers(suggested: DataFrame, files: DataFrame) -> DataFrame:
    """Containers that belong to another set (path, suggested) take its name, where that is free."""
    return granted(plan(suggested, "rename", F.col("path"), F.col("path"), beside(F.col("path"), F.col("suggested"))), files)


def beside(path: Column, name: Column) -> Column:
    """``name`` in the path's folder, with its extension."""
    ext = F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1)
    return F.concat(folder(path), F.lit("/"), name, ext)


def rename_files(matches: DataFrame, items: DataFrame, suggested: DataFrame, files: DataFrame, near: DataFrame | None = None, least: float = 0.9) -> DataFrame:
    """All renames of files, in five phases: misnamed loose files, the container of a one-item set whose item is misnamed, containers that belong to
    another set (path, suggested), files of a near name (path, set_name, score of ``least`` or more), and sets' own containers of a wrong name.

    A phase sees the paths as the phases before leave them: what they free may be taken, what they take is taken. A path is renamed once. Within a phase, files
    may take each other's names: step orders such chains, and circles go by a temporary name.
    """
    loose = file_name(F.col("path")) == F.col("entry_name")
    met = matches.where("match_status IN ('correct', 'misnamed')")
    one = items.groupBy("set_name").agg(F.count("*").alias("n")).where("n = 1").select("set_name")
    inside = met.where(~loose)
    phases = [
        met.where(loose & (F.col("match_status") == "misnamed")).select("path", F.concat(folder(F.col("path")), F.lit("/"), keep_layout_extension(F.col("path"), F.col("item_name"))).alias("target")),
        inside.where("match_status = 'misnamed'").join(one, "set_name", "left_semi").where(F.lower(stem(F.col("path"))) != F.lower("set_name")).select("path", beside(F.col("path"), F.col("set_name")).alias("target")),
        suggested.select("path", beside(F.col("path"), F.col("suggested")).alias("target")),
        near.where(F.col("score") >= least).select("path", beside(F.col("path"), F.col("set_name")).alias("target")) if near is not None else None,
        inside.select("path", beside(F.col("path"), F.col("set_name")).alias("target")).distinct(),
    ]
    taken, done, begins = files.select(place(F.col("path")).alias("place")), None, 0
    for rows in phases:
        if rows is not None:
            rows = rows.where("path <> target").groupBy("path").agg(F.min("target").alias("target"))
            if done is not None:
                rows = rows.join(done.select(F.col("source").alias("path")), "path", "left_anti")
            rows = cut(rows)
            # A phase without rows changes nothing.
            if not rows.isEmpty():
                part = cut(reserve(plan(rows, "rename", F.col("path"), F.col("path"), F.col("target")), taken).where("refused IS NULL"))
                kept = part.where("NOT temporary").select(place(F.col("target")).alias("place"))
                taken = taken.join(part.select(place(F.col("source")).alias("place")), "place", "left_anti").unionByName(kept)
                steps = part.select(*[F.col(c) if c != "step" else (F.col("turn") + begins).alias("step") for c in COLUMNS])
                done = steps if done is None else done.unionByName(steps)
                begins += part.agg(F.max("turn")).first()[0] or 0
        begins += 1
    return done if done is not None else plan(files.limit(0), "rename", F.col("path"), F.col("path"), F.col("path"))


def rename_outcomes(suggested: DataFrame, files: DataFrame) -> DataFrame:
    """(path, outcome) of every container: rename, collides, already correct, or none."""
    asked = cut(suggested.select("path", "suggested", beside(F.col("path"), F.col("suggested")).alias("target")).withColumn("t", F.lower("target")))
    occupied = files.select(F.lower("path").alias("t")).join(asked.select("t"), "t", "left_semi").distinct().withColumn("there", F.lit(True))
    rows = files.select("path").distinct().join(asked.join(occupied, "t", "left"), "path", "left")
    return rows.select("path", F.when(F.col("suggested").isNull(), "none").when(F.col("target") == F.col("path"), "already correct").when(F.col("there"), "collides").otherwise("rename").alias("outcome"))


def rename_entries(matches: DataFrame, left: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """Entries of containers that get their item's name: misnamed ones; correct ones of another base name, where no other entry has the new name;
    and with ``left`` and ``items`` owned leftovers whose content is an item of their owner, or its only item.

    One row adds the right name, the next removes the wrong one; a pair shares its group.
    """
    inside = file_name(F.col("path")) != F.col("entry_name")
    rows = matches.where("match_status = 'misnamed'").where(inside).select("path", "entry_name", "item_name")
    other = matches.where("match_status = 'correct'").where(inside & (F.lower(stem(F.col("entry_name"))) != F.lower(stem(F.col("item_name")))) & ~F.col("entry_name").startswith("._")).select("path", "entry_name", "item_name")
    if left is not None and items is not None:
        other = other.withColumn("lc", F.lower("item_name")).join(left.select("path", F.lower("entry_name").alias("lc")), ["path", "lc"], "left_anti").drop("lc")
        rows = rows.unionByName(other).unionByName(owned_entries(left.where(inside), items))
    else:
        rows = rows.unionByName(other)
    rows = rows.withColumn("want", keep_layout_extension(F.col("entry_name"), F.col("item_name"))).where("want <> entry_name").dropDuplicates(["path", "entry_name"])
    group = F.concat("path", F.lit("::"), "entry_name")
    add = plan(rows, "add_entry", group, F.col("path"), F.col("path"), F.col("entry_name"), F.col("want"), 0)
    return add.unionByName(plan(rows, "remove_entry", group, F.col("path"), F.lit(None), F.col("entry_name"), None, 1))


def owned_entries(left: DataFrame, items: DataFrame) -> DataFrame:
    """(path, entry_name, item_name) of owned leftovers: the first of the owner's items that has one of their hashes, else the owner's only item."""
    hashes = shared_hashes(items, left)
    own = left.where("owner IS NOT NULL").select("path", "entry_name", F.col("owner").alias("set_name"), *hashes)
    want = hash_rows(items.select("set_name", "item_ord", "item_name", *hashes), hashes).groupBy("set_name", "kind", "hash").agg(F.min(F.struct("item_ord", "item_name")).alias("i"))
    by_hash = hash_rows(own, hashes).join(want, ["set_name", "kind", "hash"]).groupBy("path", "entry_name").agg(F.min("i").alias("i"))
    single = items.groupBy("set_name").agg(F.count("*").alias("n"), F.min("item_name").alias("only")).where("n = 1")
    met = own.join(by_hash, ["path", "entry_name"], "left").join(single, "set_name", "left")
    return met.select("path", "entry_name", F.coalesce("i.item_name", "only").alias("item_name")).where("item_name IS NOT NULL")


def rebuild_to_folder(matches: DataFrame, target: str, files: DataFrame, move: bool = False) -> DataFrame:
    """Every claimed file to target/set/item: entries of zip containers are extracted, loose files copied or moved; of items that would get one name the first does."""
    rows = matches.where("match_status IN ('correct', 'misnamed')")
    where = F.concat(F.lit(target.rstrip("/") + "/"), safe_component(F.col("set_name")), F.lit("/"), safe_component(F.col("item_name")))
    loose = file_name(F.col("path")) == F.col("entry_name")
    inside = plan(rows.where(~loose & (extension(F.col("path")) == "zip")), "extract", F.col("set_name"), F.col("path"), where, F.col("entry_name"))
    return granted(inside.unionByName(plan(rows.where(loose), "move" if move else "copy", F.col("set_name"), F.col("path"), where)), files)


def rebuild_containers(matches: DataFrame, target: str) -> DataFrame:
    """(set_name, target, entries): one container for each set, entries as source::entry>name in catalog order."""
    rows = matches.where("match_status IN ('correct', 'misnamed')")
    entry = F.struct(*ITEM, F.concat("path", F.lit("::"), "entry_name", F.lit(">"), "item_name").alias("e"))
    out = rows.groupBy("set_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), "|").alias("entries"))
    return out.select("set_name", F.concat(F.lit(target.rstrip("/") + "/"), "set_name", F.lit(".zip")).alias("target"), "entries")


def companion_kept(files: DataFrame) -> DataFrame:
    """Item files that lie beside a .msu file of their name."""
    base = F.concat(folder(F.col("path")), F.lit("/"), stem(F.col("path")))
    flag = files.where(extension(F.col("path")) == "msu").select(base.alias("base")).distinct()
    return files.where(extension(F.col("path")).isin("sfc", "smc", "swc", "fig")).withColumn("base", base).join(flag, "base", "left_semi").drop("base")


def remove_useless(left: DataFrame, files: DataFrame, emptied: DataFrame, suggested: DataFrame | None = None) -> DataFrame:
    """Leftovers that nothing explains: no owner, no undumped slot's name, readable, not protected, of no ``suggested`` (path) name, and not the last of a container."""
    rows = left.where("owner IS NULL AND NOT nodump_name").where(~protected(F.col("path"))).join(companion_kept(files).select("path", "entry_name"), ["path", "entry_name"], "left_anti").join(emptied.select("path"), "path", "left_anti")
    if "read_state" in rows.columns:
        rows = rows.where("read_state = 'ok'")
    if suggested is not None:
        rows = rows.join(suggested.select("path").distinct(), "path", "left_anti")
    loose = file_name(F.col("path")) == F.col("entry_name")
    return plan(rows.where(loose), "remove", F.col("path"), F.col("path"), F.lit(None)).unionByName(plan(rows.where(~loose), "remove_entry", F.col("path"), F.col("path"), F.lit(None), F.col("entry_name")))


def remove_redundant(left: DataFrame, containers: DataFrame, disks: DataFrame | None = None) -> DataFrame:
    """Redundant leftovers: whole containers where all entries are, single entries and loose files elsewhere, and disk files (path, redundant)."""
    containers = cut(containers.select("path"))
    rows = left.where("redundant").join(containers, "path", "left_anti")
    loose = file_name(F.col("path")) == F.col("entry_name")
    whole = plan(containers, "remove_container", F.col("path"), F.col("path"), F.lit(None))
    out = whole.unionByName(plan(rows.where(loose), "remove", F.col("path"), F.col("path"), F.lit(None))).unionByName(plan(rows.where(~loose), "remove_entry", F.col("path"), F.col("path"), F.lit(None), F.col("entry_name")))
    return out if disks is None else out.unionByName(plan(disks.where("redundant"), "remove_disk", F.col("path"), F.col("path"), F.lit(None)))


def anchors(matches: DataFrame) -> DataFrame:
    """(set_name, anchor, is_folder): where a set's items go: the zip container of its first matched item that lies in one or is loose, or the loose item's folder."""
    rows = matches.where("match_status IN ('correct', 'misnamed')").withColumn("is_folder", file_name(F.col("path")) == F.col("entry_name"))
    rows = rows.where(F.col("is_folder") | (extension(F.col("path")) == "zip"))
    first = rows.groupBy("set_name").agg(F.min_by(F.struct("path", "is_folder"), F.struct(*ITEM)).alias("a"))
    return first.select("set_name", F.when(F.col("a.is_folder"), folder(F.col("a.path"))).otherwise(F.col("a.path")).alias("anchor"), "a.is_folder")


def into_anchors(rows: DataFrame, matches: DataFrame, op: str, source: str, source_entry: str, files: DataFrame) -> DataFrame:
    """Rows (set_name, item_name, source, ...) as operations: an entry of the set's container, or a file in its folder."""
    met = rows.join(anchors(matches), "set_name")
    to = F.when(F.col("is_folder"), F.concat("anchor", F.lit("/"), safe_component(F.col("item_name")))).otherwise(F.col("anchor"))
    return granted(plan(met, op, F.col("set_name"), F.col(source), to, F.col(source_entry), F.when(~F.col("is_folder"), F.col("item_name"))), files)


def repair(matches: DataFrame, donors: DataFrame, op: str, statuses: tuple[str, ...], files: DataFrame) -> DataFrame:
    """Items of some statuses, filled from donors (set_ord, item_ord, donor_path, donor_entry), into their set's anchor."""
    rows = matches.where(F.col("match_status").isin(*statuses)).select("set_name", *ITEM, "item_name").join(donors, list(ITEM))
    return into_anchors(rows, matches, op, "donor_path", "donor_entry", files)


def matched_content(matches: DataFrame, items: DataFrame, families: DataFrame) -> DataFrame:
    """Matched items (set_name, family, set_ord, item_ord, item_name, size, hash, path, entry_name) with the first hash that they declare."""
    hashes = [h for h in HASHES if h in items.columns]
    fam = families.select("set_name", F.coalesce("clone_of", "set_name").alias("family"))
    own = items.select("set_name", *ITEM, "item_name", "size", F.coalesce(*[F.concat(F.lit(f"{h}:"), h) for h in hashes]).alias("hash"))
    return matches.where("match_status IN ('correct', 'misnamed')").select(*ITEM, "path", "entry_name").join(own, list(ITEM)).join(fam, "set_name")


def cross_set_repair(matches: DataFrame, items: DataFrame, families: DataFrame, files: DataFrame) -> DataFrame:
    """Missing items filled from a set of the same family that has their content matched, into their set's anchor."""
    have = matched_content(matches, items, families).where("hash IS NOT NULL")
    first = have.groupBy("family", "size", "hash").agg(F.min(F.struct(*ITEM, "path", "entry_name")).alias("d"))
    hashes = [h for h in HASHES if h in items.columns]
    fam = families.select("set_name", F.coalesce("clone_of", "set_name").alias("family"))
    gone = matches.where("match_status = 'missing'").select("set_name", *ITEM, "item_name").join(items.select(*ITEM, "size", F.coalesce(*[F.concat(F.lit(f"{h}:"), h) for h in hashes]).alias("hash")), list(ITEM)).join(fam, "set_name")
    rows = gone.join(first, ["family", "size", "hash"]).where("d.set_ord <> set_ord").select("set_name", "item_name", F.col("d.path").alias("donor_path"), F.col("d.entry_name").alias("donor_entry"))
    return into_anchors(rows, matches, "fill", "donor_path", "donor_entry", files)


def parent_content(matches: DataFrame, items: DataFrame, families: DataFrame) -> DataFrame:
    """(clone_of, size, hash): what parents have matched."""
    parents = families.where("clone_of IS NULL").select("set_name")
    return matched_content(matches, items, families).join(parents, "set_name", "left_semi").where("hash IS NOT NULL").select(F.col("set_name").alias("clone_of"), "size", "hash").distinct()


def convert_to_split(matches: DataFrame, items: DataFrame, families: DataFrame) -> DataFrame:
    """Entries of variants' containers go where the parent has the content matched."""
    rows = matched_content(matches, items, families).where(extension(F.col("path")) == "zip").where(file_name(F.col("path")) != F.col("entry_name"))
    rows = rows.join(families.where("clone_of IS NOT NULL").select("set_name", "clone_of"), "set_name").join(parent_content(matches, items, families), ["clone_of", "size", "hash"], "left_semi")
    return plan(rows, "remove_entry", F.col("set_name"), F.col("path"), F.lit(None), F.col("entry_name"))


def convert_to_merged(matches: DataFrame, items: DataFrame, families: DataFrame, left: DataFrame) -> DataFrame:
    """A variant's container is emptied into its parent's and goes: one group for each variant, moves first.

    Left alone are containers with leftovers, with an undumped or mismatched slot, and families whose parent has no container.
    """
    zip_anchor = anchors(matches).where("NOT is_folder").drop("is_folder")
    fam = families.where("clone_of IS NOT NULL").select("set_name", "clone_of").join(zip_anchor.select(F.col("set_name").alias("clone_of"), F.col("anchor").alias("into")), "clone_of")
    unsafe = matches.where("match_status IN ('hashMismatch', 'nodump')").select("set_name", F.col("path").alias("anchor")).distinct()
    each = zip_anchor.join(fam, "set_name").where("anchor <> into").join(left.select(F.col("path").alias("anchor")).distinct(), "anchor", "left_anti").join(unsafe, ["set_name", "anchor"], "left_anti")
    each = cut(each.select("set_name", "clone_of", "anchor", "into"))
    rows = matched_content(matches, items, families).join(each, "set_name").where("path = anchor").join(parent_content(matches, items, families), ["clone_of", "size", "hash"], "left_anti")
    move = plan(rows, "add_entry", F.col("set_name"), F.col("path"), F.col("into"), F.col("entry_name"), F.col("item_name"), 0)
    return move.unionByName(plan(each, "remove_container", F.col("set_name"), F.col("anchor"), F.lit(None), step=1))


def corrupt_entries(matches: DataFrame, conflicts: DataFrame, policy: str, quarantine: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Correct entries whose container states another checksum than their own header (path, entry_name): left, deleted, or moved to a folder and then deleted.

    An entry whose place in the folder another one gets, or one of ``files`` has, stays where it is.
    """
    if policy == "none" or (policy == "quarantine" and quarantine is None):
        return plan(matches.limit(0), "none", F.col("path"), F.col("path"), F.lit(None))
    if policy not in ("delete", "quarantine"):
        raise ValueError(f"{policy!r} is none of none, delete, quarantine")
    rows = matches.where("match_status = 'correct'").where((extension(F.col("path")) == "zip") & (file_name(F.col("path")) != F.col("entry_name"))).join(conflicts.select("path", "entry_name").distinct(), ["path", "entry_name"], "left_semi")
    group = F.concat("path", F.lit("::"), "entry_name")
    go = plan(rows, "remove_entry", group, F.col("path"), F.lit(None), F.col("entry_name"), None, 1)
    if policy == "delete":
        return go
    to = F.concat(F.lit(quarantine.rstrip("/") + "/"), safe_component(F.coalesce("set_name", F.lit("unknown"))), F.lit("_"), safe_component(F.col("entry_name")))
    return granted(plan(rows, "extract", group, F.col("path"), to, F.col("entry_name"), None, 0).unionByName(go), files if files is not None else matches.select("path", "entry_name"))


def remove_comments(matches: DataFrame, left: DataFrame, entries: DataFrame) -> DataFrame:
    """Zip containers of matched files or leftovers that carry a comment (path, comment) lose it."""
    known = matches.where("match_status IN ('correct', 'misnamed')").select("path").unionByName(left.select("path")).where(extension(F.col("path")) == "zip").distinct()
    rows = entries.where("comment IS NOT NULL").select("path").distinct().join(known, "path", "left_semi")
    return plan(rows, "clear_comment", F.col("path"), F.col("path"), F.lit(None))


def collect_samples(samples: DataFrame, folder_: str, files: DataFrame) -> DataFrame:
    """Sample containers (sample_set, path) are copied to a folder under their set's name, where that is free."""
    return granted(plan(samples, "copy", F.col("sample_set"), F.col("path"), F.concat(F.lit(folder_.rstrip("/") + "/"), safe_component(F.col("sample_set")), F.lit(".zip"))), files)


def organise(matches: DataFrame, left: DataFrame, sets: DataFrame, folder_: str, files: DataFrame) -> DataFrame:
    """Files of the given ``sets`` (base sets, or components) move to a folder; redundant leftovers that they own go. Of files of one name the first moves, the others stay."""
    of = sets.select("set_name").distinct()
    rows = matches.where("match_status IN ('correct', 'misnamed', 'hashMismatch')").join(of, "set_name", "left_semi").select("set_name", "path").distinct().where(folder(F.col("path")) != folder_.rstrip("/"))
    move = plan(rows, "move", F.col("set_name"), F.col("path"), F.concat(F.lit(folder_.rstrip("/") + "/"), file_name(F.col("path"))))
    gone = left.where("redundant").join(of.select(F.col("set_name").alias("owner")), "owner", "left_semi")
    loose = file_name(F.col("path")) == F.col("entry_name")
    gone = gone.where((extension(F.col("path")) == "zip") | loose)
    return granted(move, files).unionByName(plan(gone.where(loose), "remove", F.col("owner"), F.col("path"), F.lit(None))).unionByName(plan(gone.where(~loose), "remove_entry", F.col("owner"), F.col("path"), F.lit(None), F.col("entry_name")))


def organise_preview(moves: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_name, text) of an ``organise`` plan: what moves, and how many duplicate copies go."""
    n = moves.groupBy(F.col("group_id").alias("set_name")).agg(F.count_if(F.col("op") == "move").alias("moved"), F.count_if(F.col("op") != "move").alias("copies"))
    told = F.concat_ws("; ", F.when(F.col("moved") == 1, "move").when(F.col("moved") > 1, F.format_string("move %d files", "moved")), F.when(F.col("copies") == 1, "1 duplicate copy removed").when(F.col("copies") > 1, F.format_string("%d duplicate copies removed", "copies")))
    about = sets.groupBy("set_name").agg(F.first("description", ignorenulls=True).alias("description"))
    return n.join(about, "set_name", "left").select("set_name", F.concat("set_name", F.lit(" — "), F.coalesce("description", "set_name"), F.lit(" ("), told, F.lit(")")).alias("text"))


def consolidate(matches: DataFrame, files: DataFrame) -> DataFrame:
    """What is found elsewhere is copied to its set's anchor."""
    return into_anchors(matches.where("match_status = 'foundElsewhere'"), matches, "copy_entry", "path", "entry_name", files)


def case_policy(matches: DataFrame, policy: str) -> DataFrame:
    """Claimed loose files and entries whose name has another case than the policy's."""
    rows = matches.where("match_status = 'correct'").withColumn("want", with_case(F.col("entry_name"), policy, F.col("item_name"))).where("want <> entry_name")
    return plan(rows, "rename_entry", F.col("path"), F.col("path"), F.col("path"), F.col("entry_name"), F.col("want"))


def placeholders(items: DataFrame, matches: DataFrame, target: str) -> DataFrame:
    """Undumped slots that no file fills."""
    rows = items.where("dump_status = 'nodump'").join(matches.select("set_ord", "item_ord"), ["set_ord", "item_ord"], "left_anti")
    return plan(rows, "placeholder", F.col("set_name"), F.lit(None), F.concat(F.lit(target.rstrip("/") + "/"), "set_name", F.lit("/"), "item_name"))


def protected_leftovers(left: DataFrame) -> DataFrame:
    return left.where("owner IS NULL AND NOT nodump_name").where(protected(F.col("path")) & ~os_junk(F.col("path"))).select("path", "entry_name")


def restrict(plan_rows: DataFrame, roots: list[str]) -> DataFrame:
    """Whole groups of which a source lies under one of the roots. Rows that add and remove an entry are one group; other kinds don't share theirs."""
    inside = F.lit(False)
    for root in roots:
        inside |= F.coalesce(under(F.col("source"), F.lit(root)), F.lit(False))
    kind = F.when(F.col("op").isin("add_entry", "remove_entry", "remove_container", "extract"), "entries").otherwise(F.col("op"))
    rows = plan_rows.withColumn("__kind", kind)
    kept = rows.where(inside).select(F.col("group_id").alias("__g"), F.col("__kind").alias("__k")).distinct()
    return rows.join(kept, F.col("group_id").eqNullSafe(F.col("__g")) & (F.col("__kind") == F.col("__k")), "left_semi").drop("__kind")


def in_order(plan_rows: DataFrame) -> DataFrame:
    """The plan in the order that it is read in: by group, step and path."""
    return plan_rows.orderBy("group_id", "step", "source", "source_entry", "target", "target_entry", "op")


def preview(*plans: DataFrame) -> DataFrame:
    rows = plans[0]
    for p in plans[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("op").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("groups"))
