"""Matching a catalog with an inventory: candidates by content, claims, what is left over and whose it is.

catalog rows: set_name, set_ord, item_ord, item_name, size, hashes (crc32, md5, sha1 as there are), dump_status, optional.
inventory rows: path, entry_name, size, hashes. Order is (set_ord, item_ord) and (path, entry_name); it decides who
wins, so it is part of every window and of the claim.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import file_name, os_junk, stem
from ..lineage import cut
from .claims import FILE, ITEM, claim, claim_anywhere, size_parts

HASHES = ("crc32", "md5", "sha1")


def shared_hashes(a: DataFrame, b: DataFrame) -> list[str]:
    return [h for h in HASHES if h in a.columns and h in b.columns]


def compatible(hashes: Sequence[str]) -> Column:
    """Sizes equal, and each hash equal or absent on either side (columns of the file carry the prefix f_)."""
    ok = F.col("size") == F.col("f_size")
    for h in hashes:
        ok &= F.col(h).isNull() | F.col(f"f_{h}").isNull() | (F.col(h) == F.col(f"f_{h}"))
    return ok


def prefixed(files: DataFrame, hashes: Sequence[str]) -> DataFrame:
    return files.select(*FILE, F.col("size").alias("f_size"), *[F.col(h).alias(f"f_{h}") for h in hashes])


def identities(files: DataFrame) -> DataFrame:
    """``files`` with a row for each identity: the whole content, and the content behind a header where there is one (``stripped``); via_strip tells them apart."""
    if "stripped" not in files.columns:
        return files.withColumn("via_strip", F.lit(False))
    hashes = [h for h in HASHES if h in files.columns]
    inner = files.schema["stripped"].dataType.fieldNames()
    none = F.lit(None).cast("string")
    whole = F.struct("size", *hashes, F.lit(False).alias("via_strip"))
    behind = F.struct(F.col("stripped.size").cast(files.schema["size"].dataType).alias("size"), *[(F.col(f"stripped.{h}") if h in inner else none).alias(h) for h in hashes], F.lit(True).alias("via_strip"))
    rest = [c for c in files.columns if c not in ("size", "stripped", "via_strip", *hashes)]
    each = F.explode(F.when(F.col("stripped").isNotNull(), F.array(whole, behind)).otherwise(F.array(whole)))
    return files.withColumn("__i", each).select(*rest, "__i.*")


def candidates(items: DataFrame, files: DataFrame, by_size: bool = False) -> DataFrame:
    """Item-file pairs of the first key that hits: crc32, md5, sha1, at last the size. A hit of the wrong size still stops later keys.

    One equi-join for each key, over the items that no key before has hit. Files count by all their identities.
    """
    hashes = shared_hashes(items, files)
    right = prefixed(identities(files), hashes)
    found, left = None, items
    for prio, (key, other) in enumerate([(h, f"f_{h}") for h in hashes] + ([("size", "f_size")] if by_size else []), 1):
        part = left.join(right, F.col(key) == F.col(other)).withColumn("prio", F.lit(4 if key == "size" else prio))
        found = part if found is None else found.unionByName(part)
        # Items that a key has hit ask for no later one; a hit is a value that files have, so values meet, not rows.
        left = left.join(right.select(F.col(other).alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*items.columns)
    return found.withColumn("hash_verified", F.col("prio") < 4)


def verified_pairs(items: DataFrame, files: DataFrame, by_size: bool = False) -> DataFrame:
    return candidates(items, files, by_size).where(compatible(shared_hashes(items, files)))


def with_scope(files: DataFrame) -> DataFrame:
    return files.withColumns({"in_container": file_name(F.col("path")) != F.col("entry_name"), "stem_lc": F.lower(stem(F.col("path"))), "junk": os_junk(F.col("path")) | os_junk(F.col("entry_name"))})


def scoped_pairs(items: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs of an item and a file of the container that is named like the item's set; a loose file only where the set has one item. fits: by any identity of the file."""
    hashes = shared_hashes(items, files)
    right = with_scope(identities(files)).where("NOT junk").select(*FILE, *f_prefixed(hashes), "in_container", "stem_lc")
    n = items.groupBy(F.lower("set_name").alias("set_lc")).agg(F.count("*").alias("n_items"))
    left = items.withColumn("set_lc", F.lower("set_name")).join(n, "set_lc")
    pairs = left.join(right, (F.col("set_lc") == F.col("stem_lc")) & (F.col("in_container") | (F.col("n_items") == 1)))
    return pairs.groupBy(*left.columns, *FILE, "in_container").agg(F.coalesce(F.bool_or(compatible(hashes)), F.lit(False)).alias("fits"))


def fitting(left: DataFrame, right: DataFrame, hashes: Sequence[str], keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """``left`` (keys, size, hashes, ...) with ``carry`` of the ``right`` rows (keys, f_size, f_hashes, carry) that agree on keys and are compatible.

    Equi-joins on the first hash that both sides have; where they share none the size decides, and one row for each size will do.
    ``right`` holds distinct contents, so equal files don't multiply.
    """
    mask = lambda cols: sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0))
    right = right.select(*[F.col(k).alias(f"k_{k}") for k in keys], *carry, "f_size", *[f"f_{h}" for h in hashes])
    at = F.col("size") == F.col("f_size")
    for k in keys:
        at &= F.col(k) == F.col(f"k_{k}")
    least = right.select(*[f"k_{k}" for k in keys], *carry, "f_size", mask([f"f_{h}" for h in hashes]).alias("f_mask")).distinct()
    out = left.join(least, at & (mask(hashes).bitwiseAND(F.col("f_mask")) == 0)).select(*left.columns, *carry)
    for i, h in enumerate(hashes):
        on = at & (F.col(h) == F.col(f"f_{h}"))
        for g in hashes[:i]:
            on &= F.col(g).isNull() | F.col(f"f_{g}").isNull()
        out = out.unionByName(left.join(right, on).where(compatible(hashes)).select(*left.columns, *carry))
    return out


def f_prefixed(hashes: Sequence[str]) -> list[Column]:
    return [F.col("size").alias("f_size"), *[F.col(h).alias(f"f_{h}") for h in hashes]]


def elect_containers(items: DataFrame, files: DataFrame, recent: Column | None = None, scope: DataFrame | None = None) -> DataFrame:
    """(set_lc, path, satisfied): of the containers with a set's name, the one that satisfies most items, then one outside recently scanned roots, then the first.

    Contents of a set meet contents of its containers, so there are no more rows than items and files.
    """
    hashes = shared_hashes(items, files)
    n = items.groupBy(F.lower("set_name").alias("set_lc")).agg(F.count("*").alias("n_items"))
    if scope is None:
        scope = with_scope(identities(files)).withColumn("recent", recent if recent is not None else F.lit(False))
    scope = scope.where("NOT junk").join(n, F.col("stem_lc") == F.col("set_lc")).where("in_container OR n_items = 1")
    wanted = items.groupBy(F.lower("set_name").alias("set_lc"), "size", *hashes).agg(F.count_distinct(F.struct(*ITEM)).alias("w"))
    held = scope.select("set_lc", "path", *f_prefixed(hashes)).distinct()
    met = fitting(wanted, held, hashes, ["set_lc"], ["path"]).distinct().groupBy("set_lc", "path").agg(F.sum("w").alias("satisfied"))
    paths = scope.groupBy("set_lc", "path").agg(F.bool_or("recent").alias("recent")).join(met, ["set_lc", "path"], "left").withColumn("satisfied", F.coalesce("satisfied", F.lit(0)))
    best = F.min_by(F.struct("path", "satisfied"), F.struct(-F.col("satisfied"), "recent", "path"))
    return paths.groupBy("set_lc").agg(best.alias("b")).select("set_lc", "b.path", "b.satisfied")


def homes(items: DataFrame, files: DataFrame, named: DataFrame) -> DataFrame:
    """(grp, home): the container elected for each ``grp`` of ``items`` that several of ``named`` (the files in scope, with grp) are named like; the others have one, which needs no election."""
    several = cut(named.groupBy("grp").agg(F.min("path").alias("a"), F.max("path").alias("b")).where("a <> b").select("grp"))
    rivals = cut(named.join(several, "grp", "left_semi").drop("n_items"))
    return cut(elect_containers(cut(items.join(several, "grp", "left_semi")), files, scope=rivals).select(F.col("set_lc").alias("grp"), F.col("path").alias("home")))


def first_file(df: DataFrame) -> DataFrame:
    """Each item's first file by (path, entry_name)."""
    return df.groupBy(*ITEM).agg(F.min(F.struct(*FILE)).alias("f")).select(*ITEM, "f.*")


def elsewhere(items: DataFrame, scope: DataFrame, hashes: Sequence[str]) -> DataFrame:
    """``items`` (ITEM, size, hashes, active) with the first file of their content anywhere, by the first hash that hits; for sets that aren't active outside known containers only.

    Contents meet contents: each content of the inventory keeps its first file and its first outside known containers.
    """
    here = F.when(~F.col("junk"), F.struct(*FILE))
    held = scope.groupBy(*f_prefixed(hashes)).agg(F.min(here).alias("first"), F.min(F.when(~F.col("known"), here)).alias("open"))
    wanted = items.select("size", *hashes).distinct()
    found = None
    for prio, h in enumerate(hashes):
        part = wanted.join(held, F.col(h) == F.col(f"f_{h}")).withColumn("prio", F.lit(prio))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return items.select(*ITEM, *[F.lit(None).cast("string").alias(c) for c in FILE]).limit(0)
    fits = compatible(hashes)
    each = found.groupBy("size", *hashes, "prio").agg(F.min(F.when(fits, F.col("first"))).alias("first"), F.min(F.when(fits, F.col("open"))).alias("open"))
    best = each.groupBy(*f_prefixed(hashes)).agg(F.min_by(F.struct("first", "open"), "prio").alias("b"))
    same = F.col("size").eqNullSafe(F.col("f_size"))
    for h in hashes:
        same &= F.col(h).eqNullSafe(F.col(f"f_{h}"))
    return items.join(best, same).select(*ITEM, F.when(F.col("active"), F.col("b.first")).otherwise(F.col("b.open")).alias("f")).where("f IS NOT NULL").select(*ITEM, "f.*")


def other_spellings(scope: DataFrame, items: DataFrame) -> DataFrame:
    """``scope`` with containers whose name is no set's filed under the set that an alias of it, or a variant, means; approximate marks the variants."""
    from .alternates import match_aliases, match_variants

    catalog = items.select("set_name").distinct()
    asked = scope.where("NOT known").select(stem(F.col("path")).alias("local_name")).distinct()
    alias = match_aliases(asked, catalog)
    variant = match_variants(asked.join(alias, "local_name", "left_anti"), catalog)
    met = cut(alias.withColumn("approximate", F.lit(False)).unionByName(variant.withColumn("approximate", F.lit(True))))
    met = met.select(F.col("local_name").alias("__local"), F.lower("set_name").alias("__lc"), F.col("approximate").alias("__approximate"))
    out = scope.join(met, stem(F.col("path")) == F.col("__local"), "left")
    return out.withColumns({"stem_lc": F.coalesce("__lc", "stem_lc"), "known": F.col("known") | F.col("__lc").isNotNull(), "approximate": F.coalesce("__approximate", F.lit(False))}).drop("__local", "__lc", "__approximate")


def match_items(items: DataFrame, files: DataFrame, recent: Column | None = None, spellings: bool = False, names_alone: str | None = None) -> DataFrame:
    """(set_name, set_ord, item_ord, item_name, match_status, path, entry_name, via_strip).

    One entry in any container makes the whole inventory container-organised: a set claims from its own container only. Otherwise
    all items compete for all files. ``recent`` (of files) marks those under just-rescanned roots, which are claimed last. Where files have a
    ``stripped`` identity, content behind a header counts as the file's too. ``spellings`` lets containers in that an alias or a variant of a
    set's name names; what a variant's container gives is misnamed. ``names_alone`` ("name", or "size" for its size as well, give or take a header) trusts
    an entry of an item's name, whatever its content.
    Statuses in this order: correct and misnamed (claimed), hashMismatch (the slot's name with other content), foundElsewhere (content that another place has;
    not consumed), nodump (a slot without a known dump whose name is there, in the set's container or in its parent's), missing. An undumped slot without a file has no row.
    """
    hashes = shared_hashes(items, files)
    loose = files.where(file_name(F.col("path")) != F.col("entry_name")).isEmpty()
    n = items.groupBy(F.lower("set_name").alias("stem_lc")).agg(F.count("*").alias("n_items"))
    scope = with_scope(identities(files)).withColumn("recent", F.coalesce(recent, F.lit(False)) if recent is not None else F.lit(False)).join(n, "stem_lc", "left").withColumn("known", F.col("n_items").isNotNull())
    scope = other_spellings(scope.drop("n_items"), items).join(n, "stem_lc", "left") if spellings else scope.withColumn("approximate", F.lit(False))
    scope = cut(scope.select("stem_lc", *FILE, "size", *hashes, "via_strip", "in_container", "junk", "recent", "n_items", "known", "approximate"))
    hashed = F.lit(False)
    for h in hashes:
        hashed |= F.col(h).isNotNull()
    if loose:
        items_, own = items.withColumn("grp", F.lit("")), scope.withColumn("grp", F.lit(""))
    else:
        items_ = items.withColumn("grp", F.lower("set_name"))
        named = scope.where("NOT junk AND known AND (in_container OR n_items = 1)").withColumn("grp", F.col("stem_lc"))
        own = cut(named.join(homes(items_, files, named), "grp", "left").where("home IS NULL OR path = home OR NOT in_container").drop("home"))
    two = "stripped" in files.columns
    claims = claim_anywhere(items_, own, hashes, two) if loose else claim(items_, own, hashes, size_parts(files) if two else None)
    if names_alone:
        from .alternates import match_names

        trusted = cut(match_names(items, files, names_alone == "size").withColumns({"via_strip": F.lit(False), "match_status": F.lit("correct")}))
        claims = trusted.unionByName(claims.join(trusted.select(*ITEM), list(ITEM), "left_anti").join(trusted.select(*FILE), list(FILE), "left_anti").select(*trusted.columns))
    if spellings:
        about = own.where("approximate").select(*FILE, "approximate").distinct()
        claims = claims.join(about, list(FILE), "left").withColumn("match_status", F.when(F.col("approximate"), "misnamed").otherwise(F.col("match_status"))).drop("approximate")
    claims = cut(claims)
    fits = compatible(hashes)
    # What is claimed has its status; the other ways are asked for the other items only.
    state = items_.withColumn("hashed", hashed).join(claims.groupBy(*ITEM).agg(F.min(F.struct("match_status", *FILE, "via_strip")).alias("claim")), list(ITEM), "left")
    state = cut(state.select("set_name", *ITEM, "item_name", "size", *hashes, "hashed", "grp", "claim", *[c for c in ("clone_of",) if c in items.columns]))
    done, rest = state.where("claim IS NOT NULL"), state.where("claim IS NULL")
    if loose:
        named = own.where("NOT junk").groupBy(F.col("entry_name").alias("item_name")).agg(F.min(F.struct(*FILE)).alias("f"))
        held = own.where("NOT junk").select(F.col("entry_name").alias("item_name"), *f_prefixed(hashes)).distinct()
        right = fitting(rest.select(*ITEM, "item_name", "size", *hashes), held, hashes, ["item_name"]).select(*ITEM).distinct()
        slot = rest.where("hashed").join(right, list(ITEM), "left_anti").join(named, "item_name").select(*ITEM, "f.*", F.lit("hashMismatch").alias("match_status"), F.lit(1).alias("prio"))
        active = rest.select(*ITEM, "size", *hashes).withColumn("active", F.lit(True))
    else:
        slot = rest.join(own.select(F.col("grp").alias("f_grp"), *FILE, *f_prefixed(hashes)), (F.col("grp") == F.col("f_grp")) & (F.col("item_name") == F.col("entry_name"))).join(claims.select(*FILE), list(FILE), "left_anti")
        slot = slot.groupBy(*ITEM, *FILE).agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("fits"), F.bool_or("hashed").alias("hashed"))
        if "clone_of" in items.columns:
            parent = scope.where("in_container AND NOT junk").select(F.col("stem_lc").alias("parent_lc"), *FILE).distinct()
            far = rest.where("NOT hashed AND clone_of IS NOT NULL").select(*ITEM, F.lower("clone_of").alias("parent_lc"), F.col("item_name").alias("entry_name")).join(parent, ["parent_lc", "entry_name"])
            slot = slot.unionByName(far.select(*ITEM, *FILE, F.lit(False).alias("fits"), F.lit(False).alias("hashed")).join(claims.select(*FILE), list(FILE), "left_anti"))
        # Of an item with a hash those files count that don't fit, of one without all.
        slot = slot.where("NOT (hashed AND fits)").groupBy(*ITEM).agg(F.min_by(F.struct(*FILE, "hashed"), F.struct(~F.col("hashed"), *FILE)).alias("f")).select(*ITEM, "f.*")
        slot = slot.select(*ITEM, *FILE, F.when(F.col("hashed"), "hashMismatch").otherwise("nodump").alias("match_status"), F.when(F.col("hashed"), 1).otherwise(3).alias("prio"))
        met = done.select("grp").distinct().withColumn("active", F.lit(True))
        active = rest.join(met, "grp", "left").select(*ITEM, "size", *hashes, F.coalesce("active", F.lit(False)).alias("active"))
    far = elsewhere(active, scope, hashes).withColumns({"match_status": F.lit("foundElsewhere"), "prio": F.lit(2)})
    best = slot.unionByName(far).groupBy(*ITEM).agg(F.min_by(F.struct("match_status", *FILE, F.lit(False).alias("via_strip")), "prio").alias("m"))
    rest = rest.join(best, list(ITEM), "left").where("m IS NOT NULL OR hashed")
    out = done.select("set_name", *ITEM, "item_name", F.col("claim").alias("m")).unionByName(rest.select("set_name", *ITEM, "item_name", "m"))
    return cut(out.select("set_name", *ITEM, "item_name", F.coalesce("m.match_status", F.lit("missing")).alias("match_status"), "m.path", "m.entry_name", F.coalesce("m.via_strip", F.lit(False)).alias("via_strip")))


def leftovers(matches: DataFrame, files: DataFrame) -> DataFrame:
    """Files that no item consumed and that no mismatch reports."""
    used = matches.where("match_status IN ('correct', 'misnamed', 'hashMismatch', 'nodump')").select(*FILE)
    return cut(files.join(used, list(FILE), "left_anti"))


def hash_rows(df: DataFrame, hashes: Sequence[str]) -> DataFrame:
    """One row for each hash that a row has: (..., kind, hash)."""
    pairs = F.array(*[F.struct(F.lit(h).alias("kind"), F.col(h).alias("hash")) for h in hashes])
    return df.withColumn("__h", F.explode(pairs)).select(*df.columns, "__h.kind", "__h.hash").where("hash IS NOT NULL")


def owners(left: DataFrame, items: DataFrame) -> DataFrame:
    """``left`` with owner: the first set that wants a leftover's content, else its name, else the single-item set named like its container."""
    hashes = shared_hashes(items, left)
    want = hash_rows(items.select("set_name", *ITEM, *hashes), hashes).groupBy("kind", "hash").agg(F.min_by("set_name", F.struct(*ITEM)).alias("owner"))
    rank = F.create_map(*[x for i, h in enumerate(hashes) for x in (F.lit(h), F.lit(i))])
    by_hash = hash_rows(identities(left).select(*FILE, "via_strip", *hashes), hashes).join(want, ["kind", "hash"]).groupBy(*FILE).agg(F.min_by("owner", F.struct(rank[F.col("kind")], "via_strip")).alias("by_hash"))
    by_name = items.groupBy(F.lower("item_name").alias("name_lc")).agg(F.min_by("set_name", F.struct(*ITEM)).alias("by_name"))
    single = items.groupBy(F.lower("set_name").alias("stem_lc")).agg(F.count("*").alias("n"), F.first("set_name").alias("by_container")).where("n = 1").drop("n")
    out = left.join(by_hash, list(FILE), "left").withColumns({"name_lc": F.lower("entry_name"), "stem_lc": F.lower(stem(F.col("path")))}).join(by_name, "name_lc", "left").join(single, "stem_lc", "left")
    return cut(out.select(*left.columns, F.coalesce("by_hash", "by_name", "by_container").alias("owner")))


def leftover_flags(left: DataFrame, matches: DataFrame, items: DataFrame) -> DataFrame:
    """Owned leftovers with redundant, copy_of (path of an earlier leftover of equal content in another container), nodump_name, known_container."""
    hashes = shared_hashes(items, left)
    met = matches.where("match_status IN ('correct', 'misnamed')").select(*ITEM).join(items, list(ITEM))
    satisfied = hash_rows(met.select(F.col("set_name").alias("owner"), *hashes), hashes).select("owner", "hash").distinct()
    redundant = hash_rows(identities(left).select(*FILE, "owner", *hashes), hashes).join(satisfied, ["owner", "hash"], "left_semi").select(*FILE).distinct().withColumn("r", F.lit(True))
    each = hash_rows(left.select(*FILE, *hashes), hashes)
    # A hash that one leftover has alone has no earlier one; the first of each other hash is a partial minimum, so a frequent hash makes no large group.
    first = each.groupBy("kind", "hash").agg(F.min("path").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = each.join(first, ["kind", "hash"]).where("first < path").groupBy(*FILE).agg(F.min("first").alias("copy_of"))
    nodump = items.where("dump_status = 'nodump'").select(F.lower("item_name").alias("name_lc")).distinct().withColumn("d", F.lit(True))
    known = items.select(F.lower("set_name").alias("stem_lc")).distinct().withColumn("k", F.lit(True))
    out = left.join(redundant, list(FILE), "left").join(copies, list(FILE), "left").withColumns({"name_lc": F.lower("entry_name"), "stem_lc": F.lower(stem(F.col("path")))}).join(nodump, "name_lc", "left").join(known, "stem_lc", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return cut(out.select(*left.columns, yes("r").alias("redundant"), "copy_of", yes("d").alias("nodump_name"), yes("k").alias("known_container")))


def misnamed_containers(left: DataFrame, items: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """(path, suggested): containers of which the leftovers hold three fifths of one set's items, of exactly one set.

    A loose file counts for a set of one item only. A container that is named like a set keeps that name, unless ``matches`` shows that nothing of its own set is claimed from it, and
    the other set has one item and has claimed no file yet.
    """
    known = items.select(F.lower("set_name").alias("stem_lc")).distinct().withColumn("known", F.lit(True))
    n = items.groupBy(F.lower("set_name").alias("owner_lc")).agg(F.count("*").alias("n_items"), F.min("set_name").alias("suggested"))
    loose = file_name(F.col("path")) == F.col("entry_name")
    rows = left.where("owner IS NOT NULL").withColumns({"stem_lc": F.lower(stem(F.col("path"))), "owner_lc": F.lower("owner"), "loose": loose}).join(n, "owner_lc").where("NOT loose OR n_items = 1")
    held = rows.groupBy("path", "stem_lc", "owner_lc").agg(F.count("*").alias("n"), F.first("n_items").alias("n_items"), F.first("suggested").alias("suggested"))
    fit = held.where("n * 5 >= n_items * 3").groupBy("path", "stem_lc").agg(F.count("*").alias("k"), *[F.min(c).alias(c) for c in ("owner_lc", "suggested", "n_items")]).where("k = 1")
    fit = fit.join(known, "stem_lc", "left")
    if matches is None:
        return fit.where("known IS NULL").select("path", "suggested")
    met = matches.where("match_status IN ('correct', 'misnamed')").select(F.lower("set_name").alias("set_lc"), "path").distinct()
    own = met.select(F.col("set_lc").alias("stem_lc"), "path", F.lit(True).alias("its_own"))
    has = met.select(F.col("set_lc").alias("owner_lc"), F.lit(True).alias("has_some")).distinct()
    fit = fit.join(own, ["stem_lc", "path"], "left").join(has, "owner_lc", "left")
    return fit.where("known IS NULL OR (n_items = 1 AND owner_lc <> stem_lc AND has_some IS NULL AND its_own IS NULL)").select("path", "suggested")


def redundant_containers(left: DataFrame, files: DataFrame) -> DataFrame:
    """Containers all of whose entries are redundant leftovers."""
    n = files.groupBy("path").agg(F.count("*").alias("n"))
    r = left.where("redundant").groupBy("path").agg(F.count("*").alias("r"))
    return n.join(r, "path").where("n = r").select("path", "n")


def emptied_containers(left: DataFrame, files: DataFrame) -> DataFrame:
    """Containers that clean-up would empty: no entry but system junk is claimed, and all of them are leftovers without an owner."""
    own = with_scope(files).where("in_container AND NOT junk").groupBy("path").agg(F.count("*").alias("n"))
    go = with_scope(left).where("in_container AND NOT junk AND owner IS NULL AND NOT nodump_name").groupBy("path").agg(F.count("*").alias("go"))
    return own.join(go, "path").where("n = go").select("path")


def to_audit(matches: DataFrame, left: DataFrame, items: DataFrame) -> DataFrame:
    """The audit rows of a match: set_name, item_name, status, dump_status, is_optional, path, entry_name."""
    attrs = items.select(*ITEM, F.coalesce("optional", F.lit(False)).alias("is_optional"), "dump_status")
    status = F.when(F.col("match_status") == "nodump", "unverifiable").when(F.col("match_status").isin("misnamed", "foundElsewhere"), "incorrect").when(F.col("match_status") == "hashMismatch", "badDump").otherwise(F.col("match_status"))
    rows = matches.join(attrs, list(ITEM)).select("set_name", "item_name", status.alias("status"), "dump_status", "is_optional", "path", "entry_name")
    kind = F.when(F.col("owner").isNotNull(), "incorrect").when(F.col("nodump_name"), "unverifiable").when(F.col("known_container"), "surplusInArchive").otherwise("unknownFile")
    rest = left.select(F.lit(None).cast("string").alias("set_name"), F.col("entry_name").alias("item_name"), kind.alias("status"), F.lit(None).cast("string").alias("dump_status"), F.lit(False).alias("is_optional"), "path", "entry_name")
    return rows.unionByName(rest)
