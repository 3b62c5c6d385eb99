"""Claims: one file for each item at most and the other way round, as a reader of the catalog would hand them out.

Items come in catalog order, those of a set without a dump last. An item takes a file of its own name before another, one outside
recently scanned roots before another, then the first by (path, entry_name). So a claim depends on those before it, but only among rows that
can meet: of one size, with equal or absent hashes, or two identities of one file. ``claim_anywhere`` finds out who can meet, and settles the groups apart.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

ITEM = ("set_ord", "item_ord")
FILE = ("path", "entry_name")
ORDER = ("set_ord", "late", "item_ord")
#: Files of a size are searched for what undumped items may take in parts of so many.
PART = 100_000
#: So many links of sizes or contents are joined in the driver, at most.
FEW_LINKS = 10_000
CLAIMS = "set_ord long, item_ord long, path string, entry_name string, via_strip boolean, match_status string"


class Pool:
    """The free files of one claim group, by their identities and by name; the first compatible one is found without going through the others."""

    def __init__(self, n_hashes: int):
        self.kinds = range(n_hashes)
        self.files: list[tuple[str, str]] = []
        self.taken: list[bool] = []
        self.found: dict[tuple, deque[tuple[int, bool]]] = {}
        self.masks: set[int] = set()

    def put(self, path: str, name: str, recent: bool, size: int, hashes: Sequence[str | None], via: bool) -> None:
        if not self.files or self.files[-1] != (path, name):  # a file's identities come one after the other
            self.files.append((path, name))
            self.taken.append(False)
        at = len(self.files) - 1
        mask = sum(1 << k for k in self.kinds if hashes[k] is not None)
        self.masks.add(mask)
        some = mask
        while True:  # all subsets of the hashes that the file has
            shared = tuple(hashes[k] for k in self.kinds if some >> k & 1)
            for n in (name, None):
                self.found.setdefault((size, mask, some, shared, n, recent), deque()).append((at, via))
            if not some:
                return
            some = (some - 1) & mask

    def take(self, name: str | None, size: int, hashes: Sequence[str | None]) -> tuple[str, str, bool] | None:
        mine = sum(1 << k for k in self.kinds if hashes[k] is not None)
        for n, recent in ((name, False), (name, True), (None, False), (None, True)):
            first = None
            for mask in self.masks:
                free = self.found.get((size, mask, mask & mine, tuple(hashes[k] for k in self.kinds if mask & mine & 1 << k), n, recent))
                while free and self.taken[free[0][0]]:
                    free.popleft()
                if free and (first is None or free[0] < first):
                    first = free[0]
            if first is not None:
                self.taken[first[0]] = True
                return *self.files[first[0]], first[1]
        return None


def joined(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return [(x, top(x)) for x in up]


def flat(up: DataFrame) -> DataFrame:
    """``up`` (node, part), where part is a node that is no larger, with the end of its way as part. Rounds double the reach."""
    while True:
        onward = up.select(F.col("node").alias("part"), F.col("part").alias("further"))
        far = cut(up.join(onward, "part").select("node", F.col("further").alias("part"), (F.col("further") < F.col("part")).alias("moved")))
        up = far.select("node", "part")
        if far.where("moved").isEmpty():
            return up


def linked(pairs: DataFrame) -> DataFrame:
    """(node, part) of all nodes of ``pairs`` (a, b), numbers: part is the least node that links reach.

    Up to ``FEW_LINKS`` links are joined here. Of more, each node goes to its least neighbour, if that is smaller, and on to where this leads; the nodes at the ends, half of all at
    most, with the links between them are the next round. So rounds grow with the logarithm of the nodes, however long a path is.
    """
    links = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rounds = []
    while len(few := links.limit(FEW_LINKS + 1).collect()) > FEW_LINKS:
        least = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("low"))
        rounds.append(flat(cut(least.select(F.col("a").alias("node"), F.least("a", "low").alias("part")))))
        ends = [rounds[-1].select(F.col("node").alias(c), F.col("part").alias(f"end_{c}")) for c in ("a", "b")]
        met = links.join(ends[0], "a").join(ends[1], "b").where("end_a <> end_b")
        links = cut(met.select(F.greatest("end_a", "end_b").alias("a"), F.least("end_a", "end_b").alias("b")).distinct())
    # Stored, so that plans know how small it is.
    state = cut(pairs.sparkSession.createDataFrame(joined(few), "node long, part long"))
    for before in reversed(rounds):
        onward = state.select(F.col("node").alias("part"), F.col("part").alias("further"))
        state = cut(before.join(onward, "part", "left").select("node", F.coalesce("further", "part").alias("part")))
    return state


def size_parts(files: DataFrame) -> DataFrame:
    """(size, part): sizes that files have with and without their headers, joined as far as that reaches, under the least of them. Sizes of no such file have no row."""
    pairs = files.where("stripped IS NOT NULL").select(F.col("size").cast("long").alias("a"), F.col("stripped.size").cast("long").alias("b")).distinct()
    return linked(pairs).withColumnRenamed("node", "size")


def competitors(items: DataFrame, files: DataFrame, hashes: Sequence[str]) -> DataFrame:
    """Files (kind 0; a row for each identity) and items (kind 1) under the same columns."""
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    rows = files.select("grp", "size", *hashes, F.lit(0).alias("kind"), zero.alias("set_ord"), F.lit(False).alias("late"), zero.alias("item_ord"), none.alias("item_name"), *FILE, "recent", "via_strip")
    late = F.coalesce(F.col("dump_status") == "nodump", F.lit(False))
    own = items.select("grp", "size", *hashes, F.lit(1).alias("kind"), "set_ord", late.alias("late"), "item_ord", "item_name", none.alias("path"), none.alias("entry_name"), F.lit(False).alias("recent"), F.lit(False).alias("via_strip"))
    return rows.unionByName(own).where("size IS NOT NULL")


def read_claims(rows: DataFrame, hashes: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Claims of each ``group`` (its rows can't meet others), whose rows, not their pairs, come sorted and are read once: the files, then the items."""

    def greedy(batches):
        at, pool = None, None
        for pdf in batches:
            out = []
            hs = list(zip(*[[v if isinstance(v, str) else None for v in pdf[h]] for h in hashes], strict=True)) if hashes else [()] * len(pdf)
            keys = list(zip(*[pdf[g] for g in group], strict=True))
            columns = ("size", "kind", "set_ord", "item_ord", "item_name", "path", "entry_name", "recent", "via_strip")
            for key, (size, kind, o, i, name, path, entry, recent, via), h in zip(keys, zip(*[pdf[c] for c in columns], strict=True), hs, strict=True):
                if at != key:
                    at, pool = key, Pool(len(hashes))
                if kind == 0:
                    pool.put(path, entry, bool(recent), size, h, bool(via))
                elif got := pool.take(name, size, h):
                    out.append((o, i, *got, "correct" if got[1] == name else "misnamed"))
            yield pd.DataFrame(out, columns=["set_ord", "item_ord", "path", "entry_name", "via_strip", "match_status"])

    rows = rows.select(*group, *[c for c in ("size", *hashes, "kind", *ORDER, "item_name", *FILE, "recent", "via_strip") if c not in group])
    return rows.repartition(*group).sortWithinPartitions(*group, "kind", *ORDER, *FILE, "via_strip").mapInPandas(greedy, CLAIMS)


def claim(items: DataFrame, files: DataFrame, hashes: Sequence[str], parts: DataFrame | None = None) -> DataFrame:
    """Claims within ``grp``, a set's items and the files of its container.

    Items (grp, size, hashes, ...) and files (grp, size, hashes, via_strip, recent, ...; a row for each identity) compete within ``grp`` and a size,
    and within a hash where all rows of that size have it; sizes of one of ``parts`` compete together, as a file has several.
    """
    rows = competitors(items, files, hashes)
    rows = rows.join(parts, "size", "left") if parts is not None else rows.withColumn("part", F.lit(None).cast("long"))
    rows = rows.withColumn("joined", F.col("part").isNotNull()).withColumn("part", F.coalesce("part", "size"))
    both = rows.groupBy("grp", "part").agg(F.count_distinct("kind").alias("sides"), *[(~F.bool_or("joined") & F.bool_and(F.col(h).isNotNull())).alias(f"all_{h}") for h in hashes]).where("sides = 2")
    key = F.coalesce(*[F.when(F.col(f"all_{h}"), F.col(h)) for h in hashes], F.lit(""))
    keyed = rows.join(both, ["grp", "part"]).withColumn("key", key).drop("sides", "joined", *[f"all_{h}" for h in hashes])
    return read_claims(keyed, hashes, ["grp", "part", "key"])


def by_content(rows: DataFrame, hashes: Sequence[str]) -> DataFrame:
    """``rows`` with node, which rows that can meet share, and wild: items that can meet every file of their size.

    A size's rows are told apart by a hash that all its files have, where an item without it shares no other hash with them either: that item is wild. Of
    several such hashes the one counts that fewest items lack. Where there is none, a size is one node.
    """
    files, items = F.col("kind") == 0, F.col("kind") == 1
    lacks = {h: F.col(h).isNull() for h in hashes}
    counts = [F.count_if(files).alias("n_files"), *[F.count_if(files & lacks[h]).alias(f"f_{h}") for h in hashes], *[F.count_if(items & lacks[h]).alias(f"i_{h}") for h in hashes]]
    counts += [F.count_if(items & lacks[h] & ~lacks[g]).alias(f"x_{h}_{g}") for h in hashes for g in hashes if g != h]
    sizes = rows.groupBy("grp", "size").agg(F.max("kind").alias("most"), F.min("kind").alias("least"), *counts).where("most <> least")
    choices = []
    for n, h in enumerate(hashes):
        fits = F.col(f"f_{h}") == 0
        for g in hashes:
            if g != h:
                fits &= (F.col(f"x_{h}_{g}") == 0) | (F.col(f"f_{g}") == F.col("n_files"))
        choices.append(F.when(fits, F.struct(F.col(f"i_{h}").alias("lack"), F.lit(n).alias("n"))))
    by = F.array_min(F.array(*choices))["n"] if choices else F.lit(None).cast("int")
    met = rows.join(sizes.select("grp", "size", by.alias("by")), ["grp", "size"])
    key = F.coalesce(*[F.when(F.col("by") == n, F.col(h)) for n, h in enumerate(hashes)], F.lit(None).cast("string"))
    return met.withColumn("key", key).withColumns({"wild": F.col("by").isNotNull() & F.col("key").isNull(), "node": F.xxhash64("grp", "size", F.coalesce("key", F.lit("")))}).drop("by", "key")


def settle(rows: DataFrame, hashes: Sequence[str]) -> DataFrame:
    """Claims of rows (grp, part, ...) that compete within (grp, part), by ranks where that is enough, else by the reader.

    Where all rows of a part are alike (one size, one value of each hash) and no name has more items than files, every item takes a file of its own name, so the
    n-th item of a name takes the n-th file of it. Where no item has a file's name, the n-th item takes the n-th file.
    """
    group = ["grp", "part"]
    named = rows.withColumn("name", F.coalesce("item_name", "entry_name"))
    alike = [F.min(c).alias(f"lo_{c}") for c in ("size", *hashes)] + [F.max(c).alias(f"hi_{c}") for c in ("size", *hashes)] + [F.count(c).alias(f"n_{c}") for c in hashes]
    names = named.groupBy(*group, "name").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == 1).alias("n_items"), F.count_if(F.col("kind") == 0).alias("n_files"), F.bool_or("via_strip").alias("via"), *alike)
    same = F.lit(True)
    for c in ("size", *hashes):
        same &= F.min(f"lo_{c}").eqNullSafe(F.max(f"hi_{c}"))
    for h in hashes:
        same &= (F.sum(f"n_{h}") == 0) | (F.sum(f"n_{h}") == F.sum("n"))
    parts = names.groupBy(*group).agg(
        F.sum("n_items").alias("items"), F.sum("n_files").alias("files"), (same & ~F.bool_or("via")).alias("same"),
        F.bool_and(F.col("n_items") <= F.col("n_files")).alias("by_name"), (~F.bool_or((F.col("n_items") > 0) & (F.col("n_files") > 0))).alias("strange"),
    ).where("items > 0 AND files > 0")
    how = F.when(F.col("same") & F.col("by_name"), 1).when(F.col("same") & F.col("strange"), 2).otherwise(0)
    rows = cut(named.join(parts.select(*group, how.alias("how")), group))
    out = read_claims(rows.where("how = 0"), hashes, group)
    rows = rows.where("how > 0").withColumn("slot", F.when(F.col("how") == 1, F.col("name")).otherwise(""))
    order = [F.when(F.col("kind") == 0, F.col("recent")), *ORDER, *FILE]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group, "slot", "kind").orderBy(*order)))
    files = ranked.where("kind = 0").select(*group, "slot", "rank", *FILE, "via_strip")
    items = ranked.where("kind = 1").select(*group, "slot", "rank", *ITEM, "how")
    met = items.join(files, [*group, "slot", "rank"])
    return out.unionByName(met.select(*ITEM, *FILE, "via_strip", F.when(F.col("how") == 1, "correct").otherwise("misnamed").alias("match_status")))


def tempting(rows: DataFrame, wild: DataFrame, claims: DataFrame) -> DataFrame:
    """(grp, size, part) of all files that ``wild`` items (with nth, their turn among those that can matter to each other) can take, given the ``claims`` that the others make among themselves.

    A wild item takes the first free file in its order. What wild items before it took changes which files are free by at most one file for each: who finds
    a file gone takes another, and so on, so at any time all but one of the free files are as before. So the n-th wild item takes
    one of the first n, of its name or of any, that are free at its turn without the others; those parts compete with it, no other does.
    """
    turn = F.struct(*ORDER)
    wild = wild.select("grp", "size", turn.alias("turn"), "item_name", "nth")
    sizes = wild.groupBy("grp", "size").agg(F.count("*").alias("n_wild"), F.max("nth").alias("most"))
    at = rows.where("kind = 0").join(sizes, ["grp", "size"])
    when = claims.select(*FILE, *ITEM).join(rows.where("kind = 1").select(*ITEM, "late"), list(ITEM)).select(*FILE, turn.alias("taken"))
    at = cut(at.join(when, list(FILE), "left").select("grp", "size", "part", "n_wild", "most", "recent", *FILE, "taken"))
    n = at.groupBy("grp", "size").agg(F.count("*").alias("n_files"), F.first(F.col("n_wild") * F.col("most")).alias("asked"))
    # Many wild items find most files: then all parts of the size compete.
    many = (F.col("asked") * 2 > F.col("n_files")).alias("many")
    n = cut(n.select("grp", "size", many, F.ceil(F.col("n_files") / PART).alias("salts")))
    whole = at.join(n.where("many").select("grp", "size"), ["grp", "size"]).select("grp", "size", "part").distinct()
    few = n.where("NOT many").select("grp", "size", "salts")
    files = at.join(few, ["grp", "size"]).withColumn("salt", F.pmod(F.xxhash64(*FILE), "salts"))
    asks = wild.join(few, ["grp", "size"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    none = F.lit(None)
    both = files.select("grp", "size", "salt", F.lit(1).alias("kind"), "taken", none.cast("string").alias("item_name"), "recent", *FILE, "part", F.lit(0).alias("nth")).unionByName(
        asks.select("grp", "size", "salt", F.lit(0).alias("kind"), F.col("turn").alias("taken"), "item_name", F.lit(False).alias("recent"), *[none.cast("string").alias(c) for c in FILE], F.lit(0).cast("long").alias("part"), "nth")
    )
    # No nulls in numbers: pandas would make them floating-point.
    both = both.select("grp", "size", "salt", "kind", "recent", *FILE, "item_name", "part", "nth", F.col("taken").isNotNull().alias("is_taken"), *[F.coalesce(F.col(f"taken.{c}"), F.lit(0).cast("boolean" if c == "late" else "long")).alias(c) for c in ORDER])

    def first(batches):
        at, turns, wanted = None, [], {}
        for pdf in batches:
            out = []
            columns = ("grp", "size", "salt", "kind", "entry_name", "item_name", "part", "nth", "is_taken", *ORDER)
            for grp, size, salt, kind, entry, name, part, nth, taken, *turn in zip(*[pdf[c] for c in columns], strict=True):
                if at != (grp, size, salt):
                    at, turns, wanted = (grp, size, salt), [], {}
                if kind == 0:
                    turns.append(tuple(turn))
                    for key in (None, name):  # places of wild items that still look for a file of any name, or of theirs, and for how many
                        wanted.setdefault(key, {})[len(turns) - 1] = nth
                    continue
                before = bisect_left(turns, tuple(turn)) if taken else len(turns)
                for key in (None, entry):
                    open_ = wanted.get(key)
                    if open_:
                        met = [k for k in open_ if k < before]
                        for k in met:
                            open_[k] -= 1
                            if not open_[k]:
                                del open_[k]
                        if met:
                            out.append((grp, size, int(part)))
            yield pd.DataFrame(out, columns=["grp", "size", "part"])

    turns = [F.when(F.col("kind") == 0, F.col(c)) for c in ORDER]  # wild items come by turn, then files by place
    dealt = both.repartition("grp", "size", "salt").sortWithinPartitions("grp", "size", "salt", "kind", *turns, "recent", *FILE)
    return whole.unionByName(dealt.mapInPandas(first, "grp string, size long, part long")).distinct()


def claim_anywhere(items: DataFrame, files: DataFrame, hashes: Sequence[str], two_identities: bool) -> DataFrame:
    """The claims of ``claim`` where ``grp`` is a whole inventory: rows that can't meet are settled apart, so no task reads a size.

    Contents are nodes, linked by files that have two; a connected part is settled on its own. Wild items (undumped ones, as a rule) can take any file of
    their size: the others are settled without them first, then again the few parts of which a wild item may take a file, with it.
    Only a size of which some file lacks every hash that tells the others apart stays one group, and copies of one content whose items differ from its files in name.
    """
    rows = cut(by_content(competitors(items, files, hashes), hashes))
    part = F.col("node")
    zone = F.xxhash64("grp", "size")
    if two_identities:
        held = rows.where("kind = 0").groupBy("grp", *FILE)
        rows = rows.join(linked(held.agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b").distinct()), "node", "left")
        part = F.coalesce("part", "node")
    rows = cut(rows.withColumn("part", part).drop("node"))
    wild = rows.where("wild")
    tame = rows.where("NOT wild")
    claims = cut(settle(tame, hashes))
    if wild.isEmpty():
        return claims
    wild = wild.withColumn("zone", zone)
    if two_identities:  # a file of two sizes lets wild items of both matter to each other
        sizes = tame.where("kind = 0").groupBy("grp", *FILE).agg(F.min(zone).alias("a"), F.max(zone).alias("b")).where("a <> b").select("a", "b").distinct()
        wild = wild.join(linked(sizes).withColumnsRenamed({"node": "zone", "part": "all"}), "zone", "left").withColumn("zone", F.coalesce("all", "zone")).drop("all")
    wild = cut(wild.withColumn("nth", F.row_number().over(Window.partitionBy("grp", "zone").orderBy(*ORDER))).drop("zone"))
    mixed = cut(tempting(tame, wild, claims))
    size = F.xxhash64("grp", "size", F.lit("size"))
    label = linked(mixed.select(size.alias("a"), F.col("part").alias("b")))
    again = tame.join(label.select(F.col("node").alias("part"), F.col("part").alias("label")), "part")
    free = wild.withColumn("node", size).drop("part", "nth").join(label.select("node", F.col("part").alias("label")), "node").drop("node")
    competing = cut(again.drop("part").unionByName(free).withColumnRenamed("label", "part"))
    apart = claims.join(competing.where("kind = 1").select(*ITEM), list(ITEM), "left_anti")
    return apart.unionByName(read_claims(competing, hashes, ["grp", "part"]))
