"""Near names: an edit-distance join with blocking, and the pick among near ties."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .closeness import BITS, close_pairs, letter_bits

#: Fixed values.
THRESHOLD, NEAR_TIE = 0.75, 0.05
#: Bytes that a file's size may be off.
SIZE_OFF = 512
#: In a range of sizes that at most so many catalog names have, each of them is compared; blocks are for larger ones. A name asks for some 3,000 pieces, and to
#: rule a name out by its letters costs far less than to send a piece.
FEW_NAMES = 20_000
#: Local names that a share of a range holds at most, and pairs that it compares; bundles of ranges for each task.
PART, PAIRS, BUNDLES = 10_000, 1_000_000, 64
SPECIAL = ("beta", "proto", "demo", "debug", "sample", "kiosk", "unl", "pirate", "alpha", "test program", "lodgenet", "gamecube", "virtual console", "switch online", "limited run", "aftermarket", "promo", "rerelease")


def local_title(name: Column) -> Column:
    """A local name without its extension; a full stop with a space somewhere behind it is no extension's."""
    return F.trim(F.regexp_replace(name, r"(?<=.)\.[^. ]*$", ""))


def title(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"(?s) \(.*$", ""))


def tags(name: Column) -> Column:
    return F.trim(F.regexp_extract(name, r"(?s) (\(.*)$", 1))


def ratio(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(F.lower(a), F.lower(b)) / F.greatest(F.length(a), F.length(b))


def similarity(a: Column, b: Column) -> Column:
    """The better of whole names and of 0.9 title with 0.1 tags; tags that one side lacks count half."""
    return score((a, title(a), tags(a)), (b, title(b), tags(b)))


def score(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """``similarity`` of two names that are given with their titles and tags."""
    (a, title_a, ta), (b, title_b, tb) = a, b
    tag_score = F.when((ta == "") & (tb == ""), 1.0).when((ta == "") | (tb == ""), 0.5).otherwise(ratio(ta, tb))
    by_title = F.when(F.greatest(F.length(title_a), F.length(title_b)) > 0, ratio(title_a, title_b) * 0.9 + tag_score * 0.1).otherwise(0.0)
    return F.greatest(ratio(a, b), by_title)


def letters(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({k: v.view("int64") for k, v in zip(BITS, letter_bits(list(x)))})


def about(names: DataFrame, c: str) -> DataFrame:
    """``names`` with what comparisons of ``c`` ask for: title, tags, and of the whole and the title the small letters, the length and bits of the letters."""
    names = names.withColumns({f"{c}_title": title(F.col(c)), f"{c}_tags": tags(F.col(c))})
    names = names.withColumns({f"{x}_text": F.lower(x) for x in (c, f"{c}_title")})
    bits = F.pandas_udf(letters, ", ".join(f"{k} long" for k in BITS))
    names = names.withColumns({f"{x}_bits": bits(f"{x}_text") for x in (c, f"{c}_title")})
    return names.withColumns({f"{x}_{k}": v for x in (c, f"{c}_title") for k, v in (("n", F.length(x)), *[(k, F.col(f"{x}_bits.{k}")) for k in BITS])})


def added(c: str) -> list[str]:
    return [f"{c}_title", f"{c}_tags", *[f"{x}_{k}" for x in (c, f"{c}_title") for k in ("text", "n", *BITS)]]


def special_words(name: Column, local: Column) -> Column:
    """How many groups of ``name`` have a special word that ``local`` lacks."""
    found = F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda g: F.get(F.filter(F.array(*[F.lit(w) for w in SPECIAL]), lambda w: g.contains(w)), F.lit(0)))
    return F.size(F.filter(found, lambda w: w.isNotNull() & ~F.lower(local).contains(w)))


def near_names(local: DataFrame, catalog: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(local_name, set_name, score) of all pairs of at least ``threshold``.

    A pair of that score has titles, or whole names, within a bounded share of edits, so of the longer one's equal pieces at least
    one stands unchanged within that many places in the other: blocks are (length, piece number, piece), as in pass-join. The
    pieces are cut from catalog names, whose lengths are few; a local name looks up its substrings near the same places.
    Names that many rows share are joined once and brought back by an equi-join.

    Where both sides have a size, it may be off by SIZE_OFF, and names meet within one range of sizes or its neighbours: each where few
    catalog names have such a size, and by blocks where many have, so names that share a piece (a tag, say) meet only there.
    """
    sized = "size" in local.columns and "size" in catalog.columns
    more, found = (["size"] if sized else []), []
    least = (threshold - 0.1) / 0.9
    whole = lambda c: (F.col(c), F.col(f"{c}_title"), F.col(f"{c}_tags"))
    a = local.select(local_title(F.col("local_name")).alias("a"), *more).where("a IS NOT NULL").distinct()
    b = catalog.select(F.col("set_name").alias("b"), *more).where("b IS NOT NULL").distinct()
    if sized:
        a = about(a, "a").withColumn("near", F.explode(F.array(*[F.floor(F.col("size") / SIZE_OFF) + k for k in (-1, 0, 1)])))
        b = about(b, "b").withColumn("near", F.floor(F.col("size") / SIZE_OFF)).withColumnRenamed("size", "b_size")
        # A range's comparisons are dealt out by shares of the local names; ranges are compared by bundles, as most may hold a name or two.
        ranges = b.groupBy("near").agg(F.count("*").alias("n")).hint("merge").join(a.groupBy("near").agg(F.count("*").alias("n_local")), "near")
        ranges = ranges.select("near", F.greatest(F.ceil(F.col("n_local") / PART), F.ceil(F.col("n_local") * F.col("n") / PAIRS)).alias("shares"), (F.col("n") > FEW_NAMES).alias("many"))
        a, b = a.join(ranges.hint("merge"), "near"), b.join(ranges.hint("merge"), "near")
        # So many tasks, however few bytes there are: it is the comparisons that take time.
        tasks = int(local.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bundle = F.pmod(F.xxhash64("near"), F.lit(tasks * BUNDLES)).alias("bundle")
        own = a.where("NOT many").select(bundle, F.pmod(F.xxhash64("a", "size"), "shares").alias("share"), "near", "a", "size", *added("a")).repartition(tasks, "bundle", "share")
        other = b.where("NOT many").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).select(bundle, "share", "near", "b", "b_size", *added("b")).repartition(tasks, "bundle", "share")
        fits = F.abs(F.col("size") - F.col("b_size")) <= SIZE_OFF
        sides, kept = [("a", "b", threshold), ("a_title", "b_title", least)], (["a", "size", "a_title", "a_tags"], ["b", "b_title", "b_tags"])
        schema = StructType([own.schema[c] for c in kept[0]] + [other.schema[c] for c in kept[1]])
        pairs = own.groupBy("bundle", "share").cogroup(other.groupBy("bundle", "share")).applyInArrow(lambda left, right: close_pairs(left, right, sides, SIZE_OFF, kept), schema)
        found.append(pairs.select("a", "size", "b", score(whole("a"), whole("b")).alias("score")))
        a, b = a.where("many").select("a", "size", "near"), b.where("many").select("b", "b_size", "near")
    at, at_b = ["near", *more] if sized else [], ["near", "b_size"] if sized else []
    keys = []
    for part, floor in ((title, least), (lambda x: x, threshold)):
        left, right = a.select("a", *at, F.lower(part(F.col("a"))).alias("x")), b.select("b", *at_b, F.lower(part(F.col("b"))).alias("y"))
        lengths = F.sequence(F.greatest(F.ceil(F.length("x") * floor).cast("int"), F.lit(1)), F.floor(F.length("x") / floor).cast("int"))
        # y of length m and x of length n differ by at most (1 - floor) * max(m, n) edits; one piece more than that.
        edits = lambda m, n, floor=floor: F.floor(F.greatest(m, n) * (1 - floor) + 1e-9).cast("int")
        most = lambda m, floor=floor: F.floor(m / floor * (1 - floor) + 1e-9).cast("int") + 1
        cut_at = lambda m, k, i: F.floor(m * i / k).cast("int")
        m = F.length("y")
        pieces = F.transform(F.sequence(F.lit(0), most(m) - 1), lambda i: F.struct(i.alias("i"), F.substr(F.col("y"), cut_at(m, most(m), i) + 1, cut_at(m, most(m), i + 1) - cut_at(m, most(m), i)).alias("p")))
        right = right.where(m > 0).select("b", *at_b, m.alias("m"), F.explode_outer(pieces).alias("s")).select("b", *at_b, "m", "s.i", "s.p")
        asks = left.where(F.length("x") > 0).select("a", *at, "x", F.explode_outer(lengths).alias("m")).withColumn("k", most(F.col("m"))).withColumn("e", edits(F.col("m"), F.length("x")))
        asks = asks.withColumn("i", F.explode_outer(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("at", cut_at(F.col("m"), F.col("k"), F.col("i"))).withColumn("len", cut_at(F.col("m"), F.col("k"), F.col("i") + 1) - F.col("at"))
        asks = asks.withColumn("from", F.explode_outer(F.sequence(F.greatest(F.col("at") - F.col("e"), F.lit(0)), F.least(F.col("at") + F.col("e"), F.greatest(F.length("x") - F.col("len"), F.lit(0))))))
        met = asks.select("a", *at, "m", "i", F.substr(F.col("x"), F.col("from") + 1, F.col("len")).alias("p")).distinct().join(right.hint("merge"), [*at[:1], "m", "i", "p"])
        keys.append((met.where(fits) if sized else met).select("a", *more, "b"))
    found.append(keys[0].unionByName(keys[1]).distinct().select("a", *more, "b", similarity(F.col("a"), F.col("b")).alias("score")))
    pairs = found[0].unionByName(found[1]) if sized else found[0]
    pairs = pairs.where(F.col("score") >= threshold - 1e-12)
    names = local.select("local_name", *more, local_title(F.col("local_name")).alias("a")).distinct()
    # Joined by a shuffle: what a table of names takes up in the driver isn't told by the size of its file.
    return pairs.join(names.hint("merge"), ["a", *more]).select("local_name", F.col("b").alias("set_name"), "score").distinct()


def near_leftovers(left: DataFrame, catalog: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, set_name, score): the best near name of each leftover that no set owns, of a size within SIZE_OFF of the set's (set_name, size)."""
    own = left.where("owner IS NULL AND NOT nodump_name").select("path", F.element_at(F.split("path", "/"), -1).alias("local_name"), "size")
    best = best_name(near_names(own, catalog, threshold))
    return own.select("path", "local_name").distinct().join(best, "local_name").select("path", "set_name", "score")


def best_name(pairs: DataFrame, available: Column | None = None) -> DataFrame:
    """One row for each local name: within a near tie of the top, plain releases before special ones, an available one before a taken one, then score, shorter name, name."""
    w = Window.partitionBy("local_name")
    pool = pairs.withColumn("top", F.max("score").over(w)).where(F.col("score") >= F.col("top") - NEAR_TIE)
    pool = pool.withColumn("special", special_words(F.col("set_name"), F.col("local_name")) > 0).withColumn("free", available if available is not None else F.lit(True))
    pool = pool.withColumn("plain", F.bool_or(~F.col("special")).over(w)).where("NOT plain OR NOT special")
    rank = F.row_number().over(w.orderBy(F.desc("free"), F.desc(F.round("score", 9)), F.length("set_name"), "set_name"))
    return pool.withColumn("rank", rank).where("rank = 1").select("local_name", "set_name", "score")
