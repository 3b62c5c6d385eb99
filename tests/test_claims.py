"""Claims over a whole inventory against a reader that goes through all items and all files."""

import random

import pytest
from pyspark.sql import functions as F

from stocktake.operators import claims

HASHES = ("crc32", "md5")
FILES = "grp string, path string, entry_name string, size long, crc32 string, md5 string, recent boolean, via_strip boolean"
ITEMS = "grp string, set_ord long, item_ord long, item_name string, size long, crc32 string, md5 string, dump_status string"


def plain_claims(items, files):
    """files: path, entry, recent, identities (size, hashes, via); the claims of one inventory."""
    free, out = sorted(files), []
    for o, i, name, size, hashes, late in sorted(items, key=lambda x: (x[0], x[5], x[1])):
        best = None
        for f in free:
            for s, hs, via in f[3]:
                if s == size and all(a is None or b is None or a == b for a, b in zip(hashes, hs, strict=True)):
                    rank = (f[1] != name, f[2], f[:2], via)
                    best = min(best, (rank, f)) if best else (rank, f)
        if best:
            free.remove(best[1])
            out.append((o, i, best[1][0], best[1][1], best[0][3], "correct" if best[1][1] == name else "misnamed"))
    return out


def random_case(rng, g):
    pick = lambda p, n: None if rng.random() < p else f"h{rng.randrange(n)}"
    bare, wild, two = rng.choice([0, 0, 0.2]), rng.choice([0, 0.1, 0.4]), rng.choice([0, 0.3])
    kinds, sizes, names = rng.randrange(1, 5), rng.randrange(1, 4), rng.randrange(1, 12)
    items = [(g * 1000 + rng.randrange(4), i, f"n{rng.randrange(names)}", rng.randrange(sizes), (pick(wild, kinds), pick(rng.choice([0, wild]), kinds)), rng.random() < 0.2) for i in range(rng.randrange(25))]
    items = [(o, i, n, s, (None, None) if rng.random() < wild else h, late) for o, i, n, s, h, late in items]
    files = []
    for i in range(rng.randrange(25)):
        whole = (rng.randrange(sizes), (pick(bare, kinds), pick(bare, kinds)), False)
        more = [(rng.randrange(sizes), (pick(bare, kinds), pick(bare, kinds)), True)] if rng.random() < two else []
        files.append((f"/{g}/{rng.randrange(3)}/{i}", f"n{rng.randrange(names)}", rng.random() < 0.3, [whole, *more]))
    return items, files


def frames(spark, cases):
    items = [(str(g), o, i, n, s, *h, "nodump" if late else "good") for g, (its, _) in enumerate(cases) for o, i, n, s, h, late in its]
    files = [(str(g), p, e, s, *h, r, via) for g, (_, fs) in enumerate(cases) for p, e, r, ids in fs for s, h, via in ids]
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(files, FILES)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_claims_anywhere_equal_the_plain_reader(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(claims, "PART", 2)
        monkeypatch.setattr(claims, "FEW_LINKS", 3)
    rng = random.Random(seed)
    cases = [random_case(rng, g) for g in range(400)]
    items, files = frames(spark, cases)
    got = claims.claim_anywhere(items, files, HASHES, True).collect()
    assert sorted(tuple(r) for r in got) == sorted(c for its, fs in cases for c in plain_claims(its, fs))


def test_one_item_without_a_hash_leaves_its_size_apart(spark, monkeypatch):
    """A hundred thousand files of one size and one undumped item of it: the reader sees a handful of rows."""
    n = 100_000
    whole = spark.range(n)
    items = whole.select(F.lit("").alias("grp"), F.col("id").alias("set_ord"), F.lit(0).cast("long").alias("item_ord"), F.concat(F.lit("n"), "id").alias("item_name"), F.lit(8).cast("long").alias("size"), F.when(F.col("id") != 5, F.md5(F.col("id").cast("string"))).alias("md5"), F.when(F.col("id") == 5, "nodump").otherwise("good").alias("dump_status"))
    files = whole.select(F.lit("").alias("grp"), F.concat(F.lit("/r/"), F.lpad("id", 6, "0")).alias("path"), F.concat(F.lit("n"), (F.col("id") + (F.col("id") >= 5).cast("int"))).alias("entry_name"), F.lit(8).cast("long").alias("size"), F.md5((F.col("id") + (F.col("id") >= 5).cast("int")).cast("string")).alias("md5"), F.lit(False).alias("recent"), F.lit(False).alias("via_strip"))
    read = []
    real = claims.read_claims
    monkeypatch.setattr(claims, "read_claims", lambda rows, *a: (read.append(rows.groupBy("grp", "part").count().agg(F.max("count")).first()[0] or 0), real(rows, *a))[1])
    found = claims.claim_anywhere(items, files, ["md5"], False)
    assert found.count() == n - 1 and max(read) < 10
    by_item = {r["set_ord"]: r["path"] for r in found.where("set_ord IN (4, 5, 6)").collect()}
    # Item 5 takes the first file that is free at its turn, that of item 6, which then has none: all others keep theirs.
    assert by_item == {4: "/r/000004", 5: "/r/000005"}


def test_long_paths_are_linked_in_few_rounds(spark, monkeypatch):
    """Labels in no order: a round that only passes the least one on to neighbours would take about as many as the path is long."""
    monkeypatch.setattr(claims, "FEW_LINKS", 20)
    steps, real = [], claims.cut

    def counted(df):
        steps.append(1)
        assert len(steps) < 60
        return real(df)

    monkeypatch.setattr(claims, "cut", counted)
    rng, n = random.Random(4), 600
    names = rng.sample(range(10**12), n)
    pairs = [(names[i], names[i + 1]) for i in range(n - 1) if i != 399]
    got = dict(tuple(r) for r in claims.linked(spark.createDataFrame([*pairs, (-1, -1)], "a long, b long")).collect())
    assert got == {-1: -1} | {x: min(names[:400] if i < 400 else names[400:]) for i, x in enumerate(names)}


def test_a_stored_table_has_no_estimate_of_its_plan(spark):
    from stocktake.lineage import cut

    df = spark.range(10)
    for _ in range(8):
        df = cut(df.join(df.withColumnRenamed("id", "other"), df["id"] == F.col("other")).select("id"))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 30
