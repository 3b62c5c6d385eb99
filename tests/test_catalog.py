"""Catalog engine: cases rebuilt as small tables, and readers on files written by the tests."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from stocktake.functions import headers, names, paths
from stocktake.operators import audit, duplicates, families, layout, match, snapshots, suggest
from stocktake.plans import changes
from stocktake.sources import catalogs, inventories

ITEMS = "set_name string, set_ord long, item_ord long, item_name string, size long, crc32 string, md5 string, dump_status string, optional boolean"
FILES = "path string, entry_name string, size long, crc32 string, md5 string"


def item(s, o, name, size, crc, md5=None, status="good"):
    return (s, o, o, name, size, crc, md5, status, False)


def statuses(spark, items, files):
    out = match.match_items(spark.createDataFrame(items, ITEMS), spark.createDataFrame(files, FILES))
    return {r["item_name"]: r["match_status"] for r in out.collect()}, out


def test_statuses_of_a_container(spark):
    items = [item("a", 0, "right.bin", 1, "aa"), item("a", 1, "named.bin", 2, "bb"), item("a", 2, "gone.bin", 3, "cc"), item("a", 3, "slot.bin", 4, "dd"), item("b", 4, "far.bin", 5, "ee"), item("b", 5, "here.bin", 6, "ff"), item("a", 6, "nd.bin", 7, None, None, "nodump"), item("a", 7, "none.bin", 8, None, None, "nodump")]
    files = [("/r/a.zip", "right.bin", 1, "aa", None), ("/r/a.zip", "other.bin", 2, "bb", None), ("/r/a.zip", "slot.bin", 4, "xx", None), ("/r/z.zip", "q.bin", 5, "ee", None), ("/r/b.zip", "here.bin", 6, "ff", None), ("/r/a.zip", "nd.bin", 99, "11", None)]
    got, out = statuses(spark, items, files)
    assert got == {"right.bin": "correct", "named.bin": "misnamed", "gone.bin": "missing", "slot.bin": "hashMismatch", "far.bin": "foundElsewhere", "here.bin": "correct", "nd.bin": "nodump"}
    assert [r["path"] for r in match.leftovers(out, spark.createDataFrame(files, FILES)).collect()] == ["/r/z.zip"]


def test_shared_content_is_not_swapped(spark):
    items = [item("a", 0, "pal.ic16", 5, "aa"), item("a", 1, "pal.ic18", 5, "aa")]
    got, out = statuses(spark, items, [("/r/a.zip", "pal.ic18", 5, "aa", None), ("/r/a.zip", "pal.ic16", 5, "aa", None)])
    assert set(got.values()) == {"correct"} and all(r["entry_name"] == r["item_name"] for r in out.collect())


def test_copies_leave_leftovers_and_the_fullest_container_wins(spark):
    items = [item("a", 0, "x", 1, "aa"), item("a", 1, "y", 2, "bb")]
    files = [(f"/r{k}/a.zip", n, s, c, None) for k in range(4) for n, s, c in (("x", 1, "aa"), ("y", 2, "bb")) if not (k == 0 and n == "y")]
    _, out = statuses(spark, items, files)
    assert {r["path"] for r in out.collect()} == {"/r1/a.zip"}
    assert match.leftovers(out, spark.createDataFrame(files, FILES)).count() == 5


def test_loose_inventory_claims_by_content(spark):
    items = [item("a", 0, "x", 1, "aa"), item("a", 1, "y", 2, "bb"), item("b", 2, "z", 2, "bb"), item("b", 3, "w", 3, "cc"), item("b", 4, "v", 4, "dd")]
    files = [(f"/r/{n}", n, s, c, None) for n, s, c in (("x", 1, "aa"), ("q", 2, "bb"), ("w", 3, "ee"))]
    got, _ = statuses(spark, items, files)
    assert got == {"x": "correct", "y": "misnamed", "z": "foundElsewhere", "w": "hashMismatch", "v": "missing"}


def test_recent_files_are_claimed_last(spark):
    items = spark.createDataFrame([item("a", 0, "x", 1, "aa")], ITEMS)
    for files in ([("/n/x", "x", 1, "aa", None), ("/o/x", "x", 1, "aa", None)], [("/n/a.zip", "x", 1, "aa", None), ("/o/a.zip", "x", 1, "aa", None)]):
        out = match.match_items(items, spark.createDataFrame(files, FILES), F.col("path").startswith("/n/"))
        assert [r["path"] for r in out.collect()] == [files[1][0]]


@pytest.mark.parametrize("loose", [False, True])
def test_claims_equal_the_plain_greedy(spark, loose):
    import random

    rng = random.Random(5)
    pick = lambda p, k: None if rng.random() < p else f"{rng.randrange(k)}"
    items = [(s, i // 40, i, f"n{rng.randrange(30)}", rng.randrange(1, 3), pick(0.2, 4), pick(0.3, 2), rng.choice(["good", "nodump"]), False) for i in range(160) for s in [f"s{i // 40}"]]
    files = sorted((f"/r{i % 2}/f{i}" if loose else f"/r/s{i % 4}.zip", f"f{i}" if loose else f"n{i // 4}", rng.randrange(1, 3), pick(0.2, 4), pick(0.3, 2)) for i in range(120))
    fits = lambda a, b: a[4] == b[2] and all(x is None or y is None or x == y for x, y in ((a[5], b[3]), (a[6], b[4])))
    taken, want = set(), {}
    for a in sorted(items, key=lambda a: (a[1], a[7] == "nodump", a[2])):
        free = [b for b in files if b[:2] not in taken and fits(a, b) and (loose or b[0] == f"/r/{a[0]}.zip")]
        if free:
            b = min(free, key=lambda b: (b[1] != a[3], b[0].startswith("/r1/"), b[:2]))
            taken.add(b[:2])
            want[a[2]] = b[:2]
    out = match.match_items(spark.createDataFrame(items, ITEMS), spark.createDataFrame(files, FILES), F.col("path").startswith("/r1/"))
    assert {r["item_ord"]: (r["path"], r["entry_name"]) for r in out.where("match_status IN ('correct', 'misnamed')").collect()} == want


@pytest.mark.parametrize("loose", [False, True])
def test_claims_by_two_identities_equal_the_plain_greedy(spark, loose):
    import random

    rng = random.Random(8)
    items = [(f"s{i // 30}", i // 30, i % 30, f"n{rng.randrange(30)}", rng.randrange(1, 9) * 16, None, f"m{rng.randrange(3)}", rng.choice(["good", "nodump"]), False) for i in range(120)]
    files = []
    for i in range(110):
        size, inner = rng.randrange(2, 9) * 16, (None if rng.random() < 0.5 else f"m{rng.randrange(3)}")
        files.append((f"/r{i % 2}/f{i}" if loose else f"/r/s{i % 4}.zip", f"f{i}" if loose else f"n{i // 4}", size, None, f"m{rng.randrange(3)}", inner and (size - 16, inner)))
    files.sort(key=lambda b: b[:2])
    fits = lambda a, b: (a[4], a[6]) in ((b[2], b[4]), b[5])
    taken, want = set(), {}
    for a in sorted(items, key=lambda a: (a[1], a[7] == "nodump", a[2])):
        free = [b for b in files if b[:2] not in taken and fits(a, b) and (loose or b[0] == f"/r/{a[0]}.zip")]
        if free:
            b = min(free, key=lambda b: (b[1] != a[3], b[:2]))
            taken.add(b[:2])
            want[a[1], a[2]] = (*b[:2], (a[4], a[6]) != (b[2], b[4]))
    df = spark.createDataFrame(files, FILES + ", stripped struct<size: long, md5: string>")
    out = match.match_items(spark.createDataFrame(items, ITEMS), df).where("match_status IN ('correct', 'misnamed')")
    assert {(r["set_ord"], r["item_ord"]): (r["path"], r["entry_name"], r["via_strip"]) for r in out.collect()} == want
    assert sum(v[2] for v in want.values()) > 10


def test_a_set_of_many_items_is_matched(spark):
    n = 10_000
    items = spark.range(n).selectExpr("'big' AS set_name", "0L AS set_ord", "id AS item_ord", "concat('i', id) AS item_name", "id % 7 AS size", "CAST(NULL AS STRING) AS crc32", "md5(CAST(id AS STRING)) AS md5", "'good' AS dump_status", "false AS optional")
    files = spark.range(n).where("id % 10 <> 3").selectExpr("'/r/big.zip' AS path", "concat('i', id + id % 2) AS entry_name", "id % 7 AS size", "CAST(NULL AS STRING) AS crc32", "md5(CAST(id AS STRING)) AS md5")
    got = {r["match_status"]: r["count"] for r in match.match_items(items, files).groupBy("match_status").count().collect()}
    assert got["correct"] == n // 2 and got["misnamed"] == n // 2 - n // 10 and sum(got.values()) == n


def test_an_undumped_slot_is_found_in_the_parents_container(spark):
    items = [item("par", 0, "p", 1, "aa"), item("var", 1, "v", 2, "bb"), item("var", 2, "nd", 9, None, None, "nodump"), item("var", 3, "none", 9, None, None, "nodump")]
    df = spark.createDataFrame(items, ITEMS).withColumn("clone_of", F.when(F.col("set_name") == "var", "par"))
    out = match.match_items(df, spark.createDataFrame([("/r/par.zip", "p", 1, "aa", None), ("/r/par.zip", "nd", 5, "cc", None), ("/r/var.zip", "v", 2, "bb", None)], FILES))
    assert {r["item_name"]: (r["match_status"], r["path"]) for r in out.collect()} == {"p": ("correct", "/r/par.zip"), "v": ("correct", "/r/var.zip"), "nd": ("nodump", "/r/par.zip")}


def test_donors_of_sets_that_number_their_items_alike(spark):
    wanted = spark.createDataFrame([("a", 0, 0, 1, "m1"), ("b", 1, 0, 2, "m2")], "set_name string, set_ord long, item_ord long, size long, md5 string")
    pool = spark.createDataFrame([("/x", "x", 1, "m1"), ("/y", "y", 2, "m2"), ("/z", "z", 2, "m1")], "path string, entry_name string, size long, md5 string")
    assert {(r["set_ord"], r["donor_path"]) for r in duplicates.donors(wanted, pool).collect()} == {(0, "/x"), (1, "/y")}


def test_the_most_specific_root(spark, monkeypatch):
    files = spark.createDataFrame([("/r0/sub/a",), ("/r0/sub2/a",), ("/r0",), ("/q/a",), ("/r0/sub::e",), ("/r0/sub/a",)], "path string")
    roots = spark.createDataFrame([("/r0", 0), ("/r0/sub", 1)], "root string, root_ord int")
    want = [(None, "/q/a"), ("/r0", "/r0"), ("/r0", "/r0/sub2/a"), ("/r0/sub", "/r0/sub/a"), ("/r0/sub", "/r0/sub/a"), ("/r0/sub", "/r0/sub::e")]
    for few in (200, 1):
        monkeypatch.setattr(duplicates, "FEW_ROOTS", few)
        got = sorted(((r["root"], r["path"]) for r in duplicates.root_of(files, roots).collect()), key=str)
        assert got == sorted(want, key=str), few


def test_renames_go_by_phases(spark):
    items = spark.createDataFrame([item("a", 0, "a.bin", 1, "aa"), item("one", 1, "o.bin", 2, "bb"), item("c", 2, "c1", 3, "cc"), item("c", 3, "c2", 4, "dd")], ITEMS)
    files = spark.createDataFrame([("/r/x.bin", "x.bin"), ("/r/on.zip", "q"), ("/r/free.zip", "s"), ("/r/C.zip", "c1"), ("/r/typo.zip", "t"), ("/r/taken.zip", "u"), ("/r/full.zip", "u")], "path string, entry_name string")
    met = spark.createDataFrame([("a", 0, 0, "a.bin", "misnamed", "/r/x.bin", "x.bin"), ("one", 0, 1, "o.bin", "misnamed", "/r/on.zip", "q"), ("c", 0, 2, "c1", "correct", "/r/C.zip", "c1")], "set_name string, set_ord long, item_ord long, item_name string, match_status string, path string, entry_name string")
    suggested = spark.createDataFrame([("/r/free.zip", "on"), ("/r/taken.zip", "full")], "path string, suggested string")
    near = spark.createDataFrame([("/r/typo.zip", "type", 0.95), ("/r/taken.zip", "far", 0.5)], "path string, set_name string, score double")
    got = [(r["step"], r["source"], r["target"]) for r in changes.rename_files(met, items, suggested, files, near).orderBy("step").collect()]
    assert got == [(0, "/r/x.bin", "/r/a.bin"), (1, "/r/on.zip", "/r/one.zip"), (2, "/r/free.zip", "/r/on.zip"), (3, "/r/typo.zip", "/r/type.zip"), (4, "/r/C.zip", "/r/c.zip")]


def test_long_document_types_and_strict_items(spark, tmp_path):
    from pyspark.errors import PySparkException

    text = "<?xml version='1.0'?>\n<!DOCTYPE mame [\n" + "<!ELEMENT x (y)>\n" * 700 + "]>\n<mame>\n<machine name='m'><rom name='a'/></machine></mame>"
    (tmp_path / "m.xml").write_text(text)
    assert catalogs.dialect(spark, str(tmp_path / "m.xml")) == "mame"
    sets = catalogs.read_sets(spark, str(tmp_path / "m.xml"))
    assert catalogs.catalog_items(sets).count() == 0
    with pytest.raises(PySparkException, match="without a name or a size in the set m"):
        catalogs.catalog_items(sets, strict=True).collect()
    (tmp_path / "d.xml").write_text("<datafile><header><name>n</name><version>2</version></header><game name='A'/><machine name='B'/><game name='C'/></datafile>")
    both = catalogs.read_sets(spark, str(tmp_path / "d.xml"))
    assert len({r["set_ord"] for r in both.collect()}) == 3 and catalogs.read_header(spark, str(tmp_path / "d.xml")).first()["version"] == "2"


def test_roots_that_are_gone_or_too_deep(spark, tmp_path):
    (tmp_path / "r" / "a" / "b").mkdir(parents=True)
    (tmp_path / "r" / "x").write_text("1")
    (tmp_path / "r" / "a" / "b" / "y").write_text("2")
    roots = [str(tmp_path / "r"), str(tmp_path / "gone")]
    assert inventories.present_roots(spark, roots) == (roots[:1], roots[1:])
    assert [r["entry_name"] for r in inventories.scan(spark, roots, 1).collect()] == ["x"] and inventories.scan(spark, roots[1:]).count() == 0
    assert [(r["folder"], r["n"]) for r in inventories.too_deep(spark, roots, 1).collect()] == [(f"{roots[0]}/a", 1)]


def test_a_changed_file_has_its_newest_row(spark):
    from datetime import datetime

    old, new = datetime(2024, 1, 1), datetime(2024, 1, 2)
    schema = "path string, entry_path string, size long, mtime timestamp"
    before = spark.createDataFrame([("/a", None, 1, old, "m1"), ("/a", None, 1, new, "m2")], schema + ", md5 string")
    known, fresh = snapshots.reuse(spark.createDataFrame([("/a", None, 1, new)], schema), before, ["md5"])
    assert [r["md5"] for r in known.collect()] == ["m2"] and fresh.count() == 0


def test_hit_of_wrong_size_stops_later_keys(spark):
    items = spark.createDataFrame([item("a", 0, "x", 1, "aa", "m1")], ITEMS)
    files = spark.createDataFrame([("/p", "p", 9, "aa", "m2"), ("/q", "q", 1, "bb", "m1")], FILES)
    assert [r["path"] for r in match.candidates(items, files).collect()] == ["/p"] and match.verified_pairs(items, files).count() == 0


def test_three_fifths_name_a_container(spark):
    items = spark.createDataFrame([item("a", i, f"a{i}", i + 1, f"a{i}") for i in range(5)] + [item("b", 10 + i, f"b{i}", 50 + i, f"b{i}") for i in range(4)], ITEMS)
    left = spark.createDataFrame([("/r/w.zip", f"a{i}", "a") for i in range(3)] + [("/r/v.zip", f"b{i}", "b") for i in range(2)], "path string, entry_name string, owner string")
    assert [(r["path"], r["suggested"]) for r in match.misnamed_containers(left, items).collect()] == [("/r/w.zip", "a")]


AUDIT = "set_name string, status string, is_disk boolean, is_optional boolean, path string"


def test_rollups_and_completion(spark):
    rows = [("a", "correct", False, False, "p"), ("a", "missing", False, True, None), ("b", "missing", False, False, None), ("b", "correct", False, False, "p"), ("c", "correct", False, False, "p"), ("c", "missing", True, False, None), ("d", "missing", False, False, None), ("e", "incorrect", False, False, "p"), ("f", "badDump", False, False, "p"), ("g", "missing", False, True, None), (None, "unknownFile", False, False, "q")]
    df = spark.createDataFrame(rows, AUDIT)
    look = lambda d, c: {r["set_name"]: r[c] for r in d.collect()}
    assert look(audit.set_rollup(df), "status") == {"a": "correct", "b": "missing", "c": "missing", "d": "missing", "e": "incorrect", "f": "badDump", "g": "correct"}
    assert look(audit.item_rollup(df), "status")["c"] == "correct"
    assert look(audit.completion(df), "completion") == {"a": "complete", "b": "partial", "c": "complete", "d": "empty", "e": "fixable", "f": "partial", "g": "complete"}
    assert audit.counters(df).first().asDict() == {"correct": 3, "incorrect": 1, "bad_dump": 1, "missing": 5, "unverifiable": 0, "surplus": 1, "duplicate": 0}


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("name", "expected"), [("Game (U)", ["Game (USA)"]), ("Big One The (JU)", ["Big One The (Japan, USA)", "Big One The (USA, Japan)", "Big One, The (Japan, USA)", "Big One, The (USA, Japan)"]), ("Game", []), ("Game (Q)", []), ("(U)", [])])
def test_aliases(spark, name, expected):
    assert one(spark, name, names.aliases) == expected


def test_names(spark):
    full = "Title (USA, Europe) (En,Fr+De) (Rev B) (v1.2) (Beta 3) (Unl) (Wii) (Other (thing))"
    d = one(spark, full, names.details)
    assert (d["regions"], d["languages"], d["revision"], d["version"], d["stage"], d["flags"], d["distribution"], d["other"]) == (["USA", "Europe"], ["English", "French", "German"], "B", "1.2", "Beta 3", ["Unlicensed"], ["Wii"], ["Other thing"])
    assert one(spark, "A (rev b) (USA)", names.numeric_revision) == "A (Rev 2) (USA)" and one(spark, "A", names.numeric_revision) is None
    assert one(spark, "A (USA) (En,Ja+Fr) (Rev 1)", names.without_languages) == "A (USA) (Rev 1)"
    assert [one(spark, n, names.embedded_checksum) for n in ("x [AABBCCDD].bin", "x (aabbccdd)", "x [AABBCC].bin", "x")] == ["aabbccdd", "aabbccdd", None, None]
    assert [one(spark, n, names.region_rank) for n in ("sf (World 910522)", "sf (Worldwide)", "sf (Japan, USA)")] == [0, None, 1]
    assert one(spark, "Some™ Game: The  Re/turn?", names.clean_name) == "Some Game - The Re-turn"


def test_headers_and_paths(spark):
    h = one(spark, "4E 45 53 1A 10 08 53 00 00 00", headers.cartridge_header)
    assert (h["mapper"], h["prg_kb"], h["chr_kb"], h["has_battery"], h["mirroring"], h["tv_system"], h["audio_chip"]) == (5, 256, 64, True, "Vertical", "NTSC", "Nintendo MMC5 — audio expansion")
    assert one(spark, "00 11", headers.cartridge_header) is None
    assert [one(spark, p, paths.protected) for p in ("/a/gamelist.xml", "/a/x.srm", "/a/Images/x.bin", "/a/images/y/x.bin", "/a/x.bin", "/a/x.state3")] == [True, True, True, True, False, True]
    assert [one(spark, p, lambda c: paths.under(c, F.lit("/a/M"))) for p in ("/a/M", "/a/M/x", "/a/M::x", "/a/M2/x")] == [True, True, True, False]


def test_near_names_pick_plain_and_available(spark):
    pairs = spark.createDataFrame([("Game X.bin", "Game X (Beta)", 0.95), ("Game X.bin", "Game X (USA)", 0.94), ("Game X.bin", "Gamma", 0.7)], "local_name string, set_name string, score double")
    assert suggest.best_name(pairs).first()["set_name"] == "Game X (USA)"
    local, cat = spark.createDataFrame([("P.O.W. - Prisoners of War (U)",)], "local_name string"), spark.createDataFrame([("P.O.W. - Prisoners of War (USA)",), ("Other",)], "set_name string")
    assert [r["set_name"] for r in suggest.near_names(local, cat).collect()] == ["P.O.W. - Prisoners of War (USA)"]


def test_near_names_of_near_sizes(spark, monkeypatch):
    import random

    rng = random.Random(4)
    names_ = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(8, 16))).strip() or "x" for _ in range(60)]
    cat = [(f"{n} (USA)", rng.randrange(4) * 400) for n in names_]
    local = [(f"{n[:3]}{n[4:]} (USA).zip", rng.randrange(4) * 400) for n in names_]
    a, b = spark.createDataFrame(local, "local_name string, size long"), spark.createDataFrame(cat, "set_name string, size long")
    score = a.withColumnRenamed("size", "s").crossJoin(b).where("abs(s - size) <= 512").withColumn("x", suggest.similarity(suggest.local_title(F.col("local_name")), F.col("set_name"))).where(F.col("x") >= 0.75 - 1e-12)
    want = {(r["local_name"], r["set_name"]) for r in score.collect()}
    for few in (200, 0):
        monkeypatch.setattr(suggest, "FEW_NAMES", few)
        assert {(r["local_name"], r["set_name"]) for r in suggest.near_names(a, b).collect()} == want and len(want) > 30


def test_near_names_are_dealt_out_and_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(suggest, "PART", 3)
    names_ = [f"{x} {y} {n}" for x in ("large", "large", "small") for y in ("ring", "bolt") for n in range(4)]
    a = spark.createDataFrame([(f"{n[0]}{n[2:]} (USA).zip", k % 3 * 500) for k, n in enumerate(names_)], "local_name string, size long")
    b = spark.createDataFrame([(f"{n} (USA)", k % 4 * 500) for k, n in enumerate(names_)] + [("", 0), (" (USA)", 0)], "set_name string, size long")
    score = a.withColumnRenamed("size", "s").crossJoin(b).where("abs(s - size) <= 512").withColumn("x", suggest.similarity(suggest.local_title(F.col("local_name")), F.col("set_name"))).where(F.col("x") >= 0.75 - 1e-12)
    near = suggest.near_names(a, b)
    assert {tuple(r) for r in near.collect()} == {(r["local_name"], r["set_name"], r["x"]) for r in score.collect()} and near.count() > 30
    # A file's size says little of what a table of pieces takes up, so Spark may not choose to hold one in the driver.
    assert "Broadcast" not in near._jdf.queryExecution().sparkPlan().toString()


SETS = "set_name string, clone_of string, rom_of string, is_bios boolean, is_device boolean, refs array<string>"
PARTS = "set_name string, item_ord long, item_name string, size long, crc32 string, merge_name string"


def test_layouts(spark):
    sets = spark.createDataFrame([("base", None, None, True, False, []), ("par", None, "base", False, False, ["dev"]), ("var", "par", "par", False, False, []), ("dev", None, None, False, True, [])], SETS)
    items = spark.createDataFrame([("base", 0, "bios.bin", 1, "b", None), ("par", 0, "p.bin", 2, "p", None), ("par", 1, "same.bin", 3, "s", None), ("var", 0, "v.bin", 4, "v", None), ("var", 1, "q.bin", 2, "p", "p.bin"), ("var", 2, "same.bin", 5, "t", None), ("dev", 0, "d.bin", 6, "d", None)], PARTS)
    shape = lambda df: sorted((r["set_name"], r["item_name"]) for r in df.collect())
    assert ("var", "q.bin") not in shape(layout.build_layout(sets, items, "split"))
    full = shape(layout.build_layout(sets, items, "non-merged", "non-merged"))
    assert {("par", "d.bin"), ("var", "p.bin"), ("var", "bios.bin"), ("par", "bios.bin")} <= set(full) and ("var", "q.bin") not in full
    one_set = [n for s, n in shape(layout.build_layout(sets, items, "merged")) if s == "par"]
    assert one_set == ["p.bin", "same.bin", "v.bin", "var/same.bin"]


def test_cycles_end(spark):
    sets = spark.createDataFrame([("a", None, "b", False, False, []), ("b", None, "a", False, False, []), ("c", None, "zz", False, False, [])], SETS)
    got = {r["set_name"]: r["error"] for r in families.dependency_chain(sets).collect()}
    assert got == {"a": "cycle", "b": "cycle", "c": "unknown"}


def test_long_chains_and_all_ancestors(spark):
    up = {f"s{i}": f"s{i - 1}" if i else None for i in range(70)} | {"x": "y", "y": "z", "z": "y", "t": "x", "lost": "s_gone", "self": "self", "far": "lost"}
    sets = spark.createDataFrame([(k, None, v, k in ("s0", "s40", "z"), False, []) for k, v in up.items()], SETS)
    chains, bases = {}, {}
    for name in up:
        seen, at = [name], up[name]
        while at is not None and at not in seen:
            seen.append(at)
            at = up.get(at)
        error = "cycle" if at is not None else "unknown" if seen[-1] not in up else None
        chains[name] = (">".join(reversed(seen)), error)
        met = seen[1:] + ([at] if at is not None else [])
        if base := next((x for x in met if x in ("s0", "s40", "z")), None):
            bases[name] = base
    assert {r["set_name"]: (r["chain"], r["error"]) for r in families.dependency_chain(sets).collect()} == chains
    assert {r["set_name"]: r["base"] for r in families.base_ancestor(sets).collect()} == bases
    assert families.ancestor_chain(sets).where("set_name = 's69'").count() == 69


def test_snapshots(spark):
    from datetime import datetime

    t, u = datetime(2024, 1, 1), datetime(2024, 1, 2)
    now = spark.createDataFrame([("/a.zip", "x", 1, t), ("/a.zip", "y", 2, u), ("/b", None, 3, t)], "path string, entry_path string, size long, mtime timestamp")
    old = spark.createDataFrame([("/a.zip", "x", 1, t, "m1"), ("/a.zip", "y", 2, t, "m2"), ("/b", None, 3, t, "m3")], "path string, entry_path string, size long, mtime timestamp, md5 string")
    known, fresh = snapshots.reuse(now, old, ["md5"])
    assert [r["md5"] for r in known.collect()] == ["m3"] and fresh.count() == 2


def test_plans_leave_occupied_targets(spark):
    files = spark.createDataFrame([("/r/w1.zip", "x"), ("/r/w2.zip", "x"), ("/r/B.zip", "x"), ("/r/w3.zip", "x")], "path string, entry_name string")
    suggested = spark.createDataFrame([("/r/w1.zip", "a"), ("/r/w2.zip", "a"), ("/r/w3.zip", "b")], "path string, suggested string")
    assert [(r["source"], r["target"]) for r in changes.rename_containers(suggested, files).collect()] == [("/r/w1.zip", "/r/a.zip")]


DATAFILE = """<?xml version="1.0"?>
<datafile><header><name>n</name></header>
<game name="Par" id="1"><description>Par &amp; co</description><rom name="a.bin" size="10" crc="AABBCCDD"/><rom name="b.bin" size=""/><rom name="c.bin"/></game>
<game name="Var" cloneofid="1"><rom name="a.bin" size="7" status="nodump" merge="x"/><disk name="d" sha1="FF"/></game>
</datafile>"""
SOFTWARE = """<softwarelist name="s"><software name="soft"><description>D</description><part name="p1"><dataarea name="rom"><rom name="x" size="3" crc="01"/></dataarea></part><part name="p2"><dataarea name="rom"><rom name="y" size="4"/><rom size="4"/></dataarea></part></software></softwarelist>"""


def test_catalog_dialects(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DATAFILE)
    (tmp_path / "s.xml").write_text(SOFTWARE)
    (tmp_path / "bad.xml").write_text("<other/>")
    sets = catalogs.read_sets(spark, str(tmp_path / "d.xml"))
    assert sorted((r["set_name"], r["clone_of"]) for r in sets.collect()) == [("Par", None), ("Var", "Par")]
    items = sorted((r["set_name"], r["item_name"], r["size"], r["crc32"], r["dump_status"]) for r in catalogs.catalog_items(sets).collect())
    assert items == [("Par", "a.bin", 10, "aabbccdd", "good"), ("Par", "b.bin", 0, None, "good"), ("Var", "a.bin", 7, None, "nodump")]
    assert [r["sha1"] for r in catalogs.catalog_disks(sets).collect()] == ["ff"]
    soft = catalogs.catalog_items(catalogs.read_sets(spark, str(tmp_path / "s.xml")))
    assert sorted((r["item_name"], r["size"]) for r in soft.collect()) == [("x", 3), ("y", 4)]
    with pytest.raises(ValueError, match="datafile.*machine list.*software list"):
        catalogs.dialect(spark, str(tmp_path / "bad.xml"))


def test_inventory_of_containers(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x.bin", b"hello")
        z.comment = b"note"
    root = tmp_path / "root"
    (root / "deep").mkdir(parents=True)
    (root / "a.zip").write_bytes(data.getvalue())
    (root / "bad.zip").write_bytes(b"nonsense")
    (root / ".hidden").write_bytes(b"h")
    (root / "deep" / "g.nes").write_bytes(b"NES\x1a" + bytes(12) + b"body")
    files = inventories.scan(spark, [str(root), str(root / "deep")])
    assert sorted(r["entry_name"] for r in files.select("entry_name").collect()) == ["a.zip", "bad.zip", "g.nes"]
    got = {r["path"].rsplit("/", 1)[-1]: r for r in inventories.zip_entries(files).collect()}
    assert (got["a.zip"]["entry_name"], got["a.zip"]["stored_crc32"], got["a.zip"]["comment"], got["bad.zip"]["read_state"]) == ("x.bin", "3610a686", "note", "corrupt")
    assert inventories.checksum_conflicts(inventories.zip_entries(files)).count() == 0
    nes = inventories.stripped_fingerprints(inventories.fingerprints(files.where("entry_name = 'g.nes'"))).first()
    assert nes["stripped"]["size"] == 4 and nes["stripped"]["md5"] == "841a2d689ad86bd1611447453c22c6fc" and len(nes["crc32"]) == 8


def test_byte_orders():
    swapped = bytes([0x37, 0x80, 0x40, 0x12, 1, 2, 3, 4])
    assert inventories.normalised_bytes("x.v64", swapped) == bytes([0x80, 0x37, 0x12, 0x40, 2, 1, 4, 3])
    block = bytes(512) + bytes([1]) * 8192 + bytes([2]) * 8192
    assert inventories.normalised_bytes("x.smd", block) == bytes([2, 1]) * 8192
