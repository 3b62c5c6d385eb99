"""Reservations: what is granted can be carried out in its order without losing a file, and what is refused could not."""

import random

import pytest
from pyspark.sql import functions as F

from stocktake.plans import changes, reservation

SCHEMA = "op string, group_id string, step int, source string, source_entry string, target string, target_entry string"


def some_plan(rng):
    names = [f"/r/{'aB'[i % 2]}{i}" for i in range(14)]
    there = rng.sample(names, 9)
    rows = []
    for i, source in enumerate(there):
        kind = rng.random()
        if kind < 0.75:
            rows.append(("move" if rng.random() < 0.5 else "rename", f"g{i}", 0, source, None, rng.choice(names + [source.upper(), source.lower()]), None))
        elif kind < 0.85:
            rows.append(("remove", f"g{i}", 0, source, None, None, None))
        elif kind < 0.95:
            rows += [("extract", f"x{i}", 0, source, "e", rng.choice(names), None), ("remove_entry", f"x{i}", 1, source, "e", None, None)]
    if rng.random() < 0.3:
        rows.append(("remove", "again", 0, rng.choice(there), None, None, None))
    return there, rows


def plain_refusals(there, rows):
    """Rows that may not be: the largest set of winners none of which would write over a file that stays."""
    key = lambda r: tuple((x is not None, x) for x in (r[2], r[0], r[3], r[4], r[1], r[5], r[6]))
    frees = lambda r: r[3].lower() if r[2] == 0 and r[0] in ("move", "rename", "remove") else None
    out, seen = {}, set()
    for r in sorted(rows, key=key):
        if frees(r) and frees(r) in seen:
            out[r] = "source"
        seen.add(frees(r))
    wanted = set()
    for r in sorted(rows, key=key):
        if r not in out and r[2] == 0 and r[5]:
            if r[5].lower() in wanted:
                out[r] = "claimed"
            wanted.add(r[5].lower())
    while True:
        leave = {frees(r) for r in rows if r not in out and frees(r)}
        stays = {p.lower() for p in there} - leave
        lost = [r for r in rows if r not in out and r[2] == 0 and r[5] and r[5].lower() in stays and r[5].lower() != frees(r)]
        if not lost:
            break
        out |= dict.fromkeys(lost, "occupied")
    bad = {r[1] for r in out if r[2] == 0}
    return out | {r: "group" for r in rows if r[2] > 0 and r[1] in bad}


@pytest.mark.parametrize("seed", range(12))
def test_granted_rows_can_be_carried_out(spark, seed):
    rng = random.Random(seed)
    there, rows = some_plan(rng)
    files = spark.createDataFrame([(p, p.rsplit("/", 1)[1]) for p in there], "path string, entry_name string")
    got = reservation.reserve(spark.createDataFrame(rows, SCHEMA), reservation.places(files)).collect()
    refused = {tuple(r[c] for c in reservation.COLUMNS): r["refused"] for r in got if r["refused"]}
    assert refused == plain_refusals(there, list(dict.fromkeys(rows)))
    disk = {p.lower(): p for p in there}
    for r in sorted((r for r in got if not r["refused"]), key=lambda r: (r["turn"], r["step"])):
        if r["op"] in ("move", "rename"):
            what = disk.pop(r["source"].lower())
            assert r["target"].lower() not in disk, (r, disk)
            disk[r["target"].lower()] = what
        elif r["op"] == "remove":
            del disk[r["source"].lower()]
        elif r["op"] == "extract":
            assert r["target"].lower() not in disk, (r, disk)
            disk[r["target"].lower()] = "new"
    gone = {r["source"] for r in got if r["op"] == "remove" and not r["refused"]}
    assert {v for v in disk.values() if v != "new"} == set(there) - gone and not any(".swap-" in k for k in disk)


def files_of(spark, *paths):
    return spark.createDataFrame([(p, p.rsplit("/", 1)[1]) for p in paths], "path string, entry_name string")


MATCHES = "set_name string, set_ord long, item_ord long, item_name string, match_status string, path string, entry_name string"


def test_repairs_of_loose_sets_go_into_their_folder(spark):
    rows = [("s", 0, 0, "a", "correct", "/r/s/a", "a"), ("s", 0, 1, "b", "missing", None, None), ("t", 1, 0, "c", "correct", "/r/t.7z", "c"), ("t", 1, 1, "d", "missing", None, None), ("u", 2, 0, "e", "misnamed", "/r/u.zip", "x"), ("u", 2, 1, "f", "foundElsewhere", "/r/s/a", "a")]
    matches = spark.createDataFrame(rows, MATCHES)
    donors = spark.createDataFrame([(0, 1, "/d/b", "b"), (1, 1, "/d/d", "d")], "set_ord long, item_ord long, donor_path string, donor_entry string")
    files = files_of(spark, "/r/s/a", "/r/t.7z", "/r/u.zip")
    got = changes.repair(matches, donors, "fill", ("missing",), files).collect()
    assert [(r["target"], r["target_entry"]) for r in got] == [("/r/s/b", None)]
    got = changes.consolidate(matches, files).collect()
    assert [(r["target"], r["target_entry"]) for r in got] == [("/r/u.zip", "f")]


def test_two_files_never_get_one_target(spark):
    rows = [(f"s{i}", i, 0, "a_x", "correct", f"/r{i}/s1.zip", "a_x") for i in range(2)] + [("s1_a", 2, 0, "x", "correct", "/r3/q.zip", "x"), ("s1", 3, 0, "a_x", "correct", "/r4/q.zip", "a_x")]
    matches = spark.createDataFrame(rows, MATCHES)
    files = matches.select("path", "entry_name")
    left = spark.createDataFrame([], "path string, entry_name string, owner string, redundant boolean")
    moves = changes.organise(matches, left, matches.select("set_name"), "/bios", files).collect()
    assert sorted((r["source"], r["target"]) for r in moves) == [("/r0/s1.zip", "/bios/s1.zip"), ("/r3/q.zip", "/bios/q.zip")]
    out = changes.corrupt_entries(matches, files, "quarantine", "/q", files).collect()
    kept = {(r["source"], r["target"]) for r in out if r["op"] == "extract"}
    assert len(kept) == len({t for _, t in kept}) == 2 and {r["source"] for r in out if r["op"] == "remove_entry"} == {s for s, _ in kept}
    folder = changes.rebuild_to_folder(matches, "/out", files).collect()
    assert len({r["target"].lower() for r in folder}) == len(folder)


def test_a_name_without_extension_is_spelt_one_way(spark):
    files = files_of(spark, "/r/noext", "/r/b.zip")
    suggested = spark.createDataFrame([("/r/noext", "noext"), ("/r/b.zip", "c")], "path string, suggested string")
    assert {r["path"]: r["outcome"] for r in changes.rename_outcomes(suggested, files).collect()} == {"/r/noext": "already correct", "/r/b.zip": "rename"}
    assert [r["target"] for r in changes.rename_containers(suggested.where(F.col("path") != "/r/noext"), files).collect()] == ["/r/c.zip"]


def test_chains_and_swaps_within_a_phase(spark):
    matches = spark.createDataFrame([], MATCHES)
    items = spark.createDataFrame([], "set_name string, item_ord long, item_name string")
    files = files_of(spark, "/r/a.zip", "/r/b.zip", "/r/x.zip", "/r/y.zip")
    suggested = spark.createDataFrame([("/r/a.zip", "b"), ("/r/b.zip", "c"), ("/r/x.zip", "y"), ("/r/y.zip", "x")], "path string, suggested string")
    got = changes.rename_files(matches, items, suggested, files).orderBy("step", "source").collect()
    disk = {"/r/a.zip": 1, "/r/b.zip": 2, "/r/x.zip": 3, "/r/y.zip": 4}
    for r in got:
        assert r["target"] not in disk
        disk[r["target"]] = disk.pop(r["source"])
    assert disk == {"/r/b.zip": 1, "/r/c.zip": 2, "/r/y.zip": 3, "/r/x.zip": 4}
