"""What queries make once, and what they leave out."""

import io
import os
import zipfile

import pandas as pd
import pytest

from stocktake import fixtures, queries_browse, queries_extra, queries_layout, queries_match, queries_more
from stocktake.operators import match
from stocktake.plans import changes, reservation
from stocktake.sources import inventories

SF_DIR = "/root/testdata/sf0.001"


class Held:
    """Keeps the function that a table would be read with."""

    def where(self, *_):
        return self

    select = where

    def mapInPandas(self, read, _):
        self.read = read
        return self


def test_entries_of_small_containers_come_together(spark):
    def packed(i):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr(f"e{i}", b"x" * i)
        return data.getvalue()

    files = pd.DataFrame({"path": [f"/r/{i}.zip" for i in range(50)], "content": [packed(i) if i != 7 else b"none" for i in range(50)]})
    batches = list(inventories.zip_entries(Held(), content=True).read(iter([files[:30], files[30:]])))
    assert len(batches) == 1 and [len(b or b"") for b in batches[0]["content"]] == [i if i != 7 else 0 for i in range(50)]
    assert list(batches[0]["read_state"]).count("corrupt") == 1 and list(batches[0]["path"]) == list(files["path"])


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the sample tables")
def test_a_query_matches_once_and_names_owners_only_if_it_reads_them(spark, monkeypatch):
    made, real = [], queries_match.report(spark, SF_DIR)

    def once(s, d):
        made.append(1)
        return real

    for module in (queries_match, queries_browse, queries_layout):
        monkeypatch.setattr(module, "report", once)
    queries_extra.queries()["J33_system_copies"](spark, SF_DIR)
    assert len(made) == 1
    monkeypatch.setattr(match, "owners", lambda *_: pytest.fail("owners are not read"))
    queries_layout.queries()["P15_corrupt_deleted"](spark, SF_DIR)
    queries_layout.queries()["P15_corrupt_moved"](spark, SF_DIR)
    queries_layout.queries()["P17_remove_comments"](spark, SF_DIR)
    queries_browse.queries()["P8_cross_set_repair"](spark, SF_DIR)


def test_hashes_stand_for_texts_in_the_views(spark, tmp_path):
    # F34 (and F25, F28, F30-F33)
    texts = [(i, None if i % 9 == 2 else f"text {i % 50}", None if i % 7 == 3 else i) for i in range(-40, 200)]
    spark.createDataFrame(texts, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    content = fixtures.contents(spark, str(tmp_path))
    assert "text" not in content.columns
    for name in ("fx_catalog", "fx_inventory"):
        want, got = fixtures.view(spark, str(tmp_path), name), fixtures.view_of_hashes(spark, str(tmp_path), name, content)
        assert got.columns == want.columns and want.count() > 200
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_only_sets_of_several_containers_elect_one(spark, monkeypatch):
    # F34 (and F25, F28, F30-F33)
    items = spark.createDataFrame([("a", 0, 0, "x", 1, "h1"), ("a", 0, 1, "y", 2, "h2"), ("b", 1, 0, "z", 3, "h3"), ("b", 1, 1, "w", 4, "h4")], "set_name string, set_ord long, item_ord long, item_name string, size long, md5 string").selectExpr("*", "'good' AS dump_status")
    files = spark.createDataFrame([("/1/a.zip", "x", 1, "h1"), ("/2/a.zip", "x", 1, "h1"), ("/2/a.zip", "y", 2, "h2"), ("/1/b.zip", "q", 3, "h3")], "path string, entry_name string, size long, md5 string")
    real, seen = match.elect_containers, []

    def elected(items, files, recent=None, scope=None):
        seen.extend(r.set_name for r in items.select("set_name").distinct().collect())
        seen.extend(r.path for r in scope.select("path").distinct().orderBy("path").collect())
        return real(items, files, recent, scope)

    monkeypatch.setattr(match, "elect_containers", elected)
    got = {(r.set_ord, r.item_ord): (r.match_status, r.path) for r in match.match_items(items, files).collect()}
    assert seen == ["a", "/1/a.zip", "/2/a.zip"]
    assert got == {(0, 0): ("correct", "/2/a.zip"), (0, 1): ("correct", "/2/a.zip"), (1, 0): ("misnamed", "/1/b.zip"), (1, 1): ("missing", None)}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the sample tables")
def test_suggested_names_read_no_flags(spark, monkeypatch):
    # F34, F28, F30, F25
    real = queries_match.report(spark, SF_DIR)
    monkeypatch.setattr(queries_match, "report", lambda s, d: real)
    monkeypatch.setattr(match, "leftover_flags", lambda *_: pytest.fail("flags are not read"))
    for name in ("J19_misnamed_containers", "P1_rename_containers", "P2_rename_outcomes"):
        queries_more.queries()[name](spark, SF_DIR)
    queries_browse.queries()["P1_rename_files"](spark, SF_DIR)


def kept_tables(monkeypatch, module):
    """The tables that a module stores from now on."""
    real, made = module.cut, []

    def cut(df):
        made.append(real(df))
        return made[-1]

    monkeypatch.setattr(module, "cut", cut)
    return made


FILES, WANTED = [("/a/1.zip", "e"), ("/a/2.zip", "e"), ("/a/3.zip", "e"), ("/A/new.zip", "e")], [("/a/1.zip", "new"), ("/a/2.zip", "other")]


def test_a_reservation_looks_up_wanted_places_only(spark, monkeypatch):
    # F28
    made = kept_tables(monkeypatch, reservation)
    rows = changes.rename_containers(spark.createDataFrame(WANTED, "path string, suggested string"), spark.createDataFrame(FILES, "path string, entry_name string"))
    assert [(r.source, r.target) for r in rows.collect()] == [("/a/2.zip", "/a/other.zip")]
    assert [[r.want for r in t.collect()] for t in made if t.columns == ["want", "there"]] == [["/a/new.zip"]]


def test_outcomes_of_wanted_names(spark, monkeypatch):
    # F30
    made = kept_tables(monkeypatch, changes)
    rows = changes.rename_outcomes(spark.createDataFrame([*WANTED, ("/a/3.zip", "3")], "path string, suggested string"), spark.createDataFrame(FILES, "path string, entry_name string"))
    assert {r.path: r.outcome for r in rows.collect()} == {"/a/1.zip": "collides", "/a/2.zip": "rename", "/a/3.zip": "already correct", "/A/new.zip": "none"}
    assert len(made) == 1


def test_redundant_containers_are_found_once(spark, monkeypatch):
    # F31
    made = kept_tables(monkeypatch, changes)
    left = spark.createDataFrame([("/a.zip", "x", True), ("/b.zip", "x", True), ("/b.zip", "y", False), ("/c", "c", True)], "path string, entry_name string, redundant boolean")
    files = left.select("path", "entry_name")
    got = sorted((r.op, r.source, r.source_entry) for r in changes.remove_redundant(left, match.redundant_containers(left, files)).collect())
    assert got == [("remove_container", "/a.zip", None), ("remove_container", "/c", None), ("remove_entry", "/b.zip", "x")] and len(made) == 1


def test_phases_without_rows_reserve_nothing(spark, monkeypatch):
    # F25
    real, calls = changes.reserve, []

    def reserve(rows, occupied):
        calls.append(rows.count())
        return real(rows, occupied)

    monkeypatch.setattr(changes, "reserve", reserve)
    none = spark.createDataFrame([], "set_name string, item_name string, match_status string, path string, entry_name string")
    items = spark.createDataFrame([("s", 0)], "set_name string, item_ord int")
    files, wanted = spark.createDataFrame(FILES, "path string, entry_name string"), spark.createDataFrame(WANTED, "path string, suggested string")
    rows = changes.rename_files(none, items, wanted, files)
    assert [(r.source, r.target, r.step) for r in rows.collect()] == [("/a/2.zip", "/a/other.zip", 2)] and calls == [2]
    empty = changes.rename_files(none, items, wanted.limit(0), files)
    assert empty.columns == rows.columns and empty.count() == 0 and calls == [2]


def test_texts_are_read_once(spark, tmp_path):
    # F32 (and all that share the match)
    spark.createDataFrame([(i, f"text {i}", i) for i in range(64)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    content = fixtures.contents(spark, str(tmp_path))
    assert not [f for f in content.inputFiles() if f"{tmp_path}/documents.parquet" in f]
    # Only what views read is hashed: 26 by what is one longer, 7 and 3 (which stands for others) by what is behind a head.
    got = {r.doc_id: (r.md5_text is not None, r.md5_longer is not None, r.md5_headed is not None) for r in content.collect()}
    assert [got[i] for i in (2, 26, 7, 3)] == [(True, False, False), (True, True, False), (True, False, True), (True, True, True)]


def test_trusted_names_are_stored_once(spark, monkeypatch):
    # F32
    made = kept_tables(monkeypatch, match)
    sets = [("a", 0, 0, "x", 1, "h1"), ("a", 0, 1, "y", 2, "h2"), ("b", 1, 0, "z", 3, "h3"), ("c", 2, 0, "c.bin", 4, "h4"), ("d", 3, 0, "w", 5, "h5"), ("e", 4, 0, "v", 6, "h6")]
    items = spark.createDataFrame(sets, "set_name string, set_ord long, item_ord long, item_name string, size long, md5 string").selectExpr("*", "'good' AS dump_status")
    held = [("/1/a.zip", "x", 9, "o"), ("/2/A.zip", "x", 1, "h1"), ("/1/a.zip", "q", 2, "h2"), ("/1/b.zip", "only", 9, "o"), ("/1/c.bin", "c.bin", 9, "o"), ("/1/d.zip", "p", 9, "o"), ("/1/d.zip", "q", 9, "o"), ("/2/d.zip", "r", 9, "o"), ("/1/e.zip", "p", 9, "o"), ("/1/e.zip", "__MACOSX/q", 9, "o")]
    files = spark.createDataFrame(held, "path string, entry_name string, size long, md5 string")
    trusted = {(0, 0): ("/2/A.zip", "x"), (1, 0): ("/1/b.zip", "only"), (2, 0): ("/1/c.bin", "c.bin"), (3, 0): ("/2/d.zip", "r"), (4, 0): ("/1/e.zip", "p")}
    got = {(r.set_ord, r.item_ord): (r.path, r.entry_name) for r in match.match_items(items, files, names_alone="name").where("match_status = 'correct'").collect()}
    assert got == trusted
    tables = [t for t in made if t.columns == ["set_ord", "item_ord", "path", "entry_name", "via_strip", "match_status"]]
    assert len(tables) == 2 and {(r.set_ord, r.item_ord): (r.path, r.entry_name) for r in tables[0].collect()} == trusted
