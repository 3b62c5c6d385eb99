"""Readers by ranges, and rules of containers and disks that are named like another set."""

import hashlib
import io
import zipfile
import zlib

import pytest

from stocktake.functions.headers import disk_image_header
from stocktake.operators import disks, match
from stocktake.sources import inventories, ranges


class Counted(io.FileIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        Counted.taken += len(data)
        return data

    def readinto(self, b):
        n = super().readinto(b)
        Counted.taken += n
        return n


@pytest.fixture
def tree(tmp_path):
    big = tmp_path / "r" / "deep" / "big.zip"
    big.parent.mkdir(parents=True)
    with zipfile.ZipFile(big, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"hello"
        for i in range(40):
            z.writestr(f"e{i}.bin", bytes([i]) * (1 << 20))
        z.writestr("nes.nes", b"NES\x1a" + b"\x01" * 12 + b"payload" * 300_000)
        z.writestr("folder/", b"")
    (tmp_path / "r" / "broken.zip").write_bytes(b"PK no zip at all")
    (tmp_path / "r" / "cut.zip").write_bytes(big.read_bytes()[:-30_000_000])
    (tmp_path / "r" / "loose.bin").write_bytes(b"x" * (1024 + 512))
    (tmp_path / "r" / "empty").write_bytes(b"")
    return tmp_path / "r"


def test_a_directory_is_read_without_the_container(tree, monkeypatch):
    path = str(tree / "deep" / "big.zip")
    monkeypatch.setattr(ranges, "opened", lambda p: Counted(p))
    Counted.taken = 0
    with ranges.opened(path) as f, zipfile.ZipFile(f) as z:
        rows = [row for _, row in ranges.entries_of(f, path, z)]
    assert len(rows) == 41 and rows[3][1:4] == ("e3.bin", 1 << 20, f"{zlib.crc32(bytes([3]) * (1 << 20)):08x}") and rows[3][5:] == ("hello", "ok")
    assert Counted.taken < 100_000 < 40_000_000 < (tree / "deep" / "big.zip").stat().st_size


def test_directories_and_fingerprints_of_a_tree(spark, tree):
    files = ranges.listing(spark, [str(tree)])
    found = {(r["path"].rsplit("/", 1)[-1], r["entry_name"]): r for r in ranges.zip_directory(files).collect()}
    whole = {(r["path"].rsplit("/", 1)[-1], r["entry_name"]): r for r in inventories.zip_entries(inventories.scan(spark, [str(tree)])).collect()}
    assert {k: tuple(r)[1:] for k, r in found.items()} == {k: tuple(r)[1:] for k, r in whole.items()} and len(found) == 43
    prints = {(r["path"].rsplit("/", 1)[-1], r["entry_name"]): r for r in ranges.streamed_fingerprints(files).collect()}
    data = b"NES\x1a" + b"\x01" * 12 + b"payload" * 300_000
    nes = prints["big.zip", "nes.nes"]
    assert (nes["size"], nes["md5"], nes["crc32"]) == (len(data), hashlib.md5(data).hexdigest(), f"{zlib.crc32(data):08x}")
    assert nes["stripped"]["sha1"] == hashlib.sha1(data[16:]).hexdigest() and nes["stripped"]["size"] == len(data) - 16
    assert prints["loose.bin", "loose.bin"]["stripped"]["md5"] == hashlib.md5(b"x" * 1024).hexdigest()
    assert prints["empty", "empty"]["md5"] == hashlib.md5(b"").hexdigest() and prints["big.zip", "e0.bin"]["stripped"] is None
    assert {k: r["read_state"] for k, r in prints.items() if r["read_state"] != "ok"} == {("broken.zip", None): "corrupt", ("cut.zip", None): "corrupt"}


def test_heads_of_disk_images(spark, tree):
    head = b"MComprHD" + bytes(4) + (5).to_bytes(4, "big") + bytes(16) + (4096).to_bytes(8, "big") + bytes(44) + b"\x11" * 20 + bytes(20)
    (tree / "a.chd").write_bytes(head + b"z" * 500_000)
    found = {r["path"].rsplit("/", 1)[-1]: r for r in ranges.heads(ranges.listing(spark, [str(tree)])).withColumn("h", disk_image_header(__import__("pyspark").sql.functions.col("content"))).collect()}
    assert found["a.chd"]["h"].asDict() == {"version": 5, "logical_bytes": 4096, "sha1": "11" * 20, "parent_sha1": None}
    assert len(found["a.chd"]["content"]) == 124 and found["loose.bin"]["h"] is None and found["empty"]["content"] == b""


def test_depth_counts_from_roots_of_any_spelling(spark, tree):
    for root in (str(tree), f"file:{tree}", f"file://{tree}/"):
        scanned = inventories.scan(spark, [root], 1).select("path").collect()
        assert {r["path"].rsplit("/", 1)[-1] for r in scanned} == {"broken.zip", "cut.zip", "loose.bin"}  # the file source leaves out empty files, ``walk`` doesn't


def test_walk_leaves_out_links_and_hidden_files_and_tells_the_rest(spark, tree):
    (tree / ".hidden").mkdir()
    (tree / ".hidden" / "x").write_bytes(b"x")
    (tree / "link.zip").symlink_to(tree / "broken.zip")
    (tree / "linked").symlink_to(tree / "deep")
    (tree / "deep" / "er").mkdir()
    (tree / "deep" / "er" / "z").write_bytes(b"zz")
    files, skipped, gone = ranges.walk(spark, [f"file:{tree}", str(tree / "deep"), str(tree / "nowhere"), str(tree / "LOOSE.BIN")])
    found = {r["path"][len(str(tree)) :]: r["size"] for r in files.collect()}
    assert set(found) == {"/broken.zip", "/cut.zip", "/loose.bin", "/empty", "/deep/big.zip", "/deep/er/z"} and found["/empty"] == 0
    assert skipped.count() == 0 and [r["root"] for r in gone.collect()] == [str(tree / "nowhere")]
    files, skipped, _ = ranges.walk(spark, [str(tree)], 1)
    assert files.count() == 4 and [r["folder"] for r in skipped.collect()] == [str(tree / "deep")]


def test_named_files_list_a_folder_once(spark, tmp_path, monkeypatch):
    for name in ("a.bin", "A.bin", "B.Bin", "c/c"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    asked, real = [], ranges.looked
    monkeypatch.setattr(ranges, "looked", lambda places: real(asked.append(places.count()) or places))
    paths = [f"file:{tmp_path}/{n}" for n in ("A.BIN", "a.bin", "b.bin", "gone", "c/C", "a.bin/A.bin", "none/x")]
    found = {(r["path"][len(str(tmp_path)) :], r["entry_name"], r["size"]) for r in ranges.files_named(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert found == {("/A.bin", "A.bin", 5), ("/a.bin", "a.bin", 5), ("/B.Bin", "B.Bin", 5), ("/c/c", "c", 3)}
    assert asked == [4]


ITEMS = "set_name string, set_ord long, item_ord long, item_name string"
LEFT = "path string, entry_name string, owner string"
MATCHES = "set_name string, match_status string, path string"


def test_a_container_named_like_another_set(spark):
    items = spark.createDataFrame([("known", 0, 0, "k"), ("one", 1, 0, "o"), ("has", 2, 0, "h"), ("two", 3, 0, "t"), ("two", 3, 1, "u")], ITEMS)
    left = spark.createDataFrame([("/r/known.zip", "o.bin", "one"), ("/r/two.zip", "h.bin", "has"), ("/r/x.bin", "x.bin", "two"), ("/r/y.bin", "y.bin", "two"), ("/r/q.bin", "q.bin", "one"), ("/r/z.zip", "t", "two"), ("/r/z.zip", "u", "two")], LEFT)
    matches = spark.createDataFrame([("has", "correct", "/r/has.zip"), ("known", "missing", None)], MATCHES)
    found = {r["path"]: r["suggested"] for r in match.misnamed_containers(left, items, matches).collect()}
    # known.zip holds one's only item and nothing of its own; two.zip's content belongs to a set that has a file; loose files of a set of two items don't count.
    assert found == {"/r/known.zip": "one", "/r/q.bin": "one", "/r/z.zip": "two"}
    claimed = matches.unionByName(spark.createDataFrame([("known", "correct", "/r/known.zip")], MATCHES))
    assert "/r/known.zip" not in {r["path"] for r in match.misnamed_containers(left, items, claimed).collect()}


def test_disks_in_folders_of_their_own(spark):
    wanted = spark.createDataFrame([(0, "s", "Disk", "aa"), (1, "t", "only", "bb"), (2, "u", "both", "cc")], "ord long, set_name string, disk_name string, sha1 string")
    files = spark.createDataFrame([("/r/a/disk/x.chd", "x", "aa"), ("/r/b/x.chd", "x", "aa"), ("/r/only/y.chd", "y", "bb"), ("/r/both/z.chd", "z", "cc"), ("/r/both2/z.chd", "z", "cc")], "path string, stem string, sha1 string")
    paths = lambda inside: {r["disk_name"]: r["path"] for r in disks.match_disks(wanted, files, inside).collect()}
    assert paths(False) == {"Disk": "/r/b/x.chd", "only": "/r/only/y.chd", "both": "/r/both2/z.chd"}
    assert paths(True) == {"Disk": "/r/a/disk/x.chd", "only": "/r/only/y.chd", "both": "/r/both/z.chd"}
