"""Queries of the match over sets that hold items of one content, against their SQL with the claims of a plain reader of the catalog. The SQL's own claims take it that there are no such sets."""

import os
import re

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.01"
NAMES = ("J6_match", "A1_match_counters", "I5_recent_last", "J12_match_by_spellings", "J15_leftover_flags", "U2_duplicate_rows", "P3_rename_entries", "P4_rebuild_folder", "P5_rebuild_containers", "J3_behind_headers", "J8_found_elsewhere")
CLAIM = re.compile(r"\nhc AS \(.*?\nclaims AS \(SELECT \* FROM hc UNION ALL SELECT \* FROM nc\)", re.S)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the sample tables")


@pytest.fixture(scope="module")
def doubled(tmp_path_factory):
    """The sample tables, with two texts in five those of another item of their set."""
    d = tmp_path_factory.mktemp("doubled")
    for file in os.listdir(SF_DIR):
        if file != "documents.parquet":
            os.symlink(f"{SF_DIR}/{file}", d / file)
    docs = f"'{SF_DIR}/documents.parquet'"
    duckdb.connect().sql(f"""COPY (SELECT d.doc_id, coalesce(o.text, d.text) AS text, d.lang, d.source, coalesce(o.n_chars, d.n_chars) AS n_chars FROM {docs} d
        LEFT JOIN {docs} o ON d.doc_id * 7919 % 1009 < 400 AND o.doc_id = d.doc_id - d.doc_id % 4 + d.doc_id // 4 % 3) TO '{d}/documents.parquet' (FORMAT parquet)""")
    return d


def claims(con, before):
    """Sets in order, undumped items last; an item takes a file of its name first, then the first by path and entry that nobody has."""
    rows = con.sql(f"{before.rstrip().rstrip(',')} SELECT uid, item_name, path, entry_name, via_strip FROM own WHERE fits ORDER BY set_ord, dump_status = 'nodump', item_ord, item_name <> entry_name, path, entry_name").fetchall()
    found, taken = {}, set()
    for uid, item, path, entry, via in rows:
        if uid not in found and (path, entry) not in taken:
            taken.add((path, entry))
            found[uid] = (uid, path, entry, via, "correct" if item == entry else "misnamed")
    return list(found.values())


@pytest.mark.parametrize("name", NAMES)
def test_items_of_one_content_have_a_file_each(spark, doubled, name):
    con = duckdb.connect()
    for file in os.listdir(doubled):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{doubled}/{file}'")
    text = __spark_entry__.oracle_sql()[name]
    at = CLAIM.search(text)
    con.sql("CREATE TABLE plain (uid BIGINT, path VARCHAR, entry_name VARCHAR, via_strip BOOLEAN, match_status VARCHAR)")
    con.executemany("INSERT INTO plain VALUES (?, ?, ?, ?, ?)", claims(con, text[: at.start()]))
    want = con.sql(f"{text[: at.start()]}\nclaims AS (SELECT * FROM plain){text[at.end() :]}")
    columns = want.columns
    rows = sorted(map(str, want.fetchall()))
    assert sorted(str(tuple(r[c] for c in columns)) for r in __spark_entry__.queries()[name](spark, str(doubled)).collect()) == rows and rows
    assert rows != sorted(map(str, con.sql(text).fetchall()))
