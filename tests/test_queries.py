"""All registered queries of the catalog engine against their SQL on the smallest sample tables."""

import os

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.001"
OWN = {name: query for module in __spark_entry__.CATALOG for name, query in module.queries().items()}
SQL = {name: text for module in __spark_entry__.CATALOG for name, text in module.oracles().items()}
#: At this size no sample row is of the kind that these look for.
MAY_BE_EMPTY = {"J9_nodump_slots", "J24_disk_leftovers"}

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the sample tables")


@pytest.fixture(scope="module")
def one_match(spark):
    """Queries that start from the match of the sample tables share one, which is a checkpoint already."""
    kept = {}

    def once(f):
        return lambda s, d: kept[f.__name__, d] if (f.__name__, d) in kept else kept.setdefault((f.__name__, d), f(s, d))

    patch = pytest.MonkeyPatch()
    for module in __spark_entry__.CATALOG:
        for name in ("both", "report", "left"):
            if hasattr(module, name):
                patch.setattr(module, name, once(getattr(module, name)))
    yield
    patch.undo()


def plain(v):
    return None if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, one_match, tables, name):
    want = tables.sql(SQL[name])
    df = OWN[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert got or name in MAY_BE_EMPTY


def test_views_of_parts_cover_all_parts(spark):
    from stocktake.fixtures import view

    d = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{d}/part.parquet").select("p_partkey").distinct().count()
    assert view(spark, d, "fx_components").select("src").distinct().count() == n and view(spark, d, "fx_titles").count() == n and view(spark, d, "fx_name_catalog").select("set_name").distinct().count() == n


def test_pack_paths_grow_with_documents(spark):
    from stocktake import queries_names

    n = {d: queries_names.packs(spark, f"/root/testdata/{d}", 10).count() for d in ("sf0.001", "sf0.01")}
    assert n["sf0.01"] > 4 * n["sf0.001"] > 400


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(OWN) - set(SQL) == {"J6_loose_mode"}
