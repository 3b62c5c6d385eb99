"""Pages against slices of the sorted list, and what they read."""

import random

from stocktake.operators import paging


def test_pages_are_slices_and_read_their_range_alone(spark, tmp_path):
    keys = sorted(f"k{random.Random(i).randrange(10**9)}-{i}" for i in range(1000))
    path = str(tmp_path / "pages")
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "node string, n long")
    paging.store_pages(rows.repartition(3), path, "node", 100)
    _, ranges = paging.index_of(spark, path)
    assert len(ranges) == 10
    for start, size in ((0, 50), (95, 10), (950, 100), (999, 1), (1000, 5), (120, 300)):
        page = paging.page_at(spark, path, "node", start, size)
        assert [r["node"] for r in page.collect()] == keys[start : start + size]
        after = keys[start - 1] if start else None
        assert [r["node"] for r in paging.page_after(spark, path, "node", after, size).collect()] == keys[start : start + size]
    chosen, before = paging.covering(ranges, None, 500, 20)
    assert len(chosen) <= 2 and before <= 500
    assert len(paging.covering(ranges, keys[499], 0, 20)[0]) <= 2
    paging.store_pages(rows.where("n < 5"), path, "node", 100)
    assert [r["n"] for r in paging.page_at(spark, path, "node", 0, 50).collect()] == [0, 1, 2, 3, 4]


def test_an_empty_list(spark, tmp_path):
    path = str(tmp_path / "pages")
    paging.store_pages(spark.createDataFrame([], "node string, n long"), path, "node")
    assert paging.page_at(spark, path, "node", 0, 5).count() == 0 and paging.page_after(spark, path, "node", "x", 5).count() == 0
