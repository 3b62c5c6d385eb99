"""Serials that many sets share, against all pairs."""

import random

from stocktake.operators import alternates


def test_serials_equal_all_pairs(spark):
    rng = random.Random(1)
    some = lambda v: None if rng.random() < 0.1 else v
    left = [(f"p{rng.randrange(300)}", "e", some(f"s{rng.randrange(60)}"), some(rng.randrange(3))) for _ in range(400)]
    sets = [(f"n{i}" + rng.choice(["", " (Beta)", " (demo 1)"]), some(f"s{rng.randrange(60)}"), some(rng.randrange(3))) for i in range(120)]
    want = set()
    for path in {p for p, *_ in left}:
        met = [(n, k is not None and k == size) for p, _, serial, size in left for n, s, k in sets if p == path and serial is not None and s == serial]
        met = [x for x in met if x[1]] or met
        met = [x for x in met if "(" not in x[0]] or met
        want |= {(path, "e", met[0][0])} if len(met) == 1 else set()
    got = alternates.match_serials(spark.createDataFrame(left, "path string, entry_name string, serial string, image_size int"), spark.createDataFrame(sets, "set_name string, serial string, image_size int"))
    assert want and {tuple(r) for r in got.collect()} == want


def test_a_frequent_serial_makes_no_pairs(spark):
    from pyspark.sql import functions as F

    rows = spark.range(100_000).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("e").alias("entry_name"), F.lit("s").alias("serial"), F.lit(1).alias("image_size"))
    assert alternates.match_serials(rows, rows.select(F.col("path").alias("set_name"), "serial", "image_size")).isEmpty()
