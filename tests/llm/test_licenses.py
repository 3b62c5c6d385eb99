"""The license scan against plain readings of phrases and of expressions."""

import random
import re

import pytest

from stocktake.llm import licenses


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", "...", "Released under the MIT License.", "UNDER the mit\nlicense, under the MIT-License", "under the mit licenses", "cc by nc by nc cc by nc",
    "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", "É under the mit license é", "\x00under\x00the\x00mit\x00license", "K under the mit license",
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", "word " * 30_000 + "cc by nc",
]


def test_base_columns_match_a_plain_reading(spark, tmp_path):
    rng = random.Random(1)
    pool = "under the mit license apache license version 2 cc by nc by cc the".split()
    texts = TEXTS + [rng.choice([" ", "-", ", "]).join(rng.choice(pool) for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, TEXTS[3], "x"), (0, None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, finds string").write.parquet(str(tmp_path / "documents.parquet"))
    found = licenses.op12_licenses(spark, str(tmp_path)).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found), key=str)
    assert got == sorted(((d, *plain_base(t)) for d, t, _ in rows), key=str)
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in found)
    assert {r["score"] for r in found if r["doc_id"] in (0, 1, 2)} == {0.0}


def labels(text):
    return [(k, label, word) for k, label, word, *_ in licenses.scan(text.encode(), licenses.BASE)[1]]


def test_longer_notices_stand_for_the_shorter_within():
    assert labels("Under the GNU General Public License, version 3.") == [("notice", "gpl-3.0", 2)]
    assert labels("cc by-nc-sa 4.0") == [("base", "cc-by-nc", 0), ("notice", "cc-by-nc-sa", 0)]
    assert labels("We license this; the licence: of all") == []


@pytest.mark.parametrize(
    ("line", "told", "found", "freedom"),
    [
        ("MIT", "mit", ["mit"], 1.0),
        ("mit or gpl-3.0+ and mpl-2.0", "(mit OR (gpl-3.0+ AND mpl-2.0))", ["gpl-3.0", "mit", "mpl-2.0"], 1.0),
        ("(mit or gpl-3.0) and mpl-2.0", "((mit OR gpl-3.0) AND mpl-2.0)", ["gpl-3.0", "mit", "mpl-2.0"], 0.7),
        ("gpl-2.0-or-later with classpath-exception-2.0", "(gpl-2.0-or-later WITH classpath-exception-2.0)", ["gpl-2.0"], 0.7),
        ("mit and gpl-2.0 with llvm-exception or agpl-3.0", "((mit AND (gpl-2.0 WITH llvm-exception)) OR agpl-3.0)", ["agpl-3.0", "gpl-2.0", "mit"], 0.7),
        ("mit and then some text", "(mit AND then)", ["mit", "then"], 0.0),
        ("mit or", "mit", ["mit"], 1.0),
        ("(mit or gpl-2.0", None, None, None),
        (") mit", None, None, None),
        ("and mit", None, None, None),
        ("((apache-2.0)) */", "apache-2.0", ["apache-2"], 1.0),
    ],
)
def test_expressions(line, told, found, freedom):
    got = licenses.well_formed(licenses.tokens(line.lower(), 0))
    if told is None:
        assert got == []
    else:
        names, value, text, _ = licenses.evaluate(got)
        assert (text, names, value) == (told, found, freedom)


def plain_value(tree):
    if isinstance(tree, str):
        return licenses.freedom_of(licenses.label_of(tree)) or 0.0
    op, a, b = tree
    return (min if op == "and" else max)(plain_value(a), plain_value(b))


def test_random_expressions_have_the_value_of_their_tree():
    rng = random.Random(2)

    def make(depth):
        return rng.choice(["mit", "gpl-3.0", "cc-by-nc-4.0", "mpl-2.0", "odd-1"]) if not depth or rng.random() < 0.3 else (rng.choice(["and", "or"]), make(depth - 1), make(depth - 1))

    def spelt(tree):
        return tree if isinstance(tree, str) else f"({spelt(tree[1])} {tree[0]} {spelt(tree[2])})"

    for _ in range(300):
        tree = make(4)
        line = spelt(tree)
        got = licenses.well_formed(licenses.tokens(line, 0))
        assert got and licenses.evaluate(got)[1] == plain_value(tree)


def test_tags_in_texts():
    assert ("tag", "apache-2", 1) in labels("x\n// SPDX-License-Identifier: Apache-2.0 OR MIT\nand more")
    assert labels('"license": "BSD-3-Clause",') == [("tag", "bsd-3-clause", 0)]
    assert labels("Licence = unknown-thing") == [] and labels("SPDX-License-Identifier: LicenseRef-Own") == [("tag", "licenseref-own", 0)]


def test_no_rows(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
