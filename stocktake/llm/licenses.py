"""License scan: one Aho-Corasick pass over a text's words finds notice phrases and identifier tags; a tag's expression is parsed by a shunting-yard.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. The automaton holds phrases with a
space at either end and reads the words joined by single spaces, so it sees all places of all phrases at once, and only
whole words. At a tag (``SPDX-License-Identifier:``, ``license:``, ``licence =`` ...) the expression after it on its line is read: identifiers joined by
WITH, AND, OR (binding in this order) and parentheses, as far as it is well formed. Its value is the freedom that it leaves a user: of
AND the least, of OR the greatest, and WITH an exception lifts a copyleft licence to a weak one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The phrases that the query asks for first, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: The method's own notices: phrase, label, and how far the phrase alone proves a licence.
NOTICES = (
    ("mit license", "mit", 0.9),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.9),
    ("apache license", "apache", 0.8),
    ("apache license version 2 0", "apache-2", 0.95),
    ("bsd license", "bsd", 0.8),
    ("redistribution and use in source and binary forms", "bsd", 0.9),
    ("isc license", "isc", 0.8),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 0.9),
    ("gnu general public license", "gpl", 0.9),
    ("gnu general public license version 2", "gpl-2.0", 0.95),
    ("gnu general public license version 3", "gpl-3.0", 0.95),
    ("gnu lesser general public license", "lgpl", 0.9),
    ("gnu affero general public license", "agpl", 0.9),
    ("mozilla public license", "mpl", 0.9),
    ("eclipse public license", "epl", 0.9),
    ("boost software license", "bsl-1.0", 0.9),
    ("artistic license", "artistic", 0.7),
    ("creative commons attribution", "cc-by", 0.8),
    ("creative commons attribution sharealike", "cc-by-sa", 0.9),
    ("creative commons attribution share alike", "cc-by-sa", 0.9),
    ("creative commons attribution noncommercial", "cc-by-nc", 0.9),
    ("creative commons attribution non commercial", "cc-by-nc", 0.9),
    ("creative commons attribution noderivatives", "cc-by-nd", 0.9),
    ("creative commons zero", "cc0-1.0", 0.9),
    ("cc by", "cc-by", 0.5),
    ("cc by sa", "cc-by-sa", 0.9),
    ("cc by nd", "cc-by-nd", 0.9),
    ("cc by nc", "cc-by-nc", 0.9),
    ("cc by nc sa", "cc-by-nc-sa", 0.9),
    ("cc by nc nd", "cc-by-nc-nd", 0.9),
    ("cc0", "cc0-1.0", 0.8),
    ("released into the public domain", "public-domain", 0.8),
    ("this is free and unencumbered software", "unlicense", 0.9),
    ("all rights reserved", "all-rights-reserved", 0.6),
)

#: Words of identifier tags; whether any identifier after them counts, or known families only.
TAGS = (("spdx license identifier", True), ("license", False), ("licence", False))
TAG_WEIGHT = 0.95
#: Identifiers of one licence that is labelled otherwise.
SAME = {"apache-2.0": "apache-2", "apache2": "apache-2"}
#: Freedom by family, the longest prefix that fits counts; unknown identifiers leave none that is known.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "zlib": 1.0, "artistic": 0.8, "unlicense": 1.0, "public-domain": 1.0, "cc0": 1.0, "cc-by": 1.0,
    "mpl": 0.7, "epl": 0.7, "lgpl": 0.7, "gpl": 0.5, "cc-by-sa": 0.5, "agpl": 0.4, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "all-rights-reserved": 0.0,
}
WEAK = 0.7

BINDING = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9][a-z0-9.+-]*)")
OPENS = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"'\[]*")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Separators become spaces, capitals small letters.
SPACED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

FINDS = "array<struct<kind:string,label:string,word:long,n_words:int,weight:double,freedom:double,expression:string>>"


def tokens(text: str, at: int) -> Iterator[str]:
    """Tokens of an expression from a place to the end of its line."""
    end = text.find("\n", at)
    end = len(text) if end < 0 else end
    while m := TOKEN.match(text, at, end):
        yield m[1]
        at = m.end()


def well_formed(found: Iterator[str]) -> list[str]:
    """The longest start of the tokens that is an expression."""
    kept, good, depth, want, last = [], 0, 0, True, ""
    for t in found:
        if t == "(" if want else t == ")":
            if last == "with" or (t == ")" and not depth):
                break
            depth += 1 if want else -1
        elif (t in BINDING or t in "()") if want else t not in BINDING:
            break
        else:
            want = not want
        kept.append(t)
        last = t
        if not want and not depth:
            good = len(kept)
    return kept[:good]


def postfix(expression: Sequence[str]) -> list[str]:
    """Shunting-yard: operators wait on a stack until one that binds no tighter, or a closing parenthesis, comes."""
    out: list[str] = []
    waiting: list[str] = []
    for t in expression:
        if t == "(":
            waiting.append(t)
        elif t == ")":
            while (op := waiting.pop()) != "(":
                out.append(op)
        elif t in BINDING:
            while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] >= BINDING[t]:
                out.append(waiting.pop())
            waiting.append(t)
        else:
            out.append(t)
    return out + waiting[::-1]


def label_of(identifier: str) -> str:
    name = re.sub(r"(-only|-or-later|\++)$", "", identifier.rstrip(".")) or identifier
    return SAME.get(name, name)


def freedom_of(label: str) -> float | None:
    parts = label.split("-")
    return next((FREEDOM[p] for n in range(len(parts), 0, -1) if (p := "-".join(parts[:n])) in FREEDOM), None)


def evaluate(expression: Sequence[str]) -> tuple[list[str], float, str, bool]:
    """(labels, freedom, the expression with all its parentheses, whether all licences are known)."""
    labels: list[str] = []
    known = True
    stack: list[tuple[str, float]] = []
    for t in postfix(expression):
        if t not in BINDING:
            stack.append((t, -1.0))
            continue
        (right, r), (left, l) = stack.pop(), stack.pop()
        if t == "with":
            value = max(l, WEAK) if (l := operand(left, l)) >= 0.5 else l
            labels_of = [left]
        else:
            l, r = operand(left, l), operand(right, r)
            value = min(l, r) if t == "and" else max(l, r)
            labels_of = [left, right]
        labels += [x for x in labels_of if " " not in x]
        stack.append((f"({left} {t.upper()} {right})", value))
    text, value = stack.pop()
    if " " not in text:
        labels.append(text)
    names = sorted({label_of(x) for x in labels})
    known = all(freedom_of(x) is not None for x in names)
    return names, operand(text, value), text, known


def operand(text: str, value: float) -> float:
    """A part's freedom: an identifier's by its family, an expression's as it was found."""
    return value if " " in text else freedom_of(label_of(text)) or 0.0


@cache
def automaton(base: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    """Phrases -> what they are; one phrase may be several things."""
    held: dict[str, list[tuple]] = {}
    for phrase, label in base:
        held.setdefault(phrase, []).append(("base", label, 0.95))
    for phrase, label, weight in NOTICES:
        held.setdefault(phrase, []).append(("notice", label, weight))
    for phrase, any_id in TAGS:
        held.setdefault(phrase, []).append(("tag", any_id, TAG_WEIGHT))
    found = ahocorasick.Automaton()
    for phrase, what in held.items():
        found.add_word(f" {phrase} ".encode().decode("latin-1"), (phrase.count(" ") + 1, len(phrase.encode()) + 2, what))
    found.make_automaton()
    return found


def scan(text: bytes, base: tuple[tuple[str, str], ...]) -> tuple[int, list[tuple]]:
    """(words, finds) of one text; finds in the order of FINDS' fields, ordered by place."""
    words = text.translate(SPACED).split()
    spaced = (b" " + b" ".join(words) + b" ").decode("latin-1")
    finds, notices, tags = [], [], []
    at = word = 0
    for last, (n, size, what) in automaton(base).iter(spaced):
        word += spaced.count(" ", at, last)  # spaces before the phrase's closing one: the number of its last word, from 1
        at = last
        for kind, label, weight in what:
            if kind == "base":
                finds.append((kind, label, word - n, n, weight, freedom_of(label_of(label)), None))
            else:
                (notices if kind == "notice" else tags).append((word - n, n, label, weight))
    reach = -1
    for start, n, label, weight in sorted(notices, key=lambda x: (x[0], -x[1])):
        if start + n > reach:  # a notice within a longer one says nothing of its own
            finds.append(("notice", label, start, n, weight, freedom_of(label), None))
            reach = start + n
    if tags:
        finds += tagged(text, tags)
    return len(words), sorted(finds, key=lambda f: (f[2], f[0], f[1]))


def tagged(text: bytes, tags: list[tuple]) -> Iterator[tuple]:
    """Finds of identifier tags; the words' places in the text are only now looked up."""
    small = text.lower()  # of bytes: A-Z alone
    low = small.decode("latin-1")
    places, passed = WORD.finditer(small), 0
    inside = -1
    for start, n, any_id, weight in sorted(tags, key=lambda x: (x[0], -x[1])):
        if start + n <= inside:
            continue  # "license" within a longer tag
        inside = start + n
        end = next(islice(places, inside - 1 - passed, None)).end()
        passed = inside
        if opened := OPENS.match(low, end):
            expression = well_formed(tokens(low, opened.end()))
            if expression:
                labels, freedom, told, known = evaluate(expression)
                if any_id or known:
                    for label in labels:
                        yield "tag", label, start, n, weight, freedom, told


def scanned(batches: Iterator[pa.RecordBatch], base: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    names = ("kind", "label", "word", "n_words", "weight", "freedom", "expression")
    types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.string())
    of = pa.list_(pa.struct(list(zip(names, types, strict=True))))
    for batch in batches:
        found = [scan(t or b"", base) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
        finds = pa.array([[dict(zip(names, f, strict=True)) for f in finds] for _, finds in found], of)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for n, _ in found], pa.int64()), finds], ["id", "n_words", "finds"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", base: Sequence[tuple[str, str]] = BASE) -> DataFrame:
    """(id, n_words, finds, score) for each row of ``docs``: finds are ``base`` phrases, the method's notices and tags, each with its place in words.

    A null text is empty and has no find; rows are read one by one, so repeated rows agree, ids may be null, and other columns are ignored.
    score is the chance that the text states a licence: each label's strongest find counts once, as if finds were independent.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    base = tuple(base)
    found = own.mapInArrow(lambda b: scanned(b, base), f"id {kind}, n_words long, finds {FINDS}")
    each = F.array_distinct(F.transform("finds", lambda f: f["label"]))
    doubt = F.transform(each, lambda label: 1 - F.array_max(F.transform(F.filter("finds", lambda f: f["label"] == label), lambda f: f["weight"])))
    return found.withColumn("score", 1 - F.aggregate(doubt, F.lit(1.0), lambda a, b: a * b))


def labels(finds: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(finds, lambda f: f["label"]))), ",")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With freedom: the least of all finds, null where there is none; a document under two notices must keep to both."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("base", F.filter("finds", lambda f: f["kind"] == "base"))
    place = F.transform("base", lambda f: f["word"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("finds")).alias("labels"), "score", F.array_min(F.transform("finds", lambda f: F.coalesce(f["freedom"], F.lit(0.0)))).alias("freedom"),
    )
