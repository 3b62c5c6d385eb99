"""Layouts against a builder that goes through one set after the other."""

import random

import pytest

from stocktake.operators import layout

SETS = "set_name string, set_ord long, clone_of string, rom_of string, is_bios boolean, refs array<string>"
ITEMS = "set_name string, item_ord long, item_name string, size long, crc32 string, merge_name string"


class Plain:
    def __init__(self, sets, items):
        self.sets = {s[0]: s for s in sets}
        self.items = {s[0]: [i for i in items if i[0] == s[0]] for s in sets}

    def chain(self, name):
        found = []
        while name is not None:
            if name in found or name not in self.sets:
                return None
            found.append(name)
            name = self.sets[name][3]
        return found[::-1]

    def parts(self, name, seen):
        for ref in self.sets[name][5]:
            if ref not in seen:
                seen.add(ref)
                if ref in self.sets:
                    yield from self.items[ref]
                    yield from self.parts(ref, seen)

    def layout(self, name, mode):
        if mode == "split":
            return list(dict.fromkeys((n, s, c) for _, _, n, s, c, m in self.items[name] if m is None))
        if mode == "merged":
            rows, held = [], {}
            for _, _, n, s, c, m in self.items[name]:
                if m is None and held.get(n) != (s, c):
                    held[n] = s, c
                    rows.append((n, s, c))
            for variant in sorted((v for v in self.sets.values() if v[2] == name), key=lambda v: v[1]):
                for _, _, n, s, c, m in self.items[variant[0]]:
                    if m is None and n not in held:
                        held[n] = s, c
                        rows.append((n, s, c))
                    elif m is None and held[n] != (s, c):
                        rows.append((f"{variant[0]}/{n}", s, c))
            return rows
        chain = self.chain(name)
        if chain is None:
            return None
        chain = [x for x in chain if x == name or not self.sets[x][4]]
        above = {n: (s, c) for x in chain[:-1] for _, _, n, s, c, m in self.items[x] if m is None}
        rows = {}
        for _, _, n, s, c, m in self.items[name]:
            if m is None:
                rows[n] = s, c
            elif m in above:
                rows[m] = above[m]
        seen = set()
        for x in chain:
            for _, _, n, s, c, _ in self.parts(x, seen):
                rows[n] = s, c
        return [(n, *v) for n, v in rows.items()]

    def build(self, mode, base_mode):
        out = []
        for name, s in self.sets.items():
            if mode == "merged" and s[2] is not None:
                continue
            rows = self.layout(name, mode)
            if base_mode != "split" and not (base_mode == "merged" and s[2] is not None):
                if self.chain(name) is None:
                    rows = None
                elif rows is not None:
                    names = {r[0] for r in rows}
                    for x in self.chain(name):
                        for _, _, n, size, c, _ in self.items[x] if self.sets[x][4] else []:
                            if n not in names:
                                names.add(n)
                                rows.append((n, size, c))
            out += [(name, *r) for r in rows or []]
        return sorted(out)


def some_catalog(seed):
    rng = random.Random(seed)
    sets = []
    for i in range(60):
        parent = rng.randrange(i) if i and rng.random() < 0.6 else None
        clone = parent is not None and sets[parent][2] is None and rng.random() < 0.6
        rom_of = None if parent is None else f"s{parent}"
        if rng.random() < 0.05:
            rom_of = rng.choice(["nowhere", f"s{i}", f"s{rng.randrange(60)}"])
        # References go to sets of higher numbers alone, so they make no circle.
        refs = [f"s{rng.randrange(i + 1, 62)}" for _ in range(rng.choice([0, 0, 1, 2]))] if i < 59 else []
        sets.append((f"s{i}", (i * 37) % 61, f"s{parent}" if clone else None, rom_of, rng.random() < 0.2, refs))
    items = []
    for name, *_ in sets:
        for k in range(rng.randrange(6)):
            items.append((name, k, f"n{rng.randrange(8)}", rng.randrange(2), f"c{rng.randrange(2)}", f"n{rng.randrange(8)}" if rng.random() < 0.3 else None))
    return sets, items


@pytest.mark.parametrize(("mode", "base_mode"), [("split", "merged"), ("non-merged", "split"), ("non-merged", "non-merged"), ("merged", "split"), ("merged", "merged")])
def test_layouts_equal_a_plain_builder(spark, mode, base_mode):
    sets, items = some_catalog(len(mode) * 31 + len(base_mode))
    got = layout.build_layout(spark.createDataFrame(sets, SETS), spark.createDataFrame(items, ITEMS), mode, base_mode)
    assert sorted((r["set_name"], r["item_name"], r["size"], r["crc32"]) for r in got.collect()) == Plain(sets, items).build(mode, base_mode)


def test_the_last_writer_of_a_name(spark):
    sets = [
        ("bios", 0, None, None, True, []), ("par", 1, None, "bios", False, ["low"]), ("var", 2, "par", "par", False, ["dev"]),
        ("dev", 3, None, None, False, ["deep"]), ("low", 4, None, None, False, []), ("deep", 5, None, None, False, []),
    ]
    items = [
        ("par", 0, "p.bin", 1, "p", None), ("par", 1, "t.bin", 1, "t", "b.bin"), ("bios", 0, "b.bin", 1, "b", None),
        ("var", 0, "x.rom", 1, "own", None), ("var", 1, "q.bin", 1, "q", "p.bin"), ("var", 2, "lost.bin", 1, "l", "no.bin"), ("var", 3, "u.bin", 1, "u", "t.bin"), ("var", 4, "b2.bin", 1, "b", "b.bin"),
        ("low", 0, "x.rom", 2, "low", None), ("low", 1, "low.rom", 2, "low", None), ("dev", 0, "x.rom", 3, "dev", None), ("deep", 0, "low.rom", 4, "deep", None), ("deep", 1, "m.rom", 4, "deep", "merged"),
    ]
    got = layout.build_layout(spark.createDataFrame(sets, SETS), spark.createDataFrame(items, ITEMS), "non-merged")
    # A component beats an own item; components come from the whole chain, the later one wins; a merged item without an unmerged ancestor's item is none; a component's merged items count.
    assert {r["item_name"]: r["crc32"] for r in got.where("set_name = 'var'").collect()} == {"x.rom": "dev", "p.bin": "p", "low.rom": "deep", "m.rom": "deep"}


def test_unknown_modes_and_empty_catalogs(spark):
    none = spark.createDataFrame([], SETS), spark.createDataFrame([], ITEMS)
    for mode in layout.MODES:
        assert layout.build_layout(*none, mode, mode).count() == 0
    with pytest.raises(ValueError):
        layout.build_layout(*none, "flat")
