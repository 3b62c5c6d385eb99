"""Comparisons of names inside a task: letters as bits, and edit distances of many pairs at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs that are looked at together, letters of a name that a word of bits holds, and kinds of letters that distances tell apart.
PAIRS, WORD, KINDS = 1 << 16, 64, 128
BITS = ("one", "two", "three")


def code_points(names: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all names behind each other, and each name's number of them."""
    names = [x or "" for x in names]
    return np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype="<u4"), np.fromiter(map(len, names), "int64", len(names))


def gathered(bits: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the union of its bits; ``row`` ascends."""
    out = np.zeros(n, "uint64")
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.bitwise_or.reduceat(bits, first)
    return out


def letter_bits(names: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A name's letters in 64 bits, a letter's second and later places in bits of their own, and its pairs of letters in 128: an edit clears one bit or two at most, and sets as many."""
    letters, n = code_points(names)
    letters, row = letters.astype("int64"), np.repeat(np.arange(len(n)), n)
    order = np.argsort(row << 21 | letters, kind="stable")
    sorted_row, sorted_letters = row[order], letters[order]
    new = np.r_[True, (sorted_row[1:] != sorted_row[:-1]) | (sorted_letters[1:] != sorted_letters[:-1])][: len(order)]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) + 1
    one = gathered(np.uint64(1) << ((sorted_letters + 41 * place) % 64).astype("uint64"), sorted_row, len(n))
    inside = row[1:] == row[:-1]
    pair, pair_row = (letters[:-1][inside] * 37 + letters[1:][inside]) % 128, row[1:][inside]
    bit = np.uint64(1) << (pair % 64).astype("uint64")
    return one, *(gathered(np.where(pair // 64 == k, bit, np.uint64(0)), pair_row, len(n)) for k in (0, 1))


class Side:
    """One side's texts, ready to be compared: bits, lengths, the edits that ``floor`` leaves to a text of such a length, and the letters' kinds, a row for each place."""

    def __init__(self, table: pa.Table, c: str, floor: float, order: np.ndarray):
        at = lambda k: table[f"{c}_{k}"].to_numpy()[order]
        self.one, self.two, self.three = (at(k).view("uint64") for k in BITS)
        edits = np.floor(at("n") * (1 - floor) + 1e-9)
        # More than the bits can tell stands for any number.
        self.few, self.twice = np.minimum(edits, 255).astype("uint8"), np.minimum(edits * 2, 255).astype("uint8")
        self.edits, names = edits.astype("int64"), table[f"{c}_text"].take(pa.array(order)).to_pylist()
        letters, self.n = code_points(names)
        row, place = np.repeat(np.arange(len(names)), self.n), np.arange(len(letters)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        short = place < WORD
        self.kinds = np.zeros((WORD, len(names)), "int64")
        self.kinds[place[short], row[short]] = letters[short] % KINDS

    def words(self, rows: np.ndarray) -> np.ndarray:
        """For each kind of letter, the places in each of ``rows`` that have it, as bits."""
        found = np.zeros((len(rows), KINDS), "uint64")
        n = self.n[rows]
        for place in range(min(int(n.max(initial=0)), WORD)):
            has = np.flatnonzero(n > place)
            found[has, self.kinds[place, rows[has]]] |= np.uint64(1) << np.uint64(place)
        return found


def distances(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edit distances of texts of 1 to WORD letters, by Myers' bits. Kinds of letters stand for letters, so a distance may be too small, never too large."""
    rows, at = np.unique(i, return_inverse=True)
    words, at = a.words(rows).ravel(), at * KINDS
    one, n, last = np.uint64(1), b.n[j], (a.n[i] - 1).astype("uint64")
    plus, minus, found = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), "uint64"), a.n[i].copy()
    for place in range(int(n.max(initial=0))):
        same = words.take(at + b.kinds[place].take(j))
        across = ((same & plus) + plus ^ plus) | same
        up, down = minus | ~(across | plus), plus & across
        found += np.where(n > place, (up >> last & one).astype("int64") - (down >> last & one).astype("int64"), 0)
        up, down, same = up << one | one, down << one, same | minus
        plus, minus = down | ~(same | up), up & same
    return found


def close(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs can be within their edits: by letters, lengths, pairs of letters, and then by distance. Longer texts stay in."""
    lacks = lambda x, y, i, j: (np.bitwise_count(x.take(i) & ~y.take(j)), np.bitwise_count(y.take(j) & ~x.take(i)))
    here, there = lacks(a.one, b.one, i, j)
    kept = np.flatnonzero(np.maximum(here, there) <= np.maximum(a.few.take(i), b.few.take(j)))
    p, q = i[kept], j[kept]
    (two, two_there), (three, three_there) = lacks(a.two, b.two, p, q), lacks(a.three, b.three, p, q)
    edits = np.maximum(a.edits.take(p), b.edits.take(q))
    fits = (np.abs(a.n.take(p) - b.n.take(q)) <= edits) & (np.maximum(two + three, two_there + three_there) <= np.maximum(a.twice.take(p), b.twice.take(q)))
    kept, p, q, edits = kept[fits], p[fits], q[fits], edits[fits]
    short = np.flatnonzero((a.n[p] > 0) & (a.n[p] <= WORD) & (b.n[q] <= WORD))
    far = np.zeros(len(kept), bool)
    far[short] = distances(a, b, p[short], q[short]) > edits[short]
    return kept[~far]


def blocks(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of each row and the others from its ``low`` to its ``high``, about PAIRS at a time."""
    n = np.maximum(high - low, 0)
    before = np.cumsum(n) - n
    edges = np.flatnonzero(np.r_[True, before[1:] // PAIRS != before[:-1] // PAIRS, True]) if len(n) else []
    for start, end in zip(edges[:-1], edges[1:]):
        i = np.repeat(np.arange(start, end), n[start:end])
        yield i, np.arange(len(i)) - np.repeat(before[start:end] - before[start] - low[start:end], n[start:end])


def close_pairs(left: pa.Table, right: pa.Table, sides: list[tuple[str, str, float]], off: int, kept: tuple[list[str], list[str]]) -> pa.Table:
    """The columns ``kept`` of both tables' rows that can be close in one of the ``sides`` (column, other column, floor), of one ``near`` and of sizes (``size``, ``b_size``) at most ``off`` apart."""
    order, other = np.argsort(left["size"].to_numpy(), kind="stable"), np.lexsort((right["b_size"].to_numpy(), right["near"].to_numpy()))
    near, size = left["near"].to_numpy()[order], left["size"].to_numpy()[order]
    b_near, b_size = right["near"].to_numpy()[other], right["b_size"].to_numpy()[other]
    # Rows of one near have neighbouring sizes, so both ascend together.
    start, end = np.searchsorted(b_near, near), np.searchsorted(b_near, near, "right")
    low, high = np.maximum(start, np.searchsorted(b_size, size - off)), np.minimum(end, np.searchsorted(b_size, size + off, "right"))
    texts = [(Side(left, x, floor, order), Side(right, y, floor, other)) for x, y, floor in sides]
    found = [(np.zeros(0, "int64"),) * 2]
    for i, j in blocks(low, high):
        at = np.unique(np.concatenate([close(a, b, i, j) for a, b in texts]))
        found.append((order[i[at]], other[j[at]]))
    # A block's rows are a batch of their own, however many pairs are close.
    return pa.concat_tables(pa.table({c: t[c].take(pa.array(k)) for t, k, cs in ((left, i, kept[0]), (right, j, kept[1])) for c in cs}) for i, j in found)
