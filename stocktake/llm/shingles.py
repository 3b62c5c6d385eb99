"""Word shingles of whole texts as sorted sets of 64-bit hashes, made batch by batch with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z are lower-cased, words lie between the ASCII white space characters, a shingle has five words.
WORDS = 5
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[bounds[i]:bounds[i + 1]], and how many words each text has.

    A word's hash is the mixed sum of its bytes' codes times powers of an odd number, by place in the word.
    """
    low = LOWER[data]
    word = ~IS_SPACE[low]
    begins = np.zeros(len(low) + 1, bool)
    begins[bounds] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | begins[1:-1]
    starts = np.flatnonzero(first)
    per_text = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.empty(0, np.uint64), per_text
    owner = np.cumsum(first) - 1
    place = np.arange(len(low)) - starts[np.maximum(owner, 0)]
    place[~word] = 0
    powers = np.cumprod(np.full(int(place.max()) + 1, BASE), dtype=np.uint64)
    terms = BYTE[low] * powers[place]
    terms[~word] = 0
    return mixed(np.add.reduceat(terms, starts)), per_text


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending; with fewer than five words all of them as one; none for no words."""
    binary = texts.cast(pa.large_binary()).fill_null(b"")
    binary = pa.concat_arrays([binary])  # offsets from 0
    offsets = np.frombuffer(binary.buffers()[1], np.int64, len(binary) + 1, binary.offset * 8)
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
    words, per_text = word_hashes(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    ends = np.cumsum(per_text)
    n = len(words) - WORDS + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(WORDS):
        if n > 0:
            rolled += mixed(words[k : k + n] + np.uint64((k * int(BASE)) % 2**64))
    rolled = mixed(rolled)
    found = []
    for count, end in zip(per_text.tolist(), ends.tolist(), strict=True):
        start = end - count
        if count >= WORDS:
            found.append(np.unique(rolled[start : end - WORDS + 1]))
        elif count:
            whole = np.uint64(count)
            for k in range(count):
                whole = mixed(np.array([whole], np.uint64) * BASE + words[start + k])[0]
            found.append(np.array([whole], np.uint64))
        else:
            found.append(np.empty(0, np.uint64))
    return found
