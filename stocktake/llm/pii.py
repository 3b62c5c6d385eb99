"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss.

The field reads the words of a line as features of their shape (digits, letters, signs, length, hexadecimal look) and a
few cue words before them. It is trained by gradient ascent on a small labelled table and decoded by Viterbi in
numpy, many lines at a time. Its spans come beside the patterns' spans, which all stay.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .shingles import IS_SPACE, LOWER

#: The kinds in their order, and the patterns. Possessive repeats and the guards in front find the same
#: matches as the plain patterns do, in linear time.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: The kind that the field adds to the patterns' kinds.
LEARNED = (*KINDS, "secret")
TAGS = ("O", *(f"{p}-{k}" for k in LEARNED for p in "BI"))
CUES = ("token", "key", "secret", "password", "passwd", "pwd", "api_key", "phone", "tel", "mail", "email", "ip", "card")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the longest run of local characters before an @, after the last match, and the domain behind it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        end = max(end, at + 1)
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


# The field: words, features, training, decoding.

BITS = ("digit1", "digit3", "digit8", "alpha", "alpha_digit", "at", "dots1", "dots3", "equals", "plus", "paren", "dash", "quote", "hexlong", "long", "colon", "upper", "cue", "beyond", "caps", "hexquote")


#: What a byte is, as bits: letter, digit, full stop, upper case, beyond ASCII, sign, lower case.
BYTE = np.zeros(256, np.uint8)
BYTE[65:91] = 1 | 8
BYTE[97:123] = 1 | 64
BYTE[48:58] = 2
BYTE[46] = 4
BYTE[128:] = 1 | 16
BYTE[[ord(c) for c in "@=+()-\"':"]] = 32


def shape_codes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Shape code of each word data[start:stop], its features as bits. Only words with digits or signs are looked at closely."""
    n = stops - starts
    if not len(n):
        return np.empty(0, np.int64)
    seen = np.bitwise_or.reduceat(BYTE[data], starts)
    bit = {name: np.int64(1) << i for i, name in enumerate(BITS)}
    code = ((seen & 1) > 0) * bit["alpha"] + ((seen & 4) > 0) * bit["dots1"] + ((seen & 8) > 0) * bit["upper"] + ((seen & 16) > 0) * bit["beyond"] + (n >= 16) * bit["long"]
    code += ((seen & (8 | 64 | 16)) == 8) * (n >= 12) * bit["caps"]
    odd = np.flatnonzero(seen & (2 | 32))
    if len(odd):
        size = n[odd]
        end = np.cumsum(size)
        part = data[np.repeat(starts[odd] - (end - size), size) + np.arange(end[-1])]
        total = lambda ok: (c := np.r_[0, np.cumsum(ok)])[end] - c[end - size]
        digit, lower = (part >= 48) & (part <= 57), LOWER[part]
        digits, hexes = total(digit), total(digit | (lower >= 97) & (lower <= 102))
        more = {
            "digit1": digits >= 1, "digit3": digits >= 3, "digit8": digits >= 8, "alpha_digit": (digits > 0) & ((seen[odd] & 1) > 0), "at": total(part == 64) > 0, "dots3": total(part == 46) >= 3, "equals": total(part == 61) > 0,
            "plus": total(part == 43) > 0, "paren": total((part == 40) | (part == 41)) > 0, "dash": total(part == 45) > 0, "quote": total((part == 34) | (part == 39)) > 0, "hexlong": (hexes >= 14) & (hexes + 14 >= size) & (digits >= 2), "colon": total(part == 58) > 0,
        }
        more["hexquote"] = more["hexlong"] & more["quote"]
        for name, flag in more.items():
            code[odd] |= flag * bit[name]
    # Cue words, also where = or : joins them to what follows, are compared byte by byte.
    for word in CUES:
        w = np.frombuffer(word.encode(), np.uint8)
        can = np.flatnonzero(n >= len(w))
        for i, c in enumerate(w):
            can = can[LOWER[data[starts[can] + i]] == c]
        after = np.minimum(starts[can] + len(w), len(data) - 1)
        code[can[(n[can] == len(w)) | np.isin(data[after], (61, 58))]] |= bit["cue"]
    return code


def features(code: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(code)), (code[:, None] >> np.arange(len(BITS))) & 1].astype(np.float64)


def code_ids(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, place of each code among them); codes are few bits, so this is a table lookup."""
    there = np.zeros(1 << len(BITS), bool)
    there[code] = True
    uniq = np.flatnonzero(there)
    place = np.empty(1 << len(BITS), np.int32)
    place[uniq] = np.arange(len(uniq))
    return uniq, place[code]


def decode(code: np.ndarray, begin: np.ndarray, size: np.ndarray, w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags of all words; a word's scores come from its own code and its neighbours' in the line (``w`` is (3, features, tags)).

    A line in which O leads every other tag, at each word, by twice the most that transitions can make up for, has the
    best path O throughout: m words off O gain at most m + 1 transitions. Such lines need no decoding.
    """
    uniq, ids = code_ids(code)
    parts = [(features(uniq) @ w[k]).astype(np.float32) for k in range(3)]
    lead = [(p[:, :1] - p[:, 1:]).min(1) for p in parts]
    first, last = np.zeros(len(code), bool), np.zeros(len(code), bool)
    first[begin], last[begin + size - 1] = True, True
    before, after = np.r_[0, ids[:-1]], np.r_[ids[1:], 0]
    margin = lead[0][ids] + np.where(first, 0, lead[1][before]) + np.where(last, 0, lead[2][after])
    open_ = np.add.reduceat(margin < 2 * max(0.0, float(trans.max() - trans[0, 0])) + 1e-3, begin) > 0
    tags = np.zeros(len(code), np.int8)
    if open_.any():
        at = np.repeat(begin[open_], size[open_]) + np.arange(size[open_].sum()) - np.repeat(np.cumsum(size[open_]) - size[open_], size[open_])
        scores = parts[0][ids[at]] + np.where(first[at, None], 0, parts[1][before[at]]) + np.where(last[at, None], 0, parts[2][after[at]])
        tags[at] = viterbi(scores, np.cumsum(size[open_]) - size[open_], size[open_], trans.astype(np.float32))
    return tags


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, line) of words between ASCII white space; lines end at line feeds."""
    word = ~IS_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.cumsum(data == 10)[starts]


def lines_of(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.empty(0, np.int64)
    return begin, np.diff(np.r_[begin, len(line)])


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - m).sum(axis, keepdims=True)) + m).squeeze(axis)


def viterbi(scores: np.ndarray, begin: np.ndarray, size: np.ndarray, trans: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Best tags of all words. Lines go by length, so a batch of them has little padding; each line is decoded whole."""
    tags = np.zeros(len(scores), np.int8)
    order = np.argsort(size, kind="stable")
    k = scores.shape[1]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and j - i < rows and size[order[j]] <= size[order[i]] * 1.3 + 2 and (j - i) * size[order[j]] < 1 << 17:
            j += 1
        lines = order[i:j]
        n, t = size[lines], int(size[lines].max())
        best, back = scores[begin[lines]], np.zeros((t, len(lines), k), np.int8)
        for step in range(1, t):
            live = n > step
            to = best[:, :, None] + trans
            arg = to.argmax(1)
            new = np.take_along_axis(to, arg[:, None], 1)[:, 0] + scores[np.where(live, begin[lines] + step, 0)]
            back[step] = np.where(live[:, None], arg, np.arange(k))
            best = np.where(live[:, None], new, best)
        tag = best.argmax(1)
        for step in range(t - 1, -1, -1):
            live = n > step
            tags[begin[lines][live] + step] = tag[live]
            tag = back[step][np.arange(len(lines)), tag]
        i = j
    return tags


def train(rows: Sequence[tuple[str, Sequence[tuple[str, int, int]]]], steps: int = 250, decay: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a field for ``rows`` of (text, [(kind, start, end)]), by Adam on the regularised likelihood."""
    coded = []
    for text, spans in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        starts, stops, line = split_words(data)
        tags = np.zeros(len(starts), int)
        for kind, a, b in spans:
            inside = [i for i in range(len(starts)) if starts[i] < b and stops[i] > a]
            for k, i in enumerate(inside):
                tags[i] = TAGS.index(("I-" if k else "B-") + kind)
        coded.append((shape_codes(data, starts, stops), tags))
    k, f, t = len(TAGS), len(BITS) + 1, max(len(c) for c, _ in coded)
    x = np.zeros((len(coded), t, 3 * f))
    y, mask = np.zeros((len(coded), t), int), np.zeros((len(coded), t))
    for i, (code, tags) in enumerate(coded):
        own = features(code)
        x[i, : len(code), :f], x[i, 1 : len(code), f : 2 * f], x[i, : len(code) - 1, 2 * f :] = own, own[:-1], own[1:]
        y[i, : len(code)], mask[i, : len(code)] = tags, 1
    w, trans = np.zeros((3 * f, k)), np.zeros((k, k))
    moment = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, trans)]
    gold = np.eye(k)[y] * mask[:, :, None]
    pairs = np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])
    for step in range(1, steps + 1):
        e = x @ w
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for i in range(1, t):
            alpha[:, i] = np.where(mask[:, i, None] > 0, logsumexp(alpha[:, i - 1, :, None] + trans, 1) + e[:, i], alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            beta[:, i] = np.where(mask[:, i + 1, None] > 0, logsumexp(trans + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0)
        z = logsumexp(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        both = np.exp(alpha[:, :-1, :, None] + trans + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grads = (np.einsum("btf,btk->fk", x, gold - marginal) - decay * w, pairs - both.sum((0, 1)) - decay * trans)
        for v, g, (m, s) in zip((w, trans), grads, moment, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return w.reshape(3, f, k), trans


def labelled_table(seed: int = 0, copies: int = 12) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: made sentences with personal data and secrets, and as many with harmless numbers."""
    rng = np.random.default_rng(seed)
    letters, hexed = list("abdeghilmnorstuéüñ"), list("0123456789abcdef")
    pick = lambda chars, n: "".join(rng.choice(chars, n))
    word = lambda: pick(letters, int(rng.integers(1, 12)))
    digits = lambda n: pick(list("0123456789"), n)
    filler = lambda n: " ".join((w.capitalize() if rng.random() < 0.15 else w) + (rng.choice([".", ","]) if rng.random() < 0.15 else "") for w in (word() for _ in range(n)))
    make = {
        "email": lambda: f"{word()}.{digits(2)}@{word()}.example.{rng.choice(['com', 'org'])}",
        "ip": lambda: ".".join(str(rng.integers(1, 256)) for _ in range(4)),
        "card": lambda: digits(16) if rng.random() < 0.5 else " ".join(digits(4) for _ in range(4)),
        "phone": lambda: rng.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}", f"+{digits(11)}"]),
        "secret": lambda: rng.choice([f"password={pick(hexed, 18)}", f'token = "{pick(hexed, 40)}"', f"api_key: {pick(hexed, 32)}", f"secret={pick(hexed, 24)}", f"AKIA{pick(list('ABCDEFGHJKLMNPQRSTUVWXYZ234567'), 14)}{digits(2)}"]),
    }
    harmless = (lambda: digits(4), lambda: f"{digits(1)}.{digits(1)}.", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"({digits(2)})", lambda: f"{word()}{digits(2)}", lambda: digits(7), lambda: "token", lambda: "password", lambda: f"{word()}-{word()}", lambda: f'"{word()}"', lambda: f"{word()}=", lambda: digits(12), lambda: f"{word()}_{word()}", lambda: "=", lambda: pick(letters, 20), lambda: f"{pick(letters, 18).capitalize()}.", lambda: f"{word()} {pick(list('ABDEGHILMNOR'), 18)}!", lambda: pick(hexed, 6))
    rows = []
    for _ in range(copies):
        for kind, new in make.items():
            a, b, value = filler(int(rng.integers(1, 7))), filler(int(rng.integers(1, 7))), new()
            rows.append((f"{a} {value} {b}", [(kind, len(f"{a} ".encode()), len(f"{a} {value}".encode()))]))
        for new in harmless:
            rows.append((f"{filler(int(rng.integers(1, 7)))} {new()} {filler(int(rng.integers(1, 7)))}", []))
    return rows


def field_spans(texts: list[bytes], w: np.ndarray, trans: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per text (start, kind, end) in bytes, by the field."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, stops, line = split_words(data)
    if not len(starts):
        return found
    begin, size = lines_of(line)
    tags = decode(shape_codes(data, starts, stops), begin, size, w, trans)
    first = np.zeros(len(starts), bool)
    first[begin] = True
    bounds = np.cumsum([len(t) + 1 for t in texts])
    marked = np.flatnonzero(tags)
    spans: list[list[int]] = []
    for i in marked.tolist():
        kind, inside = (int(tags[i]) - 1) // 2, int(tags[i]) % 2 == 0
        if inside and spans and spans[-1][3] == i - 1 and spans[-1][1] == kind and not first[i]:
            spans[-1][2:] = [int(stops[i]), i]
        else:
            spans.append([int(starts[i]), kind, int(stops[i]), i])
    for a, kind, b, _ in spans:
        t = int(np.searchsorted(bounds, a, "right"))
        off = int(bounds[t - 1]) if t else 0
        raw = texts[t][a - off : b - off]
        lead, tail = len(raw) - len(raw.lstrip(b"(\"'")), len(raw) - len(raw.rstrip(b".,;:)\"'"))
        if lead + tail < len(raw):
            found[t].append((a - off + lead, kind, b - off - tail))
    return found


def all_spans(texts: list[bytes], w: np.ndarray, trans: np.ndarray) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, base and learned spans) in code points; a learned span that overlaps a base one is left out."""
    for raw, learned in zip(texts, field_spans(texts, w, trans), strict=True):
        text = raw.decode("utf-8", "replace")
        base = base_spans(text)
        more: list[tuple[int, int, int]] = []
        byte = char = i = reached = 0  # both lists come by their start, so each is read once
        for a, kind, b in learned:
            char += len(raw[byte:a].decode("utf-8", "replace"))
            start, byte = char, b
            char += len(raw[a:b].decode("utf-8", "replace"))
            while i < len(base) and base[i][0] < char:
                reached = max(reached, base[i][2])
                i += 1
            if reached <= start:
                more.append((start, kind, char))
        yield base, sorted(base + more)


def pieces(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in groups of about ``most`` bytes, so memory does not follow the batch."""
    group, size = [], 0
    for text in texts:
        group.append(text or b"")
        size += len(text or b"")
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{LEARNED[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, text: str = "text", labelled: Sequence[tuple[str, Sequence[tuple[str, int, int]]]] | None = None) -> DataFrame:
    """``docs`` with base_spans and spans: arrays of (kind, start, end) in code points, end exclusive, by start and then kind.

    Input columns of these names are replaced. Null and empty texts have no spans; rows with equal texts have equal
    spans; texts of any length are read whole. No shuffle. ``labelled`` is the table that the field learns from.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(labelled if labelled is not None else labelled_table()))
    own = docs.drop("base_spans", "spans")
    at = own.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    as_rows = lambda spans: [{"kind": LEARNED[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, both = [], []
            for group in pieces(batch.column(at).cast(pa.large_binary()).to_pylist()):
                for some, found in all_spans(group, *weights.value):
                    base.append(as_rows(some))
                    both.append(as_rows(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, kind), pa.array(both, kind)], [*batch.schema.names, "base_spans", "spans"])

    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

    spans = ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()))
    return own.mapInArrow(run, StructType(list(own.schema.fields)).add("base_spans", spans).add("spans", spans))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
