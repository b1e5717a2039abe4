"""Fuzzy line deduplication across documents.

Lines are normalised and hashed. Two lines link when the edit similarity of their words is at least
0.8; no fingerprint stands in for that rule. An edit touches at most q of a line's q-word
windows, so of the windows in one fixed order (by hash) the first ones of two such lines share one
(a prefix filter). Lines that share a window, and whose lengths and word parities allow so few edits,
are candidates; the candidates of a window are verified together, and of each group that verified links connect
the first occurrence stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress, count, groupby
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from levelwise.llm.common import bind, identity, slices, stored, text_of
from levelwise.llm.components import components

#: Lines without a word take no part: they are blank or have marks only. Below four words no edit is
#: allowed, so short lines repeat by equality.
MIN_WORDS = 1
SIMILARITY = 0.8
#: Bits of the words' SimHash in which linked lines may differ: all, only the edit similarity decides.
DISTANCE = 64
#: Lines of at most ``SHORT`` words meet on windows of two words, longer ones on three.
SHORT = 11
#: Windows kept of a line. Up to 39 words these are all the rule needs and no pair is missed.
KEYS = 24
#: Lines of more words than the first number have so many more parities in their sketch; from the first
#: step on they have counts of their words in so many classes too, as repeated words cancel in parities.
WIDER = ((24, 192), (150, 1024))
CLASSES = 16
#: So few lines are verified without bounds.
FEW = 4
#: Classes of the words of lines that are verified.
VERIFY_CLASSES = 256
#: Lines that a task remembers, so that a line it meets again carries no windows. It only saves rows.
REMEMBERED = 1 << 19
#: Groups of so many lines are compared in whole arrays; larger ones are searched.
SMALL_GROUP = 64
#: Windows are dealt to buckets by so many of their keys' bits; a task has a few buckets at a time in memory.
BUCKET_BITS = 12
#: Of the rows that are looked for, a filter has a bit each in so many words of 64 bits at most. It lets others pass too.
FILTER_WORDS = 1 << 16
#: Lines of one window that are tested by lengths and word parities before sketches are fetched; of larger
#: groups all lines go on to the search.
TESTED_GROUP = 4096
#: Pairs of lines of one window that are tested at a time; a group of more links a line is searched line by line.
BLOCK, DENSE = 1 << 20, 64
#: Lines verified together; a larger set of candidates is verified in pairs of blocks.
VERIFY_ROWS = 4096

#: Every digit becomes 0 and every mark a blank, in an ASCII text by one table.
_PLAIN = "".join(
    "0" if c.isdecimal() else c if c.isalnum() or c == "\n" else " " for c in map(chr, range(128))
)

#: Letters of scripts that put no blanks between words: Thai to Myanmar, Khmer, kana, Han. Each is a word.
_UNPARTED = re.compile(
    "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]"
)


@lru_cache(maxsize=1 << 16)
def _spelled(c: str) -> str:
    """What stands for a character: 0 for a digit, a blank for a mark, a word for a letter of those scripts."""
    if c.isdecimal():
        return "0"
    if not c.isalnum() and c != "\n":
        return " "
    return f" {c} " if _UNPARTED.match(c) else c


def plain(text: str) -> str:
    """``text`` lower-cased and without marks, every number being the same word of its own."""
    text = text.lower()
    if text.isascii():
        text = text.translate(_PLAIN)
    else:
        for c in set(text):
            if _spelled(c) != c:
                text = text.replace(c, _spelled(c))
    while "00" in text:
        text = text.replace("00", "0")
    return text.replace("0", " 0 ")


def _plain_others(text: str) -> str:
    """``text`` lower-cased and ``plain`` in the characters beyond ASCII."""
    text = text.lower()
    for c in set(text):
        if c > "\x7f" and _spelled(c) != c:
            text = text.replace(c, _spelled(c))
    return text


def normalised(line: str) -> list[str]:
    """Words of a line, without case, marks and the values of numbers."""
    return plain(line).split()


_LINES = "row long, doc_id long, line_no int, line long, sketch long, wide binary, keys binary"

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: A sketch has the length of a line in its low bits and above them the parities of its words.
_LENGTH = np.uint64(0xFFF)
_PARITIES = 52
#: A key has 40 bits, the others are zero and take no room in a shuffle. Two windows of one key cost a test.
_KEY, _KEY_BYTES = np.uint64((1 << 40) - 1), 5


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


#: Of each byte: its small letter, every digit being 0; and whether it is of a word (1), of a number (2) or parts them.
_SMALL = "".join("0" if chr(b).isdecimal() else chr(b).lower() for b in range(128)).encode() + bytes(range(128, 256))
_KIND = bytes(2 if chr(b).isdecimal() else b > 127 or chr(b).isalnum() for b in range(256))
#: The low bytes of a number, by how many they are.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Words of more bytes are hashed one by one.
_LONG_WORD = 64


def _eight(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes from places ``at`` on, ``size`` of them or eight, as numbers. ``data`` has whole eights of bytes."""
    whole, by = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
    low, high = data.view("<u8")[whole] >> by, data.view("<u8")[whole + 1]
    return (low | high << (np.uint64(63) - by) << np.uint64(1)) & _LOW[np.minimum(size, 8)]


def line_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the ``normalised`` words of all lines of texts, how many each line has, and how many lines each text has.

    The words are found in the bytes of all texts at once; none is a Python object.
    """
    flat = "\n".join(t if t.isascii() else _plain_others(t) for t in texts).encode()
    flat += bytes(16 + -len(flat) % 8)
    kind, data = (np.frombuffer(flat.translate(table), dtype=np.uint8) for table in (_KIND, _SMALL))
    ends = np.flatnonzero(data == 10)
    starts = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    if kind[0]:
        starts = np.concatenate([[0], starts])
    sizes, kinds = np.diff(starts, append=len(data)), kind[starts]
    starts, sizes, kinds = starts[kinds > 0], sizes[kinds > 0], kinds[kinds > 0]
    sizes = np.where(kinds == 2, 1, sizes)
    hashes = mixed(_eight(data, starts, sizes) + _MIX[0])
    left, k = np.flatnonzero(sizes > 8), 8
    for i in left[sizes[left] > _LONG_WORD]:
        hashes[i] = xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes())
    left = left[sizes[left] <= _LONG_WORD]
    while len(left):
        hashes[left] = mixed(hashes[left] * _MIX[0] + _eight(data, starts[left] + k, sizes[left] - k))
        k += 8
        left = left[sizes[left] > k]
    bounds = np.searchsorted(starts, ends)
    counts = np.diff(np.concatenate([[0], bounds, [len(starts)]]))
    return hashes, counts, np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))


def line_numbers(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash for the words of each line, in their order. Every line has a word."""
    if not len(counts):
        return np.zeros(0, dtype=np.uint64)
    starts = np.cumsum(counts) - counts
    place = (np.arange(1, len(hashes) + 1) - np.repeat(starts, counts)).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(hashes + place * _MIX[0]), starts) + counts.astype(np.uint64))


def _packed(values: np.ndarray, counts: np.ndarray, size: int) -> pa.Array:
    """Binaries of so many values each, the low ``size`` bytes of each value."""
    low = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize)[:, :size])
    offsets = np.concatenate([[0], np.cumsum(counts) * size]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(low)])


def _unpacked(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All values of ``size`` bytes in a column of binaries, a row of bytes each, and how many every binary has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(-1, size), np.diff(offsets) // size


def allowed_edits(longest: int) -> int:
    return int((1 - SIMILARITY) * longest + 1e-9)


@lru_cache(maxsize=None)
def prefix_size(n: int, q: int) -> int:
    """How many windows of a line of ``n`` words must be looked at.

    With a longer line of ``b`` words there are ``d`` edits at most, ``b - n`` of them
    insertions; these break q - 1 windows, others q.
    """
    most, b = 0, n
    while b - n <= allowed_edits(b):
        most = max(most, q * allowed_edits(b) - (b - n))
        b += 1
        if b > 4 * n + 8:
            break
    return most + 1


def word_hashes(lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lines, line after line, and their numbers."""
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    return np.fromiter(map(xxh64_intdigest, chain.from_iterable(lines)), np.uint64, int(counts.sum())), counts


def window_keys(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows under which lines meet others, line after line, and their numbers.

    ``words`` has the hashes of the lines' words, ``counts`` how many each line has.
    """
    line_of, place = np.repeat(np.arange(len(counts)), counts), np.arange(len(words))
    after = np.repeat(np.cumsum(counts), counts) - place  # words of the line from here on
    keys, owners = [], []
    # A pair is met by the windows of its longer line's length.
    least = SHORT + 1 - allowed_edits(SHORT + 1)
    for q, meets in ((2, counts <= SHORT), (3, counts >= least)):
        at = place[meets[line_of] & (after >= q)]
        h = np.full(len(at), q, dtype=np.uint64)
        for k in range(q):
            h = mixed(h * _MIX[0] + words[at + k])
        h &= _KEY
        own = line_of[at]
        if len(counts) < 1 << 24:
            # Line and key in one number: it is sorted faster than the two.
            both = np.sort(own.astype(np.uint64) << np.uint64(40) | h)
            h, own = both & _KEY, (both >> np.uint64(40)).astype(np.int64)
        else:
            order = np.lexsort((h, own))
            h, own = h[order], own[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        h, own = h[new], own[new]
        found = np.bincount(own, minlength=len(counts))
        rank = np.arange(len(h)) - np.repeat(np.cumsum(found) - found, found)
        sizes, which = np.unique(counts, return_inverse=True)
        limit = np.array([min(prefix_size(int(n), q), KEYS) for n in sizes], dtype=np.int64)
        kept = rank < limit[which][own] if len(counts) else new
        keys.append(h[kept])
        owners.append(own[kept])
    own = np.concatenate(owners)
    return np.concatenate(keys)[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(counts))


def sketches(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One sketch per line; an edit changes two parities at most."""
    if not len(counts):
        return np.zeros(0, dtype=np.uint64)
    bits = np.uint64(1) << (mixed(values) % np.uint64(_PARITIES) + np.uint64(12))
    starts = np.cumsum(counts) - counts
    return np.bitwise_xor.reduceat(bits, starts) | np.minimum(counts, 0xFFF).astype(np.uint64)


def word_counts(values: np.ndarray, counts: np.ndarray, classes: int) -> np.ndarray:
    """How many words of each line fall in each class of words."""
    own = np.repeat(np.arange(len(counts)), counts)
    at = own * classes + (mixed(values ^ np.uint64(classes)) % np.uint64(classes)).astype(np.int64)
    return np.bincount(at, minlength=len(counts) * classes).reshape(-1, classes)


def wide_sketches(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Counts and more parities of the words: none for lines of few words, the most for long ones."""
    words = np.repeat(counts, counts)
    out = [b""] * len(counts)
    for step, (more, bits) in enumerate(WIDER):
        some = np.flatnonzero(counts > more)
        if len(some):
            own, sizes = values[words > more], counts[some]
            odd = np.packbits((word_counts(own, sizes, bits) & 1).astype(np.uint8), axis=1, bitorder="little")
            if not step:
                # Counts wrap at 256; the distance of two wrapped ones is no greater.
                odd = np.concatenate([word_counts(own, sizes, CLASSES).astype(np.uint8), odd], axis=1)
            for i, row in zip(some, odd):
                out[i] += row.tobytes()
    return out


class Sketches:
    """Sketches of many lines, the wide ones as matrices of the lines that have them."""

    def __init__(self, sketch: np.ndarray, wide: list[bytes]):
        self.sketch, self.levels, start = sketch, [], CLASSES
        sizes = np.fromiter(map(len, wide), np.int64, len(wide))
        has = np.flatnonzero(sizes)
        self.counted = np.full(len(wide), -1)
        self.counted[has] = np.arange(len(has))
        flat = b"".join(wide[i][:CLASSES] for i in has)
        self.counts = np.frombuffer(flat, dtype=np.uint8).reshape(-1, CLASSES)
        for _, bits in WIDER:
            has = np.flatnonzero(sizes > start)
            end = start + bits // 8
            flat = b"".join(wide[i][start:end] for i in has)
            index = np.full(len(wide), -1)
            index[has] = np.arange(len(has))
            self.levels.append((index, np.frombuffer(flat, dtype=np.uint64).reshape(-1, bits // 64)))
            start = end

    def may_link(self, i: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        """Whether lengths, parities and counts leave room for the similarity; never false for linked lines.

        Words that only one of two lines has, the lengths' difference added, are at most two an edit.
        """
        a, b = self.sketch[i], self.sketch[j]
        m, n = (a & _LENGTH).astype(np.int64), (b & _LENGTH).astype(np.int64)
        longest = np.maximum(m, n)
        room = 2 * np.floor((1 - SIMILARITY) * longest + 1e-9) - np.abs(m - n)
        # A length that fills its bits may be any greater one.
        endless = longest == 0xFFF
        near = endless | (np.bitwise_count((a ^ b) & ~_LENGTH) <= room)
        for index, marks in [(self.counted, self.counts), *self.levels]:
            x, y = index[i], index[j]
            test = np.flatnonzero(near & (x >= 0) & (y >= 0) & ~endless)
            if len(test):
                other = marks[y[test]] if np.ndim(y) else marks[y]
                if marks.dtype == np.uint8:
                    apart = np.abs((marks[x[test]] - other).view(np.int8).astype(np.int16)).sum(axis=1)
                else:
                    apart = np.bitwise_count(marks[x[test]] ^ other).sum(axis=1, dtype=np.int64)
                near[test] = apart <= room[test]
        return near


    def may_meet(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """``close`` of all rows and others and, where many are, the first wide parities: a matrix."""
        a, b = self.sketch[rows][:, None], self.sketch[others]
        near = close(a, b)
        index, marks = self.levels[0]
        x, y = index[rows], index[others]
        if np.count_nonzero(near) * 16 > near.size and (x >= 0).any():
            apart = np.zeros(near.shape, dtype=np.int32)
            for k in range(marks.shape[1]):
                apart += np.bitwise_count(marks[x, k][:, None] ^ marks[y, k])
            m, n = (a & _LENGTH).astype(np.int32), (b & _LENGTH).astype(np.int32)
            longest = np.maximum(m, n)
            free = (x < 0)[:, None] | (y < 0) | (longest == int(_LENGTH))
            near &= free | (apart + np.abs(m - n) <= _TWICE[longest])
        return near


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for whole in batches:
        for batch in slices(whole):
            if len(seen) > REMEMBERED:
                seen.clear()
            hashes, sizes, n_lines = line_words(batch.column(2).to_pylist())
            docs = np.repeat(np.arange(len(n_lines)), n_lines)
            places = np.arange(len(docs)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
            kept = sizes >= MIN_WORDS
            hashes, docs, places, sizes = hashes[np.repeat(kept, sizes)], docs[kept], places[kept], sizes[kept]
            lines = line_numbers(hashes, sizes)
            new = np.zeros(len(lines), dtype=bool)
            for i, line in enumerate(lines.tolist()):
                if line not in seen:
                    seen.add(line)
                    new[i] = True
            hashes, sizes = hashes[np.repeat(new, sizes)], sizes[new]
            flat, found = window_keys(hashes, sizes)
            # Columns of the first occurrences, null in the rows of all others.
            spread = pa.array(np.cumsum(new) - 1, mask=~new)
            at = pa.array(docs)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(places.astype(np.int32)),
                    pa.array(lines.view(np.int64)),
                    pa.array(sketches(hashes, sizes).view(np.int64)).take(spread),
                    pa.array(wide_sketches(hashes, sizes), pa.binary()).take(spread),
                    _packed(flat, found, _KEY_BYTES).take(spread),
                ],
                names=["row", "doc_id", "line_no", "line", "sketch", "wide", "keys"],
            )


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, a column at a time in the bits of an integer."""
    least = min(len(a), len(b))
    skip = next(compress(count(), map(ne, a, b)), least)
    # Ends are cut off at once: a copy for each word of them takes the square of their length.
    end = min(next(compress(count(), map(ne, reversed(a), reversed(b))), least), least - skip)
    a, b = a[skip : len(a) - end], b[skip : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        flat = same | down
        carry = (((same & up) + up) ^ up) | same
        rise = down | (full & ~(carry | up))
        fall = up & carry
        score += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 | 1, fall << 1
        up = (fall | ~(flat | rise)) & full
        down = rise & flat & full
    return score


def similar(a: list, b: list) -> bool:
    longest = max(len(a), len(b))
    least = abs(len(a) - len(b))  # the distance is no less
    allowed = (1 - SIMILARITY) * longest + 1e-9
    if least == 0 and sum(map(ne, a, b)) <= allowed:
        return True  # the distance is no more than the words changed in place
    return least <= allowed and edit_distance(a, b) <= allowed


def _direct_edges(lines: list[tuple[int, list[str]]]) -> list[tuple[int, int]]:
    """The edges of a few lines, without bounds on their distances."""
    left, edges = list(lines), []
    while len(left) > 1:
        queue = [left.pop(0)]
        while queue and left:
            line, words = queue.pop()
            found = [similar(words, other) for _, other in left]
            queue += [x for x, near in zip(left, found) if near]
            edges += [(line, x[0]) for x, near in zip(left, found) if near]
            left = [x for x, near in zip(left, found) if not near]
    return edges


def verified_edges(lines: list[tuple[int, list]], hashed: tuple | None = None) -> list[tuple[int, int]]:
    """Edges that connect all pairs of (line, words) that are similar. ``hashed`` are the words' hashes, if known.

    As in a search through a graph, a line already reached is not compared again. Words that only one
    of two lines has bound the edit distance from below, so few distances are computed in vain.
    """
    if len(lines) <= FEW:
        return _direct_edges(lines)
    hashes, counts = hashed or word_hashes([words for _, words in lines])
    marks = Sketches(sketches(hashes, counts), wide_sketches(hashes, counts))
    bags = word_counts(hashes, counts, VERIFY_CLASSES).astype(np.int32)
    left = np.arange(len(lines))
    edges = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.flatnonzero(marks.may_link(left, at))
            other = left[near]
            longest = np.maximum(counts[other], counts[at])
            apart = np.abs(bags[other] - bags[at]).sum(axis=1) + np.abs(counts[other] - counts[at])
            near = near[apart <= 2 * np.floor((1 - SIMILARITY) * longest + 1e-9)]
            found = [int(i) for i in near if similar(lines[at][1], lines[left[i]][1])]
            queue += [left[i] for i in found]
            edges += [(lines[at][0], lines[left[i]][0]) for i in found]
            left = np.delete(left, found)
    return edges


def candidate_sets(
    keys: np.ndarray, lines: np.ndarray, sketch: np.ndarray, wide: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Sets of two and more lines of a key that are connected by pairs that may link: set and line.

    Rows are sorted by key, then line. A set has the number of its least line, so sets of several keys that have
    it in common are one.
    """
    alone = np.ones(len(keys), dtype=bool)
    same = keys[1:] == keys[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    keys, lines, sketch, wide = keys[~alone], lines[~alone], sketch[~alone], wide[~alone]
    label = np.arange(len(keys))
    if len(keys):
        marks = Sketches(sketch, wide.tolist())
        starts, sizes = _groups(keys)
        _connect(label, starts, sizes, marks.may_link)
        for s, n in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
            if not _connect_blocks(label, s, n, marks):
                _search(label, s, n, marks)
    return _sets(label, lines, lines)


def _search(label: np.ndarray, start: int, n: int, marks: Sketches) -> None:
    """Labels the rows of a group of many links: a row already reached is not compared again."""
    left = np.arange(start, start + n)
    label[left] = left
    while len(left) > 1:
        queue, left, first = [left[0]], left[1:], left[0]
        while queue and len(left):
            near = marks.may_link(left, queue.pop())
            found, left = left[near], left[~near]
            label[found] = first
            queue += list(found)


def _connect_blocks(label: np.ndarray, start: int, n: int, marks: Sketches) -> bool:
    """Labels the rows of a group of few links; false, if there are too many.

    In the order of length, so that a block meets only lines that are not too long for it.
    """
    lengths = (marks.sketch[start : start + n] & _LENGTH).astype(np.int64)
    order = np.argsort(lengths, kind="stable")
    lengths, order = lengths[order], start + order
    step, links, heads, tails = max(1, min(256, BLOCK // n)), 0, [], []
    for i in range(0, n, step):
        high = np.searchsorted(lengths, int(lengths[min(i + step, n) - 1] / SIMILARITY) + 1, "right")
        a, b = np.nonzero(np.triu(marks.may_meet(order[i : i + step], order[i:high]), 1))
        links += len(a)
        if links > DENSE * n:
            return False
        a, b = order[i + a], order[i + b]
        met = marks.may_link(a, b)
        heads.append(a[met])
        tails.append(b[met])
    _spread(label, np.concatenate(heads), np.concatenate(tails))
    return True


def _spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the rows that links a-b connect their least label; labels are rows."""
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sizes of the runs of equal keys."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    return starts, np.diff(np.concatenate([starts, [len(keys)]]))


def _connect(label: np.ndarray, starts: np.ndarray, sizes: np.ndarray, near: Callable) -> None:
    """Labels the rows of small groups with the first row that ``near`` connects them with."""
    ends = np.repeat(np.where(sizes <= SMALL_GROUP, starts + sizes, 0), sizes)
    at, heads, tails = np.arange(len(label)), [], []
    for by in range(1, SMALL_GROUP):
        at = at[at + by < ends[at]]
        met = at[near(at, at + by)]
        heads.append(met)
        tails.append(met + by)
    _spread(label, np.concatenate(heads), np.concatenate(tails))


def _sets(label: np.ndarray, names: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of labels that two or more have: the name of the label's first row, and the line, each pair once."""
    more = np.bincount(label)[label] > 1 if len(label) else np.zeros(0, dtype=bool)
    sets, lines = names[label[more]], lines[more]
    order = np.lexsort((lines, sets))
    sets, lines = sets[order], lines[order]
    new = np.ones(len(sets), dtype=bool)
    new[1:] = (sets[1:] != sets[:-1]) | (lines[1:] != lines[:-1])
    return sets[new], lines[new]


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (key, line, sketch, wide) sorted by the first two."""
    held: list[list[np.ndarray]] = []

    def flush():
        found = candidate_sets(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in found], names=["set", "line"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        columns[2] = columns[2].view(np.uint64)
        # The last key may go on in the next batch.
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            held.append([c[:cut] for c in columns])
            yield flush()
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield flush()


def _verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (set, i, j, line, text) sorted by the first three."""

    def rows():
        # Words are compared by their hashes.
        for whole in batches:
            for batch in slices(whole, 1024):
                hashes, counts, _ = line_words(batch.column(4).to_pylist())
                words = np.split(hashes, np.cumsum(counts)[:-1])
                yield from zip(zip(*(batch.column(i).to_pylist() for i in range(3))), batch.column(3).to_pylist(), words)

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

    edges: list[tuple[int, int]] = []
    for _, members in groupby(rows(), key=lambda r: r[0]):
        _, lines, words = zip(*members)
        hashed = np.concatenate(words), np.array(list(map(len, words)))
        edges += verified_edges([(line, w.tolist()) for line, w in zip(lines, words)], hashed)
        if len(edges) >= 1024:
            yield batch()
            edges = []
    yield batch()


#: Twice the edits that the longer line of so many words allows.
_TWICE = 2 * np.floor((1 - SIMILARITY) * np.arange(int(_LENGTH) + 1) + 1e-9).astype(np.int32)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``Sketches.may_link`` by lengths and the 52 parities alone."""
    m, n = (a & _LENGTH).astype(np.int32), (b & _LENGTH).astype(np.int32)
    longest = np.maximum(m, n)
    return (longest == int(_LENGTH)) | (np.bitwise_count((a ^ b) & ~_LENGTH) + np.abs(m - n) <= _TWICE[longest])


def partnered(keys: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Rows, sorted by key, that are close to another row of their key; all of a group too large to be tested."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    ends = np.repeat(np.where(sizes <= SMALL_GROUP, starts + sizes, 0), sizes)
    met, at = np.zeros(len(keys), dtype=bool), np.arange(len(keys))
    for by in range(1, SMALL_GROUP):
        at = at[at + by < ends[at]]
        found = at[close(sketch[at], sketch[at + by])]
        met[found] = met[found + by] = True
    for s, n in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
        if n > TESTED_GROUP:
            met[s : s + n] = True
            continue
        # By length, so that a block meets only lines that are neither too short nor too long for it.
        order = np.argsort(sketch[s : s + n] & _LENGTH, kind="stable")
        own = sketch[s + order]
        lengths = (own & _LENGTH).astype(np.int64)
        for i in range(0, n, 256):
            block = own[i : i + 256]
            low = np.searchsorted(lengths, int(SIMILARITY * lengths[i]) - 1)
            high = np.searchsorted(lengths, int(lengths[min(i + 255, n - 1)] / SIMILARITY) + 1, "right")
            # A row is close to itself.
            met[s + order[i : i + 256]] = close(block[:, None], own[low:high]).sum(axis=1) > 1
    return met


def window_sets(keys: np.ndarray, lines: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets of two and more lines that share a key and are connected by close ones: set and line.

    A set of a small group has the number of its least line, so similar lines are one set however many keys they
    share. Of a larger group all lines that are close to another one are one set, named by the key.
    """
    order = np.argsort(keys)
    keys = keys[order]
    # Most windows are of one line only.
    same = keys[1:] == keys[:-1]
    met = np.zeros(len(keys), dtype=bool)
    met[1:] |= same
    met[:-1] |= same
    keys, order = keys[met], order[met]
    lines, sketch = lines[order], sketch[order]
    order = np.lexsort((lines, keys))
    keys, lines, sketch = keys[order], lines[order], sketch[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (lines[1:] != lines[:-1])
    keys, lines, sketch = keys[new], lines[new], sketch[new].view(np.uint64)
    label, names = np.arange(len(keys)), lines.copy()
    if len(keys):
        starts, sizes = _groups(keys)
        _connect(label, starts, sizes, lambda i, j: close(sketch[i], sketch[j]))
        large = np.flatnonzero(np.repeat(sizes > SMALL_GROUP, sizes))
        if len(large):
            large = large[partnered(keys[large], sketch[large])]
        if len(large):
            first, n = _groups(keys[large])
            label[large] = np.repeat(large[first], n)
            names[large] = mixed(keys[large].view(np.uint64)).view(np.int64)
    return _sets(label, names, lines)


#: A window: the rest of its key, its line and the line's sketch.
_WINDOW = np.dtype([("key", "<i4"), ("line", "<i8"), ("sketch", "<i8")])


def _dealt_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (line, sketch, keys); gives the windows of many lines, dealt by key: bucket and windows."""
    for batch in batches:
        packed, counts = _unpacked(batch.column(2), _KEY_BYTES)
        if not len(packed):
            continue
        keys = np.zeros((len(packed), 8), dtype=np.uint8)
        keys[:, :_KEY_BYTES] = packed
        keys = keys.view("<i8").ravel()
        bucket = (keys & ((1 << BUCKET_BITS) - 1)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket, owner = bucket[order], np.repeat(np.arange(len(counts)), counts)[order]
        windows = np.empty(len(keys), dtype=_WINDOW)
        windows["key"] = keys[order] >> BUCKET_BITS
        windows["line"] = batch.column(0).to_numpy()[owner]
        windows["sketch"] = batch.column(1).to_numpy()[owner]
        starts, sizes = _groups(bucket)
        dealt = pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts].astype(np.int32)), _packed(windows, sizes, _WINDOW.itemsize)], names=["bucket", "windows"]
        )
        yield from slices(dealt, 1024)


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (bucket, windows) sorted by bucket; gives the sets of lines that share a window and are close."""
    held: list[pa.RecordBatch] = []

    def flush():
        parts = [_unpacked(b.column(1), _WINDOW.itemsize) for b in held]
        windows = np.concatenate([p.reshape(-1) for p, _ in parts]).view(_WINDOW)
        buckets = [np.repeat(b.column(0).to_numpy(), n) for b, (_, n) in zip(held, parts)]
        keys = windows["key"].astype(np.int64) << BUCKET_BITS | np.concatenate(buckets)
        found = window_sets(keys, windows["line"], windows["sketch"])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["set", "line"])

    for whole in batches:
        for batch in slices(whole, 1024):
            buckets = batch.column(0).to_numpy()
            # The last bucket may go on in the next batch.
            cut = int(np.searchsorted(buckets, buckets[-1]))
            if held and (cut or buckets[0] != held[-1].column(0)[-1].as_py()):
                held.append(batch.slice(0, cut))
                yield flush()
                held = []
            elif cut:
                held = [batch.slice(0, cut)]
                yield flush()
                held = []
            held.append(batch.slice(cut))
    if held:
        yield flush()


def _candidates(lines: DataFrame) -> DataFrame:
    """(line, sets) of lines that another line may be linked to: the sets of lines that are verified together.

    A set has the candidates of one line in its windows. Chains of candidates from window to window grow with the
    corpus, sets do not: a line is in no more of them than it has windows.
    """
    # A task gives the windows of a line once, so a common line is not met again and again. They go by the bucket
    # of their key, many in a row. Most windows are of one line only or of lines that are not close; wide sketches
    # are fetched for the others, once for all windows of a set.
    once = lines.where("keys is not null")
    dealt = once.select("line", "sketch", "keys").mapInArrow(_dealt_batches, "bucket int, windows binary")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    shared = stored(dealt.mapInArrow(_shared_batches, "set long, line long").distinct(), "line-windows")
    wanted = shared.select(F.col("line").alias("l")).distinct()
    marks = once.select("line", "sketch", "wide").join(wanted, F.col("line") == F.col("l"), "left_semi")
    marks = marks.dropDuplicates(["line"]).withColumnRenamed("line", "l")
    met = shared.join(marks, F.col("line") == F.col("l")).select("set", "line", "sketch", "wide")
    met = met.repartition("set").sortWithinPartitions("set", "line")
    sets = met.mapInArrow(_candidate_batches, "set long, line long").distinct()
    sets = stored(sets, "line-sets")
    size = sets.groupBy(F.col("set").alias("s")).agg(F.ceil(F.count("*") / VERIFY_ROWS).cast("int").alias("blocks"))
    sized = sets.join(size.where("blocks > 1"), F.col("set") == F.col("s"), "left")
    blocks = F.coalesce("blocks", F.lit(1)).alias("blocks")
    return sized.groupBy("line").agg(F.collect_list(F.struct("set", blocks)).alias("sets"))


def _filtered(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """``row`` and ``whole`` of the documents whose row is an ``at_row``, and of a few others.

    The texts of most documents are not shuffled then. The filter does not grow beyond its words.
    """
    word = lambda row: F.col(row).bitwiseAND(F.lit(FILTER_WORDS - 1))
    bit = lambda row: F.expr(f"shiftleft(1L, cast(shiftright({row}, 32) & 63 as int))")
    marks = spots.groupBy(word("at_row").alias("word")).agg(F.bit_or(bit("at_row")).alias("bits"))
    met = docs.select("row", "whole", word("row").alias("own")).join(F.broadcast(marks), F.col("own") == F.col("word"))
    return met.where(F.col("bits").bitwiseAND(bit("row")) != 0).select("row", "whole")


def _line_texts(lines: DataFrame, wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(line, text) of the lines of ``wanted``."""
    found = lines.select("row", "line_no", "line").join(wanted.select(F.col("line").alias("l")), F.col("line") == F.col("l"), "left_semi")
    # Any occurrence gives the text of a line; the least one is taken. A document's lines are fetched together, so its
    # text is read once. Stored, so that Spark knows the size of this side before it would shuffle all texts.
    spots = found.groupBy("line").agg(F.min(F.struct("row", "line_no")).alias("at"))
    spots = spots.groupBy(F.col("at.row").alias("at_row")).agg(
        F.collect_list(F.struct(F.col("at.line_no").alias("line_no"), "line")).alias("spots")
    )
    spots = stored(spots, "line-places")
    texts = _filtered(docs, spots).join(spots.hint("shuffle_hash"), F.col("row") == F.col("at_row")).select(F.split("whole", "\n", -1).alias("texts"), "spots")
    texts = texts.select(
        F.explode(F.transform("spots", lambda s: F.struct(s["line"].alias("line"), F.get("texts", s["line_no"]).alias("text")))).alias("x")
    )
    # Repeated rows give a line more than once.
    return texts.select("x.line", "x.text").dropDuplicates(["line"])


def _line_groups(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """``vertex`` and ``root`` of lines that are linked to another line."""
    wanted = stored(_candidates(lines), "line-candidates")
    texts = _line_texts(lines, wanted, docs).withColumnRenamed("line", "l")
    texts = texts.join(wanted, F.col("line") == F.col("l")).select("line", "text", F.inline("sets"))
    own = F.pmod("line", "blocks").cast("int")
    other = texts.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    keyed = other.select(
        "set", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "line", "text"
    )
    sorted_rows = keyed.repartition("set", "i", "j").sortWithinPartitions("set", "i", "j", "line")
    return components(sorted_rows.mapInArrow(_verifier, "a long, b long"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``gone_row`` and ``gone``, the numbers of lines that repeat an earlier one, by document.

    ``docs`` has ``row``, ``doc_id`` and ``whole``. Earlier means by doc_id, then line number; rows
    that repeat a document as a whole count as one and keep the same lines.
    """
    slim = docs.select("row", "doc_id", "whole")
    lines = stored(slim.mapInArrow(_line_batches, _LINES), "lines", compression="zstd")
    roots = stored(_line_groups(lines, docs), "line-groups")
    named = lines.join(roots, F.col("line") == F.col("vertex"), "left").select(
        "doc_id", "row", "line_no", F.coalesce("root", "line").alias("g")
    )
    place = F.struct("doc_id", "row", "line_no")
    first = named.groupBy("g").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.col("g").alias("g2"), "first")
    later = named.join(first, F.col("g") == F.col("g2")).where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy(F.col("row").alias("gone_row")).agg(F.collect_set("line_no").alias("gone"))
    return stored(gone, "repeated-lines")


def without_repeats(docs: DataFrame, text: str = "whole") -> DataFrame:
    """``docs`` with columns ``row``, ``doc_id``, ``whole`` and others, and ``kept``, the text left over, and ``n_gone``.

    ``text`` is the column that ``whole`` comes from; where it is another one, it alone goes through the join.
    """
    gone = repeated_lines(docs)
    lines = F.split("whole", "\n", -1)
    left = _left_over(lines)
    slim = docs if text == "whole" else docs.drop("whole")
    # The same plan at every size, and texts are not sorted.
    joined = slim.join(gone.hint("shuffle_hash"), F.col("row") == F.col("gone_row"), "left").withColumn("whole", text_of(F.col(text)))
    return joined.select(
        *docs.columns,
        F.when(F.col("gone").isNull(), F.col("whole")).otherwise(left).alias("kept"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_gone"),
    )


def _left_over(lines):
    """The lines whose numbers are not in ``gone``, joined again."""
    return bind(
        lines,
        lambda a: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("gone")), lambda i: F.get(a, i)
            ),
            "\n",
        ),
    )


def _named(docs: DataFrame, *more) -> DataFrame:
    return docs.select(
        identity("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("whole"), *more
    )


def deduplicated_lines(docs: DataFrame) -> DataFrame:
    """Every document with the lines that are left of it.

    A null text is empty and has one empty line; a document may end up empty; an empty table gives an
    empty result.
    """
    found = without_repeats(_named(docs))
    return found.select(
        "doc_id",
        F.size(F.split("whole", "\n", -1)).cast("long").alias("n_lines"),
        F.col("n_gone").alias("n_removed"),
        F.col("kept").alias("text"),
    )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, all columns kept; null texts stay null."""
    packed = docs.select(F.struct("*").alias("all")).select(
        F.col("all.doc_id").alias("doc_id"), F.col("all.text").alias("text"), "all"
    )
    found = without_repeats(_named(packed, "all"), "all.text")
    text = F.when(F.col("all.text").isNotNull(), F.col("kept"))
    n_chars = {"n_chars": F.char_length(text).cast("long")} if "n_chars" in docs.columns else {}
    changed = {"text": text, **n_chars}
    return found.select(*[changed.get(c, F.col("all")[c]).alias(c) for c in docs.columns])
