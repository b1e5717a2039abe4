"""Conflict-constrained best-fit packing.

Documents, or pieces of those longer than a bin, are put into bins of fixed capacity. Two
pieces conflict when they share a source or a duplicate cluster. Each piece goes to
the fullest bin that has room for it and no conflict; bins are kept in order of
residual room and carry bitmaps of their sources and clusters, and the search goes on from the first
bin with room until it finds a compatible one.

Packing runs in independent groups of pieces, dealt by a hash of the row, so sources and
clusters spread over all groups and a group is of bounded size whatever the input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelwise.llm.common import BLANKS, bind, slices, stored, text_of, words_of

CAPACITY = 4096
#: Words in a group on average; a group is packed in one task's memory.
GROUP_WORDS = 4_000_000
#: Bins looked at in one step of the search.
STEP = 64


class Bins:
    """Open bins in order of residual, with a bitmap of what each holds.

    Bitmaps are rows of 64-bit words; every conflict key of the group that occurs
    twice or more has one bit.
    """

    def __init__(self, capacity: int, keys: int):
        self.capacity = capacity
        self.residual = np.empty(0, dtype=np.int64)  # ascending
        self.number = np.empty(0, dtype=np.int64)  # of the bin at this place
        self.maps = np.zeros((64, max(1, -(-keys // 64))), dtype=np.uint64)  # by number
        self.count = 0

    def _fits(self, numbers: np.ndarray, bits: list[int]) -> np.ndarray:
        free = np.ones(len(numbers), dtype=bool)
        for bit in bits:
            free &= (self.maps[numbers, bit >> 6] & np.uint64(1 << (bit & 63))) == 0
        return free

    def put(self, need: int, bits: list[int]) -> tuple[int, int]:
        """The bin for a piece of ``need`` and the place in it where the piece starts."""
        at = int(np.searchsorted(self.residual, need))
        step = STEP
        while at < len(self.residual):
            free = np.flatnonzero(self._fits(self.number[at : at + step], bits))
            if len(free):
                at += int(free[0])
                break
            at += step
            step *= 2
        if at < len(self.residual):
            number, room = int(self.number[at]), int(self.residual[at])
            self.residual = np.delete(self.residual, at)
            self.number = np.delete(self.number, at)
        else:
            number, room = self.count, self.capacity
            self.count += 1
            if number == len(self.maps):
                self.maps = np.vstack([self.maps, np.zeros_like(self.maps)])
        for bit in bits:
            self.maps[number, bit >> 6] |= np.uint64(1 << (bit & 63))
        if room > need:  # a full bin takes nothing more
            at = int(np.searchsorted(self.residual, room - need))
            self.residual = np.insert(self.residual, at, room - need)
            self.number = np.insert(self.number, at, number)
        return number, self.capacity - room


def pack_group(
    sizes: list[int], conflicts: list[tuple], capacity: int
) -> list[tuple[int, int]]:
    """(bin, start) of every piece, in the order given. ``conflicts`` are the keys of each piece."""
    seen = Counter(k for keys in conflicts for k in set(keys))
    bit = {k: i for i, k in enumerate(k for k, n in seen.items() if n > 1)}
    bins = Bins(capacity, len(bit))
    return [bins.put(n, [bit[k] for k in set(keys) if k in bit]) for n, keys in zip(sizes, conflicts)]


def _packer(capacity: int, schema: pa.Schema):
    """Reads rows sorted by (group, size descending); adds bin and start to each."""

    def rows(batches):
        for whole in batches:
            for batch in slices(whole):
                yield from batch.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, members in groupby(rows(batches), key=lambda r: r["pack_group"]):
            held = list(members)
            keys = [
                tuple((f, r[f]) for f in ("pack_source", "pack_cluster") if r[f] is not None) for r in held
            ]
            placed = pack_group([r["n_words"] for r in held], keys, capacity)
            for start in range(0, len(held), 256):
                out = [
                    {**r, "bin_id": (group << 24) + b, "bin_start": s}
                    for r, (b, s) in zip(held[start : start + 256], placed[start : start + 256])
                ]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def pieces(docs: DataFrame, capacity: int, keep: dict[str, Column], with_text: bool) -> DataFrame:
    """Pieces of at most ``capacity`` words: columns of ``keep``, piece, first_word, n_words, and text.

    A longer document is cut after every ``capacity`` words; all blanks stay with the
    word before them, so its pieces joined give the document. A text without words, also a
    null one, is one piece of no words.
    """
    whole = text_of("text")
    slim = docs.select(*[c.alias(k) for k, c in keep.items()], whole.alias("_whole"))
    if with_text:
        # A word with the blanks behind it; leading blanks go with the first.
        unit = rf"(?:\A{BLANKS})?[^\x20\x09-\x0D]+(?:{BLANKS})?"
        last = F.floor((F.greatest(F.col("_n"), F.lit(1)) - 1) / capacity).cast("int")
        part = lambda i, text: F.struct(i.alias("piece"), text.alias("text"))
        cut = bind(
            F.regexp_extract_all("_whole", F.lit(unit), 0),
            lambda units: F.transform(
                F.sequence(F.lit(0), last),
                lambda i: part(i, F.array_join(F.slice(units, i * capacity + 1, capacity), "")),
            ),
        )
        parts = F.when(F.col("_n") <= capacity, F.array(part(F.lit(0), F.col("_whole")))).otherwise(cut)
        count = F.size(words_of(F.col("_whole")))
        split = slim.withColumn("_n", count).select("*", F.explode(parts).alias("_p"))
        text = [F.col("_p.text").alias("piece_text")]
        number = F.col("_p.piece")
    else:
        split = slim.withColumn("_n", F.size(words_of(F.col("_whole"))))
        last = F.floor((F.greatest("_n", F.lit(1)) - 1) / capacity).cast("int")
        split = split.select("*", F.explode(F.sequence(F.lit(0), last)).alias("_p"))
        text, number = [], F.col("_p")
    return split.select(
        *keep,
        number.alias("piece"),
        (number * capacity).cast("long").alias("first_word"),
        F.least(F.col("_n") - number * capacity, F.lit(capacity)).cast("long").alias("n_words"),
        *text,
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, with_text: bool = False) -> DataFrame:
    """Bin of every piece of every document.

    Columns: doc_id, piece, first_word, n_words, bin_id, bin_start and, when asked
    for, piece_text. ``docs`` has doc_id, text and source; pieces of one source, and of equal
    texts, never share a bin. A null source conflicts with none; repeated rows are
    duplicates of each other; pieces without words take no room and still keep clear of
    conflicts, as empty texts are equal too; an empty table gives an empty result.
    """
    keep = {
        "doc_id": F.col("doc_id"),
        "pack_source": F.col("source").cast("string"),
        "pack_cluster": F.xxhash64(text_of("text")),
        "pack_row": F.monotonically_increasing_id(),
    }
    rows = stored(pieces(docs, capacity, keep, with_text), "pieces")
    total = rows.agg(F.sum("n_words"), F.count("*")).first()
    # Pieces without words are counted too, so that they cannot crowd one group.
    groups = max(1, -(-((total[0] or 0) + 100 * total[1]) // GROUP_WORDS))
    group = F.pmod(F.xxhash64("pack_row", "piece"), F.lit(groups)).cast("long")
    grouped = rows.withColumn("pack_group", group)
    order = ["pack_group", F.desc("n_words"), "doc_id", "piece", "pack_cluster", "pack_row"]
    placed = grouped.repartition("pack_group").sortWithinPartitions(*order)
    names = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [*[(f.name, f.dataType.simpleString()) for f in placed.schema.fields], ("bin_id", "bigint"), ("bin_start", "bigint")]
    schema = pa.schema([(n, names[t]) for n, t in fields])
    out = placed.mapInArrow(_packer(capacity, schema), ", ".join(f"{n} {t}" for n, t in fields))
    text = ["piece_text"] if with_text else []
    return out.select("doc_id", "piece", "first_word", "n_words", "bin_id", "bin_start", *text)
