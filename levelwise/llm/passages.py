"""Repeated passages by a sparse suffix array.

Suffixes are retained at minimiser positions only: of every ``WINDOW`` consecutive k-gram
hashes the least one marks its position, so equal passages keep the same positions. Retained suffixes are
brought next to each other by their first ``PREFIX`` words; those with an equal
neighbour are extended to the left, to every passage of ``LENGTH`` words that has its
minimiser there, and to the right by joining overlapping passages.

Neighbours are found by aggregation on a hash of the compared words and not in a
lexicographic order: equal prefixes meet all the same, and a prefix that a third of the
corpus shares is combined map-side instead of filling one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levelwise.llm.common import identity, slices, stored, text_of

#: Repeats of so many words or more are found, every one of them.
LENGTH = 50
GRAM, WINDOW = 8, 27
#: A minimiser lies at most WINDOW - 1 words into a passage.
PREFIX = LENGTH - (WINDOW - 1)

_BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolled(h: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every run of ``length`` values, by joining runs of doubled length."""
    if len(h) < length:
        return np.empty(0, dtype=np.uint64)
    done, size = None, 0
    part, width = h, 1
    while True:
        if length & width:
            # The runs done so far are continued by one of this width.
            if done is None:
                done = part
            else:
                power = np.uint64(pow(_BASE, width, 1 << 64))
                n = len(h) - size - width + 1
                done = done[:n] * power + part[size : size + n]
            size += width
        if size == length:
            return _mixed(done[: len(h) - length + 1])
        power = np.uint64(pow(_BASE, width, 1 << 64))
        n = len(part) - width
        part = part[:n] * power + part[width:]
        width *= 2


def sliding_argmin(values: np.ndarray, window: int) -> np.ndarray:
    """Position of the leftmost least value in every window."""
    n = len(values) - window + 1
    best = np.arange(len(values))
    width = 1
    while width < window:
        step = min(width, window - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        width += step
    return best[:n]


def word_hashes(text: bytes) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.split()
    return np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))


def anchors(h: np.ndarray) -> np.ndarray:
    """For every passage of LENGTH words, by start, the position of its minimiser."""
    grams = rolled(h, GRAM)
    return sliding_argmin(grams, WINDOW)[: len(h) - LENGTH + 1]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text hash, text) to (row, copy, n, p, prefix); p = -1 marks the document itself."""
    for whole in batches:
        for batch in slices(whole):
            rows, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for row, copy, text in zip(rows, copies, batch.column(2).to_pylist()):
                h = word_hashes(text)
                at, prefix = np.array([-1]), np.zeros(1, np.uint64)
                if len(h) >= LENGTH:
                    p = np.unique(anchors(h))
                    at, prefix = np.append(at, p), np.append(prefix, rolled(h, PREFIX)[p])
                for column, value in zip(out, (row, copy, len(h))):
                    column.append(np.full(len(at), value))
                out[3].append(at)
                out[4].append(prefix.view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in out],
                    names=["row", "copy", "n", "p", "prefix"],
                )


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(copy, text, positions) to (copy, start, passage) of passages anchored at these positions."""
    for whole in batches:
        for batch in slices(whole, 64):
            out: list[list] = [[], [], []]
            for copy, text, marks in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h = word_hashes(text)
                starts = np.flatnonzero(np.isin(anchors(h), np.array(marks)))
                out[0].append(np.full(len(starts), copy))
                out[1].append(starts)
                out[2].append(rolled(h, LENGTH)[starts].view(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in out],
                    names=["copy", "start", "passage"],
                )


def _twice(rows: DataFrame, key: str, occurrence) -> DataFrame:
    """Keys that come at two different occurrences at least."""
    ends = rows.groupBy(key).agg(F.min(occurrence).alias("a"), F.max(occurrence).alias("b"))
    return ends.where("a <> b").select(F.col(key).alias("again"))


def repeated_passages(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Stretches of a document whose every word is in a passage of LENGTH words or more that
    occurs elsewhere, in another document or the same one.

    One row for each stretch: ``doc_id``, ``start`` and ``end`` (words from 0, end
    exclusive), ``n_words``. Overlapping and adjoining passages make one stretch. Documents without repeats, and
    null or short texts, give no row; each of two repeated rows gives its own. Passages
    are compared by 64-bit hashes.
    """
    own = docs.select(
        F.col(id_column).alias("doc_id"),
        identity(id_column, text).alias("row"),
        F.xxhash64(text_of(text)).alias("copy"),
        F.encode(text_of(text), "UTF-8").alias("bytes"),
    )
    kinds = "row long, copy long, n long, p long, prefix long"
    marks = stored(own.select("row", "copy", "bytes").mapInArrow(_suffixes, kinds), "suffixes")
    suffixes = marks.where("p >= 0")
    again = stored(_twice(suffixes, "prefix", F.xxhash64("copy", "p")), "repeated-prefixes")
    # Of equal texts one is enough to go on with.
    texts = marks.where("p < 0").groupBy("copy").agg(
        F.min("row").alias("lead"), F.count("*").alias("copies"), F.first("n").alias("n")
    )
    texts = stored(texts, "distinct-texts")
    met = suffixes.join(again, F.col("prefix") == F.col("again"), "left_semi")
    met = met.groupBy("row").agg(F.collect_set("p").alias("marks"))
    met = stored(
        met.join(texts.select("lead"), F.col("row") == F.col("lead"), "left_semi").withColumnRenamed("row", "r"), "marked-texts"
    )
    fetched = own.join(met, F.col("row") == F.col("r")).select("copy", "bytes", "marks")
    found = stored(fetched.mapInArrow(_passages, "copy long, start long, passage long"), "passages")
    shared = stored(_twice(found, "passage", F.xxhash64("copy", "start")), "repeated-passages")
    hits = found.join(shared, F.col("passage") == F.col("again"), "left_semi")
    # Starts of one text in order; a gap longer than a passage begins a new stretch.
    ordered = Window.partitionBy("copy").orderBy("start")
    gap = F.col("start") - F.lag("start").over(ordered) > LENGTH
    runs = hits.select("copy", "start").distinct().withColumn("new", F.coalesce(gap, F.lit(False)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(ordered))
    stretches = runs.groupBy("copy", "run").agg(
        F.min("start").alias("start"), (F.max("start") + LENGTH).alias("end")
    )
    # A text with copies repeats as a whole.
    copied = texts.where((F.col("copies") > 1) & (F.col("n") >= LENGTH))
    part = stretches.join(copied.select(F.col("copy").alias("c")), F.col("copy") == F.col("c"), "left_anti")
    spans = part.select("copy", "start", "end").union(
        copied.select("copy", F.lit(0).cast("long"), F.col("n"))
    )
    spans = stored(spans.withColumnRenamed("copy", "c"), "stretches")
    return own.select("doc_id", "copy").join(spans, F.col("copy") == F.col("c")).select(
        "doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words")
    )
