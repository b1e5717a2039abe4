"""Vector codes: product quantisation with Orchard's search for the nearest codebook entry.

Vectors become integers and are cut into parts; each part is written as the number of the nearest
entry in its codebook. Orchard's search keeps, for every entry, the other entries in order of their distance
to it. It walks the list of the best entry so far, jumps to the list of a better one as soon as it
finds it, passes over entries it has seen, and stops where the list goes beyond twice the distance
reached: by the triangle inequality nothing behind that point is nearer.

Only codebooks, of a fixed number of entries, ever reach the driver; sums and counts of a round are added up in
every task before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelwise.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers beyond this could overflow a sum of squares.
LARGEST = 1 << 24


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries in order of distance, itself first, and these squared distances."""
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, -1)  # an entry heads its own list, before its equals
    order = np.argsort(apart, axis=1, kind="stable")
    np.fill_diagonal(apart, 0)
    return order, np.take_along_axis(apart, order, axis=1)


def orchard(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, of equally near ones the first, and its squared distance.

    All parts walk at once, each on its own list; one that has stopped is left out.
    """
    n, size = len(parts), len(book)
    lists, apart = neighbour_lists(book)
    best = np.zeros(n, dtype=np.int64)
    near = ((parts - book[0]) ** 2).sum(axis=1)
    seen = np.zeros((n, size), dtype=bool)
    seen[:, 0] = True
    place = np.ones(n, dtype=np.int64)  # an entry itself comes first in its list
    going = np.arange(n if size > 1 else 0)
    while len(going):
        at, where = best[going], place[going]
        other = lists[at, where]
        # Twice the distance, squared; an entry just there may be as near and come earlier.
        beyond = apart[at, where] > 4 * near[going]
        new = ~beyond & ~seen[going, other]
        walker, entry = going[new], other[new]
        seen[walker, entry] = True
        there = ((parts[walker] - book[entry]) ** 2).sum(axis=1)
        better = (there < near[walker]) | ((there == near[walker]) & (entry < best[walker]))
        place[going] += 1
        jumped = walker[better]
        best[jumped], near[jumped], place[jumped] = entry[better], there[better], 1
        going = going[~beyond]
        going = going[place[going] < size]
    return best, near


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors of a list column, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(-1, width)


def _cut(vectors: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part its piece of the vectors, the nearest entries and their distances."""
    step = books.shape[2]
    for p, book in enumerate(books):
        piece = np.ascontiguousarray(vectors[:, p * step : (p + 1) * step])
        yield piece, *orchard(piece, book)


def _sums(books: np.ndarray):
    """Reads vectors; one row for each part and entry that a task has used: count and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, step = books.shape
        counts, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, step), np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), parts * step)
            for p, (piece, nearest, _) in enumerate(_cut(vectors, books)):
                counts[p] += np.bincount(nearest, minlength=size)
                np.add.at(sums[p], nearest, piece)
        part, entry = np.nonzero(counts)
        rows = {
            "part": part, "entry": entry, "n": counts[part, entry], "total": list(sums[part, entry]),
        }
        schema = pa.schema(
            [("part", pa.int64()), ("entry", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]
        )
        yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return run


def _codes(books: np.ndarray):
    """Reads (vec_id, label, vector); yields codes and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(2), books.shape[0] * books.shape[2])
            code, error = np.zeros((len(vectors), len(books)), np.uint8), np.zeros(len(vectors), np.int64)
            for p, (_, nearest, apart) in enumerate(_cut(vectors, books)):
                code[:, p] = nearest
                error += apart
            text = [row.tobytes().hex() for row in code]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def whole_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has finite components only, with ``_ints``, the scaled integers."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    large = F.raise_error("a component is too large to be coded").cast("bigint")

    def scaled(x):
        whole = F.floor(x.cast("double") * SCALE)
        return F.when(F.abs(whole) <= LARGEST, whole).otherwise(large)

    kept = table.where(F.col(vector).isNotNull() & finite)
    return kept.withColumn("_ints", F.transform(vector, scaled))


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks from the first ``entries`` ids: (part, entry, place). None without a vector."""
    # A repeated id brings one vector, the least; only as many rows as a codebook has reach the driver.
    each = vectors.groupBy("vec_id").agg(F.min("_ints").alias("_ints"))
    first = each.orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    if not first:
        return None
    width = len(first[0]["_ints"])
    if not width or width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    if any(len(r["_ints"]) != width for r in first):
        raise ValueError("vectors differ in length")
    book = np.array([r["_ints"] for r in first], dtype=np.int64)
    return np.ascontiguousarray(book.reshape(len(first), parts, -1).transpose(1, 0, 2))


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after a round: each entry is the floored mean of the parts it is nearest to."""
    sums = vectors.select("_ints").mapInArrow(
        _sums(books), "part long, entry long, n long, total array<long>"
    )
    places = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(books.shape[2])]
    # One row an entry: as many as the codebooks have.
    rows = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *places).collect()
    out = books.copy()
    for r in rows:
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(books.shape[2])]
    return out


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def trained_books(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray | None:
    """Codebooks (part, entry, place) of the integer vectors ``_ints``; None without a vector."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number must fit a byte")
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = refined(vectors, books)
    return books


def compressed(
    table: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """A row for each usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Rows without a vector, or with a null or non-finite component, are left out; a table without
    any other row gives an empty result. Null ids are coded too and come last among the first ids. Of
    a repeated id the least vector enters the first codebooks; all its rows are coded. Vectors must have one
    length that ``parts`` divides, and components within ``LARGEST``: others fail the query.
    """
    slim = table.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vector).alias("_vector"))
    vectors = whole_vectors(slim, "_vector")
    books = trained_books(vectors, parts, entries, rounds)
    if books is None:
        books = np.zeros((parts, 1, 1), dtype=np.int64)
    width = books.shape[0] * books.shape[2]
    wrong = F.raise_error("vectors differ in length").cast("array<bigint>")
    checked = F.when(F.size("_ints") == width, F.col("_ints")).otherwise(wrong)
    kind = dict(slim.dtypes)["label"]
    coded = vectors.select("vec_id", "label", checked.alias("_ints")).mapInArrow(
        _codes(books), f"vec_id long, label {kind}, code string, error long"
    )
    coded = stored(coded, "vector-codes")  # used twice: searched once
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    digest = F.lit(books_digest(books)).alias("codebooks_sha256")
    return joined.select("vec_id", "code", "error", "label_error", digest)
