"""Sharding by sampled splitters.

Records are ordered by a key and cut into shards of nearly equal bytes. The order
is never formed in one place: splitters drawn from a size-weighted sample cut the
key space into ranges, exact range sizes place each range in the whole, and only
inside a range are records numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levelwise.llm.common import stored, text_of

#: Ranges for each shard at least, and sampled keys for each range, on average.
RANGES_PER_SHARD = 8
SAMPLES_PER_RANGE = 24
#: Records of a range, on average, at most: one task sorts their keys, without texts.
ROWS_PER_RANGE = 1_000_000
#: A range is cut again when it holds this many times its share.
OVERFULL = 2.0


def _order_key(key: Column, tie: Column) -> Column:
    """Text that sorts by key, then tie, then by the row's number in the stored table.

    The last part differs for every row, so one hot key, or a third of all rows
    being one repeated row, can still be cut anywhere.
    """
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    row = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    return F.concat(part(key), F.lit("\x01"), part(tie), F.lit("\x01"), row)


def _splitters(rows: DataFrame, wanted: int, salt: int) -> DataFrame:
    """Quantile boundaries of a size-weighted sample, as rows ``cut``.

    A row is drawn when a hash of its order key falls below its share of the
    bytes, so the expected sample is ``wanted * SAMPLES_PER_RANGE`` whatever the input.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    drawn = wanted * SAMPLES_PER_RANGE
    chance = F.col("size") * F.lit(drawn / max(total, 1))
    uniform = F.pmod(F.xxhash64(F.col("order_key"), F.lit(salt)), F.lit(1 << 40)) / F.lit(
        float(1 << 40)
    )
    sample = rows.where(uniform < chance).select("order_key")
    # The sample is of bounded size; one task ranks it.
    placed = Window.orderBy("order_key")
    tile = sample.select("order_key", F.ntile(wanted).over(placed).alias("tile"))
    return tile.groupBy("tile").agg(F.min("order_key").alias("cut")).where("tile > 1")


def _range_of(key: Column, cuts: list[str]) -> Column:
    """How many cuts are at most ``key``, by binary search over the sorted cuts."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at),
    )


def _cuts(rows: DataFrame, ranges: int) -> list[str]:
    """Boundaries for about ``ranges`` ranges, overfull ranges subdivided.

    What comes to the driver is a row for each range: a key for each ``ROWS_PER_RANGE`` records.
    """
    cuts = sorted(r.cut for r in _splitters(rows, ranges, 1).collect())
    sized = rows.groupBy(_range_of(F.col("order_key"), cuts).alias("r")).agg(
        F.sum("size").alias("size")
    )
    held = {r.r: r["size"] for r in sized.collect()}
    share = max(1, sum(held.values()) / ranges)
    overfull = [r for r, size in held.items() if size > OVERFULL * share]
    if overfull:
        inside = rows.where(_range_of(F.col("order_key"), cuts).isin(overfull))
        finer = _splitters(inside, max(2, round(sum(held[r] for r in overfull) / share)), 2)
        cuts = sorted({*cuts, *(r.cut for r in finer.collect())})
    return cuts


def assign_shards(
    docs: DataFrame,
    shards: int,
    key: Column,
    tie: Column,
    size: Column,
    keep: dict[str, Column],
) -> DataFrame:
    """Shard and slot of every row, by equal bytes along the order of key and tie.

    Returns the columns of ``keep``, ``size``, ``shard`` (from 0) and ``slot`` (from 0,
    gapless in each shard). A shard's bytes differ from the mean by less than
    one record. Null keys and ties sort as empty text; repeated rows are rows of their
    own; an empty table gives an empty result; other columns are ignored.
    """
    columns = [c.alias(f"k{i}") for i, c in enumerate(keep.values())]
    rows = stored(
        docs.select(_order_key(key, tie).alias("order_key"), size.alias("size"), *columns),
        "shard-rows",
    )
    cuts = _cuts(rows, max(shards * RANGES_PER_SHARD, rows.count() // ROWS_PER_RANGE))
    spread = rows.withColumn("r", _range_of(F.col("order_key"), cuts))
    sizes = spread.groupBy("r").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row for each range: a bounded table, so a plain dictionary and literals do.
    ahead, first, total, count = {}, {}, 0, 0
    for r in sorted(sizes.collect(), key=lambda r: r.r):
        ahead[r.r], first[r.r] = total, count
        total, count = total + r.bytes, count + r.rows
    bound = lambda of: F.array(
        *[F.lit(of.get(r, 0)).cast("long") for r in range(len(cuts) + 1)]
    )
    inside = Window.partitionBy("r").orderBy("order_key")
    before = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    offset = F.get(bound(ahead), F.col("r")) + F.coalesce(before, F.lit(0))
    numbered = spread.select(
        "*",
        # A row belongs to the shard in which its middle byte lies.
        ((2 * offset + F.col("size")) * shards).alias("at"),
        (F.get(bound(first), F.col("r")) + F.row_number().over(inside) - 1).alias("row"),
    ).withColumn("shard", F.expr(f"cast(least(at div {2 * max(total, 1)}, {shards - 1}) as int)"))
    placed = stored(numbered.drop("order_key", "r", "at"), "shard-placed")
    heads = placed.groupBy("shard").agg(F.min("row").alias("start")).collect()
    starts = {r.shard: r.start for r in heads}
    start = F.array(*[F.lit(starts.get(s, 0)).cast("long") for s in range(shards)])
    return placed.select(
        *[F.col(f"k{i}").alias(name) for i, name in enumerate(keep)],
        "size",
        "shard",
        (F.col("row") - F.get(start, F.col("shard"))).alias("slot"),
    )


def text_size(text: str = "text") -> Column:
    """Bytes a text needs: its UTF-8 length, nothing for null, and 16 for the record."""
    return (F.octet_length(text_of(text)) + 16).cast("long")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The digest of sharding documents by the hash of their text.

    Equal texts lie next to each other, and a group that is larger than a shard goes
    on in the next one. Law ``bytes``: sizes of shards are nearly equal.
    """
    text = text_of("text")
    placed = assign_shards(
        docs,
        shards,
        key=F.md5(text),
        tie=F.lpad(F.hex(F.col("doc_id")), 16, "0"),
        size=text_size(),
        keep={"doc_id": F.col("doc_id"), "text_crc32": F.crc32(text)},
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
