"""How filters interact: what each removes, alone and behind others, in every order.

Every filter but one looks at a document's own text. The last removes a text that a smaller id
has too, which no document can tell by itself. All files are streamed as available-now
micro-batches. A state keyed by text holds the least id seen so far and its rows. A row counts
as a repeat when it arrives; rows that bring a text's least id take that back, and those that held the
least id before are retracted and counted as repeats again. The counters have one row for each part of
the corpus and set of failed filters, so all orders of the filters are read from them at the end.

Every micro-batch writes its own folders of state and counters and overwrites them when it is repeated, so
a lost executor, or a driver that starts again with the same ``work`` folder, counts nothing twice.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.llm.common import bind, stored, text_of, words_of
from levelwise.sources.scratch import scratch_path

FILTERS = "ABCDE"
#: The bit of the filter that compares texts; the others are bits 0 to 3 in their order.
REPEAT = 1 << FILTERS.index("E")
#: Micro-batches that the files are dealt to. Each reads the state, some 40 bytes a text, once more.
MICRO_BATCHES = 8

_CELL = ["part", "mask", "good", "toxic"]
_HELD = "key binary, doc_id long, part string, mask int, good boolean, toxic boolean, n long"


def own_failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A, B, C and D."""

    def bits(w: Column) -> Column:
        n = F.size(w)
        capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
        failed = [
            n < 100,
            100 * F.size(F.array_distinct(w)) < 80 * n,
            100 * capitals.cast("long") > 10 * F.char_length(text).cast("long"),
            text.rlike("[#$%&*|]"),
        ]
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))

    return bind(words_of(text), bits)


def _slim(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A narrow row for each document: the text by its digest, part, failures and labels."""
    text = text_of("text")
    rows = docs.select(
        F.unhex(F.md5(text.cast("binary"))).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of("lang").alias("part"),
        own_failures(text).cast("int").alias("mask"),
    )
    joined = rows.join(labels, F.col("doc_id") == F.col("label_id"), "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return joined.select("key", "doc_id", "part", "mask", *flags)


def _flagged(labels: DataFrame) -> DataFrame:
    """Labels by id; of several rows of an id, one that says so is enough."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), "quality", "toxic")
    flags = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))) for c in ("quality", "toxic")]
    grouped = known.where("label_id is not null").groupBy("label_id")
    return grouped.agg(flags[0].alias("good"), flags[1].alias("toxic"))


class _Auditor:
    """Takes micro-batches one after the other; all it keeps lies in ``work``."""

    def __init__(self, spark: SparkSession, work: str, labels: DataFrame):
        self.spark, self.work, self.labels = spark, work, labels

    def _kept(self, name: str, df: DataFrame, batch: int) -> DataFrame:
        path = f"{self.work}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _state(self, batch: int) -> DataFrame:
        """Rows that were the least of their text after some earlier batch."""
        if not batch:
            return self.spark.createDataFrame([], _HELD)
        held = self.spark.read.schema(f"{_HELD}, batch int").parquet(f"{self.work}/state")
        return held.where(F.col("batch") < batch).drop("batch")

    def take(self, docs: DataFrame, batch: int) -> None:
        rows = self._kept("rows", _slim(docs, self.labels), batch)
        held = self._state(batch)
        # Least ids combine before the shuffle, so a text with a third of all rows is no hot key.
        arrived = rows.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
        before = held.groupBy("key").agg(F.min("doc_id").alias("before"))
        found = arrived.join(before.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left")
        least = found.where("before is null or least <= before").select(
            F.col("key").alias("k"), "least", "before"
        )
        least = self._kept("least", least, batch)
        # Joined by text and id: copies of one text have many ids, so they lie in many tasks.
        entering = rows.join(least, (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("least")))
        counted = entering.groupBy("key", "doc_id", *_CELL).agg(F.count("*").alias("n"))
        entering = self._kept("state", counted, batch)
        passed = least.where("least < before")
        leaving = held.join(
            passed, (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("before"))
        )

        def cells(df: DataFrame, mask: Column, n: Column) -> DataFrame:
            return df.select("part", mask.alias("mask"), "good", "toxic", n.alias("n"))

        own, repeat = F.col("mask"), F.col("mask").bitwiseOR(REPEAT)
        first = F.when(F.col("doc_id").isNull(), own).otherwise(repeat)
        changes = cells(rows, first, F.lit(1).cast("long"))
        for moved, sign in ((entering, 1), (leaving, -1)):
            changes = changes.union(cells(moved, own, sign * F.col("n")))
            changes = changes.union(cells(moved, repeat, -sign * F.col("n")))
        self._kept("counters", changes.groupBy(*_CELL).agg(F.sum("n").alias("n")), batch)


def failure_counts(spark: SparkSession, path: str, labels: DataFrame, work: str | None = None) -> DataFrame:
    """Documents by ``part``, ``mask`` (bits of the filters failed), ``good`` and ``toxic``: column ``n``.

    ``path`` names the files of a documents table. With ``work``, a folder of an earlier call that did not
    end, that call is carried on.
    """
    source = spark.read.parquet(path)
    files = max(1, -(-len(source.inputFiles()) // MICRO_BATCHES))
    work = work or scratch_path(spark, "filter-audit")
    auditor = _Auditor(spark, work, stored(_flagged(labels), "audit-labels"))
    # A path that is a single file can be streamed only as a pattern.
    pattern = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files).parquet(pattern)
    query = (
        stream.select("doc_id", "text", "lang")
        .writeStream.foreachBatch(auditor.take)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    counters = spark.read.schema("part string, mask int, good boolean, toxic boolean, n long").parquet(
        f"{work}/counters/*"
    )
    return counters.groupBy(*_CELL).agg(F.sum("n").alias("n")).where("n <> 0")


def interaction_report(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from ``failure_counts``."""
    orders = ["".join(order) for order in permutations(FILTERS)]
    bits = f"transform(sequence(1, {len(FILTERS)}), i -> shiftleft(1, ascii(substr(filter_order, i, 1)) - ascii('A')))"
    each = (
        counts.selectExpr(*_CELL, "n", f"explode(array({', '.join(map(repr, orders))})) as filter_order")
        .selectExpr("*", f"{bits} as bits")
        .selectExpr("*", "posexplode(bits) as (i, own)")
        .selectExpr("*", "i + 1 as step", "aggregate(slice(bits, 1, i), 0, (seen, x) -> seen | x) as earlier")
    )
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0
    removed = fails & ~gone

    def total(condition: Column, weight=F.lit(1)) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n") * weight)), F.lit(0)).cast("long")

    # A document that fails k filters goes by each of them in one of k orders.
    share = F.expr(f"{len(orders)} div greatest(bit_count(mask), 1)")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(removed).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def audited_filters(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    """The report over all documents of the files at ``path``.

    A null text is empty and equal to other empty ones; a null lang is the part with the empty name. A null
    doc_id is neither smaller nor larger than another, so it makes no document a repeat and is none. Rows with
    equal doc_id and text are no repeats of each other. An empty table gives an empty result.
    """
    return interaction_report(failure_counts(spark, path, labels))
