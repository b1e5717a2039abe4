"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the least is a fingerprint. A document and
an item that share ``GUARANTEE`` = k + window - 1 words share the least hash of
that span, so joining fingerprints misses no span of this length. Hits are then extended
word by word to both sides and count when the matching run is long enough.

Items shorter than that are one window as a whole; for them k is their length and
every k-gram is a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelwise.llm.common import ascii_lower, identity, stored, text_of

#: Fixed value: consecutive words of an item that make a window.
GUARANTEE = 10
#: Words of one hashed gram; a window of 6 grams then spans 10 words.
GRAM = 5

#: Words are runs of other characters than these: ASCII without digits and letters.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), _GAPS, -1), "")


def _grams(words: Column, k: int) -> Column:
    """Hashes of the k-grams, in order; none for fewer than k words."""
    return F.when(F.size(words) < k, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0))),
            lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]),
        )
    )


def _least(grams: Column, window: int) -> Column:
    """The least hash of every window of grams; none for fewer grams than a window."""
    if window == 1:
        return grams
    return F.when(F.size(grams) < window, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.slice(grams, 1, F.greatest(F.size(grams) - (window - 1), F.lit(0))),
            lambda g, i: F.least(g, *[F.get(grams, i + j) for j in range(1, window)]),
        )
    )


def _context(words: Column, at: Column, k: int, reach: int) -> Column:
    """The k words at a place with ``reach`` words before and behind; null past the ends."""
    return F.transform(
        F.sequence(at - reach, at + (k + reach - 1)), lambda j: F.get(words, j)
    )


def _placed(
    texts: DataFrame, key: str, k: int, window: int, reach: int, name: str
) -> DataFrame:
    """(key, h, at, context) of every fingerprint: each gram that is least in some window.

    Equal least grams in one window all count, so both sides of a match have the same.
    """
    hashed = texts.select(key, "words", _grams(F.col("words"), k).alias("grams"))
    hashed = hashed.select("*", _least(F.col("grams"), window).alias("least"))

    def chosen(h: Column, i: Column) -> Column:
        found = F.lit(False)
        for j in range(window):
            found = found | F.coalesce(F.get("least", i - j) == h, F.lit(False))
        return found

    spots = F.filter(
        F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("at"))),
        lambda x: chosen(x["h"], x["at"]),
    )
    framed = F.transform(
        spots,
        lambda x: F.struct(x["h"], x["at"], _context(F.col("words"), x["at"], k, reach).alias(name)),
    )
    return hashed.select(key, F.explode(framed).alias("f")).select(
        key, F.col("f.h").alias("h"), F.col("f.at").alias("at"), F.col(f"f.{name}").alias(name)
    )


def _run(ours: Column, theirs: Column, reach: int, k: int) -> tuple[Column, Column, Column]:
    """Whether the k words in the middle agree, and how many do before and behind."""
    same = lambda i: F.coalesce(F.get(ours, F.lit(i)) == F.get(theirs, F.lit(i)), F.lit(False))
    middle = F.lit(True)
    for i in range(reach, reach + k):
        middle = middle & same(i)

    def count(places: list[int]) -> Column:
        total = F.lit(len(places))
        for n in reversed(range(len(places))):
            total = F.when(same(places[n]), total).otherwise(F.lit(n))
        return total

    before = count([reach - 1 - d for d in range(reach)])
    return middle, before, count([reach + k + d for d in range(reach)])


def _hits(docs: DataFrame, items: DataFrame, span: int, k: int) -> DataFrame:
    """(row, start, end, class) of matching runs of at least ``span`` words.

    ``docs`` has ``row`` and ``words``; ``items`` has ``class`` and ``words``, different in
    every class. ``end`` is exclusive, positions count words from 0.
    """
    window, reach = span - k + 1, span - k
    theirs = stored(_placed(items, "class", k, window, reach, "theirs"), "item-fingerprints")
    known = stored(theirs.select(F.col("h").alias("known")).distinct(), "item-hashes")

    own = docs.select("row", _grams(F.col("words"), k).alias("grams"))
    own = own.select("row", _least(F.col("grams"), window).alias("least"))
    winnowed = own.select("row", F.explode(F.array_distinct("least")).alias("h"))
    met = winnowed.join(known, F.col("h") == F.col("known"), "left_semi")
    suspects = stored(met.select(F.col("row").alias("suspect")).distinct(), "suspects")

    again = docs.join(suspects, F.col("row") == F.col("suspect"), "left_semi")
    ours = _placed(again, "row", k, window, reach, "ours")
    joined = ours.join(theirs.withColumnsRenamed({"h": "h2", "at": "at2"}), F.col("h") == F.col("h2"))
    middle, before, behind = _run(F.col("ours"), F.col("theirs"), reach, k)
    runs = joined.where(middle).select("row", "at", "class", before.alias("b"), behind.alias("e"))
    start, end = F.col("at") - F.col("b"), F.col("at") + k + F.col("e")
    return runs.where(F.col("b") + k + F.col("e") >= span).select(
        "row", start.alias("start"), end.alias("end"), "class"
    )


def _union_length(spans: Column) -> Column:
    """Words covered by spans (start, end)."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["to"], x["end"]).alias("to"),
            (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0))).alias("n"),
        ),
        lambda s: s["n"],
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    item_column: str = "item_id",
) -> DataFrame:
    """``row``, ``n_hit`` and ``classes`` of every document row with a hit.

    ``row`` is the number of the row's contents (:func:`levelwise.llm.common.identity`); repeated
    rows have one entry. ``classes`` holds numbers of distinct item texts, see
    :func:`item_classes`. Null texts have no words and no windows.
    """
    items = item_classes(benchmark, item_column)
    texts = stored(items.groupBy("class").agg(F.first("words").alias("words")), "item-texts")
    own = docs.select(
        identity(id_column, text).alias("row"), _words(text_of(text)).alias("words")
    )
    found = _hits(own, texts.where(F.size("words") >= GUARANTEE), GUARANTEE, GRAM)
    lengths = texts.where(F.size("words") < GUARANTEE).select(F.size("words").alias("n")).distinct()
    for n in sorted(r.n for r in lengths.collect()):  # nine at most
        found = found.union(_hits(own, texts.where(F.size("words") == n), n, n))
    return (
        found.groupBy("row")
        .agg(
            F.collect_set(F.struct("start", "end")).alias("spans"),
            F.array_sort(F.collect_set("class")).alias("classes"),
        )
        .select("row", _union_length(F.col("spans")).cast("long").alias("n_hit"), "classes")
    )


def item_classes(benchmark: DataFrame, item_column: str = "item_id") -> DataFrame:
    """Items that have words, with ``class``, a number of their sequence of words."""
    items = benchmark.select(
        F.col(item_column).cast("string").alias("item"), _words(text_of("text")).alias("words")
    ).where(F.size("words") > 0)
    return items.withColumn("class", F.xxhash64(F.array_join("words", " ")))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words, hit words and hit items of every document. A null item id is passed over in the list."""
    found = stored(contamination(docs, benchmark), "contamination")
    # Documents with the same set of classes share one list of items, made once.
    items = item_classes(benchmark).select("class", "item")
    sets = found.select("classes").distinct()
    listed = (
        sets.select("classes", F.explode("classes").alias("c"))
        .join(items, F.col("c") == F.col("class"))
        .groupBy("classes")
        .agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("all"))
        .select(
            F.col("classes").alias("set"),
            "n_items",
            F.sha2(F.array_join("all", ","), 256).alias("items_sha256"),
        )
    )
    listed = stored(listed, "item-sets")
    hits = found.join(listed, F.col("classes") == F.col("set")).select(
        F.col("row").alias("hit_row"), "n_hit", "n_items", "items_sha256"
    )
    own = docs.select(
        "doc_id",
        F.size(_words(text_of("text"))).cast("long").alias("n_words"),
        identity("doc_id", "text").alias("row"),
    )
    none = F.sha2(F.lit(""), 256)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return own.join(hits, F.col("row") == F.col("hit_row"), "left").select(
        "doc_id",
        "n_words",
        zero("n_hit"),
        zero("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns."""
    packed = docs.select(F.struct("*").alias("_row"))
    inner = packed.select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), "_row"
    )
    hit = stored(
        contamination(inner, benchmark).select(F.col("row").alias("_hit")), "contaminated"
    )
    kept = inner.withColumn("_k", identity("doc_id", "text"))
    return kept.join(hit, F.col("_k") == F.col("_hit"), "left_anti").select("_row.*")
