"""Nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from levelwise.llm import (
    chat, decontaminate, lines, packing, passages, pii, quality, sharding, simhash, warc,
)


@pytest.fixture(scope="module")
def plain(odd_docs):
    return [(r.doc_id, r.text) for r in odd_docs.collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, None), (5, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "d e f g h i j k l m n"), (2, None), (3, ""), (None, "x"), (5, "x"), (6, "naïve")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_quality(clashing, plain, labels):
    got = quality.quality_verdicts(clashing, labels).collect()
    key = lambda r: (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert Counter(map(key, got)) == Counter((d, *brute.base_counts(t)) for d, t in plain)
    kept = quality.keep_good(clashing, labels)
    assert kept.columns == clashing.columns and kept.count() == sum(r.kept for r in got)


def test_decontamination(clashing, plain, items):
    got = decontaminate.contaminated_documents(clashing, items).collect()
    want = brute.contamination(plain, [(r.item_id, r.text) for r in items.collect()])
    assert Counter(map(tuple, got)) == Counter(want)
    kept = decontaminate.keep_clean(clashing, items)
    assert kept.columns == clashing.columns and kept.count() == sum(not w[-1] for w in want)


def test_near_duplicates(clashing, plain):
    prints = [brute.fingerprint(t) for _, t in plain]
    root = brute.near(prints, 4)
    least = {}
    for (d, _), p in zip(plain, prints):
        ids = [x for x in (d, least.get(root[p])) if x is not None]
        least[root[p]] = min(ids) if ids else None
    want = Counter((d, f"{p:016x}", least[root[p]]) for (d, _), p in zip(plain, prints))
    assert Counter(map(tuple, simhash.near_duplicates(clashing).collect())) == want
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == len(set(root.values()))


def test_passages(clashing, plain):
    got = [(r.doc_id, r.start, r.end) for r in passages.repeated_passages(clashing).collect()]
    assert sorted(got, key=str) == brute.passages(plain)


def test_personal_data(clashing, plain):
    got = pii.personal_data(clashing).collect()
    counts = lambda t: Counter(k for *_, k in brute.personal(t))
    want = Counter((d, *[counts(t)[k] for k in brute.PATTERNS]) for d, t in plain)
    assert Counter(tuple(r)[:5] for r in got) == want


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c@d.e x%y@q.r", "a@b.cx%y@d.e", "1.2.3.4.5.6.7.8 1.2.3x 300.1.1.1 0001.02.3.255", "a" * 3000 + "@x.y",
        "4111 1111 1111 1111 4111-1111-1111-1112 5" * 3, "+1 (555) 123-4567 +1((((((( +44 20 7946 0958-", "1" * 5000, "é@b.c é+49 30 123456789",
    ],
)
def test_patterns(spark, docs_of, text):
    got = pii.personal_data(docs_of([(1, text)])).first()
    want = [f"{kind}:{a}:{b}" for a, _, b, kind in brute.personal(text)]
    assert [s for s in got.spans.split(",") if s and not s.startswith("term")] == want


def test_sharding(clashing, plain):
    got = sharding.shard_documents(clashing, 4).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, len((t or "").encode()) + 16) for d, t in plain)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_one_row_a_third_of_all_is_split(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"),
    )
    sizes = sharding.shard_documents(rows, 10).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(sizes) == 10 and max(r.s for r in sizes) - min(r.s for r in sizes) < 60


def test_lines(clashing, plain):
    got = lines.deduplicated_lines(clashing)
    assert Counter((r.doc_id, r.n_lines) for r in got.collect()) == Counter((d, (t or "").count("\n") + 1) for d, t in plain)
    kept = lines.drop_repeats(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(plain)
    nine = kept.where("doc_id = 9").first().text
    assert nine == "mail me@x.org or +1 (555) 123-4567\n\n"


def test_packing(clashing, plain):
    got = packing.pack(clashing, 500, True).collect()
    assert Counter((r.doc_id, r.n_words) for r in got if not r.first_word and r.n_words < 500) == Counter(
        (d, len(brute.words(t))) for d, t in plain if len(brute.words(t)) < 500
    )
    assert sum(len(r.piece_text) for r in got) == sum(len(t or "") for _, t in plain)


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "a</turn>\n### x:\n"), (None, None, "assistant", "b\\"), (1, 1, "assistant", "𝒳" * 70_000)]
    got = {r.conv_id: r for r in chat.formatted_conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    ).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns, got[None].loss_chars) == (3, 70_000, 1, 2)


def test_warc(spark):
    big = "ß" * 900
    rows = [(1, "http://a/\r\nX: y", big), (4, None, big), (4, "u", big), (None, "u", big), (2, "u", "small"), (3, "u", "small"), (5, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived_pages(pages).collect())
    assert got == Counter({
        (1, 1800, "revisit", 4): 1, (4, 1800, "response", None): 2, (None, 1800, "revisit", 4): 1,
        (2, 5, "response", None): 1, (3, 5, "response", None): 1, (5, 0, "response", None): 1,
    })


def test_coalesced_ranges():
    places = [(0, 10), (10, 5), (100_000, 7), (100_010, 7)]
    assert list(warc.coalesced(places)) == [(0, 15, places[:2]), (100_000, 100_017, places[2:])]


def test_empty_tables(spark, odd_docs, labels, items):
    none = odd_docs.limit(0)
    assert quality.quality_verdicts(none, labels.limit(0)).count() == 0
    assert quality.quality_verdicts(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert decontaminate.contaminated_documents(none, items).count() == 0
    assert decontaminate.contaminated_documents(odd_docs, items.limit(0)).where("contaminated").count() == 0
    for empty in (
        simhash.near_duplicates(none), passages.repeated_passages(none), pii.personal_data(none),
        sharding.shard_documents(none), lines.deduplicated_lines(none), packing.pack(none),
    ):
        assert empty.count() == 0
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.formatted_conversations(talks).collect()] == [-7]
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
