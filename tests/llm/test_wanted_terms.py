from pyspark.sql import functions as F

from levelwise.llm import pii


def test_words_of_every_text_are_not_counted_in_all(spark):
    texts = spark.createDataFrame(
        [(f"common near{i % 40} rare" if i < 4 else f"common near{i % 40} text{i}",) for i in range(800)] * 2, "whole string"
    )
    both = spark.createDataFrame([(1, "common", 30), (2, "common", 9), (1, "rare", 4), (2, "absent", 3)], "entity long, term string, both long")
    assert {r.wanted for r in pii._wanted_terms(both, texts).collect()} == {"rare", "absent"}
    # Copies of a text count once, in a part as in all.
    found = {r.term: r.with_term for r in pii._texts_with(texts, both.select(F.col("term").alias("wanted")).distinct()).collect()}
    assert found == {"common": 800, "rare": 4}


def test_a_term_at_the_bound_is_not_lost(spark):
    # Of 40 texts with the term 29 have the entity: just likely enough in all texts, more so in a part.
    texts = spark.createDataFrame([(f"t{i} " + ("edge" if i < 40 else "other"),) for i in range(600)], "whole string")
    both = spark.createDataFrame([(1, "edge", n) for n in (5, 29)], "entity long, term string, both long")
    likely = spark.range(1).select(pii.likelihood_bound(F.lit(29), F.lit(40))).first()[0]
    kept = pii._wanted_terms(both, texts, (1,))
    assert (kept.count() == 1) == (likely >= pii.LIKELY)
    assert pii._wanted_terms(both, texts).count() == 1
