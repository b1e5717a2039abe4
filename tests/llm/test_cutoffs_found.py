"""Cutoffs are proven from a few hundred labelled documents, and bad documents are rejected."""

import random

from pyspark.sql import functions as F

from levelwise.llm import quality


def test_cutoffs_from_few_labels(spark):
    draw = random.Random(3)
    good = lambda: {
        "symbol_ratio": 0.04 * draw.random(), "dup_line_ratio": 0.0, "repeat_ratio": 0.02 * draw.random(),
        "long_words": 5 + draw.random() / 2, "upper_ratio": 0.04 * draw.random(), "bang_ratio": 0.0,
        "short_words": -5.1, "few_letters": -0.97, "base_failed": False,
    }
    kinds = ", ".join(f"{rule}: double" for rule in quality.GRIDS)
    shape = f"row struct<doc_id: long, lang: string>, stats struct<{kinds}, base_failed: boolean>"
    rows = [((i, "abcd"[i % 4]), good()) for i in range(1400)]
    bad = [((2000 + i, "abcd"[i % 4]), good() | {"symbol_ratio": 2.8}) for i in range(40)]
    frame = spark.createDataFrame(rows + bad, shape)
    labels = spark.createDataFrame([(i, 1) for i in range(1400)], "doc_id long, quality int")
    holdout = frame.where("row.doc_id < 2000").select(F.col("row.lang").alias("stratum"), "stats")
    cuts = {r.stratum: r.cut for r in quality.cutoffs(holdout).collect()}
    assert set(cuts) == set("abcd") and all(c.symbol_ratio < 2.8 for c in cuts.values())
    kept = {r.row.doc_id for r in quality.judge(frame, labels).where("kept").collect()}
    assert not any(k >= 2000 for k in kept) and len(kept) > 0.97 * 1400
