"""Pages of a stored result."""

import re

from pyspark.sql import functions as F

from levelwise.operators import grid
from levelwise.plans.inspect import plan_text


def test_pages_cover_the_result_in_order(spark, tmp_path):
    df = spark.range(1, 1001).select(
        F.when(F.col("id") % 9 != 0, F.col("id") % 50).alias("k"), "id", F.lit("x").alias("_chunks")
    )
    order = [F.col("k").desc_nulls_last(), "id"]
    path = str(tmp_path / "pages")
    grid.write_pages(df, path, order, chunk_rows=90)
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    got = []
    for page in range(1, 36):
        rows = [tuple(r) for r in grid.stored_page(spark, path, page, 30, 90).collect()]
        assert len(rows) == max(0, min(30, 1000 - 30 * (page - 1)))
        got += rows
    assert got == want


def test_a_late_page_reads_about_a_page(spark, tmp_path):
    path = str(tmp_path / "pages")
    grid.write_pages(spark.range(200_000), path, [F.col("id").desc()], chunk_rows=1000)
    page = grid.stored_page(spark, path, 7777, 25, 1000)
    text = plan_text(page)
    assert re.search(r"PartitionFilters: \[.*_chunk", text) and re.search(r"PushedFilters: \[.*_row", text)
    assert [r.id for r in page.collect()] == list(range(200_000 - 7776 * 25 - 1, 200_000 - 7777 * 25 - 1, -1))
