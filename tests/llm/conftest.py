import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source)."""

    def build(rows):
        full = [(*r, *("en", "s")[len(r) - 2 :], len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return build


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls in every column, empty and blank texts, repeated rows, one very long text."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    return docs_of(
        [
            (1, "a b c d e f g h i j k l m n o p q r s t", None, None),
            (1, "a b c d e f g h i j k l m n o p q r s t", None, None),
            (2, None), (None, "a b c d e f g h i j k l m n o p q r s t"), (None, None),
            (3, ""), (4, " \n\t "), (5, long), (6, long), (7, "x"), (-8, "naïve İstanbul ẞ 𝒳 ok"),
            (9, "mail me@x.org or +1 (555) 123-4567\n\n\nmail me@x.org or +1 (555) 123-4567"),
        ]
    )


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same with more columns, named as those the operators use within."""
    from pyspark.sql import functions as F

    names = ["row", "words", "kept", "stats", "h", "_k", "_row", "all", "whole", "piece", "fp", "size", "stratum", "r"]
    return odd_docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
