"""One query per operator, over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from levelwise.llm.audit import audited_filters
from levelwise.llm.chat import formatted_conversations
from levelwise.llm.codes import compressed
from levelwise.llm.decontaminate import contaminated_documents
from levelwise.llm.lines import deduplicated_lines
from levelwise.llm.neighbours import nearest_neighbours
from levelwise.llm.oracle import ORACLE_SQL
from levelwise.llm.packing import pack
from levelwise.llm.passages import repeated_passages
from levelwise.llm.pii import personal_data
from levelwise.llm.quality import quality_verdicts
from levelwise.llm.sharding import shard_documents
from levelwise.llm.simhash import near_duplicates
from levelwise.llm.warc import archived_pages


def _on(build: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

    return query


def _filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The files are streamed, so the operator takes their path.
    return audited_filters(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": _on(archived_pages, "pages"),
        "op2_quality_rules": _on(quality_verdicts, "documents", "labels"),
        "op3_repeated_passages": _on(repeated_passages, "documents"),
        "op4_decontamination": _on(contaminated_documents, "documents", "benchmark"),
        "op5_personal_data": _on(personal_data, "documents"),
        "op6_sharding": _on(shard_documents, "documents"),
        "op7_line_dedup": _on(deduplicated_lines, "documents"),
        "op8_chat": _on(formatted_conversations, "conversations"),
        "op9_near_duplicates": _on(near_duplicates, "documents"),
        "op10_packing": _on(pack, "documents"),
        "op11_vector_codes": _on(compressed, "embeddings"),
        "op12_filter_audit": _filter_audit,
        "op13_nearest_neighbours": _on(nearest_neighbours, "embeddings"),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
