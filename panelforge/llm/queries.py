"""The queries of this subpackage and their DuckDB SQL: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import alignment, exact_dedup, langid, line_dedup, mixing, near_dedup, neighbours, packing, pii, quality, spelling, suffix_tree, token_files
from panelforge.llm.common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False).drop("row")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no words, a null id is empty text, repeated rows count each; an empty table gives no rows."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts, and those that a tokenizer doesn't spell, have zeros; repeated rows count each."""
    return alignment.align_documents(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts score as empty ones; repeated rows score alike; without trusted positives all score 0.5."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_mix": op3_mix,
    "op4_neighbours": op4_neighbours,
    "op5_line_dedup": op5_line_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_packing": op8_packing,
    "op9_pii": op9_pii,
    "op10_token_files": op10_token_files,
    "op11_spelling": op11_spelling,
    "op12_alignment": op12_alignment,
    "op13_quality": op13_quality,
}
SQL = {
    "op3_mix": mixing.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op9_pii": pii.ORACLE,
    "op11_spelling": spelling.ORACLE,
}
