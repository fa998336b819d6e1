"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import ann, fingerprint, htmlblocks, infill, linededup, mixing, neardup, packing, pii, relativeparse, tokenfile, toxicity, turnrepair


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mixed(_table(spark, sf_dir, "documents"), added=True)
    return chosen.select("doc_id", "source", "lang", "topic", "tokens", "probability")


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.without_boilerplate(_table(spark, sf_dir, "documents"), added=True)
    return rows.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("text_sha256"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(_table(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(_table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlblocks.main_text(_table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.fill_in_middle(_table(spark, sf_dir, "documents")))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turnrepair.repaired(turnrepair.damaged(_table(spark, sf_dir, "conversations")))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relativeparse.digest(relativeparse.without_repeats(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_near_duplicates, op3_toxicity, op4_mixing, op5_nearest_vectors, op6_line_dedup,
        op7_personal_data, op8_packing, op9_token_files, op10_main_text, op11_fill_in_middle, op12_turn_repair, op13_substring_dedup,
    )
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES = {
    "op11_fill_in_middle": infill.ORACLE,
    "op12_turn_repair": turnrepair.ORACLE,
    "op13_substring_dedup": relativeparse.ORACLE,
    "op6_line_dedup": linededup.ORACLE.format(documents="documents")
    + """
SELECT doc_id, source,
  CASE WHEN text IS NULL THEN 0 ELSE len(every) END::BIGINT AS n_lines,
  CASE WHEN less THEN len(every) - len(kept) ELSE 0 END::BIGINT AS n_dropped,
  sha256(CASE WHEN less THEN array_to_string(kept, chr(10)) ELSE text END) AS text_sha256
FROM decided
"""
}
