"""A corpus pipeline of five stages over documents, each one operator of loomwork.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import linededup, mixing, neardup, packing, toxicity
from loomwork.session import ready
from loomwork.sized import join_small
from loomwork.storage import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier calls toxic go."""
    return toxicity.without_toxic(docs, ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: lines that a large share of a source's documents has go; n_chars follows the text."""
    cut = linededup.without_boilerplate(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near duplicates the document with the least doc_id stays; rows without a doc_id stay."""
    kept = written(neardup.near_duplicates(docs).where("kept").select("doc_id").distinct(), "kept")
    stay = join_small(docs.dropDuplicates(), kept, "doc_id", "left_semi") if _repeated(docs) else join_small(docs, kept, "doc_id", "left_semi")
    return stay.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def _repeated(docs: DataFrame) -> bool:
    """Whether a doc_id comes twice: only then rows are compared whole."""
    return not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: a sample whose tokens follow the raked targets of source, language and topic."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of all documents in sequences of at most 2048 ids."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_boilerplate),
    ("near dedup", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL expresses neither the classifier nor raking to convergence nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage; each stage is written to the shared folder and read again."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
