"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.language import held_out, identified, learn
from treeline.llm.mixing import mixed_documents
from treeline.llm.packing import packed, pieces
from treeline.llm.queries import table, tokenizer
from treeline.llm.quotient import without_copies
from treeline.llm.set_join import one_of_each
from treeline.session import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those between two languages."""
    found = identified(docs, learn(docs, ~held_out(F.col("doc_id"))))
    return found.where(~F.col("rejected")).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and round: what the mix takes twice comes twice."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(pieces(docs, tokenizer()))[0]


STAGES = [
    ("language id", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram join", ngram_join),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Compression, token ids and best-fit packing have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
