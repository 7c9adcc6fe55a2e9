"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.fill_middle import fill_in_middle, restored
from treeline.llm.graph_index import nearest_neighbours
from treeline.llm.language import held_out, identified, learn
from treeline.llm.lexical import best_documents
from treeline.llm.line_dedup import deduplicated_lines
from treeline.llm.mixing import mixed
from treeline.llm.packing import packed, pieces
from treeline.llm.quotient import exact_duplicates
from treeline.llm.set_join import near_copies
from treeline.llm.slots import sharded
from treeline.llm.token_counts import counted
from treeline.llm.url_rules import filtered
from treeline.llm.wrapper import extracted

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filtered(table(spark, folder, "pages"), RULES)


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(pieces(table(spark, folder, "documents"), tokenizer()))[0]


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = held_out(F.col("doc_id"))
    found = identified(docs.select("doc_id", "text"), learn(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    return sharded(table(spark, folder, "documents"))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents"))


def op6_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extracted(table(spark, folder, "pages"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicated_lines(table(spark, folder, "documents")).drop("mark")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents"))[0].drop("_row")


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut_up = fill_in_middle(table(spark, folder, "documents"))
    again = F.sha2(restored(F.col("form"), F.col("output")), 256)
    return cut_up.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), again.alias("restored_sha256"))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counted(table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return best_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_best_fit_packing, op3_language_id, op4_virtual_slots, op5_ngram_join, op6_nearest_neighbours, op7_exact_dedup, op8_main_text, op9_line_dedup, op10_mixing, op11_fill_in_middle, op12_token_counts, op13_lexical_search)
}
