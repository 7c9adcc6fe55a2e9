"""Files that keep arriving: verdict, text and token counts without looking back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from treeline.operators import contents, verdicts
from treeline.operators.tokens import TokenModel, with_counts


def arrivals(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """Corpus rows from Parquet files dropped into a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_contents(
    stream: DataFrame, rules: verdicts.RuleSet, models: Sequence[TokenModel] = (), include_binary: bool = False,
    keep: str = "included", level: int | None = None, max_bytes: int | None = None,
) -> DataFrame:
    """Kept files with text and token counts, one pass and no state.

    Rules of the run (defaults and the user's) are tested row by row. Rules in ignore files need a join
    over the whole batch; use :func:`each_batch` for them.
    """
    if rules.ignore_files is not None:
        raise ValueError("ignore files need each_batch()")
    judged = verdicts.judge(verdicts.within_level(stream, level), rules, include_binary)
    texts = contents.with_text(verdicts.disposition(judged, keep), max_bytes=max_bytes)
    return with_counts(texts.where("has_text"), models)


def each_batch(stream: DataFrame, job: Callable[[DataFrame], DataFrame], folder: str) -> DataStreamWriter:
    """Runs a batch job on every micro-batch and writes its result to ``folder/batch=N``.

    A batch that is run again after a failure overwrites its own folder, so each row lands once.
    """

    def write(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write)
