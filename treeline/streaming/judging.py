"""Verdicts of a stream whose ignore files arrive like any other file, early or late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from treeline.operators import contents, verdicts
from treeline.operators.rules import is_ignore_file
from treeline.plans.project import KEYS, Selection

SEEN = "repo_id string, path string, size bigint, is_binary boolean, ignore_text string, has_text boolean, batch bigint"
VERDICTS = "repo_id string, path string, is_ignored boolean, is_binary boolean, reason string, batch bigint"


class RunningVerdicts:
    """The verdict of every file that has arrived, under all rules that have arrived.

    The state is a table in ``folder``: narrow rows of all files seen, texts of ignore files with them, one folder per batch. A batch judges its own
    files under the rules known by then. Where it brings a new version of a repository's ignore files, the earlier files of that repository,
    and of no other, are judged again by the same joins as in a batch job, so that a repository of any size is never one group. A batch
    that is run again after a failure sees what it saw before and writes the same again.

    A file that arrives again counts as its last version. Contents are read when they arrive and not kept.
    """

    def __init__(self, spark: SparkSession, folder: str, select: Selection = Selection()):
        self.spark, self.folder, self.select = spark, folder.rstrip("/"), select

    def _seen(self, upto: int) -> DataFrame:
        """The last version of each file up to a batch."""
        rows = self.spark.read.schema(SEEN).parquet(f"{self.folder}/seen").where(F.col("batch") <= upto)
        others = [c for c in rows.columns if c not in (*KEYS, "batch")]
        last = F.max_by(F.struct(*others), "batch")
        return rows.groupBy(*KEYS).agg(last.alias("_last"), F.max("batch").alias("batch")).select(*KEYS, "_last.*", "batch")

    def add(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        select = self.select
        measured = contents.measure(batch.select(*KEYS, "size", "content"), max_bytes=select.max_bytes).dropDuplicates(KEYS)
        measured.write.mode("overwrite").parquet(f"{self.folder}/seen/batch={number}")
        seen = self._seen(number)
        new_rules = seen.where((F.col("batch") == number) & is_ignore_file(F.col("path"))).select("repo_id").distinct()
        open_again = seen.join(new_rules.withColumn("_changed", F.lit(True)), "repo_id", "left").where(F.col("_changed") | (F.col("batch") == number))
        rules = verdicts.RuleSet.of(seen.join(open_again.select("repo_id").distinct(), "repo_id", "left_semi"), select.ignore, select.use_defaults, select.read_ignore_files)
        near = verdicts.within_level(open_again.drop("_changed", "batch"), select.level)
        judged = verdicts.judge(near, rules, select.include_binary, patterns=False)
        judged.select(*KEYS, "is_ignored", "is_binary", "reason").write.mode("overwrite").parquet(f"{self.folder}/verdicts/batch={number}")

    def follow(self, stream: DataFrame) -> DataStreamWriter:
        """The writer that keeps the table up to date with ``stream(repo_id, path, size, content)``."""
        return stream.writeStream.foreachBatch(self.add)

    def verdicts(self) -> DataFrame:
        """``repo_id, path, is_ignored, is_binary, reason``: each file's latest."""
        rows = self.spark.read.schema(VERDICTS).parquet(f"{self.folder}/verdicts")
        last = F.max_by(F.struct("is_ignored", "is_binary", "reason"), "batch")
        return verdicts.disposition(rows.groupBy(*KEYS).agg(last.alias("_last")).select(*KEYS, "_last.*"), self.select.keep)
