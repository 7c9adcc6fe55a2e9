"""Directory totals that are available while files are still arriving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from treeline.functions import paths
from treeline.operators import rollup

KEYS = ["repo_id", "path"]


def first_arrivals(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """``stream`` with a file that is delivered twice once.

    The state of that check has one entry per path; with ``watermark`` (a delay on ``mtime``) entries expire, and a copy arriving later
    than that counts again.
    """
    if watermark:
        return stream.withWatermark("mtime", watermark).dropDuplicatesWithinWatermark(KEYS)
    return stream.dropDuplicates(KEYS)


def running_directories(
    stream: DataFrame, sums: Sequence[str] = ("size",), watermark: str | None = None
) -> DataFrame:
    """``repo_id, path, n_files, sums..., created, modified`` of every directory, for update mode.

    Changed and deleted files need :mod:`treeline.operators.refresh`, as nothing is taken back here. The totals themselves are state, one entry
    per directory, kept as long as the stream runs; :class:`RunningTotals` keeps them in a table instead.
    """
    measures = [F.sum(c).alias(c) for c in sums]
    dates = [c for c in ("created", "modified") if c in stream.columns]
    measures += [(F.min if c == "created" else F.max)(F.nullif(c, F.lit(""))).alias(c) for c in dates]
    above = F.explode(paths.directories_of(paths.parent(F.col("path")))).alias("path")
    # Each task adds its rows up before the shuffle, so the root is one row per task and batch.
    return (
        first_arrivals(stream, watermark)
        .select("repo_id", above, *sums, *dates)
        .groupBy("repo_id", "path")
        .agg(F.count("*").alias("n_files"), *measures)
    )


class RunningTotals:
    """Directory totals as a keyed table that micro-batches add to.

    A batch writes what it adds, a row for each directory it touches and no other, to a folder of its own number; run again after a failure it
    writes the same again. The table is the sum over the batches (earliest and latest of the dates). The stream itself
    keeps no totals, only the check for repeated files, which a watermark bounds.

    :meth:`compact` merges what is there into one base, so that a reader never sums more than the batches since. Batches up to the base's
    number are then void, wherever their folders still lie.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, sums: Sequence[str] = ("size",)):
        """``schema`` is that of :func:`treeline.operators.rollup.directories` for the files of the stream."""
        self.spark, self.folder, self.schema, self.sums = spark, folder.rstrip("/"), schema, list(sums)

    def add(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch`` of a stream of :func:`first_arrivals`."""
        rollup.directories(batch, self.sums).write.mode("overwrite").parquet(f"{self.folder}/batches/batch={number}")

    def follow(self, stream: DataFrame, watermark: str | None = None) -> DataStreamWriter:
        """The writer that keeps the table up to date with ``stream``."""
        return first_arrivals(stream, watermark).writeStream.foreachBatch(self.add)

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch bigint").option("ignoreMissingFiles", "true").parquet(f"{self.folder}/{kind}")

    def _exists(self, kind: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def base(self) -> int:
        """The last batch that the newest base holds, -1 without one. A base counts from when it was written to its end."""
        if not self._exists("done"):
            return -1
        return self.spark.read.schema("upto bigint").parquet(f"{self.folder}/done").agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]

    def totals(self, upto: int | None = None) -> DataFrame:
        """The table as it is, or as it was after batch ``upto`` (of those after the base)."""
        base = self.base()
        empty = self.spark.createDataFrame([], f"{self.schema}, batch bigint")
        batches = self._read("batches") if self._exists("batches") else empty
        since = batches.where(F.col("batch") > base)
        rows = (since if upto is None else since.where(F.col("batch") <= upto)).drop("batch")
        if base >= 0:
            rows = rows.unionByName(self._read("bases").where(F.col("batch") == base).drop("batch"))
        dates = [c for c in ("created", "modified") if c in rows.columns]
        added = [F.sum(f"`{c}`").alias(c) for c in ("n_files", *self.sums)] + [(F.min if c == "created" else F.max)(c).alias(c) for c in dates]
        return rows.groupBy(*KEYS).agg(*added)

    def compact(self, upto: int) -> None:
        """Makes a base of all batches up to ``upto``; to be called between batches, with the number of one that is done."""
        if upto > self.base():
            self.totals(upto).write.mode("overwrite").parquet(f"{self.folder}/bases/batch={upto}")
            self.spark.range(upto, upto + 1).select(F.col("id").alias("upto")).coalesce(1).write.mode("append").parquet(f"{self.folder}/done")
