"""Corpus tables: one row per file, ``repo_id, path, size, content`` and optional times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.session import cut

KEYS = ["repo_id", "path"]


def files_table(
    df: DataFrame, repo: Column, path: Column, content: Column | None = None, keep: Sequence[str | Column] = (), **times: Column
) -> DataFrame:
    """Any table as a corpus table. Text columns become bytes, ``size`` is their number.

    ``times`` may give ``mtime`` and ``birthtime``. Without ``content`` the table carries sizes of 0 and is
    good for structure only.
    """
    columns = [repo.cast("string").alias("repo_id"), path.alias("path")]
    if content is None:
        columns.append(F.lit(0).cast("bigint").alias("size"))
    else:
        columns += [F.coalesce(F.octet_length(content), F.lit(0)).cast("bigint").alias("size"), content.cast("binary").alias("content")]
    columns += [value.alias(name) for name, value in times.items()]
    return df.select(*columns, *keep)


def addresses() -> list[Column]:
    """What names a row of a Parquet scan, for the ``keep`` of :func:`files_table`: columns ``_file`` and ``_row``."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


def one_per_path(files: DataFrame, newest: Column, address: Sequence[str] = ()) -> DataFrame:
    """One row per ``(repo_id, path)``: the one with the greatest ``newest``, then the greatest content.

    Copies are found on narrow rows; only files that do have copies are compared as whole rows, and every
    map task forwards one row per path, so many copies of one file do not meet in one task.

    ``address`` lists columns that together name a row, such as those of :func:`addresses`. Then losers are found by address on
    narrow rows, and the scan that reads the contents leaves them out; contents are read before only for rows that share the
    greatest ``newest`` of their path. Rows without repository or path all stay, null is the smallest ``newest``.
    """
    others = [c for c in files.columns if c not in (*KEYS, *address)]
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in others])
    if address:
        return files.join(_losers(files, newest, digest, list(address)), list(address), "left_anti").select(*files.columns)
    copies = files.groupBy(*KEYS).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(*KEYS)
    chosen = (
        files.join(copies, KEYS, "left_semi")
        .groupBy(*KEYS)
        .agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in others]), F.struct(newest, F.col("size"), digest)).alias("_row"))
        .select(*KEYS, "_row.*")
    )
    return files.join(copies, KEYS, "left_anti").unionByName(chosen)


def _losers(files: DataFrame, newest: Column, digest: Column, address: list[str]) -> DataFrame:
    """The addresses of the rows that give way to another row of their path; a written table, so a short one is broadcast by its size."""
    narrow = files.select(*KEYS, newest.alias("_newest"), *address)
    best = narrow.groupBy(*KEYS).agg(F.max("_newest").alias("_best"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    rivals = cut(narrow.join(best.drop("_n"), KEYS).select(*KEYS, *address, F.col("_newest").eqNullSafe(F.col("_best")).alias("_top")))
    top = rivals.where("_top")
    tied = cut(top.groupBy(*KEYS).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(*KEYS))
    losers = rivals.where("not _top").select(*address)
    if not tied.isEmpty():
        open_ = top.join(tied, KEYS, "left_semi").select(*KEYS, *address)
        last = F.max(F.struct("size", digest.alias("_digest"), *address)).alias("_last")
        won = files.join(open_.select(*address), address, "left_semi").groupBy(*KEYS).agg(last).select("_last.*").select(*address)
        losers = losers.unionByName(open_.select(*address).join(won, address, "left_anti"))
    return cut(losers)


def conflicts(files: DataFrame) -> DataFrame:
    """Paths that are a file and a directory at once: ``repo_id, path, n_below``.

    Directory rollups treat such a path as a directory.
    """
    path = F.col("path")
    below = (
        files.select("repo_id", paths.parent(path).alias("dir"))
        .groupBy("repo_id", "dir").agg(F.count("*").alias("n"))
        .select("repo_id", F.explode(paths.prefixes(F.col("dir"))).alias("path"), "n")
        .groupBy(*KEYS).agg(F.sum("n").alias("n_below"))
    )
    return files.select(*KEYS).distinct().join(below, KEYS)


def without_conflicts(files: DataFrame) -> DataFrame:
    """Drops the file rows of :func:`conflicts`, as tree jobs need a path to be one thing."""
    return files.join(conflicts(files).select(*KEYS), KEYS, "left_anti")


def bucketed(files: DataFrame, name: str, buckets: int, place: str | None = None) -> DataFrame:
    """Saves a corpus as table ``name``, bucketed and sorted by repository and path, at ``place`` or in the warehouse.

    Verdicts, dates and other narrow tables of the same key then join it in place: they move, contents do not. Several hundred MB a
    bucket are a good size.
    """
    writer = files.repartition(buckets, "repo_id", "path").write.format("parquet").mode("overwrite")
    writer = writer.bucketBy(buckets, "repo_id", "path").sortBy("repo_id", "path")
    (writer.option("path", place) if place else writer).saveAsTable(name)
    return files.sparkSession.table(name)
