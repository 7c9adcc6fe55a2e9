"""Directory totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.session import cut


def _measures(df: DataFrame, sums: Sequence[str]) -> tuple[list[Column], list[str]]:
    dates = [c for c in ("created", "modified") if c in df.columns]
    columns = [F.sum(f"`{c}`").alias(c) for c in sums]
    if "created" in dates:
        columns.append(F.min(F.nullif("created", F.lit(""))).alias("created"))
    if "modified" in dates:
        columns.append(F.max(F.nullif("modified", F.lit(""))).alias("modified"))
    return columns, [*sums, *dates]


def own_totals(files: DataFrame, sums: Sequence[str] = ("size",)) -> DataFrame:
    """Totals of the files directly in each directory: ``repo_id, path, n_files, sums..., dates``."""
    columns, _ = _measures(files, sums)
    return files.groupBy("repo_id", paths.parent(F.col("path")).alias("path")).agg(
        F.count("*").alias("n_files"), *columns
    )


def roll_up(own: DataFrame, sums: Sequence[str] = ("size",)) -> DataFrame:
    """Totals of everything below each directory, from :func:`own_totals`; the root is ``''``.

    Every directory adds to itself and all directories above. Sums are NULL only if no file below has the
    measure; ``created`` is the earliest, ``modified`` the latest date below.
    """
    columns, names = _measures(own, sums)
    return (
        own.select("repo_id", "n_files", *[f"`{c}`" for c in names], F.explode(paths.directories_of(F.col("path"))).alias("above"))
        .groupBy("repo_id", F.col("above").alias("path"))
        .agg(F.sum("n_files").alias("n_files"), *columns)
    )


def roll_up_deep(own: DataFrame, sums: Sequence[str] = ("size",)) -> DataFrame:
    """The result of :func:`roll_up` for trees of any depth, by doubling.

    After round k a directory holds the totals of what lies less than 2^k levels below it; the next round adds what it holds to the
    directory 2^k levels above. That takes as many rounds as the depth has binary digits, each with two rows per directory
    and a map-side combined sum, where a row per directory and ancestor grows with the square of a chain. In shallow trees
    :func:`roll_up` has fewer shuffles.
    """
    columns, names = _measures(own, sums)
    kept = ["n_files", *names]
    totals = cut(own.select("repo_id", "path", *[f"`{c}`" for c in kept]))
    deepest = totals.agg(F.max(paths.node_depth(F.col("path")))).first()[0] or 0
    step = 1
    while step <= deepest:
        depth = paths.node_depth(F.col("path"))
        above = F.call_function("substring_index", F.col("path"), F.lit("/"), depth - F.lit(step))
        both = F.when(depth >= step, F.array("path", above)).otherwise(F.array("path"))
        dealt = totals.select("repo_id", F.explode(both).alias("path"), *[f"`{c}`" for c in kept])
        totals = dealt.groupBy("repo_id", "path").agg(F.sum("n_files").alias("n_files"), *columns)
        step *= 2
    # sums and empty dates as roll_up gives them, in a tree without levels as well
    return totals if step > 1 else totals.groupBy("repo_id", "path").agg(F.sum("n_files").alias("n_files"), *columns)


def directories(files: DataFrame, sums: Sequence[str] = ("size",)) -> DataFrame:
    """``repo_id, path, n_files, sums..., created, modified`` of every directory that has a file below.

    Two steps, each combined map-side: files collapse into their own directory first, so only directories,
    not files, are multiplied by their depth. One directory or repository with a large share of the files
    reaches the reducers as one row per map task.
    """
    return roll_up(own_totals(files, sums), sums)


def crowded_directories(folders: DataFrame, rows_per_key: int) -> DataFrame:
    """Directories above more files than one task should hold, as keys for a salted join."""
    pieces = F.ceil(F.col("n_files") / F.lit(rows_per_key)).cast("int").alias("_pieces")
    return folders.where(F.col("n_files") > rows_per_key).select("repo_id", "path", pieces)


def nodes(files: DataFrame, sums: Sequence[str] = ("size",), folders: DataFrame | None = None, repositories: DataFrame | None = None) -> DataFrame:
    """Files and directories as one table: ``repo_id, path, parent, name, depth, is_dir, extension, ...``.

    The root of a repository is the path ``''``; its parent is NULL. ``repositories(repo_id)`` adds an empty root of size 0 for those without files.
    """
    folders = directories(files, sums) if folders is None else folders
    names = _measures(files, sums)[1]
    if repositories is not None:
        bare = repositories.join(folders.where("path = ''").select("repo_id"), "repo_id", "left_anti")
        size = [F.lit(0 if c == "size" else None).cast(folders.schema[c].dataType).alias(c) for c in names]
        folders = folders.select("repo_id", "path", "n_files", *[f"`{c}`" for c in names]).unionByName(
            bare.select("repo_id", F.lit("").alias("path"), F.lit(0).cast("bigint").alias("n_files"), *size)
        )
    measures = [F.col(f"`{c}`") for c in names]
    path = F.col("path")
    both = folders.select("repo_id", "path", F.lit(True).alias("is_dir"), "n_files", *measures).unionByName(
        files.select("repo_id", "path", F.lit(False).alias("is_dir"), F.lit(1).cast("bigint").alias("n_files"), *measures)
    )
    return both.select(
        "repo_id",
        "path",
        F.when(path != "", paths.parent(path)).alias("parent"),
        paths.base_name(path).alias("name"),
        paths.node_depth(path).alias("depth"),
        "is_dir",
        F.when(F.col("is_dir"), F.lit("")).otherwise(paths.node_extension(path)).alias("extension"),
        "n_files",
        *measures,
    )
