"""Directory totals kept up to date for changed files only.

The state is two tables: directory totals, and how many files below each directory have each date. A date that goes is
subtracted there, and the next one is known; no file and no directory without a change is looked at again. Sum columns must not be NULL
here; fill absent counts with 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.operators.rollup import own_totals, roll_up
from treeline.session import cut

KEYS = ["repo_id", "path"]


@dataclass(frozen=True)
class Totals:
    """``directories`` as :func:`treeline.operators.rollup.directories` gives them, and ``days``: ``repo_id, path, kind, day, n``, with one
    row for every date that some file below a directory has as ``kind``, ``created`` or ``modified``."""

    directories: DataFrame
    days: DataFrame


def _kinds(df: DataFrame) -> list[str]:
    return [c for c in ("created", "modified") if c in df.columns]


def _days(files: DataFrame, kinds: Sequence[str], sign: Column) -> DataFrame:
    """Signed counts of the dates of ``files``, at their own directories."""
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("day")) for c in kinds]))
    rows = files.select("repo_id", paths.parent(F.col("path")).alias("path"), sign.alias("_sign"), each).where(F.nullif("day", F.lit("")).isNotNull())
    return rows.groupBy(*KEYS, "kind", "day").agg(F.sum("_sign").alias("n"))


def _above(own: DataFrame, *columns: str) -> DataFrame:
    above = F.explode(paths.directories_of(F.col("path"))).alias("above")
    return own.select("repo_id", above, *[f"`{c}`" for c in columns]).withColumnRenamed("above", "path")


def _day_counts(own: DataFrame) -> DataFrame:
    return _above(own, "kind", "day", "n").groupBy(*KEYS, "kind", "day").agg(F.sum("n").alias("n"))


def _no_days(spark) -> DataFrame:
    return spark.createDataFrame([], "repo_id string, path string, kind string, day string, n bigint")


def rebuild(files: DataFrame, sums: Sequence[str] = ("size",)) -> Totals:
    """Both tables from scratch."""
    kinds = _kinds(files)
    days = _day_counts(_days(files, kinds, F.lit(1).cast("bigint"))) if kinds else _no_days(files.sparkSession)
    return Totals(roll_up(own_totals(files, sums), sums), days)


def changes(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows gone from ``old`` and rows come in ``new``; a changed file is in both."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*KEYS, F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name))

    joined = packed(old, "_old").join(packed(new, "_new"), KEYS, "full_outer")
    differ = joined.where(~F.col("_old").eqNullSafe(F.col("_new")))
    gone = differ.where(F.col("_old").isNotNull()).select(*KEYS, "_old.*")
    come = differ.where(F.col("_new").isNotNull()).select(*KEYS, "_new.*")
    return gone, come


def refresh(before: Totals, gone: DataFrame, come: DataFrame, sums: Sequence[str] = ("size",)) -> Totals:
    """Both tables after ``gone`` rows left and ``come`` rows arrived.

    Only the directories above a changed file are multiplied by their depth. Counts and sums move by the difference; a touched directory's
    dates are the first and the last of its counted ones, all others stay as they are. Directories left without files drop out.
    """
    kinds = _kinds(before.directories)
    if missing := [c for c in kinds if c not in gone.columns or c not in come.columns]:
        raise ValueError(f"changes have to tell {missing} of their files")
    signed = gone.withColumn("_sign", F.lit(-1).cast("bigint")).unionByName(come.withColumn("_sign", F.lit(1).cast("bigint")))
    moved = [F.sum("_sign").alias("n_files"), *[F.sum(F.col("_sign") * F.col(f"`{c}`")).alias(c) for c in sums]]
    adding = ["n_files", *sums]
    own = signed.groupBy("repo_id", paths.parent(F.col("path")).alias("path")).agg(*moved)
    moves = cut(_above(own, *adding).groupBy(*KEYS).agg(*[F.sum(f"`{c}`").alias(f"_d_{c}") for c in adding]))
    merged = before.directories.join(moves.withColumn("_touched", F.lit(True)), KEYS, "full_outer")
    totals = [(F.coalesce(F.col(f"`{c}`"), F.lit(0)) + F.coalesce(F.col(f"`_d_{c}`"), F.lit(0))).alias(c) for c in adding]
    merged = merged.select(*KEYS, *totals, "_touched", *kinds).where(F.col("n_files") > 0)
    if not kinds:
        return Totals(merged.select(*before.directories.columns), before.days)
    delta = _day_counts(_days(signed, kinds, F.col("_sign")))
    days = cut(before.days.unionByName(delta).groupBy(*KEYS, "kind", "day").agg(F.sum("n").alias("n")).where("n > 0"))
    first_and_last = {"created": F.min(F.when(F.col("kind") == "created", F.col("day"))), "modified": F.max(F.when(F.col("kind") == "modified", F.col("day")))}
    known = days.join(moves.select(*KEYS), KEYS, "left_semi").groupBy(*KEYS).agg(*[first_and_last[c].alias(f"_new_{c}") for c in kinds])
    fixed = merged.join(known, KEYS, "left")
    chosen = {c: F.when(F.col("_touched"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in kinds}
    return Totals(fixed.withColumns(chosen).select(*before.directories.columns), days)
