"""Joins and ranks that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.session import cut

#: Most rows of one key that a single task is asked to hold. A key above it is split.
ROWS_PER_KEY = 1_000_000
#: Most keys in the list of split ones, which is held by the driver and broadcast: some 10 MB. Of more, those with the most rows are split.
MOST_CROWDED = 100_000


def crowded_keys(df: DataFrame, on: Sequence[str], rows_per_key: int = ROWS_PER_KEY) -> DataFrame:
    """Keys with more than ``rows_per_key`` rows and the number of pieces each is split into."""
    return (
        df.groupBy(*on)
        .agg(F.count("*").alias("_rows"))
        .where(F.col("_rows") > rows_per_key)
        .select(*on, F.ceil(F.col("_rows") / F.lit(rows_per_key)).cast("int").alias("_pieces"))
    )


def bounded(crowded: DataFrame, most: int = MOST_CROWDED) -> DataFrame | None:
    """``crowded`` as a table of known size, ``most`` rows at most; None if no key is crowded.

    Where more keys are, the limit above which a key is split doubles until the list is short enough; results do not depend on it.
    """
    pieces = 1
    while len(rows := crowded.where(F.col("_pieces") > pieces).limit(most + 1).collect()) > most:
        pieces *= 2
    return crowded.sparkSession.createDataFrame(rows, crowded.schema) if rows else None


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Column,
    crowded: DataFrame | None = None,
    rows_per_key: int = ROWS_PER_KEY,
) -> DataFrame:
    """Equi-join of a many-rows ``left`` with a few-rows-per-key ``right``; the result is the plain join's.

    Rows of a crowded key are dealt over ``_pieces`` sub-keys by the hash of ``spread`` and the right side
    is repeated once per piece. All other keys keep a single piece. ``crowded`` can be handed in when the
    counts are known already; otherwise they are taken from ``left`` by a map-side combined count.
    """
    if rows_per_key < 1:
        raise ValueError(f"rows_per_key must be at least 1, not {rows_per_key}")
    crowded = bounded(crowded_keys(left, on, rows_per_key) if crowded is None else crowded)
    if crowded is None:
        return left.join(right, list(on), how)
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    dealt = (
        left.join(F.broadcast(crowded), list(on), "left")
        .withColumn("_piece", F.pmod(F.xxhash64(spread), pieces.cast("bigint")).cast("int"))
        .drop("_pieces")
    )
    repeated = (
        right.join(F.broadcast(crowded), list(on), "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - F.lit(1))))
        .drop("_pieces")
    )
    return dealt.join(repeated, [*on, "_piece"], how).drop("_piece")


def _laid_out(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` range partitioned on group *and* order, with the partition as ``_slice`` and a row's place as ``_at``.

    The positions are only meaningful for one fixed layout of the partitions, so they are written down.
    """
    return cut(
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_slice", F.spark_partition_id())
    )


def _with_slices(laid_out: DataFrame, group: Sequence[str], value: Column) -> DataFrame:
    """Adds to each row what its group has of ``value`` in earlier partitions (``_before``) and in all (``_total``), and its first ``_at`` here."""
    # One row per group and partition it lies in.
    window = W.partitionBy(*group)
    before = window.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = (
        laid_out.groupBy(*group, "_slice")
        .agg(F.min("_at").alias("_first"), F.sum(value).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(window))
        .drop("_n")
        .withColumnsRenamed({name: f"_of_{name}" for name in [*group, "_slice"]})
    )
    same = F.col("_slice") == F.col("_of__slice")
    for name in group:
        same &= F.col(name).eqNullSafe(F.col(f"_of_{name}"))
    return laid_out.join(slices, same)


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], rank: str = "rn", total: str | None = None) -> DataFrame:
    """``df`` with ``row_number`` per group as ``rank``, and the group's size as ``total``; ``group`` may be empty.

    Rows are range partitioned on group *and* order, so that a group of any size runs over as many sorted
    partitions as it needs; a rank is the place in the partition plus the rows of the group in earlier ones.
    """
    columns = df.columns
    placed = _with_slices(_laid_out(df, group, order), group, F.lit(1))
    ranked = placed.withColumn(rank, F.col("_before") + F.col("_at") - F.col("_first") + F.lit(1))
    return ranked.select(*[f"`{name}`" for name in columns], rank, *([F.col("_total").alias(total)] if total else []))


def sum_before(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows of each group as ``name``, 0 for the first.

    Two levels, as in :func:`rank_within`: sums of the group's earlier partitions, and sums along one partition, which are all that a task
    ever holds of a group.
    """
    laid_out = _laid_out(df, group, order)
    inside = W.partitionBy("_slice", *group).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    along = laid_out.withColumn("_along", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    placed = _with_slices(along, group, F.col(value))
    return placed.select(*[f"`{c}`" for c in df.columns], (F.col("_before") + F.col("_along")).alias(name))
