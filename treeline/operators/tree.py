"""Sibling order and the drawn tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.labels import stats_label
from treeline.functions.paths import directories_of, node_depth, prefixes
from treeline.operators import rollup, skew
from treeline.operators.tokens import TokenModel
from treeline.session import cut

NO_DATE = "0000-00-00"


def sibling_order(sort_by: str, models: Sequence[TokenModel] = (), dated: bool = True) -> list[Column]:
    """Directories first; then by name, by size or tokens (largest first), or by date (newest first).

    Ties go by lower-case name, upwards, except under a date, where they go downwards; the name itself
    closes the order so that it is total.
    """
    name, lower = F.col("name"), F.lower("name")
    if sort_by == "name":
        keys = []
    elif sort_by == "size":
        keys = [F.col("size").desc()]
    elif sort_by in ("created", "modified"):
        if not dated:
            raise ValueError(f"sorting by {sort_by!r} needs dates")
        date = F.coalesce(F.nullif(sort_by, F.lit("")), F.lit(NO_DATE))
        return [F.col("is_dir").desc(), date.desc(), lower.desc(), name.desc()]
    else:
        columns = {m.name: m.column for m in models}
        if sort_by not in columns:
            raise ValueError(f"sorting by {sort_by!r} needs it among the token models")
        keys = [F.coalesce(F.col(f"`{columns[sort_by]}`"), F.lit(0)).desc()]
    return [F.col("is_dir").desc(), *keys, lower.asc(), name.asc()]


def rank_siblings(
    nodes: DataFrame,
    sort_by: str = "name",
    models: Sequence[TokenModel] = (),
) -> DataFrame:
    """All nodes with ``rn`` and ``siblings``; a root is its own only sibling."""
    order = sibling_order(sort_by, models, "created" in nodes.columns)
    return skew.rank_within(nodes, ["repo_id", "parent"], order, "rn", "siblings")


def _places(folders: DataFrame, crowded: DataFrame, rows_per_key: int) -> DataFrame:
    """``repo_id, parent, place, indent`` of every directory but the root.

    ``place`` is the list of sibling ranks on the way down. Directories meet the directories above them by
    an equi-join; those above many others are salted.
    """
    path = F.col("path")
    steps = folders.select("repo_id", path.alias("parent"), F.explode(prefixes(path)).alias("path"))
    ranks = folders.select("repo_id", "path", "rn", (F.col("rn") == F.col("siblings")).alias("is_last"))
    met = skew.salted_join(steps, ranks, ["repo_id", "path"], "inner", F.col("parent"), crowded, rows_per_key)
    # At most one step per level.
    return (
        met.groupBy("repo_id", "parent")
        .agg(F.array_sort(F.collect_list(F.struct(node_depth(path).alias("depth"), "rn", "is_last"))).alias("steps"))
        .select(
            "repo_id",
            "parent",
            F.transform("steps", lambda s: s["rn"]).alias("place"),
            F.array_join(F.transform("steps", lambda s: F.when(s["is_last"], "    ").otherwise("│   ")), "").alias("indent"),
        )
    )


def tree_lines(
    nodes: DataFrame,
    sort_by: str = "name",
    show_stats: bool = False,
    models: Sequence[TokenModel] = (),
    rows_per_key: int = skew.ROWS_PER_KEY,
) -> DataFrame:
    """The drawn tree, one row per line: ``repo_id, path, place, line``.

    Sorting by ``place`` within a repository gives the drawing: arrays compare element by element and a
    shorter one comes first, so a directory precedes what is below it. The root's place is empty.
    """
    ranked = rank_siblings(nodes, sort_by, models)
    # Ranked once, then used as files, as directories and as directories above directories.
    rows = cut(ranked.drop("depth", "extension"))
    crowded = rollup.crowded_directories(rows.where("is_dir"), rows_per_key)
    places = _places(rows.where(F.col("is_dir") & (F.col("path") != "")), crowded, rows_per_key)
    below = crowded.withColumnRenamed("path", "parent")
    drawn = skew.salted_join(rows.where(F.col("parent") != ""), places, ["repo_id", "parent"], "inner", F.col("name"), below)
    top = rows.where(F.col("parent") == "").withColumns(
        {"place": F.array().cast("array<bigint>"), "indent": F.lit("")}
    )
    label = F.lit("")
    if show_stats:
        dates = [F.col(c) if c in nodes.columns else None for c in ("created", "modified")]
        label = stats_label(F.col("size"), [(m.name, F.col(f"`{m.column}`")) for m in models], *dates)
    branch = F.when(F.col("rn") == F.col("siblings"), "└── ").otherwise("├── ")
    name = F.concat("name", F.when(F.col("is_dir"), "/").otherwise(""))
    lines = drawn.unionByName(top).select(
        "repo_id",
        "path",
        F.concat("place", F.array("rn")).alias("place"),
        F.concat("indent", branch, name, label).alias("line"),
    )
    root = rows.where(F.col("path") == "").select(
        "repo_id", "path", F.array().cast("array<bigint>").alias("place"), F.concat(F.lit("."), label).alias("line")
    )
    return root.unionByName(lines)


def line_numbers(nodes: DataFrame, sort_by: str = "name", models: Sequence[TokenModel] = ()) -> DataFrame:
    """``repo_id, path, line_no``: the line of each node in the drawing, from 1, as one number however deep the tree is.

    A node comes one line after its parent and the whole subtrees of the siblings before it. Subtree sizes are counted once, prefix sums among
    siblings run in partitions, and a directory's line adds up along its path, combined map-side.
    """
    path = F.col("path")
    folders = nodes.where("is_dir").select("repo_id", "path")
    # nodes directly in a directory, added up over all directories above
    held = nodes.where(path != "").groupBy("repo_id", F.col("parent").alias("path")).agg(F.count("*").alias("n"))
    below = held.select("repo_id", F.explode(directories_of(path)).alias("above"), "n").groupBy("repo_id", F.col("above").alias("path")).agg(F.sum("n").alias("_below"))
    sized = nodes.join(below, ["repo_id", "path"], "left").withColumn("_lines", F.lit(1) + F.coalesce("_below", F.lit(0)))
    order = sibling_order(sort_by, models, "created" in nodes.columns)
    stepped = skew.sum_before(sized.where(path != ""), ["repo_id", "parent"], order, "_lines", "_earlier")
    steps = cut(stepped.select("repo_id", "path", "parent", "is_dir", (F.col("_earlier") + 1).alias("_step")))
    down = folders.select("repo_id", path.alias("parent"), F.explode(prefixes(path)).alias("path"))
    met = skew.salted_join(down, steps.where("is_dir").select("repo_id", "path", "_step"), ["repo_id", "path"], "inner", F.col("parent"))
    starts = met.groupBy("repo_id", "parent").agg(F.sum("_step").alias("_start"))
    top = steps.where(F.col("parent") == "").select("repo_id", "path", (F.col("_step") + 1).alias("line_no"))
    deeper = skew.salted_join(steps.where(F.col("parent") != ""), starts, ["repo_id", "parent"], "inner", path)
    lines = deeper.select("repo_id", "path", (F.col("_start") + F.col("_step") + 1).alias("line_no"))
    root = nodes.where(path == "").select("repo_id", "path", F.lit(1).cast("bigint").alias("line_no"))
    return root.unionByName(top).unionByName(lines)
