"""What the rules removed: counters over verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.operators import skew
from treeline.operators.rule_index import Hits

# Names and order of the rules' origins and of the summary's lines.
ORIGINS = ("default", "gitignore", "user")
SUMMARY = (
    "Total files checked",
    "Files ignored",
    "Binary files found",
    "Binary files blocked",
    "Files included",
)


def pattern_hits(judged: DataFrame, by: Sequence[str] = ("repo_id",), hits: Hits | None = None) -> DataFrame:
    """``by..., origin, pattern, hits``: files credited to each pattern.

    A pattern listed twice counts twice. ``origin`` is the first one that holds the pattern, so a user's
    copy of a default rule counts as a default. With ``hits`` (and a verdict without ``patterns``), rules of ignore files come as counted rows.
    """
    used = judged.select(*by, "is_ignored", F.explode("matched").alias("m")).where(F.col("m.include") == F.col("is_ignored"))
    counted = used.groupBy(*by, F.col("m.origin").alias("origin"), F.col("m.pattern").alias("pattern")).agg(F.count("*").alias("hits"))
    if hits is not None:
        counted = counted.unionByName(hits.credits(judged).select(*by, F.lit("gitignore").alias("origin"), "pattern", "hits"))
    rank = F.array_position(F.array(*[F.lit(o) for o in ORIGINS]), F.col("origin"))
    return counted.groupBy(*by, "pattern").agg(F.min_by("origin", rank).alias("origin"), F.sum("hits").alias("hits")).select(*by, "origin", "pattern", "hits")


def binary_extensions(judged: DataFrame, by: Sequence[str] = ("repo_id",)) -> DataFrame:
    """``by..., binary_extension, files, blocked``; files without extension are left out."""
    return (
        judged.where(F.col("binary_extension") != "")
        .groupBy(*by, "binary_extension")
        .agg(F.count("*").alias("files"), F.count_if("is_ignored").alias("blocked"))
    )


def ignore_summary(judged: DataFrame, by: Sequence[str] = ("repo_id",)) -> DataFrame:
    """``by..., category, count``: five lines per group."""
    counted = judged.groupBy(*by).agg(
        F.count("*").alias("c0"),
        F.count_if("is_ignored").alias("c1"),
        F.count_if("is_binary").alias("c2"),
        F.count_if(F.col("is_binary") & F.col("is_ignored")).alias("c3"),
    ).withColumn("c4", F.col("c0") - F.col("c1"))
    lines = [F.struct(F.lit(name).alias("category"), F.col(f"c{i}").alias("count")) for i, name in enumerate(SUMMARY)]
    return counted.select(*by, F.inline(F.array(*lines)))


def ignored_files(judged: DataFrame, most: int | None = 20, by: Sequence[str] = ("repo_id",), hits: Hits | None = None) -> DataFrame:
    """The first ``most`` ignored files of each group by path, and a line counting the others.

    ``by..., line, file, reason, is_binary, patterns``. The rank limit reaches the map tasks, which
    forward at most ``most`` rows per group. Without a limit (``most=None``) all ignored files are listed.
    With ``hits`` (and a verdict without ``patterns``), rules of ignore files are listed for the files shown only.
    """
    ignored = judged.where("is_ignored").select(*dict.fromkeys([*by, "repo_id"]), F.col("path").alias("file"), "reason", "is_binary", "matched")
    columns = [*by, "line", "file", "reason", "is_binary", "patterns"]

    def shown(ranked: DataFrame) -> DataFrame:
        found = F.col("matched")
        if hits is not None:
            lists = hits.lists(ranked.where(~F.col("is_binary")).select("repo_id", F.col("file").alias("path"))).withColumnRenamed("path", "file")
            ranked = ranked.join(lists, ["repo_id", "file"], "left")
            of = lambda origin: F.filter("matched", lambda m: m["origin"] == origin)
            found = F.when(F.col("_found").isNull(), found).otherwise(F.concat(of("default"), F.col("_found"), of("user")))
        credited = F.transform(F.filter(found, lambda m: m["include"]), lambda m: m["pattern"])
        patterns = F.when(F.size(credited) > 0, F.array_join(credited, ", ")).otherwise("-")
        return ranked.withColumn("patterns", patterns).select(*columns)

    if most is None:
        return shown(skew.rank_within(ignored, by, [F.col("file").asc()], "line"))
    first = W.partitionBy(*by).orderBy("file")
    top = shown(ignored.withColumn("line", F.row_number().over(first)).where(F.col("line") <= most))
    others = ignored.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > most)
    nothing = F.lit("")
    return top.unionByName(
        others.select(
            *by,
            F.lit(most + 1).alias("line"),
            F.format_string("... and %d more", F.col("n") - F.lit(most)).alias("file"),
            nothing.alias("reason"),
            F.lit(None).cast("boolean").alias("is_binary"),
            nothing.alias("patterns"),
        )
    )


def _strings(items: DataFrame, group: Sequence[str], order: str, item, name: str) -> DataFrame:
    ranked = skew.rank_within(items, group, [F.col(order).asc()], "ordinal")
    comma = F.when(F.col("ordinal") > 1, ",").otherwise("")
    return ranked.select(*group, "ordinal", F.concat(comma, item).alias(name))


def pattern_strings(hits: DataFrame, by: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Active patterns of each origin: ``by..., origin, ordinal, patterns``.

    One row per pattern; the rows of an origin, put together in their order, are the text to paste.
    """
    return _strings(hits, [*by, "origin"], "pattern", F.col("pattern"), "patterns")


def extension_strings(extensions: DataFrame, by: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Binary extensions: ``by..., ordinal, extensions``, one row each; together the text to paste (``*.pyc,*.zip``)."""
    return _strings(extensions, list(by), "binary_extension", F.concat(F.lit("*"), "binary_extension"), "extensions")


def extension_statistics(files: DataFrame, by: Sequence[str] = ("repo_id",)) -> DataFrame:
    """``by..., extension, files, bytes`` by node extension."""
    extension = paths.node_extension(F.col("path")).alias("extension")
    return files.groupBy(*by, extension).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
