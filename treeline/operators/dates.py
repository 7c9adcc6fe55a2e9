"""Created and modified dates of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history_dates(commits: DataFrame) -> DataFrame:
    """``repo_id, path, h_created, h_modified`` from ``repo_id, path, commit_ord, author_date``.

    Author dates are ISO strings in the author's own zone; their first ten characters are the date, which
    is never moved to another zone. Every map task keeps one row per file.
    """
    day = F.left("author_date", F.lit(10))
    return commits.groupBy("repo_id", "path").agg(
        F.min_by(day, "commit_ord").alias("h_created"), F.max_by(day, "commit_ord").alias("h_modified")
    )


def with_dates(files: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """Adds ``created`` and ``modified``: from history, each missing one from ``mtime``.

    ``birthtime`` is used for ``created`` when the table has it. Without ``mtime`` there is no fallback.
    """
    out = files
    first = last = F.lit(None).cast("string")
    if commits is not None:
        out = out.join(history_dates(commits), ["repo_id", "path"], "left")
        first, last = F.nullif("h_created", F.lit("")), F.nullif("h_modified", F.lit(""))
    changed = F.date_format("mtime", "yyyy-MM-dd") if "mtime" in files.columns else F.lit(None).cast("string")
    born = F.coalesce(F.date_format("birthtime", "yyyy-MM-dd"), changed) if "birthtime" in files.columns else changed
    return out.withColumns({"created": F.coalesce(first, born), "modified": F.coalesce(last, changed)}).drop(
        "h_created", "h_modified"
    )
