"""Commit history as a table: ``repo_id, path, commit_ord, author_date``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A commit starts with the mark and its date, at the begin of the log or behind what ends the commit before.
COMMIT = r"(?:^|\x00|\n)\x01(?=[0-9]{4}-[0-9]{2}-)"


def parse_log(lines: DataFrame) -> DataFrame:
    """Commits from the text of ``git log -z --reverse --name-only --format=%x01%aI``.

    ``-z`` ends date and paths with NUL and leaves paths as they are, so that any name comes through. Without it they are one per line, and git
    puts names with special characters in quotes, which fails here rather than losing them.

    ``lines`` holds ``repo_id, log``: any number of rows per repository, each a whole number of commits,
    with ``log_ord`` numbering them. A commit starts with the mark and its author date; the paths it
    touches follow.
    """
    commit = lines.select("repo_id", "log_ord", F.posexplode(F.split("log", COMMIT)).alias("nth", "commit")).where(F.trim("commit") != "")
    ended = F.contains("commit", F.lit("\0"))
    raw = F.split(F.regexp_replace("commit", r"^[^\x00]*\x00\n?", ""), r"\x00")
    quoted = F.exists(F.slice(F.split("commit", "\n"), 2, 1 << 30), lambda p: F.startswith(p, F.lit('"')) & F.endswith(p, F.lit('"')))
    fails = F.raise_error(F.concat(F.lit("quoted path in a log that was written without -z: "), "commit")).cast("array<string>")
    by_line = F.when(quoted, fails).otherwise(F.slice(F.split("commit", "\n"), 2, 1 << 30))
    return commit.select(
        "repo_id",
        F.explode(F.filter(F.when(ended, raw).otherwise(by_line), lambda p: p != "")).alias("path"),
        F.struct("log_ord", "nth").alias("commit_ord"),
        F.trim(F.regexp_extract("commit", r"^[^\x00\n]*", 0)).alias("author_date"),
    )
