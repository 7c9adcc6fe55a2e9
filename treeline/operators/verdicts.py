"""Ignored or kept: every file of a corpus against defaults, ignore files and the user's rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.operators import binary, skew
from treeline.operators.rule_index import Hits, match_rules
from treeline.operators.rules import DEFAULT_RULES, MATCH_TYPE, Rule, compile_rules, ignore_file_rules, matches_of_list

Detector = Callable[[Column, Column], Column]

DISPOSITIONS = ("included", "removed", "all")


@dataclass(frozen=True)
class RuleSet:
    """Rules in the order they apply: defaults, then ignore files of the corpus, then the user's.

    The two lists are parameters of a run and compile on the driver. ``ignore_files`` is a table made by
    :func:`treeline.operators.rules.ignore_file_rules`; it grows with the corpus and is only ever joined.
    """

    user: Sequence[str] = ()
    use_defaults: bool = True
    ignore_files: DataFrame | None = None
    compiled_defaults: list[Rule] = field(init=False)
    compiled_user: list[Rule] = field(init=False)

    def __post_init__(self) -> None:
        defaults = DEFAULT_RULES if self.use_defaults else ()
        object.__setattr__(self, "compiled_defaults", compile_rules(defaults))
        object.__setattr__(self, "compiled_user", compile_rules(self.user))

    @classmethod
    def of(cls, files: DataFrame, user: Sequence[str] = (), use_defaults: bool = True, read_ignore_files: bool = True):
        """Rules of a run over ``files``; ignore files are read before any depth limit."""
        return cls(user, use_defaults, ignore_file_rules(files) if read_ignore_files else None)


def within_level(files: DataFrame, level: int | None) -> DataFrame:
    """Files at most ``level`` directories deep; applied before the verdict, as it changes statistics."""
    return files if level is None else files.where(paths.file_level(F.col("path")) <= level)


def rule_hits(seen: DataFrame, rules: RuleSet, rows_per_key: int = skew.ROWS_PER_KEY, once: bool = False) -> Hits | None:
    """What the rules of ignore files hold for the text files of ``seen(repo_id, path, is_binary)``; None without ignore files."""
    if rules.ignore_files is None:
        return None
    return match_rules(seen.where(~F.col("is_binary")).select("repo_id", "path"), rules.ignore_files, rows_per_key, once)


def judge(
    files: DataFrame,
    rules: RuleSet,
    include_binary: bool = False,
    detector: Detector = binary.is_binary,
    rows_per_key: int = skew.ROWS_PER_KEY,
    patterns: bool = True,
    hits: Hits | None = None,
) -> DataFrame:
    """Adds the verdict to ``files`` (``repo_id, path, content, ...``, unique paths).

    ``is_binary``, ``binary_extension`` (NULL for text), ``matched`` (all matching rules in rule order),
    ``is_ignored`` (the last matching rule decides), ``credited`` (the patterns that count for the
    verdict) and ``reason`` (``binary``, ``pattern`` or NULL). Binary files never meet a rule. With no
    ignore files this is a projection: no shuffle, content columns may stay on board.

    Rules of ignore files decide by a maximum over :func:`rule_hits` (taken here unless given as ``hits``). Only with ``patterns`` are they
    listed per file; without, ``matched`` and ``credited`` hold defaults and the user's rules alone, and
    :meth:`treeline.operators.rule_index.Hits.credits` counts the others. A column ``_by_files`` of
    :meth:`treeline.operators.rule_index.Hits.decide` is taken as their decision.
    """
    path = F.col("path")
    empty = F.array().cast(f"array<{MATCH_TYPE}>")
    seen = files if "is_binary" in files.columns else files.withColumn("is_binary", detector(path, F.col("content")))
    from_files, by_files = empty, F.lit(None).cast("boolean")
    if "_by_files" in seen.columns:
        by_files = F.col("_by_files")
    elif (hits := hits or rule_hits(seen, rules, rows_per_key, not patterns)) is not None:
        if patterns:
            seen = seen.join(hits.lists(seen.where(~F.col("is_binary"))), ["repo_id", "path"], "left")
            from_files = F.coalesce(F.col("_found"), empty)
        seen = hits.decide(seen)
        by_files = F.col("_by_files")
    defaults, user = matches_of_list(path, rules.compiled_defaults, "default"), matches_of_list(path, rules.compiled_user, "user")
    held = seen.withColumns({"_defaults": F.when(F.col("is_binary"), empty).otherwise(defaults), "_user": F.when(F.col("is_binary"), empty).otherwise(user)})
    last = F.coalesce(
        F.try_element_at("_user", F.lit(-1))["include"], F.when(~F.col("is_binary"), by_files), F.try_element_at("_defaults", F.lit(-1))["include"], F.lit(False)
    )
    blocked = F.col("is_binary") & F.lit(not include_binary)
    credited = F.transform(
        F.filter("matched", lambda m: m["include"] == F.col("is_ignored")), lambda m: m["pattern"]
    )
    return (
        held.withColumn("matched", F.concat("_defaults", from_files, "_user"))
        .withColumn("is_ignored", blocked | last)
        .drop("_defaults", "_user", "_found", "_by_files")
        .withColumn("credited", credited)
        .withColumn("reason", F.when(blocked, F.lit("binary")).when(F.col("is_ignored"), F.lit("pattern")))
        .withColumn("binary_extension", F.when(F.col("is_binary"), F.lower(paths.suffix(path))))
    )


def disposition(judged: DataFrame, keep: str = "included") -> DataFrame:
    """``included`` or ``removed`` files, or ``all`` of them."""
    if keep not in DISPOSITIONS:
        raise ValueError(f"disposition must be one of {DISPOSITIONS}, not {keep!r}")
    if keep == "all":
        return judged
    return judged.where(F.col("is_ignored") if keep == "removed" else ~F.col("is_ignored"))
