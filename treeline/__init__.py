"""Summaries of file corpora as Spark jobs: trees, totals, rules, tokens and bundles."""

from treeline.operators.rules import DEFAULT_RULES, compile_rule, ignore_file_rules
from treeline.operators.sections import write_bundles
from treeline.operators.tokens import TokenModel, token_models
from treeline.operators.verdicts import RuleSet, disposition, judge
from treeline.plans.project import Selection, ignore_report, kept_files, show_tree, summarize, token_totals
from treeline.sources.directory import read_tree
from treeline.sources.tables import conflicts, files_table, one_per_path, without_conflicts

__all__ = [
    "DEFAULT_RULES",
    "RuleSet",
    "Selection",
    "TokenModel",
    "compile_rule",
    "conflicts",
    "disposition",
    "files_table",
    "ignore_file_rules",
    "ignore_report",
    "judge",
    "kept_files",
    "one_per_path",
    "read_tree",
    "show_tree",
    "summarize",
    "token_models",
    "token_totals",
    "without_conflicts",
    "write_bundles",
]
