"""The three whole jobs: listing with statistics, bundle, ignore report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.operators import contents, dates, report, rollup, sections, skew, tree, verdicts
from treeline.operators.rule_index import Hits, match_rules
from treeline.operators.rules import ignore_file_rules, is_ignore_file, text_in_pieces
from treeline.operators.tokens import TokenModel, token_models, totals, with_counts
from treeline.session import cut

KEYS = ["repo_id", "path"]


@dataclass(frozen=True)
class Selection:
    """Which files a job looks at, and what it learns about them."""

    ignore: Sequence[str] = ()
    use_defaults: bool = True
    read_ignore_files: bool = True
    include_binary: bool = False
    keep: str = "included"
    level: int | None = None
    models: Sequence[str] = ()
    own_models: Sequence[TokenModel] = ()
    include_dates: bool = False
    commits: DataFrame | None = None
    max_bytes: int | None = None
    #: Write narrow rows to the checkpoint folder where a job uses them several times, so that contents
    #: are read once. Off, everything stays one lazy plan that reads them again for each use.
    materialise: bool = True

    def settle(self, df: DataFrame) -> DataFrame:
        return cut(df) if self.materialise else df

    def token_models(self) -> list[TokenModel]:
        return token_models(self.models, self.own_models)


def judged_with_hits(files: DataFrame, select: Selection, patterns: bool = True, once: bool = False) -> tuple[DataFrame, Hits | None]:
    """One narrow row per file with its verdict, and the hits of ignore files; content is read once and left behind.

    ``once`` says that the verdict is all that is wanted of the hits.
    """
    models = [m for m in select.token_models() if m.native]
    if select.level is not None:
        # Deeper files are not even measured, but ignore files count from everywhere.
        near = paths.file_level(F.col("path")) <= select.level
        files = files.where(near | is_ignore_file(F.col("path")) if select.read_ignore_files else near)
    measured = contents.measure(files, models, max_bytes=select.max_bytes)
    reads, texts = select.read_ignore_files, measured
    if reads:
        # one pass, and one table: a row per file, and the texts of ignore files in pieces
        both = select.settle(text_in_pieces(measured, "ignore_text", "ignore_at", whole=True))
        measured, texts = both.where(F.col("ignore_at").isNull()), both.where(F.col("ignore_at").isNotNull())
        if select.materialise:
            # Column statistics answer this; a corpus without ignore files is spared their join.
            reads = not texts.isEmpty()
    rules = verdicts.RuleSet.of(texts, select.ignore, select.use_defaults, reads)
    near = verdicts.within_level(measured.drop("ignore_text", "ignore_at"), select.level)
    hits = verdicts.rule_hits(near, rules, once=once)
    return verdicts.judge(near, rules, select.include_binary, patterns=patterns, hits=hits), hits


def judged_files(files: DataFrame, select: Selection) -> DataFrame:
    """One narrow row per file with its verdict and the patterns it is credited to."""
    return judged_with_hits(files, select)[0]


def kept_files(files: DataFrame, select: Selection) -> DataFrame:
    """Narrow rows of the files the job keeps, with token counts and dates."""
    judged, _ = judged_with_hits(files, select, patterns=False, once=True)
    kept = verdicts.disposition(judged.drop("matched", "credited"), select.keep)
    costly = [m for m in select.token_models() if not m.native]
    if costly:
        texts = contents.with_text(files.join(kept.select(*KEYS), KEYS, "left_semi"), max_bytes=select.max_bytes)
        counted = with_counts(texts, costly).select(*KEYS, *[F.col(f"`{m.column}`") for m in costly])
        kept = kept.join(counted, KEYS, "left")
    return dates.with_dates(kept, select.commits) if select.include_dates else kept


def _nodes(kept: DataFrame, models: Sequence[TokenModel], files: DataFrame) -> DataFrame:
    """Nodes of the kept files; a repository of which none is kept has its root all the same."""
    return rollup.nodes(kept, ["size", *[m.column for m in models]], repositories=files.select("repo_id").distinct())


def show_tree(
    files: DataFrame, select: Selection = Selection(), sort_by: str = "name", show_stats: bool = True,
    rows_per_key: int = skew.ROWS_PER_KEY,
) -> DataFrame:
    """The drawn tree with sizes, token counts and dates: ``repo_id, path, place, line``."""
    models = select.token_models()
    tree.sibling_order(sort_by, models, select.include_dates)  # fails before any job starts
    return tree.tree_lines(_nodes(select.settle(kept_files(files, select)), models, files), sort_by, show_stats, models, rows_per_key)


def summarize(
    files: DataFrame, select: Selection = Selection(), form: str = "text", sort_by: str = "name",
    only_structure: bool = False, delimiter: str = sections.FENCE, replacement: str = "'''",
    rows_per_key: int = skew.ROWS_PER_KEY,
) -> DataFrame:
    """The pieces of the bundle documents (``repo_id, place, path, chunk``), for ``sections.write_bundles``.

    Contents are read once: verdicts, counts and finished sections leave the same pass, are written down, and move once when the
    documents are put in order. Numbers, dates of a history and costly counts are known only after the verdict; with them, contents come in a second
    time by one join with the files that are written (no shuffle of theirs if the corpus table is bucketed by repository and path).
    """
    look = sections.layout(form, delimiter, replacement)
    models = select.token_models()
    tree.sibling_order(sort_by, models, select.include_dates)
    plain = select.materialise and not (look.numbered or select.include_dates or any(not m.native for m in models))
    if plain and not only_structure:
        kept = select.settle(kept_with_sections(files, select, look))
        parts = kept.where("has_text").select(*KEYS, "section", "section_bytes")
        lines = tree.tree_lines(_nodes(kept.drop("section", "section_bytes"), models, files), sort_by, False, models, rows_per_key)
        return sections.bundle_rows(lines, parts, look)
    kept = select.settle(kept_files(files, select))
    lines = tree.tree_lines(_nodes(kept, models, files), sort_by, False, models, rows_per_key)
    if only_structure:
        return sections.bundle_rows(lines, None, look)
    narrow = [c for c in (*KEYS, "created", "modified") if c in kept.columns]
    written = kept.where("has_text").select(*narrow)
    if look.numbered:
        written = sections.number_files(written)
    shown = files.drop("created", "modified").join(written, KEYS)
    parts = sections.sections(contents.with_text(shown, max_bytes=select.max_bytes), look)
    return sections.bundle_rows(lines, parts, look, kept.where("has_text"))


def _decided_by_files(files: DataFrame, select: Selection) -> DataFrame | None:
    """``repo_id, path, _by_files``: what ignore files decide, from paths and from the contents of ignore files alone; None without any."""
    near = verdicts.within_level(files.select(*KEYS), select.level)
    found = files.where(is_ignore_file(F.col("path"))).select(*KEYS, "content")
    if not select.read_ignore_files or found.select("path").isEmpty():
        return None
    # binary files never ask for the decision
    hits = match_rules(near, ignore_file_rules(found), once=True)
    return select.settle(hits.decide(near).where(F.col("_by_files").isNotNull()))


def kept_with_sections(files: DataFrame, select: Selection, look: sections.Layout) -> DataFrame:
    """:func:`kept_files` with ``section`` and ``section_bytes``, from one pass over the contents.

    Ignore files have decided before, on paths. Their decisions are the one thing that joins the pass: contents do not move for it if
    the corpus table is bucketed by repository and path, or if the decisions are few.
    """
    decided = _decided_by_files(files, select)
    near = verdicts.within_level(files.drop("created", "modified"), select.level)
    near = near.withColumns({c: F.lit(None).cast("string") for c in ("created", "modified")})
    if decided is not None:
        near = near.join(decided, KEYS, "left")
    models = select.token_models()
    read = contents.measure(near, models, max_bytes=select.max_bytes, more=sections.section_columns(look))
    judged = verdicts.judge(read, verdicts.RuleSet(select.ignore, select.use_defaults), select.include_binary, patterns=False)
    return verdicts.disposition(judged.drop("matched", "credited"), select.keep).drop("created", "modified", "ignore_text")


def token_totals(files: DataFrame, select: Selection, by: Sequence[str] = ()) -> DataFrame:
    """Token totals of the kept files per model."""
    return totals(kept_files(files, select), select.token_models(), by)


def ignore_report(files: DataFrame, select: Selection = Selection(), by: Sequence[str] = ("repo_id",), most: int | None = 20) -> dict[str, DataFrame]:
    """The ignore statistics as tables; all of them are aggregations over the same verdicts."""
    judged, found = judged_with_hits(files, select, patterns=False)
    judged = select.settle(judged)
    hits = report.pattern_hits(judged, by, found)
    extensions = report.binary_extensions(judged, by)
    return {
        "summary": report.ignore_summary(judged, by),
        "patterns": hits,
        "binary_extensions": extensions,
        "ignored_files": report.ignored_files(judged, most, by, found),
        "pattern_strings": report.pattern_strings(hits, by),
        "extension_strings": report.extension_strings(extensions, by),
        "extensions": report.extension_statistics(verdicts.disposition(judged, select.keep), by),
    }
