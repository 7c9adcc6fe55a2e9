"""The queries: every operator over whole given tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from catalogue import corpora
from treeline.functions.labels import human_size, stats_label
from treeline.functions.paths import fence_language, node_depth, node_extension, split_extension, suffix
from treeline.operators import binary, contents, dates, refresh, report, rollup, sections, tokens, tree, verdicts
from treeline.operators.rules import is_ignore_file
from treeline.plans import project
from treeline.session import checkpoint_dir, cut, folders_listed_together
from treeline.sources import history, tables
from treeline.sources.directory import read_tree
from treeline.streaming import ingest
from treeline.streaming.judging import RunningVerdicts
from treeline.streaming.running import RunningTotals, first_arrivals

MODELS = tokens.token_models(["chars-1", "chars-4", "chars-3.5"])
USER_RULES = ["b3/", "en/b1", "*.json", "!doc_*8.json", "/fr/b2/*", "doc_14.py", "*.log"]

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}


def query(function: Query) -> Query:
    CATALOGUE[function.__name__] = function
    return function


def _judged(spark: SparkSession, folder: str, include_binary: bool = False) -> DataFrame:
    """Verdicts of the documents under defaults and the user's rules: one projection, no shuffle."""
    rules = verdicts.RuleSet(USER_RULES)
    return verdicts.judge(corpora.documents(spark, folder), rules, include_binary).drop("content")


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    return contents.measure(corpora.documents(spark, folder), MODELS)


def _place(column: str = "place") -> Column:
    return F.array_join(F.transform(column, lambda i: F.lpad(i.cast("string"), 6, "0")), ".").alias("place")


@query
def directory_totals(spark, folder):
    return rollup.directories(corpora.documents(spark, folder))


@query
def deep_directory_totals(spark, folder):
    """Totals of chains of some hundred folders, where every folder has files."""
    totals = rollup.roll_up_deep(rollup.own_totals(corpora.nested_documents(spark, folder)))
    return totals.select("repo_id", node_depth(F.col("path")).alias("level"), F.md5(F.col("path").cast("binary")).alias("path_md5"), "n_files", "size")


@query
def order_value_by_place(spark, folder):
    totals = rollup.directories(corpora.orders(spark, folder), ["value"])
    return totals.select("path", "n_files", F.col("value").cast("double").alias("value"))


@query
def extension_notions(spark, folder):
    path = F.col("path")
    return corpora.documents(spark, folder).select(
        "repo_id", "path", node_extension(path).alias("node"), suffix(path).alias("suffix"),
        split_extension(path).alias("split"), fence_language(path).alias("fence"),
    )


@query
def tree_by_name(spark, folder):
    lines = tree.tree_lines(rollup.nodes(corpora.documents(spark, folder)))
    return lines.select("repo_id", "path", _place(), "line")


@query
def tree_by_size_with_stats(spark, folder):
    select = project.Selection(USER_RULES, read_ignore_files=False)
    lines = project.show_tree(corpora.documents(spark, folder), select, "size")
    return lines.select("repo_id", "path", _place(), "line")


@query
def order_tree_structure(spark, folder):
    """Folders of the order tree; the orders themselves are its files."""
    lines = tree.tree_lines(rollup.nodes(corpora.orders(spark, folder), ["value"]))
    return lines.select("path", _place(), "line")


@query
def siblings_by_size(spark, folder):
    ranked = tree.rank_siblings(rollup.nodes(corpora.documents(spark, folder)), "size").where(F.col("path") != "")
    return ranked.select("repo_id", "path", "rn", "size", human_size(F.col("size")).alias("label"))


@query
def token_counts(spark, folder):
    texts = contents.with_text(corpora.documents(spark, folder))
    return tokens.token_counts(texts, MODELS)


@query
def directory_tokens(spark, folder):
    totals = rollup.directories(_counted(spark, folder), [m.column for m in MODELS])
    return tokens.unpivot_counts(totals, ["repo_id", "path"], MODELS)


@query
def token_totals(spark, folder):
    return tokens.totals(_counted(spark, folder), MODELS)


@query
def siblings_by_tokens(spark, folder):
    nodes = rollup.nodes(_counted(spark, folder), ["size", *[m.column for m in MODELS]])
    ranked = tree.rank_siblings(nodes, "chars-4", MODELS).where(F.col("path") != "")
    return ranked.select("repo_id", "path", "rn", F.col("`tokens:chars-4`").alias("n"))


@query
def file_dates(spark, folder):
    files = corpora.dated_documents(spark, folder).drop("content")
    return dates.with_dates(files, corpora.commits(spark, folder)).select("repo_id", "path", "created", "modified")


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    return dates.with_dates(corpora.dated_documents(spark, folder).drop("content"), corpora.commits(spark, folder))


@query
def directory_dates(spark, folder):
    return rollup.directories(_dated(spark, folder)).select("repo_id", "path", "created", "modified")


@query
def siblings_by_modified(spark, folder):
    ranked = tree.rank_siblings(rollup.nodes(_dated(spark, folder)), "modified").where(F.col("path") != "")
    return ranked.select("repo_id", "path", "rn", "modified")


@query
def siblings_by_created(spark, folder):
    ranked = tree.rank_siblings(rollup.nodes(_dated(spark, folder)), "created").where(F.col("path") != "")
    return ranked.select("repo_id", "path", "rn", "created", stats_label(F.col("size"), (), F.col("created"), F.col("modified")).alias("label"))


@query
def binary_files(spark, folder):
    docs = corpora.documents(spark, folder)
    return docs.select("repo_id", "path", binary.is_binary(F.col("path"), F.col("content")).alias("is_binary"))


@query
def rule_verdicts(spark, folder):
    return _judged(spark, folder).select("repo_id", "path", "is_ignored", "is_binary")


@query
def ignore_file_verdicts(spark, folder):
    files = corpora.documents_with_ignore_files(spark, folder)
    judged = project.judged_files(files, project.Selection(["*.md", "!doc_2*.md"]))
    return judged.select("repo_id", "path", "is_ignored", "reason", F.array_join("credited", "|").alias("credited"))


@query
def many_rules_verdicts(spark, folder):
    """Ignore files of thousands of rules: verdicts without a list of patterns."""
    files = corpora.documents_with_many_rules(spark, folder)
    judged, _ = project.judged_with_hits(files, project.Selection(["!doc_3*.md"]), patterns=False, once=True)
    return judged.select("repo_id", "path", "is_ignored", "reason")


@query
def many_rules_hits(spark, folder):
    """How many files each rule of those ignore files is credited for, and the first ignored files."""
    files = corpora.documents_with_many_rules(spark, folder)
    told = project.ignore_report(files, project.Selection(["!doc_3*.md"]))
    return told["patterns"].select("repo_id", "origin", "pattern", "hits")


@query
def removed_files(spark, folder):
    return verdicts.disposition(_judged(spark, folder), "removed").select("repo_id", "path", "reason", "binary_extension")


@query
def files_within_level(spark, folder):
    near = verdicts.within_level(corpora.pages(spark, folder), 1)
    judged = verdicts.judge(near, verdicts.RuleSet(["*.html", "/de/"]))
    return verdicts.disposition(judged).select("repo_id", "path", "size")


@query
def credited_rules(spark, folder):
    judged = _judged(spark, folder)
    return judged.select("repo_id", "path", F.posexplode("credited").alias("nth", "pattern"))


@query
def binaries_kept_or_not(spark, folder):
    docs = contents.measure(corpora.documents(spark, folder))
    rules = verdicts.RuleSet(USER_RULES)
    without = verdicts.judge(docs, rules).select("repo_id", "path", "is_binary", F.col("is_ignored").alias("without"))
    kept = verdicts.judge(docs, rules, include_binary=True).select("repo_id", "path", F.col("is_ignored").alias("included"))
    return without.join(kept, ["repo_id", "path"])


@query
def pattern_hits(spark, folder):
    return report.pattern_hits(_judged(spark, folder))


@query
def pattern_hits_of_all(spark, folder):
    return report.pattern_hits(_judged(spark, folder), by=())


@query
def binary_extensions(spark, folder):
    return report.binary_extensions(_judged(spark, folder))


@query
def ignore_summary(spark, folder):
    return report.ignore_summary(_judged(spark, folder))


@query
def first_ignored_files(spark, folder):
    return report.ignored_files(_judged(spark, folder))


@query
def pattern_strings(spark, folder):
    return report.pattern_strings(report.pattern_hits(_judged(spark, folder)))


@query
def extension_strings(spark, folder):
    return report.extension_strings(report.binary_extensions(_judged(spark, folder)))


def _whole_report(spark: SparkSession, folder: str, by: tuple[str, ...]) -> DataFrame:
    """All parts of the ignore report as rows of one table."""
    select = project.Selection(USER_RULES, read_ignore_files=False)
    parts = project.ignore_report(corpora.documents(spark, folder), select, by)
    rows = []
    for name, part in parts.items():
        told = [F.col(c).cast("string") for c in sorted(part.columns) if c not in by]
        rows.append(part.select(*by, F.lit(name).alias("part"), F.concat_ws("|", *told).alias("told")))
    return functools.reduce(DataFrame.unionByName, rows)


@query
def ignore_report(spark, folder):
    return _whole_report(spark, folder, ("repo_id",))


@query
def ignore_report_of_all(spark, folder):
    return _whole_report(spark, folder, ())


@query
def all_files(spark, folder):
    """The disposition ``all``: what is included and what is removed, each file once."""
    judged = _judged(spark, folder)
    parts = [verdicts.disposition(judged, kind).select("repo_id", "path", F.lit(kind).alias("part")) for kind in ("included", "removed")]
    every = verdicts.disposition(judged, "all").select("repo_id", "path", "is_ignored", "reason")
    return every.join(parts[0].unionByName(parts[1]), ["repo_id", "path"], "full")


@query
def rare_texts(spark, folder):
    """Empty texts, line ends of other systems and NUL bytes."""
    texts = contents.with_text(corpora.rare_documents(spark, folder))
    return texts.select("repo_id", "path", "is_binary", "has_text", F.md5(F.when(F.col("has_text"), F.col("text"))).alias("digest"))


@query
def rare_text_sections(spark, folder):
    """Fences inside of fenced sections."""
    parts = sections.sections(contents.with_text(corpora.rare_documents(spark, folder)), sections.text_layout())
    return parts.select("repo_id", "path", F.md5("section").alias("digest"))


@query
def rare_xml_sections(spark, folder):
    """The end of CDATA inside of CDATA."""
    parts = sections.sections(contents.with_text(corpora.rare_documents(spark, folder)), sections.xml_layout())
    return parts.select("repo_id", "idx", "path", F.md5("section").alias("digest"))


@query
def extension_statistics(spark, folder):
    return report.extension_statistics(corpora.documents(spark, folder))


@query
def text_sections(spark, folder):
    texts = contents.with_text(corpora.conversations(spark, folder))
    return sections.sections(texts, sections.text_layout())


@query
def xml_sections(spark, folder):
    texts = contents.with_text(corpora.pages(spark, folder))
    parts = sections.sections(texts, sections.xml_layout())
    return parts.select("repo_id", "idx", "path", F.md5("section").alias("digest"))


@query
def markdown_sections(spark, folder):
    texts = contents.with_text(_dated_texts(spark, folder))
    parts = sections.sections(texts, sections.markdown_layout())
    return parts.select("repo_id", "path", F.md5("section").alias("digest"))


def _dated_texts(spark: SparkSession, folder: str) -> DataFrame:
    return dates.with_dates(corpora.dated_documents(spark, folder))


@query
def written_files(spark, folder):
    """Files with a section per repository, binaries as placeholders."""
    files = contents.measure(corpora.documents(spark, folder))
    return files.where("has_text").groupBy("repo_id").agg(F.count("*").alias("n_files"))


@query
def readable_files(spark, folder):
    """How many files the size cap leaves readable, here at 5,000 bytes."""
    texts = contents.with_text(corpora.documents(spark, folder), max_bytes=5000)
    kind = (
        F.when(F.col("size") > 5000, "capped")
        .when(F.col("text") == "", "empty")
        .when(F.col("is_binary"), "placeholder")
        .otherwise("text")
    )
    return texts.groupBy("repo_id", kind.alias("kind")).agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))


@query
def notebook_texts(spark, folder):
    texts = contents.with_text(corpora.notebooks(spark, folder))
    return texts.select("repo_id", "path", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query
def latest_pages(spark, folder):
    return corpora.pages(spark, folder).select("repo_id", "path", "size", F.md5(F.col("content")).alias("digest"))


@query
def path_conflicts(spark, folder):
    """Languages as files next to the folders of the same name."""
    docs = corpora.documents(spark, folder).select("repo_id", "path")
    langs = docs.select("repo_id", F.substring_index("path", "/", 1).alias("path")).distinct()
    return tables.conflicts(docs.unionByName(langs))


@query
def refreshed_totals(spark, folder):
    """Totals after a change: toxic documents are gone, low-quality ones emptied, their dates too."""
    labels = corpora.table(spark, folder, "labels")
    docs = corpora.table(spark, folder, "documents").select("doc_id")
    marked = docs.join(labels, "doc_id", "left")
    dated = dates.with_dates(corpora.dated_documents(spark, folder).drop("content"))
    number = F.regexp_extract("path", "doc_([0-9]+)", 1).cast("bigint").alias("doc_id")
    old = dated.select("repo_id", "path", "size", "created", "modified", number)
    new = old.join(marked, "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0)
    emptied = F.coalesce("quality", F.lit(1)) == 0
    new = new.select(
        "repo_id", "path", F.when(emptied, F.lit(0)).otherwise(F.col("size")).alias("size"),
        F.when(emptied, "2030-01-01").otherwise(F.col("created")).alias("created"),
        F.when(emptied, "2030-01-01").otherwise(F.col("modified")).alias("modified"),
    )
    old, new = cut(old.drop("doc_id")), cut(new)
    gone, come = refresh.changes(old, new, ["size", "created", "modified"])
    return refresh.refresh(refresh.rebuild(old), gone, come).directories


@query
def log_dates(spark, folder):
    """Dates from commit logs, here one commit per event."""
    commits = corpora.commits(spark, folder)
    entry = F.concat(F.lit("\x01"), "author_date", F.lit("\0\n"), "path", F.lit("\0"))
    logs = commits.select("repo_id", F.col("commit_ord").alias("log_ord"), entry.alias("log"))
    return dates.history_dates(history.parse_log(logs))


@query
def token_maps(spark, folder):
    return _counted(spark, folder).select("repo_id", "path", F.to_json(tokens.token_map(MODELS)).alias("counts"))


@query
def own_detector_and_reader(spark, folder):
    """The hooks: logs count as binary, texts of one kind get a title."""
    titled = contents.Reader(
        lambda: F.endswith("path", F.lit(".txt")), lambda: F.concat(F.lit("# "), "path", F.lit("\n"), F.col("content").cast("string"))
    )
    docs = corpora.documents(spark, folder)
    marked = docs.withColumn("is_binary", F.endswith("path", F.lit(".log")))
    texts = contents.with_text(marked, (titled, *contents.READERS))
    return texts.select("repo_id", "path", "is_binary", F.md5("text").alias("digest"))


@query
def own_layout(spark, folder):
    """The hook for formats: one line per turn."""

    def line() -> Column:
        return F.concat(F.col("idx").cast("string"), F.lit(" "), "path", F.lit(" "), F.length("text").cast("string"), F.lit("\n"))

    look = sections.Layout("", lambda drawn: drawn, "", line, numbered=True)
    return sections.sections(contents.with_text(corpora.conversations(spark, folder)), look)


@query
def structure_only(spark, folder):
    """XML documents of the removed files without their contents."""
    select = project.Selection(USER_RULES, keep="removed", read_ignore_files=False)
    rows = project.summarize(corpora.documents(spark, folder), select, "xml", only_structure=True)
    return rows.select("repo_id", _place(), "chunk")


@query
def structure_forms(spark, folder):
    """The structure alone in all three layouts, here of late turns; conversations without any keep their empty root."""
    select = project.Selection(["*", "!turn_000[3-9]_*"], read_ignore_files=False)
    files = corpora.conversations(spark, folder)
    forms = [project.summarize(files, select, form, only_structure=True).select(F.lit(form).alias("form"), "repo_id", _place(), "chunk") for form in ("text", "xml", "markdown")]
    return functools.reduce(DataFrame.unionByName, forms)


@query
def bundle_text(spark, folder):
    """The pieces of the text documents of all conversations, in their order."""
    rows = project.summarize(corpora.conversations(spark, folder), project.Selection(["*_system.md"]))
    return rows.select("repo_id", _place(), "path", "chunk")


@query
def listing_with_stats(spark, folder):
    """The whole listing job: rules, tokens, dates, totals and the drawn tree."""
    select = project.Selection(USER_RULES, models=["chars-4"], include_dates=True, commits=corpora.commits(spark, folder))
    lines = project.show_tree(corpora.dated_documents(spark, folder), select, "modified")
    return lines.select("repo_id", "path", _place(), "line")


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own next to the intermediate tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def written_bundles(spark, folder):
    """The Markdown documents of all conversations, written to files and read back."""
    place = _scratch(spark, "bundles")
    files = corpora.conversations(spark, folder)
    sections.write_bundles(project.summarize(files, project.Selection(read_ignore_files=False), "markdown"), place)
    with folders_listed_together(spark):
        lines = spark.read.schema("value string, repo_id string").text(place)
    return lines.groupBy("repo_id").agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars"))


@query
def bundle_positions(spark, folder):
    """Where each piece of the text documents begins and how long it is, in bytes."""
    rows = project.summarize(corpora.conversations(spark, folder), project.Selection(["*_system.md"]))
    return sections.positions(rows).select("repo_id", _place(), "path", "offset", "bytes")


@query
def bundle_spans(spark, folder):
    """The pieces again, each read from its span of the file that holds it."""
    place = _scratch(spark, "spans")
    rows = project.summarize(corpora.conversations(spark, folder), project.Selection(["*_system.md"]))
    sections.write_bundles(rows, place)
    with folders_listed_together(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(place)
    spans = sections.located(sections.positions(rows), sections.written_parts(files.select("path", F.col("length").alias("size"))))
    # as many spans as pieces of one file
    per_file = spans.groupBy("part", "repo_id").agg(F.collect_list(F.struct(_place(), "path", "offset_in_part", "bytes")).alias("spans"))
    at = [F.element_at(F.split("path", "/"), -1).alias("part"), F.regexp_extract("path", "repo_id=([^/]*)/[^/]*$", 1).alias("repo_id"), "content"]
    read = files.select(*at).join(per_file, ["part", "repo_id"])

    def piece(span: Column) -> Column:
        bytes_ = F.substring(F.col("content"), (span["offset_in_part"] + 1).cast("int"), span["bytes"].cast("int"))
        return F.struct(span["place"].alias("place"), span["path"].alias("path"), F.md5(bytes_).alias("digest"))

    return read.select("repo_id", F.inline(F.transform("spans", piece)))


@query
def scanned_directory(spark, folder):
    """Bundles written as files, found again by walking the directory that a URI names: by paths, sizes and contents."""
    place = _scratch(spark, "scanned")
    place = place if "://" in place else f"file://{place.removeprefix('file:')}"
    files = corpora.conversations(spark, folder)
    sections.write_bundles(project.summarize(files, project.Selection(read_ignore_files=False), "markdown"), place)
    found = read_tree(spark, place, "bundles", level=1, name="*.txt")
    size, read = F.sum("size").alias("bytes"), F.sum(F.octet_length("content")).alias("read")
    return found.groupBy(F.regexp_extract("path", "^repo_id=([^/]+)/", 1).alias("repo_id")).agg(size, read)


@query
def processed_texts(spark, folder):
    """A Python function called with every text."""
    texts = contents.with_text(corpora.documents(spark, folder)).select("repo_id", "path", "size", "has_text", "text")

    def words(path: str, text: str, metadata: dict) -> dict:
        return {"repo_id": metadata["repo_id"], "path": path, "words": len(text.split(" "))}

    return contents.process_contents(texts, words, "repo_id string, path string, words bigint")


def _arriving(spark: SparkSession, folder: str) -> DataFrame:
    schema = corpora.table(spark, folder, "documents").schema
    raw = spark.readStream.schema(schema).parquet(f"{folder}/documents*.parquet")
    return tables.files_table(raw, F.col("source"), corpora._doc_path(), F.col("text"))


def _drain(writer: DataStreamWriter, state: str) -> None:
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


@query
def arriving_texts(spark, folder):
    """Kept files of a stream with their token counts, appended as they arrive."""
    place = _scratch(spark, "arrived")
    stream = ingest.stream_contents(_arriving(spark, folder), verdicts.RuleSet(USER_RULES), MODELS)
    counts = tokens.unpivot_counts(stream, ["repo_id", "path"], MODELS)
    _drain(counts.writeStream.format("parquet").option("path", f"{place}/counts"), f"{place}/state")
    return spark.read.schema(counts.schema).parquet(f"{place}/counts")


@query
def running_totals(spark, folder):
    """Directory totals of files that arrive as a stream, from a table that each batch adds to; here each twice, as after a failure."""
    place = _scratch(spark, "running")
    arriving = _arriving(spark, folder).drop("content")
    schema = "repo_id string, path string, n_files bigint, size bigint"
    table = RunningTotals(spark, f"{place}/totals", schema)

    def add_twice(batch: DataFrame, number: int) -> None:
        table.add(batch, number)
        table.add(batch, number)
        table.compact(number)

    _drain(first_arrivals(arriving).writeStream.foreachBatch(add_twice), f"{place}/state")
    return table.totals()


@query
def late_ignore_files(spark, folder):
    """Ignore files that arrive after the files they remove."""
    place = _scratch(spark, "late")
    files = corpora.documents_with_ignore_files(spark, folder)
    table = RunningVerdicts(spark, f"{place}/verdicts", project.Selection(["*.md", "!doc_2*.md"], keep="all"))
    rules = is_ignore_file(F.col("path"))
    for delivery in (files.where(~rules), files.where(rules)):
        delivery.write.mode("append").parquet(f"{place}/arriving")
        _drain(table.follow(ingest.arrivals(spark, f"{place}/arriving", files.schema)), f"{place}/state")
    return table.verdicts().select("repo_id", "path", "is_ignored", "reason")


@query
def judged_batches(spark, folder):
    """A batch job on every micro-batch of a stream, with a detector of its own: logs are binary."""
    place = _scratch(spark, "batches")

    def job(batch: DataFrame) -> DataFrame:
        judged = verdicts.judge(batch, verdicts.RuleSet(USER_RULES), detector=lambda path, content: F.endswith(path, F.lit(".log")))
        return judged.select("repo_id", "path", "is_ignored", "is_binary", "reason")

    _drain(ingest.each_batch(_arriving(spark, folder), job, f"{place}/judged"), f"{place}/state")
    return spark.read.parquet(f"{place}/judged").drop("batch")


@query
def tree_line_numbers(spark, folder):
    """The line of each file and directory in the drawn tree."""
    return tree.line_numbers(rollup.nodes(corpora.documents(spark, folder)))
