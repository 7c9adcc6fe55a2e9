"""Bundle documents: the tree on top, one section per file with text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.paths import fence_language
from treeline.operators import skew

FENCE = "```"


@dataclass(frozen=True)
class Layout:
    """How a bundle looks. ``section`` refers to ``path, text, created, modified`` and, if ``numbered``, to
    ``idx``, the file's number in its document."""

    head: str
    tree_line: Callable[[Column], Column]
    after_tree: str
    section: Callable[[], Column]
    foot: str | None = None
    numbered: bool = False
    #: In place of ``after_tree`` in a document without sections.
    after_lone_tree: str | None = None


def _dates(opening: str, closing: str, created: str, modified: str) -> Column:
    """The optional block of dates, ``''`` without any."""
    one = [
        F.when(F.coalesce(F.col(c), F.lit("")) != "", F.format_string(f, c)).otherwise("")
        for c, f in (("created", created), ("modified", modified))
    ]
    block = F.concat(*one)
    return F.when(block != "", F.concat(F.lit(opening), block, F.lit(closing))).otherwise("")


def _split_cdata(text: Column) -> Column:
    return F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def _escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def text_layout(delimiter: str = FENCE, replacement: str = "'''") -> Layout:
    """Sections between delimiters; delimiters inside a file are replaced."""

    def section() -> Column:
        return F.concat(
            F.lit("## "), "path", F.lit("\n\n"),
            _dates("---\n", "---\n", "created: %s\n", "modified: %s\n"),
            F.lit(f"{delimiter}\n"),
            F.replace("text", F.lit(delimiter), F.lit(replacement)),
            F.lit(f"\n{delimiter}\n\n"),
        )

    return Layout(
        f"Project Structure:\n{delimiter}\n", lambda line: line, f"{delimiter}\n\n", section, after_lone_tree=f"{delimiter}\n"
    )


def xml_layout() -> Layout:
    """``<documents>`` with a ``<structure>`` and one ``<document>`` per file, contents as CDATA."""

    def section() -> Column:
        return F.concat(
            F.format_string('<document index="%d">\n', "idx"),
            F.lit("<source>"), _escape(F.col("path")), F.lit("</source>\n"),
            _dates("<metadata>\n", "</metadata>\n", "<created>%s</created>\n", "<modified>%s</modified>\n"),
            F.lit("<document_content>\n<![CDATA[\n"),
            _split_cdata(F.col("text")),
            F.lit("\n]]>\n</document_content>\n</document>\n"),
        )

    return Layout(
        "<documents>\n<structure>\n<![CDATA[\n", _split_cdata, "]]>\n</structure>\n", section, "</documents>\n", True
    )


def markdown_layout() -> Layout:
    """Fenced sections with a language hint."""

    def section() -> Column:
        return F.concat(
            F.lit("## "), "path", F.lit("\n\n"),
            _dates("---\n", "---\n\n", "created: %s\n", "modified: %s\n"),
            F.lit(FENCE), fence_language(F.col("path")), F.lit("\n"),
            "text",
            F.lit(f"\n{FENCE}\n\n"),
        )

    return Layout(f"# Project Structure\n\n{FENCE}\n", lambda line: line, f"{FENCE}\n\n", section)


def layout(name: str, delimiter: str = FENCE, replacement: str = "'''") -> Layout:
    """A layout by its format name: ``text``, ``xml`` or ``markdown``."""
    if name == "text":
        return text_layout(delimiter, replacement)
    if name == "xml":
        return xml_layout()
    if name == "markdown":
        return markdown_layout()
    raise ValueError(f"unknown format {name!r}")


def number_files(files: DataFrame) -> DataFrame:
    """``idx`` from 1 in path order within each repository; runs on narrow rows."""
    return skew.rank_within(files, ["repo_id"], [F.col("path").asc()], "idx")


def section_columns(look: Layout) -> dict[str, Column]:
    """``section`` and ``section_bytes`` of a file, for :func:`treeline.operators.contents.measure`."""
    return {"section": look.section(), "section_bytes": F.octet_length(look.section()).cast("bigint")}


def sections(contents: DataFrame, look: Layout) -> DataFrame:
    """``repo_id, path, section`` for every file with text, and ``idx`` if the layout has numbers.

    ``contents`` comes from :func:`treeline.operators.contents.with_text`, perhaps with dates. Files get
    their numbers, unless they have some, in path order; that is done on narrow rows, so texts are joined
    once and never ranked.
    """
    written = contents.where("has_text")
    if look.numbered and "idx" not in written.columns:
        written = written.join(number_files(written.select("repo_id", "path")), ["repo_id", "path"])
    for date in ("created", "modified"):
        if date not in written.columns:
            written = written.withColumn(date, F.lit(None).cast("string"))
    number = ["idx"] if look.numbered else []
    return written.select("repo_id", "path", *number, look.section().alias("section"))


def bundle_rows(lines: DataFrame, parts: DataFrame | None, look: Layout, filled: DataFrame | None = None) -> DataFrame:
    """``repo_id, place, path, chunk, bytes``: all pieces of the documents, ordered by ``place`` and ``path``.

    ``lines`` comes from :func:`treeline.operators.tree.tree_lines`, ``parts`` from :func:`sections` (None
    for the structure alone), perhaps with ``section_bytes``. Each piece ends with a newline. Sections share one place and go by path.
    ``filled(repo_id)`` names the repositories with sections where a narrower table than ``parts`` can tell.
    """

    def at(part: int) -> Column:
        return F.array(F.lit(part)).cast("array<bigint>")

    def piece(place: Column, chunk: Column | str) -> Column:
        return F.struct(place.alias("place"), (F.lit(chunk) if isinstance(chunk, str) else chunk).alias("chunk"))

    line = piece(F.concat(at(1), "place"), F.concat(look.tree_line(F.col("line")), F.lit("\n")))
    after_tree = F.lit(look.after_tree)
    if look.after_lone_tree is not None:
        if parts is None:
            after_tree = F.lit(look.after_lone_tree)
        else:
            told = parts if filled is None else filled
            lines = lines.join(told.select("repo_id", F.lit(True).alias("_sections")).distinct(), "repo_id", "left")
            after_tree = F.when(F.col("_sections"), look.after_tree).otherwise(look.after_lone_tree)
    fixed = [piece(at(0), look.head), piece(at(2), after_tree)]
    if look.foot:
        fixed.append(piece(at(4), look.foot))
    # The root's line brings the fixed pieces of its document along.
    pieces = F.when(F.col("path") == "", F.array(line, *fixed)).otherwise(F.array(line))
    rows = lines.select("repo_id", F.lit("").alias("path"), F.inline(pieces)).withColumn("bytes", F.octet_length("chunk").cast("bigint"))
    if parts is not None:
        length = F.col("section_bytes") if "section_bytes" in parts.columns else F.octet_length("section").cast("bigint")
        rows = rows.unionByName(parts.select("repo_id", "path", at(3).alias("place"), F.col("section").alias("chunk"), length.alias("bytes")))
    return rows.select("repo_id", "place", "path", "chunk", "bytes")


def write_bundles(rows: DataFrame, folder: str, partitions: int | None = None) -> None:
    """One text document per repository below ``folder/repo_id=.../``.

    Rows are range partitioned on ``(repo_id, place, path)``, so a document is the concatenation of its part
    files in name order and a huge repository simply has several of them.
    """
    keys = ["repo_id", "place", "path"]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    # The writer adds a newline to each row; the pieces bring their own.
    (
        ranged.sortWithinPartitions(*keys)
        .select("repo_id", F.left("chunk", F.length("chunk") - F.lit(1)).alias("value"))
        .write.mode("overwrite")
        .partitionBy("repo_id")
        .text(folder)
    )


#: Bytes of a document that share a key when pieces meet the files that hold them.
SPAN = 1 << 26


def positions(rows: DataFrame) -> DataFrame:
    """The manifest of the documents: ``repo_id, place, path, offset, bytes`` of every piece of :func:`bundle_rows`.

    Offsets are prefix sums of bytes in document order, on rows without their chunks.
    """
    narrow = rows.select("repo_id", "place", "path", "bytes")
    return skew.sum_before(narrow, ["repo_id"], [F.col("place"), F.col("path")], "bytes", "offset")


def written_parts(rows: DataFrame) -> DataFrame:
    """``repo_id, part, part_offset, part_bytes`` of the files that :func:`write_bundles` wrote, from a listing ``(path, size)`` below its folder.

    The files of a document follow each other by name, so their offsets are prefix sums as well.
    """
    name = F.element_at(F.split("path", "/"), -1)
    repo = F.url_decode(F.replace(F.regexp_extract("path", "repo_id=([^/]*)/[^/]*$", 1), F.lit("+"), F.lit("%2B")))
    repo = F.when(repo != "__HIVE_DEFAULT_PARTITION__", repo)
    listed = rows.where(F.startswith(name, F.lit("part-"))).select(repo.alias("repo_id"), name.alias("part"), F.col("size").alias("part_bytes"))
    return skew.sum_before(listed, ["repo_id"], [F.col("part")], "part_bytes", "part_offset")


def located(manifest: DataFrame, parts: DataFrame) -> DataFrame:
    """The manifest with ``part`` and ``offset_in_part``: which file holds each piece, and where.

    A piece lies in one file. Files and pieces meet by repository and stretch of ``SPAN`` bytes, so a document of any length is no single key.
    """
    stretches = F.sequence(F.floor(F.col("part_offset") / SPAN), F.floor((F.col("part_offset") + F.greatest("part_bytes", F.lit(1)) - 1) / SPAN))
    held = parts.where("part_bytes > 0").select(F.col("repo_id").alias("_repo"), "part", "part_offset", "part_bytes", F.explode(stretches).alias("_stretch"))
    here = manifest.where("bytes > 0")
    same = F.col("repo_id").eqNullSafe(F.col("_repo")) & (F.floor(F.col("offset") / SPAN) == F.col("_stretch"))
    inside = (F.col("offset") >= F.col("part_offset")) & (F.col("offset") < F.col("part_offset") + F.col("part_bytes"))
    met = here.join(held, same & inside)
    return met.select("repo_id", "place", "path", "part", (F.col("offset") - F.col("part_offset")).alias("offset_in_part"), "offset", "bytes")
