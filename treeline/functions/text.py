"""Column expressions that turn file bytes into text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_text(content: Column) -> Column:
    """Strict UTF-8 with ``\\r\\n`` and ``\\r`` read as ``\\n``; NULL if the bytes are not UTF-8."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def binary_placeholder(size: Column) -> Column:
    return F.concat(F.lit("binary content ("), size.cast("string"), F.lit(" bytes)"))


_NOTEBOOK = """
    nbformat INT,
    cells ARRAY<STRUCT<cell_type: STRING, source: VARIANT>>,
    worksheets ARRAY<STRUCT<cells: ARRAY<
        STRUCT<cell_type: STRING, input: VARIANT, source: VARIANT, level: INT>>>>
"""


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _joined(value: Column) -> Column:
    """A cell's source: a string, or a list of strings to be joined; NULL when the key is missing."""
    listed = F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))
    lines = F.try_variant_get(value, "$", "array<string>")
    one = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))
    return F.when(value.isNotNull(), F.when(listed, F.array_join(lines, "")).otherwise(one))


def _section(kind: str, source: Column) -> Column:
    return F.when(source == "", F.lit("")).otherwise(F.concat(F.lit(f"# {kind} cell\n"), source, F.lit("\n\n")))


def _current_cell(c: Column) -> Column:
    source = _joined(c["source"])
    return (
        F.when(c["cell_type"] == "code", _section("Code", source))
        .when(c["cell_type"] == "markdown", _section("Markdown", source))
        .otherwise(F.lit(""))
    )


def _older_cell(c: Column) -> Column:
    """Format 2 and 3: code sits in ``input``, headings and HTML become Markdown."""
    kind, source = c["cell_type"], _joined(c["source"])
    heading = F.concat(
        F.repeat(F.lit("#"), F.coalesce(c["level"], F.lit(1))),
        F.lit(" "),
        F.replace(F.regexp_replace(F.coalesce(source, F.lit("")), "\n$", ""), F.lit("\n"), F.lit(" ")),
    )
    return (
        F.when(kind == "code", _section("Code", F.coalesce(_joined(c["input"]), F.lit(""))))
        .when(kind == "heading", _section("Markdown", heading))
        .when(kind.isin("markdown", "html"), _section("Markdown", source))
        .otherwise(F.lit(""))
    )


def notebook_text(content: Column) -> Column:
    """Code and Markdown cells of a notebook; NULL or ``''`` when it cannot be read as one.

    A code or Markdown cell without a source makes the whole notebook unreadable, so ``concat`` over the
    cells may well be NULL.
    """

    def cells(book: Column) -> Column:
        sheets = F.flatten(F.transform(book["worksheets"], lambda w: w["cells"]))
        return F.when(book["nbformat"] >= 4, F.transform(book["cells"], _current_cell)).when(
            book["nbformat"].isin(2, 3), F.transform(sheets, _older_cell)
        )

    def joined(texts: Column) -> Column:
        return F.when(~F.exists(texts, lambda c: c.isNull()), F.array_join(texts, ""))

    return let(let(F.from_json(decode_text(content), _NOTEBOOK), cells), joined)
