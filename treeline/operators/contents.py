"""Text of files: notebooks, binary placeholders, plain text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.text import binary_placeholder, decode_text, let, notebook_text
from treeline.operators import binary
from treeline.operators.rules import is_ignore_file

#: A usual limit for ``max_bytes``, 5 MiB; a file of exactly this size still is read. None is set unless the caller names one.
MAX_BYTES = 5 * 1024 * 1024


@dataclass(frozen=True)
class Reader:
    """One way to get text: ``reads`` says for which rows, ``text`` gives it (NULL or ``''`` = not me).

    All parts take no argument and refer to the columns ``path, content, size, is_binary``; ``text`` may
    be a pandas UDF. ``fills`` tells without building the text whether there is one, where that is cheaper.
    """

    reads: Callable[[], Column]
    text: Callable[[], Column]
    fills: Callable[[], Column] | None = None

    def found(self) -> Column:
        return let(self.text(), lambda text: F.nullif(text, F.lit("")))

    def has_text(self) -> Column:
        filled = self.fills() if self.fills else self.found().isNotNull()
        return self.reads() & F.coalesce(filled, F.lit(False))


#: What a notebook shows comes from readable bytes, so one of the other readers has text as well.
NOTEBOOK = Reader(
    lambda: F.endswith("path", F.lit(".ipynb")), lambda: notebook_text(F.col("content")), lambda: F.lit(False)
)
BINARY = Reader(lambda: F.col("is_binary"), lambda: binary_placeholder(F.col("size")), lambda: F.lit(True))
PLAIN = Reader(
    lambda: ~F.col("is_binary"),
    lambda: decode_text(F.col("content")),
    lambda: (F.octet_length("content") > 0) & F.is_valid_utf8(F.col("content").cast("string")),
)

#: The first reader that returns something wins.
READERS = (NOTEBOOK, BINARY, PLAIN)


def text_column(readers: Sequence[Reader] = READERS, max_bytes: int | None = None) -> Column:
    """Text of a file, ``''`` for none. With ``max_bytes``, larger files have none, binaries included."""
    *first, last = readers
    # What the last reader gives is final, empty or not, and needs no second look.
    found = [F.when(r.reads(), r.found()) for r in first] + [F.when(last.reads(), last.text())]
    text = F.coalesce(*found, F.lit(""))
    return text if max_bytes is None else F.when(F.col("size") <= max_bytes, text).otherwise(F.lit(""))


def has_text_column(readers: Sequence[Reader] = READERS, max_bytes: int | None = None) -> Column:
    """Whether :func:`text_column` gives anything. Filters on it may run below the text itself."""
    filled = reduce(Column.__or__, [r.has_text() for r in readers])
    return filled if max_bytes is None else (F.col("size") <= max_bytes) & filled


def with_text(files: DataFrame, readers: Sequence[Reader] = READERS, max_bytes: int | None = None) -> DataFrame:
    """Adds ``has_text`` and ``text``; needs ``path, content, size`` and adds ``is_binary`` if missing."""
    if "is_binary" not in files.columns:
        files = files.withColumn("is_binary", binary.is_binary(F.col("path"), F.col("content")))
    return files.withColumns({"has_text": has_text_column(readers, max_bytes), "text": text_column(readers, max_bytes)})


def measure(
    files: DataFrame,
    models: Sequence = (),
    readers: Sequence[Reader] = READERS,
    max_bytes: int | None = None,
    detector: Callable[[Column, Column], Column] = binary.is_binary,
    more: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Everything the other jobs want to know about content, from one pass over it.

    Narrow rows: all columns but ``content``, plus ``is_binary``, ``ignore_text`` (the text of ignore
    files, NULL elsewhere), ``has_text`` and one count column per token model. Verdicts, rollups and
    reports run on this table, so that content is scanned once and never shuffled. ``more`` adds columns made of ``text``,
    NULL for files without.
    """
    path = F.col("path")
    judged = files if "is_binary" in files.columns else files.withColumn("is_binary", detector(path, F.col("content")))
    read = with_text(judged, readers, max_bytes)
    if models:  # the text is needed anyway
        read = read.withColumn("has_text", F.col("text") != "")
    keep = [c for c in judged.columns if c != "content"]
    return read.select(
        *keep,
        F.when(is_ignore_file(path), decode_text(F.col("content"))).alias("ignore_text"),
        "has_text",
        *[F.when(F.col("has_text"), m.count(F.col("text"))).alias(m.column) for m in models],
        *[F.when(F.col("has_text"), column).alias(name) for name, column in (more or {}).items()],
    )


def process_contents(
    contents: DataFrame, processor: Callable[[str, str, dict], dict], schema: str
) -> DataFrame:
    """Calls ``processor(path, text, metadata)`` for every file with text; it returns one output row.

    ``metadata`` holds the other columns. The hook for work that has no expression in Spark; rows come in
    Arrow batches and nothing is kept between them.
    """
    other = [c for c in contents.columns if c not in ("path", "text", "has_text", "content")]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [processor(row["path"], row["text"], {c: row[c] for c in other}) for row in frame.to_dict("records")]
            yield pd.DataFrame(rows)

    return contents.where("has_text").select("path", "text", *other).mapInPandas(batches, schema)
