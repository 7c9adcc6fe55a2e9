"""Ignore rules: reading them, and testing paths against them.

A rule is compiled once into a *test* that Spark evaluates natively. With ``P = path + '/'`` and
``S = '/' + path``:

==========  ==============================  ==========================================
kind        holds when                      patterns
==========  ==============================  ==========================================
component   ``'/' + P`` contains the key    ``name`` ``*.ext`` ``name*`` at any level
inside      ``S`` contains the key          ``name/`` ``*.ext/`` (directories only)
anchored    ``P`` starts with the key       ``/a/b`` ``a/b``
under       ``path`` starts with the key    ``a/b/`` ``a/*`` ``a/**``
regex       ``path`` matches the key        everything else
==========  ==============================  ==========================================
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.functions import paths
from treeline.functions.text import decode_text

# The rules that are always on unless switched off, in this order.
DEFAULT_RULES = (
    ".git",
    ".env",
    ".env.local",
    ".env.*.local",
    "node_modules",
    "__pycache__",
    "*.pyc",
    "*.pyo",
    ".pytest_cache",
    ".coverage",
    "*.log",
    ".DS_Store",
    "Thumbs.db",
    ".vscode",
    ".idea",
    "*.swp",
    "*.swo",
    "*~",
)

#: ``meets`` to ``literal`` are a rule's place in an index (:mod:`treeline.operators.rule_index`).
RULE_TYPE = (
    T.StructType().add("pattern", "string").add("include", "boolean").add("kind", "string").add("key", "string")
    .add("meets", "string").add("dir", "string").add("text", "string").add("inside", "boolean").add("below", "string")
    .add("shows", "string").add("literal", "string")
)
RULES_TYPE = T.ArrayType(RULE_TYPE)
MATCH_TYPE = "struct<origin: string, pattern: string, include: boolean>"


class Rule(NamedTuple):
    pattern: str
    include: bool
    kind: str
    key: str


WILD = re.compile(r"[*?\[\\]")


def _component_regex(glob: str) -> str:
    """One path component of a glob as a regular expression."""
    pieces = []
    rest = glob
    while rest:
        char, rest = rest[0], rest[1:]
        if char == "*":
            rest = rest.lstrip("*")
            pieces.append("[^/]*")
        elif char == "?":
            pieces.append("[^/]")
        elif char == "\\":
            if not rest:
                raise ValueError(f"nothing to escape at the end of {glob!r}")
            pieces.append(re.escape(rest[0]))
            rest = rest[1:]
        elif char == "[" and (found := re.match(r"([!^]?)(\]?[^\]]*)\]", rest)):
            negated, members = found.groups()
            # `[` and `&` would start a nested class or an intersection in Java.
            members = re.sub(r"([\[\]&^\\])", r"\\\1", members)
            pieces.append(f"[{'^' if negated else ''}{members}]")
            rest = rest[found.end() :]
        else:
            pieces.append(re.escape(char))
    return "".join(pieces)


def _path_regex(parts: Sequence[str], floating: bool, only_inside: bool) -> str:
    """Whole-path expression: ``**`` spans any number of components, the end also covers what is below."""
    todo = [part for i, part in enumerate(parts) if part != "**" or i == 0 or parts[i - 1] != "**"]
    out = "(?:.+/)?" if floating else ""
    closing = "/.*" if only_inside else "(?:/.*)?"
    for i, part in enumerate(todo):
        first, last = i == 0, i == len(todo) - 1
        if part != "**":
            out += "[^/]+" if part == "*" else _component_regex(part)
            if not last and todo[i + 1] != "**":
                out += "/"
        elif first and last:
            out += "[^/]+"
        elif first:
            out += "(?:.+/)?"
        elif last:
            closing = "/.*"
        else:
            out += "(?:/.+)?/"
    return f"(?d)^{out}{closing}$"


def rule_parts(line: str) -> tuple[bool, list[str], bool, bool] | None:
    """``include, parts, only_inside, floating`` of a rule line, None for a line without a rule; ValueError if it cannot be read."""
    text = line.lstrip() if line.endswith("\\ ") else line.strip()
    if not text or text.startswith("#") or text == "/":
        return None
    include = not text.startswith("!")
    parts = (text if include else text[1:]).split("/")
    only_inside = len(parts) > 1 and parts[-1] == ""
    if only_inside:
        parts = parts[:-1]
    floating = len(parts) == 1
    if parts[0] == "" and len(parts) > 1:
        parts = parts[1:]
    if parts == [""]:
        raise ValueError(f"not a rule: {line!r}")
    return include, parts, only_inside, floating


def compile_rule(line: str) -> Rule | None:
    """The test for one rule line, None for a line without a rule; ValueError if it cannot be read."""
    read = rule_parts(line)
    if read is None:
        return None
    include, parts, only_inside, floating = read

    def rule(kind: str, key: str) -> Rule:
        return Rule(line, include, kind, key)

    plain = [not WILD.search(part) for part in parts]
    if floating:
        glob = parts[0]
        kind = "inside" if only_inside else "component"
        if plain[0]:
            return rule(kind, f"/{glob}/")
        if glob.startswith("*") and not WILD.search(glob[1:]) and not (only_inside and glob == "*"):
            return rule(kind, f"{glob[1:]}/")
        if glob.endswith("*") and not only_inside and not WILD.search(glob[:-1]):
            return rule(kind, f"/{glob[:-1]}")
    elif all(plain):
        return rule("under" if only_inside else "anchored", "/".join(parts) + "/")
    elif all(plain[:-1]) and not only_inside and parts[-1] in ("*", "**"):
        return rule("under", "".join(part + "/" for part in parts[:-1]))
    return rule("regex", _path_regex(parts, floating and parts[0] != "**", only_inside))


def compile_rules(lines: Iterable[str]) -> list[Rule]:
    return [rule for line in lines if (rule := compile_rule(line)) is not None]


def _tests(path: Column, rules: Sequence[Rule]) -> list[Column]:
    """Tests of rules known when the plan is built; constant keys stay inside generated code."""
    slash = F.lit("/")
    within, before, after = F.concat(slash, path, slash), F.concat(slash, path), F.concat(path, slash)
    kinds = {
        "component": lambda key: F.contains(within, F.lit(key)),
        "inside": lambda key: F.contains(before, F.lit(key)),
        "anchored": lambda key: F.startswith(after, F.lit(key)),
        "under": lambda key: F.startswith(path, F.lit(key)),
        "regex": path.rlike,
    }
    return [kinds[rule.kind](rule.key) for rule in rules]


def holds_row(path: Column, rule: Column) -> Column:
    """The same test for a rule that is data."""
    kind, key, slash = rule["kind"], rule["key"], F.lit("/")
    return (
        F.when(kind == "component", F.contains(F.concat(slash, path, slash), key))
        .when(kind == "inside", F.contains(F.concat(slash, path), key))
        .when(kind == "anchored", F.startswith(F.concat(path, slash), key))
        .when(kind == "under", F.startswith(path, key))
        .otherwise(F.rlike(path, key))
    )


def matches_of_list(path: Column, rules: Sequence[Rule], origin: str) -> Column:
    """Matching rules of a list known on the driver, in its order, as ``ARRAY<match>``."""
    if not rules:
        return F.array().cast(f"array<{MATCH_TYPE}>")
    constant = json.dumps([{"origin": origin, "pattern": rule.pattern, "include": rule.include} for rule in rules])
    listed = F.from_json(F.lit(constant), f"array<{MATCH_TYPE}>")
    places = F.array(*[F.when(test, F.lit(i)) for i, test in enumerate(_tests(path, rules), 1)])
    return F.transform(F.array_compact(places), lambda i: F.element_at(listed, i))


# --- rules found in the corpus ---------------------------------------------------------------------


def _simple(glob: str) -> tuple[str, str] | None:
    """How a name meets a glob, if a key can tell."""
    if glob and not WILD.search(glob):
        return "name", glob
    if len(glob) > 1 and glob.startswith("*") and not WILD.search(glob[1:]):
        return "tail", glob[1:]
    if len(glob) > 1 and glob.endswith("*") and not WILD.search(glob[:-1]):
        return "head", glob[:-1]
    return None


def index_entry(line: str) -> dict:
    """``meets, dir, text, inside, below`` of a rule line.

    ``inside`` asks for a directory, ``below`` for a node anywhere under that path. ``rest`` rules name in ``dir`` the directory all
    their files lie under.
    """
    _, parts, only_inside, floating = rule_parts(line)

    def entry(meets: str, folder: str = "", text: str = "", inside: bool = only_inside, below: str = "") -> dict:
        return {"meets": meets, "dir": folder, "text": text, "inside": inside, "below": below}

    plain = [bool(part) and not WILD.search(part) for part in parts]
    last = parts[-1]
    if floating or (len(parts) > 1 and parts[-2] == "**" and all(plain[:-2])):
        under = "/".join(parts[:-2])
        if last in ("*", "**") and not only_inside:
            return entry("path", text=under, inside=True)
        if found := _simple(last):
            return entry(found[0], text=found[1], below=under)
    elif all(plain):
        return entry("path", text="/".join(parts))
    elif all(plain[:-1]):
        folder = "/".join(parts[:-1])
        if last in ("*", "**") and not only_inside:
            return entry("path", text=folder, inside=True)
        if (found := _simple(last)) and found[0] != "name":
            return entry(f"{found[0]} in", folder, found[1])
    return entry("rest", "/".join(parts[: _fixed(parts)]))


def _fixed(parts: Sequence[str]) -> int:
    """How many parts, the last one apart, name a directory before the first wildcard."""
    return next((i for i, part in enumerate(parts[:-1]) if not part or WILD.search(part)), len(parts) - 1)


def rule_end(line: str) -> dict:
    """``shows, literal``: how the name starts or ends, or what it is, of some node below ``dir`` on the path of each file a ``rest`` rule holds for.

    It is the longest literal of the last part that names a node; what follows a closing ``**`` lies below that node.
    """
    parts = rule_parts(line)[1]
    named = [part for part in parts[_fixed(parts) :] if part != "**"]
    last = named[-1] if named else ""
    if last and not WILD.search(last):
        return {"shows": "name", "literal": last}
    head, tail = WILD.split(last)[0], re.split(r"[*?\[\]\\]", last)[-1]
    return {"shows": "tail", "literal": tail} if len(tail) > len(head) else {"shows": "head", "literal": head}


NO_END = {"shows": None, "literal": None}


def _line_rule(base: str, raw: str) -> dict | None:
    """The rule of one line of an ignore file, prefixed with the directory the file lies in."""
    line = raw.strip()
    if not line or line.startswith("#"):
        return None
    mark, body = ("!", line[1:]) if line.startswith("!") else ("", line)
    try:
        rule = compile_rule(f"{mark}{base}/{body}" if base else mark + body)
    except ValueError as error:
        raise ValueError(f"rule {line!r} in the ignore file of {base or '.'!r}: {error}") from error
    if rule is None:
        return None
    place = index_entry(rule.pattern)
    return rule._asdict() | place | (rule_end(rule.pattern) if place["meets"] == "rest" else NO_END)


def _file_rules(base: str, text: str | None) -> list[dict]:
    return [rule for raw in (text or "").split("\n") if (rule := _line_rule(base, raw)) is not None]


@F.pandas_udf(RULES_TYPE)
def _parse_ignore_files(base: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([_file_rules(b, t) for b, t in zip(base, text)])


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``lines``, of which ``base`` and ``line`` are read, with the fields of the rule in place of ``line``; only lines that hold one."""
    kept = [field for field in lines.schema.fields if field.name != "line"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_line_rule(base, raw) for base, raw in zip(frame["base"], frame["line"])]
            held = [rule is not None for rule in found]
            fields = pd.DataFrame([tuple(rule.values()) for rule in found if rule is not None], columns=RULE_TYPE.names)
            yield pd.concat([frame.loc[held].drop(columns="line").reset_index(drop=True), fields], axis=1)

    return lines.mapInPandas(read, T.StructType([*kept, *RULE_TYPE.fields]))


#: Texts of ignore files go about in pieces of about this many bytes, so that a file of millions of rules is never one cell, or one array of lines.
PIECE_BYTES = 1 << 12
#: Two steps lead to the pieces: a row may be copied for each part that is taken out of it.
STRETCH_BYTES = 1 << 19
#: How far the end of a line is looked for before the rest of the text is searched.
_LOOK_BYTES = 1 << 10


def _line_begin(text: Column, place: Column) -> Column:
    """How many bytes of the binary ``text`` stand before the first line that begins ``place`` bytes in or later; all, without such a line."""

    def to_line_end(stretch: Column) -> Column:
        return F.octet_length(F.substring_index(stretch.cast("string"), "\n", 1))

    near = F.substring(text, place, F.lit(_LOOK_BYTES))
    end = F.when(to_line_end(near) < F.octet_length(near), to_line_end(near)).otherwise(to_line_end(F.substring(text, place, F.octet_length(text))))
    return F.when(place <= 0, F.lit(0)).when(place >= F.octet_length(text), F.octet_length(text)).otherwise(F.least(place + end, F.octet_length(text)))


def _taken_apart(rows: DataFrame, size: int, most: int, whole: bool = False) -> DataFrame:
    """``rows``, a row for each stretch of about ``size`` bytes of the binary ``_text``, which begins ``_at`` bytes in and ends with a line.

    A text of more than ``most`` bytes stays as it is. ``whole`` keeps every row as well, without text and place; without a text a row is
    kept either way.
    """
    text, length, k = F.col("_text"), F.octet_length("_text"), F.col("_k")
    # a text of no bytes is one stretch
    stretches = F.when(length > most, F.lit(1)).otherwise(F.greatest(F.ceil(length / F.lit(size)), F.lit(1)))
    last = F.coalesce(stretches, F.lit(0 if whole else 1)).cast("int") - F.lit(1)
    numbered = rows.withColumn("_last", last).withColumn("_k", F.explode(F.sequence(F.lit(-1 if whole else 0), F.col("_last"))))
    end = F.when(k == F.col("_last"), length).otherwise(_line_begin(text, (k + F.lit(1)) * F.lit(size)))
    placed = numbered.withColumns({"_begin": _line_begin(text, k * F.lit(size)), "_end": end})
    cut_out = F.when(k >= 0, F.substring(text, F.col("_begin") + F.lit(1), F.col("_end") - F.col("_begin")))  # empty where a line is longer
    return placed.withColumns({"_text": cut_out, "_at": F.when(k >= 0, F.col("_at") + F.col("_begin"))}).drop("_k", "_last", "_begin", "_end")


def text_in_pieces(files: DataFrame, text: str, at: str, whole: bool = False) -> DataFrame:
    """``files``, a row for each piece of the column ``text``; ``at`` tells how many bytes stand before the piece, whose lines are all whole.

    With ``whole`` every file also has a row of its own, without ``text`` and ``at``, so that one pass writes down both.
    """
    rows = files.withColumns({"_text": F.col(text).cast("binary"), "_at": F.lit(0)}).drop(text)
    # a stretch of more than two holds a line longer than one, which would be looked through for each piece
    pieces = _taken_apart(_taken_apart(rows, STRETCH_BYTES, 1 << 31, whole), PIECE_BYTES, 2 * STRETCH_BYTES)
    return pieces.withColumns({text: F.col("_text").cast("string"), at: F.col("_at")}).drop("_text", "_at")


#: Lines whose last part is a name, or one with a single ``*`` in front or behind. None of them is unreadable, and at its ends stands nothing that
#: has to be stripped but blanks and tabs.
LINE_END = r"^[ \t]*(?=[!-~])!?+(?:[^\\\[?]*/)?(\*?[^\\\[?*/]+|[^\\\[?*/]+\*)/?(?<=[!-~])[ \t]*\z"


def line_end(line: Column) -> Column:
    """The last part of a line, ``name``, ``*tail`` or ``head*``, as :func:`rule_end` would tell it, but without reading the rule; ``''`` if this does not tell.

    Of a rule of any kind: a node on the path of each file it holds for has such a name. The directory of the ignore file must be without a backslash.
    """
    return F.regexp_extract(line, LINE_END, 1)


def is_ignore_file(path: Column) -> Column:
    """Written as comparisons a Parquet scan can be given."""
    return (path == ".gitignore") | F.endswith(path, F.lit("/.gitignore"))


def ignore_file_rules(files: DataFrame) -> DataFrame:
    """One row per ignore file of the corpus: ``repo_id, base, text, rules``; ``base`` is its directory.

    ``rules`` is for displays; an index reads the lines of ``text``, which are dealt over the cluster.
    ``files`` holds ``content``, or ``ignore_text`` when it comes from :func:`treeline.operators.contents.measure`. With ``ignore_at`` next to
    it (:func:`text_in_pieces`) there is one row per piece, and its place as ``at``.
    """
    path = F.col("path")
    text = F.col("ignore_text") if "ignore_text" in files.columns else decode_text(F.col("content"))
    at = [F.col("ignore_at").alias("at")] if "ignore_at" in files.columns else []
    found = files.where(is_ignore_file(path)).select("repo_id", paths.parent(path).alias("base"), text.alias("text"), *at)
    return found.select("*", _parse_ignore_files("base", "text").alias("rules"))
