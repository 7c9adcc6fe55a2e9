"""Column expressions over POSIX relative paths. Directories are plain strings, the root is ``''``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory part; ``''`` for a path at the root (a negative length makes ``left`` empty)."""
    return F.left(path, F.length(path) - F.length(base_name(path)) - F.lit(1))


def slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def file_level(path: Column) -> Column:
    """Level of a file: 0 at the root."""
    return slashes(path)


def node_depth(path: Column) -> Column:
    """Depth of a node: 0 for the root itself, 1 for its children."""
    return F.when(path == "", F.lit(0)).otherwise(slashes(path) + F.lit(1))


def prefixes(path: Column) -> Column:
    """``a``, ``a/b``, ... up to ``path`` itself; empty for the root."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), slashes(path) + F.lit(1)),
            lambda i: F.call_function("substring_index", path, F.lit("/"), i),
        )
    )


def directories_of(directory: Column) -> Column:
    """The directory itself and all directories above it, root first."""
    return F.concat(F.array(F.lit("")), prefixes(directory))


def _tail(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _stem(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(_tail(name)) - F.lit(1))


def split_extension(path: Column) -> Column:
    """Extension with its dot as ``os.path.splitext`` gives it: leading dots never start one."""
    name = base_name(path)
    found = F.contains(name, F.lit(".")) & (F.ltrim(_stem(name), F.lit(".")) != "")
    return F.when(found, F.concat(F.lit("."), _tail(name))).otherwise(F.lit(""))


def suffix(path: Column) -> Column:
    """Extension with its dot as ``pathlib`` gives it: differs on ``..foo`` and on a closing dot."""
    name = base_name(path)
    found = F.contains(name, F.lit(".")) & (_stem(name) != "") & (_tail(name) != "")
    return F.when(found, F.concat(F.lit("."), _tail(name))).otherwise(F.lit(""))


def node_extension(path: Column) -> Column:
    """Lower-case extension without dot; a lone leading dot starts one (``.gitignore``)."""
    name = base_name(path)
    dotfile = F.startswith(name, F.lit(".")) & (F.instr(F.substring(name, 2, 1 << 30), ".") == 0)
    return F.lower(
        F.when(dotfile, F.substring(name, 2, 1 << 30)).otherwise(
            F.substring(split_extension(path), 2, 1 << 30)
        )
    )


def fence_language(path: Column) -> Column:
    """Language hint of a Markdown fence: extension without dots, letters kept as they are."""
    return F.ltrim(suffix(path), F.lit("."))
