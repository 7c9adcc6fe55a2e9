"""Files of a directory tree: on a file system that all executors mount, or on one that is named by a URI.

Spark's own ``binaryFile`` source skips hidden files, names with a leading underscore and empty files, so
the tree is listed here: level by level, every directory a row, so that the work spreads over the cluster
however the tree is shaped. Contents are read in a second step, after the paths have been dealt out evenly.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatchcase

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators.binary import SAMPLE_BYTES
from treeline.session import cut

#: Names per batch that a listing task hands on.
BATCH = 10_000
#: Content bytes per batch that a reading task holds.
BATCH_BYTES = 64 * 1024 * 1024


class Mounted:
    """A folder that every executor mounts."""

    def __init__(self, root: str):
        self.root = root

    def entries(self, directory: str) -> Iterator[tuple[str, bool]]:
        """Paths in a directory and whether they are directories; links to directories are not followed."""

        def is_directory(entry: os.DirEntry) -> bool:
            try:
                return entry.is_dir()
            except OSError:
                return False

        with os.scandir(os.path.join(self.root, directory) if directory else self.root) as found:
            for entry in found:
                path = f"{directory}/{entry.name}" if directory else entry.name
                if not is_directory(entry):
                    yield path, False
                elif not entry.is_symlink():
                    yield path, True

    def stat(self, path: str) -> tuple[int, datetime | None, datetime | None]:
        """Size, time of change and of creation."""

        def moment(seconds: float | None) -> datetime | None:
            return None if seconds is None else datetime.fromtimestamp(seconds, timezone.utc)

        found = os.stat(os.path.join(self.root, path))
        return found.st_size, moment(found.st_mtime), moment(getattr(found, "st_birthtime", None))

    def read(self, path: str, most: int | None = None) -> bytes:
        with open(os.path.join(self.root, path), "rb") as file:
            return file.read(-1 if most is None else most)


class Remote:
    """A folder of a file system that a URI names (``file:``, ``hdfs:``, ``s3:``, ``gs:``); nothing is mounted."""

    def __init__(self, root: str):
        self.files, place = fs.FileSystem.from_uri(root)
        self.place = place.rstrip("/")

    def _full(self, path: str) -> str:
        return f"{self.place}/{path}" if path else self.place or "/"

    def entries(self, directory: str) -> Iterator[tuple[str, bool]]:
        for found in self.files.get_file_info(fs.FileSelector(self._full(directory))):
            path = f"{directory}/{found.base_name}" if directory else found.base_name
            if found.type != fs.FileType.Directory:
                yield path, False
            elif not (isinstance(self.files, fs.LocalFileSystem) and os.path.islink(found.path)):
                yield path, True

    def stat(self, path: str) -> tuple[int, datetime | None, datetime | None]:
        found = self.files.get_file_info(self._full(path))
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        return found.size or 0, found.mtime, None

    def read(self, path: str, most: int | None = None) -> bytes:
        with self.files.open_input_stream(self._full(path)) as file:
            return file.read(most) if most is not None else file.read()


def opened(root: str) -> Mounted | Remote:
    """The file system interface for a root; made in the task that uses it."""
    return Remote(root) if "://" in root else Mounted(root)


def _list_level(root: str, name: str | None):
    """Entries of the given directories: ``path, is_dir``; of the files only those whose name fits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = opened(root)
        batch: list[tuple[str, bool]] = []
        for frame in frames:
            for directory in frame["path"]:
                try:
                    for path, is_dir in tree.entries(directory):
                        if is_dir or name is None or fnmatchcase(path.rsplit("/", 1)[-1], name):
                            batch.append((path, is_dir))
                        if len(batch) == BATCH:
                            yield pd.DataFrame(batch, columns=["path", "is_dir"])
                            batch = []
                except OSError as error:
                    raise OSError(f"directory {directory or root!r} cannot be listed on this executor: {error}") from error
        yield pd.DataFrame(batch, columns=["path", "is_dir"])

    return run


def _reader(root: str, content: str, max_bytes: int | None):
    def read(tree: Mounted | Remote, path: str) -> dict:
        row = {"path": path, "size": 0, "mtime": None, "birthtime": None, "content": None, "head": None}
        try:
            row["size"], row["mtime"], row["birthtime"] = tree.stat(path)
        except OSError:
            return row
        whole = content == "full" and (max_bytes is None or row["size"] <= max_bytes)
        if whole or content == "head":
            try:
                row["content" if whole else "head"] = tree.read(path, None if whole else SAMPLE_BYTES)
            except OSError:
                pass
        return row

    columns = list(_columns(content))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = opened(root)
        rows: list[dict] = []
        held = 0
        for frame in frames:
            for path in frame["path"]:
                rows.append(read(tree, path))
                held += len(rows[-1]["content"] or rows[-1]["head"] or b"")
                if len(rows) == BATCH or held > BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)

    return run


_COLUMNS = {"path": "string", "size": "bigint", "mtime": "timestamp", "birthtime": "timestamp", "content": "binary"}


def _columns(content: str) -> dict[str, str]:
    return _COLUMNS | ({"head": "binary"} if content == "head" else {})


def list_tree(spark: SparkSession, root: str, level: int | None = None, name: str | None = None) -> DataFrame:
    """``path`` of every file below ``root``, relative, hidden and ignored ones included.

    One job per level. Each level is checkpointed, so a lost executor does not list the tree again. ``level`` is the deepest level of
    files that is wanted (0: in the root): no directory below is listed. ``name`` is a pattern with ``*``, ``?`` and ``[...]`` that
    file names must fit, tried where they are listed.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders = spark.createDataFrame([("",)], "path string")
    files, at = None, 0
    while True:
        found = cut(folders.repartition(tasks, "path").mapInPandas(_list_level(root, name), "path string, is_dir boolean"))
        here = found.where(~F.col("is_dir")).select("path")
        files = here if files is None else files.union(here)
        folders = found.where("is_dir").select("path")
        if at == level or folders.isEmpty():
            return files
        at += 1


def read_tree(
    spark: SparkSession, root: str, repo_id: str, content: str = "full", max_bytes: int | None = None, tasks: int | None = None,
    level: int | None = None, name: str | None = None,
) -> DataFrame:
    """The corpus table of one directory tree: ``repo_id, path, size, mtime, birthtime, content``.

    ``root`` is a folder that all executors mount, or a URI of a file system that they reach without a mount (without birth
    times and links to nothing). ``content`` is ``none`` (sizes and times), ``head`` (the first 64 KiB, in a column ``head`` of its own) or ``full``: the whole
    content, or NULL for unreadable files and those above ``max_bytes``, never a part. A root or directory that an executor cannot list fails the run.
    ``level`` and ``name`` narrow the listing as in :func:`list_tree`.
    """
    if content not in ("none", "head", "full"):
        raise ValueError(f"content must be none, head or full, not {content!r}")
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{name} {kind}" for name, kind in _columns(content).items())
    dealt = list_tree(spark, root, level, name).repartition(tasks, F.xxhash64("path"))
    return dealt.mapInPandas(_reader(root, content, max_bytes), schema).select(F.lit(repo_id).alias("repo_id"), "*")
