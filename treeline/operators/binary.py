"""Binary or text, decided from the name and the bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions import paths

#: A usual length of a sample, 64 KiB.
SAMPLE_BYTES = 65536

# Extensions that mean binary whatever the content is.
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".tiff", ".tif", ".webp", ".svg",
    ".psd", ".ai", ".raw", ".cr2", ".nef", ".orf", ".sr2",
    ".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".mpg", ".mpeg",
    ".mp3", ".wav", ".flac", ".aac", ".ogg", ".wma", ".m4a", ".opus",
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".jar", ".war", ".ear",
    ".exe", ".dll", ".so", ".dylib", ".bin", ".o", ".a", ".lib", ".pyc", ".pyo", ".pyd",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods", ".odp",
    ".ttf", ".otf", ".woff", ".woff2", ".eot",
    ".db", ".sqlite", ".sqlite3", ".mdb",
    ".class", ".dex", ".apk", ".ipa", ".dmg", ".iso", ".img",
    ".pickle", ".pkl", ".npy", ".npz", ".h5", ".hdf5",
    ".parquet", ".avro", ".orc",
    ".wasm", ".bc",
)


def is_binary(path: Column, content: Column, sample_bytes: int | None = None) -> Column:
    """Unreadable (NULL content), a listed extension, or a NUL byte: anywhere, or in the first ``sample_bytes`` if given.

    An empty file is text, and so is anything else: no other property of the bytes changes the answer.
    """
    listed = F.lower(paths.split_extension(path)).isin(*BINARY_EXTENSIONS)
    head = content if sample_bytes is None else F.substring(content, 1, sample_bytes)
    return listed | content.isNull() | F.coalesce(F.contains(head, F.lit(b"\x00")), F.lit(False))
