"""Fill-in-middle documents cut through a compressed set of code point boundaries (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Byte offsets that share their upper bits are one container.
CONTAINER_BITS = 16
WORD = 64


@dataclass(frozen=True)
class Container:
    """The offsets of one stretch of ``2^CONTAINER_BITS`` bytes, counted from its begin, in the smallest of three forms.

    ``array``: sorted offsets. ``run``: where runs begin and, in ``sums``, how many offsets lie before each. ``bitmap``: 64-bit
    words and, in ``sums``, how many bits are set before each.
    """

    kind: str
    data: np.ndarray
    sums: np.ndarray | None = None

    @classmethod
    def of(cls, member: np.ndarray) -> Container:
        """``member`` holds one truth value a byte."""
        edges = np.flatnonzero(np.diff(member, prepend=False, append=False))
        begins, lengths = edges[::2], edges[1::2] - edges[::2]
        size = {"array": 2 * int(lengths.sum()), "run": 4 * len(begins), "bitmap": -(-len(member) // 8)}
        kind = min(size, key=size.get)
        if kind == "array":
            return cls(kind, np.flatnonzero(member).astype(np.uint16))
        if kind == "run":
            return cls(kind, begins.astype(np.uint16), np.cumsum(lengths) - lengths)
        packed = np.packbits(member, bitorder="little")
        words = np.frombuffer(packed.tobytes().ljust(-(-len(packed) // 8) * 8, b"\0"), dtype="<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(kind, words, np.cumsum(counts) - counts)

    def select(self, k: int) -> int:
        """The ``k``-th offset, from 0."""
        if self.kind == "array":
            return int(self.data[k])
        at = int(np.searchsorted(self.sums, k, side="right")) - 1
        left = k - int(self.sums[at])
        if self.kind == "run":
            return int(self.data[at]) + left
        bits = np.unpackbits(np.frombuffer(self.data[at : at + 1].tobytes(), np.uint8), bitorder="little")
        return at * WORD + int(np.flatnonzero(bits)[left])


class BoundarySet:
    """The byte offsets of a UTF-8 text at which a code point begins: containers and the cardinality before each."""

    def __init__(self, text: bytes):
        begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        step = 1 << CONTAINER_BITS
        self.end = len(text)
        self.containers = [Container.of(begins[at : at + step]) for at in range(0, len(text), step)]
        counts = np.array([np.count_nonzero(begins[at : at + step]) for at in range(0, len(text), step)], dtype=np.int64)
        self.n = int(counts.sum())
        self.before = np.cumsum(counts) - counts

    def select(self, k: int) -> int:
        """The offset of the ``k``-th code point, from 0; the end of the text for ``k = n``."""
        if k >= self.n:
            return self.end
        at = int(np.searchsorted(self.before, k, side="right")) - 1  # of containers without a begin, the last before k
        return (at << CONTAINER_BITS) + self.containers[at].select(k - int(self.before[at]))


def cut_text(text: bytes, one: int, two: int) -> tuple[int, int, int, bytes, bytes, bytes]:
    """``(n, prefix_chars, middle_chars, prefix, middle, suffix)`` for two numbers that are taken modulo ``n + 1``."""
    marks = BoundarySet(text)
    low, high = sorted((one % (marks.n + 1), two % (marks.n + 1)))
    x, y = marks.select(low), marks.select(high)
    return marks.n, low, high - low, text[:x], text[x:y], text[y:]


def draws(seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first groups of eight hexadecimal digits of a digest of seed and ``doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every row of ``docs(doc_id, text)``.

    ``n`` counts code points. Two draws cut a text in prefix, middle and suffix; ``plain`` per cent of the documents stay as they are, and of
    the others ``spm`` per cent put the suffix first. Both cuts are found in the text's boundary set; a task holds one
    text and a bit a byte at a time.

    A null text is empty. Empty texts and those that hold one of the three marks stay plain, with null for both lengths. Equal draws give
    an empty middle. A null ``doc_id`` draws by the seed alone, rows that repeat a ``doc_id`` draw alike. An empty table gives no rows. Other
    columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    one, two, three, four = draws(seed)
    stays = (text == "") | marked | (three % 100 >= 100 - plain)
    form = F.when(stays, "plain").when(four % 100 < spm, "spm").otherwise("psm")
    rows = docs.select("doc_id", form.alias("form"), one.alias("_one"), two.alias("_two"), text.alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, one, two = (batch.column(c).to_pylist() for c in ("form", "_one", "_two"))
            texts = batch.column("text").cast(pa.binary())
            n, prefix_chars, middle_chars, output = [], [], [], []
            for i, kind in enumerate(form):
                count, low, middle, p, m, s = cut_text(texts[i].as_py(), one[i], two[i])
                n.append(count)
                prefix_chars.append(None if kind == "plain" else low)
                middle_chars.append(None if kind == "plain" else middle)
                output.append({"plain": (p, m, s), "psm": (b"<P>", p, b"<S>", s, b"<M>", m), "spm": (b"<S>", s, b"<P>", p, b"<M>", m)}[kind])
            joined = pa.array([b"".join(parts) for parts in output], pa.binary()).cast(pa.string())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("form"), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), joined]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(transform, f"doc_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(form: Column, output: Column) -> Column:
    """The text again, from nothing but ``form`` and ``output``: no part holds a mark, and none can arise where a part meets one."""
    parts = F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    first, second, third = (F.get(parts, F.lit(k)) for k in range(3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)
