"""Token counts by batch encoding, with lengths only leaving the encoder (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters after which a text is split at the next safe boundary, and bytes that one call of the encoder gets.
CHUNK_CHARS, BATCH_BYTES = 1 << 14, 1 << 20
SPACE = "▁"


class PieceCounter:
    """Counts tokens of a SentencePiece model as the library does for whole texts.

    The encoder merges neighbours only into pieces of its vocabulary. Between two characters that stand side by side in no piece nothing
    ever merges, so what stands before and what stands after can be encoded apart. The library puts a space before every text: a part that
    begins with a space leaves its own out, any other such part is one token too long and is cut only where that space cannot merge either.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.vocab_size())
        pieces = [self.model.id_to_piece(i) for i in ids if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.pairs = {piece[k : k + 2] for piece in pieces for k in range(len(piece) - 1)}
        probe = "  a ﬁ  b\nＡ c "
        # texts are taken as they are, and unknown characters are bytes: otherwise texts are encoded whole
        self.splits = any(self.model.is_byte(i) for i in ids) and self.model.normalize(probe) == SPACE + probe.replace(" ", SPACE)

    def boundary(self, text: str, at: int) -> tuple[int, int, int]:
        """The first safe boundary from ``at`` on: where the part ends, where the next begins, and by how much that one counts too many."""
        for i in range(at, len(text)):
            left, right = text[i - 1].replace(" ", SPACE), text[i].replace(" ", SPACE)
            if left + right in self.pairs:
                continue
            if text[i] == " " and i + 1 < len(text):
                return i, i + 1, 0
            if SPACE + right not in self.pairs:
                return i, i, 1
        return len(text), len(text), 0

    def parts(self, text: str, chunk: int = CHUNK_CHARS) -> Iterator[tuple[str, int]]:
        """``(part, surplus)``: the text's count is the sum of the parts' counts without the surplus."""
        begin, surplus = 0, 0
        while self.splits and len(text) - begin > chunk:
            end, after, more = self.boundary(text, begin + chunk)
            yield text[begin:end], surplus
            begin, surplus = after, more
        if begin < len(text):
            yield text[begin:], surplus

    def counts(self, texts: list[str | None], chunk: int = CHUNK_CHARS, batch: int = BATCH_BYTES) -> np.ndarray:
        """The count of each text; the encoder gets parts of many texts at once, about as many bytes each time."""
        total = np.zeros(len(texts), np.int64)
        rows, parts, held = [], [], 0

        def encode() -> None:
            np.add.at(total, rows, [len(ids) for ids in self.model.encode(parts, num_threads=1)])

        for row, text in enumerate(texts):
            for part, surplus in self.parts(text or "", chunk):
                total[row] -= surplus
                rows.append(row)
                parts.append(part)
                held += len(part.encode())
                if held >= batch:
                    encode()
                    rows, parts, held = [], [], 0
        if parts:
            encode()
        return total


def counted(docs: DataFrame, tokenizer: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs(doc_id, text)``, without begin, end or added special tokens.

    ``tokenizer`` is the path of a SentencePiece model that every executor can read; strings of special tokens in a text are plain text, as is the
    library's default. Only numbers return from Python. A text that has no safe boundary for long is encoded in one part up to the next.

    A null text is empty and has no bytes and no tokens. Rows with equal or null ``doc_id`` are rows of their own. An empty table gives no
    rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(tokenizer)
        for batch in batches:
            found = pa.array(counter.counts(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), found], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
