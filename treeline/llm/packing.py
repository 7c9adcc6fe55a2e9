"""Best-fit packing with certified lower bounds (operator 2)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.session import cut, release

CAPACITY = 2048
#: Pieces that one task packs; a full partition takes about 100 bytes a piece.
PIECES_PER_PARTITION = 100_000

PIECES = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint"


def encoder(path: str):
    """The tokenizer file's vocabulary and merges; special tokens in a text are taken as such, as the file's own library does.

    Ids are those of that library on the same file (the tests compare them); this encoder takes a fifth of the time.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


def cut_lengths(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: all full but the first, which takes the odd rest."""
    start, length = 0, n % capacity or min(n, capacity)
    while start < n:
        yield start, length
        start, length = start + length, capacity


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: the ids of a text and a closing 0, cut to ``capacity``; null text is empty."""

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer)
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = np.array([*coder.encode(text or "", allowed_special="all"), 0], dtype="<u4")
                for k, (start, length) in enumerate(cut_lengths(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    # ids travel as text: a column of numbers with a null would come as floating point
    cut_up = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(tokens, PIECES)
    return cut_up.withColumn("doc_id", F.col("doc_id").cast("long"))


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that these items need at least, by dual feasible functions.

    For a threshold ``e`` up to half a bin, items above ``capacity - e`` count as whole bins, items under ``e`` as nothing, the rest as
    they are; for a ``k``, an item counts its ``(k + 1)``-fold share rounded down in units of ``1 / k`` (as it is when
    that is whole). Each is a function under which no bin's contents exceed one, so each sum is a bound.
    """
    if not len(lengths):
        return 0
    best = -(-int((lengths * counts).sum()) // capacity)
    for e in range(1, capacity // 2 + 1):
        large, middle = lengths > capacity - e, (lengths >= e) & (lengths <= capacity - e)
        best = max(best, int(counts[large].sum()) - (-int((lengths * counts)[middle].sum()) // capacity))
    for k in range(1, 41):
        scaled = (k + 1) * lengths
        # in units of 1 / (k * capacity)
        share = np.where(scaled % capacity == 0, lengths * k, scaled // capacity * capacity)
        best = max(best, -(-int((share * counts).sum()) // (k * capacity)))
    return best


def best_fit(lengths: Sequence[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill."""
    lengths = np.asarray(lengths, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with room r
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = some >> n
        if fitting:
            r = n + ((fitting & -fitting).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            b, r = len(fill), capacity
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += n
        room[r - n].append(b)
        some |= 1 << (r - n)
    return bin_of, offset, np.asarray(fill, dtype=np.int64)


PACKED = "_part int, _row bigint, length bigint, _bin bigint, offset bigint, _room bigint, _gap boolean"


def pack_once(dealt: DataFrame, capacity: int) -> DataFrame:
    """Packs each ``_part`` of ``(_part, _row, length)``; ``_gap`` says that the bound does not certify its number of bins."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        bin_of, offset, fill = best_fit(frame["length"].to_numpy(), capacity)
        bound = lower_bound(*np.unique(frame["length"].to_numpy(), return_counts=True), capacity)
        return frame.assign(_bin=bin_of, offset=offset, _room=capacity - fill[bin_of], _gap=len(fill) > bound)[["_part", "_row", "length", "_bin", "offset", "_room", "_gap"]]

    return dealt.groupBy("_part").applyInPandas(one, PACKED)


def packed(cut_pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION, most_rounds: int | None = None) -> tuple[DataFrame, dict]:
    """``cut_pieces(length, ...)`` with ``sequence_id`` and ``offset``; and the certificate ``{sequences, lower_bound, rounds}``.

    Partitions of at most about ``per_partition`` pieces are packed by best-fit decreasing. One whose number of bins meets the lower bound is
    final. The others keep their full bins and exchange the contents of the rest: these are dealt out anew,
    to half as many partitions or fewer, and packed again, until all are certified, the total meets the bound of all lengths,
    a single partition is left, or a round saves nothing (then its predecessor stands); ``most_rounds`` ends it earlier, if given. The bound of all comes from counts per length.

    Rows may repeat; an empty table gives no rows and needs no sequence. Other columns are carried along and may not be
    called ``sequence_id`` or ``offset`` (these are replaced).
    """
    rows = cut(cut_pieces.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()))
    counted = rows.groupBy("length").count().toPandas()  # at most one row per length up to the capacity
    bound, n = lower_bound(counted["length"].to_numpy(np.int64), counted["count"].to_numpy(np.int64), capacity), int(counted["count"].sum())
    deal = lambda df, parts, salt: df.select(F.pmod(F.xxhash64("_row", F.lit(salt)), F.lit(parts)).cast("int").alias("_part"), "_row", "length")
    parts = max(1, -(-n // per_partition))
    placed = cut(pack_once(deal(rows, parts, 0), capacity).withColumn("_round", F.lit(0)))
    rounds = 1
    while parts > 1 and (most_rounds is None or rounds < most_rounds):
        bins = _bins(placed)
        open_rows = placed.where("_gap and _room > 0")
        pool = open_rows.count()
        if bins == bound or not pool:
            break
        parts = max(1, min(-(-pool // per_partition), parts // 2))
        again = pack_once(deal(open_rows, parts, rounds), capacity).withColumn("_round", F.lit(rounds))
        after = cut(placed.where("not _gap or _room = 0").unionByName(again))
        if _bins(after) >= bins:
            release(after)
            break
        release(placed)
        placed, rounds = after, rounds + 1
    total = _bins(placed)
    sequence = F.col("_round").cast("long") * (1 << 56) + F.col("_part").cast("long") * (1 << 32) + F.col("_bin")
    joined = rows.join(placed.select("_row", sequence.alias("sequence_id"), "offset"), "_row").drop("_row")
    return joined, {"sequences": total, "lower_bound": bound, "rounds": rounds}


def _bins(placed: DataFrame) -> int:
    return placed.where("offset = 0").count()
