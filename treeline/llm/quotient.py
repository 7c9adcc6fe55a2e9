"""Exact deduplication with counting quotient filters (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A filter's block holds the remainders of 2^QUOTIENT_BITS quotients at most, a filter of 2^ALL_BITS in all.
QUOTIENT_BITS, ALL_BITS = 12, 22
#: One task merges a block at a time, of about so many different fingerprints at most; there are 2^LEAST_BLOCK_BITS blocks or more.
PRINTS_PER_BLOCK, LEAST_BLOCK_BITS = 1 << 14, 10

FILTER = "block int, run_ends array<int>, remainders array<bigint>, counts array<bigint>"


def block_bits_of(rows: int) -> int:
    """The logarithm of the number of blocks for so many rows."""
    return max(LEAST_BLOCK_BITS, (max(0, rows - 1) // PRINTS_PER_BLOCK).bit_length())


def quotient_bits(block_bits: int) -> int:
    """More blocks have fewer quotients each, so that a filter's run ends do not grow with their number."""
    return max(0, min(QUOTIENT_BITS, ALL_BITS - block_bits))


def encode_block(prints: np.ndarray, counts: np.ndarray, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Run ends per quotient and sorted remainders of one block's sorted, distinct fingerprints (uint64)."""
    q = quotient_bits(block_bits)
    rest = 64 - block_bits - q
    quotients = (prints >> np.uint64(rest)) & np.uint64(2**q - 1)
    run_ends = np.searchsorted(quotients, np.arange(2**q, dtype=np.uint64), side="right")
    return run_ends.astype(np.int32), (prints & np.uint64(2**rest - 1)).astype(np.int64)


def decode_block(block: int, run_ends: np.ndarray, remainders: np.ndarray, block_bits: int) -> np.ndarray:
    """The sorted fingerprints of a block: nothing is lost on the way in."""
    q = quotient_bits(block_bits)
    rest = 64 - block_bits - q
    quotients = np.repeat(np.arange(2**q, dtype=np.uint64), np.diff(run_ends, prepend=0))
    top = np.uint64(int(block) << q) | quotients
    return (top << np.uint64(rest)) | remainders.astype(np.int64).view(np.uint64)


def merge_sorted(prints: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merges sorted runs of fingerprints; counts of equal ones add up."""
    every, each = np.concatenate(prints), np.concatenate(counts)
    order = np.argsort(every, kind="stable")  # merges the sorted runs
    every, each = every[order], each[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(each, first) if len(first) else each


def quotient_filters(prints: DataFrame, column: str, block_bits: int) -> DataFrame:
    """One counting quotient filter per partition, as its blocks. Memory: 16 bytes a row of the partition."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [f[column].to_numpy(np.int64).view(np.uint64) for f in frames]
        if not every:
            return
        distinct, counts = np.unique(np.concatenate(every), return_counts=True)
        blocks = (distinct >> np.uint64(64 - block_bits)).astype(np.int64)
        for lot in np.split(np.arange(len(distinct)), np.flatnonzero(np.diff(blocks)) + 1):
            if len(lot):
                run_ends, remainders = encode_block(distinct[lot], counts[lot], block_bits)
                yield pd.DataFrame({"block": [int(blocks[lot[0]])], "run_ends": [run_ends], "remainders": [remainders], "counts": [counts[lot]]})

    return prints.select(column).mapInPandas(build, FILTER)


def merge_filters(filters: DataFrame, block_bits: int) -> DataFrame:
    """The one filter of all rows, block by block. A fingerprint occurs once per partition at most, however hot."""

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        runs = [decode_block(key[0], np.asarray(e), np.asarray(r), block_bits) for e, r in zip(frame["run_ends"], frame["remainders"], strict=True)]
        prints, counts = merge_sorted(runs, [np.asarray(c) for c in frame["counts"]])
        run_ends, remainders = encode_block(prints, counts, block_bits)
        return pd.DataFrame({"block": [key[0]], "run_ends": [run_ends], "remainders": [remainders], "counts": [counts]})

    return filters.groupBy("block").applyInPandas(merge, FILTER)


def repeated_prints(merged: DataFrame, block_bits: int, name: str = "print") -> DataFrame:
    """Fingerprints with a count above one, and that count."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, ends, rest, counts in frame.itertuples(index=False, name=None):
                prints = decode_block(block, np.asarray(ends), np.asarray(rest), block_bits).view(np.int64)
                many = np.asarray(counts) > 1
                yield pd.DataFrame({name: prints[many], "n": np.asarray(counts)[many]})

    return merged.mapInPandas(read, f"{name} bigint, n bigint")


def exact_duplicates(docs: DataFrame, block_bits: int | None = None, bits: int = 64, whole: bool = False) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row of ``docs(doc_id, text)``.

    Every partition counts the 64-bit fingerprints of its texts in a quotient filter, the filters merge by
    their sorted remainders, and only texts whose fingerprint counts above one go on to byte verification: they
    are grouped by the text itself, combined map-side. A fingerprint shared by different texts is told apart
    there. Of equal texts the largest ``doc_id`` stays.

    Null text counts as empty, null ``doc_id`` sorts first and stays only where its group has no other; rows that
    repeat text and ``doc_id`` are returned as often as they occur, and one of them is ``kept`` per occurrence
    of the largest id. An empty table gives no rows; columns besides ``doc_id`` and ``text`` are not looked at.
    ``block_bits`` follows from the number of rows; ``bits`` shortens the fingerprint, for tests of collisions; ``whole`` adds each row itself as ``document``.
    """
    if block_bits is None:
        block_bits = block_bits_of(docs.count())
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.xxhash64(text) if bits == 64 else F.shiftleft(F.xxhash64(text), 64 - bits)
    rows = docs.select("doc_id", text.alias("_text"), mark.alias("_print"), *([F.struct("*").alias("_document")] if whole else []))
    merged = merge_filters(quotient_filters(rows, "_print", block_bits), block_bits)
    repeated = repeated_prints(merged, block_bits, "_print").select("_print")
    texts = (
        rows.join(repeated, "_print", "left_semi")
        .groupBy("_print", "_text")
        .agg(F.max("doc_id").alias("_keep"), F.count("*").alias("_size"))
        .select("_print", F.sha2("_text", 256).alias("_sha"), "_keep", "_size")
    )
    narrow = rows.select("doc_id", "_print", F.sha2("_text", 256).alias("_sha"), *(["_document"] if whole else []))
    joined = narrow.join(texts.withColumnsRenamed({"_print": "_p", "_sha": "_s"}), (F.col("_print") == F.col("_p")) & (F.col("_sha") == F.col("_s")), "left")
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(keep), F.lit(False)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *([F.col("_document").alias("document")] if whole else []),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text, that of the largest ``doc_id``; of rows that repeat both, any one."""
    kept = exact_duplicates(docs, whole=True).where("kept or keep_id is null")
    groups = kept.where("group_size > 1").dropDuplicates(["text_sha256"])
    return kept.where("group_size = 1").unionByName(groups).select("document.*")
