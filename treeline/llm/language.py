"""Language identification by compression with per-language dictionaries (operator 3)."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sample that is learned from: so many rows per language, and so many characters of each.
SAMPLE_ROWS = 512
SAMPLE_CHARS = 1024
#: A language's rows are ranked in so many parts before the sample is chosen among the parts' first.
PARTS = 64
#: Bytes of a dictionary at most.
DICTIONARY_BYTES = 120_000
#: Texts are compressed in blocks of so many characters, since far into a text a compressor knows it better than any dictionary.
BLOCK_CHARS = 2048
#: Tables large enough for every place in a dictionary, and matches from four bytes on.
SETTINGS = {"window_log": 20, "hash_log": 18, "chain_log": 18, "search_log": 5, "min_match": 4}
LEVEL = 5
#: The best language has to be smaller than the next by this share of the next one's size. Texts of one language are at 0.2 as a rule; below 0.02 are
#: those that are nearly as much in one as in another.
LEAST_MARGIN = 0.02

#: Ties in bytes go by code lengths from the frequencies of runs of so many bytes at most.
ORDER = 5

NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Letters in lower case, everything else as single spaces."""
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def learn(docs: DataFrame, training: Column) -> dict[str, bytes]:
    """One raw-content dictionary per non-null ``lang`` of the rows for which ``training`` holds.

    A bounded sample: the ``SAMPLE_ROWS`` rows of a language that come first by a hash of ``doc_id``, and of each
    ``SAMPLE_CHARS`` characters from a place that the hash chooses. Rows are chosen before texts are read. Their words are
    shuffled, or a passage that occurs in several languages would speak for the one whose sample happens to hold it.
    """
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    first = Window.partitionBy("_lang").orderBy("_h", "_id")
    mark = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    marked = rows.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"), mark.alias("_h")).withColumn("_part", F.pmod("_id", F.lit(PARTS)))
    in_part = Window.partitionBy("_lang", "_part").orderBy("_h", "_id")  # first among a part of a language's rows, then among those
    few = marked.withColumn("_r", F.row_number().over(in_part)).where(F.col("_r") <= SAMPLE_ROWS)
    chosen = few.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= SAMPLE_ROWS)
    start = F.pmod(F.col("_h"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    passage = F.substring(F.col("text"), start.cast("int"), F.lit(SAMPLE_CHARS))
    sample = rows.join(chosen, (F.col("lang") == F.col("_lang")) & (F.col("doc_id") == F.col("_id"))).groupBy("_lang", "_h", "_id").agg(F.min(passage).alias("_p"))
    found: dict[str, list[str]] = {}
    for lang, _, _, text in sorted(map(tuple, sample.collect())):
        found.setdefault(lang, []).extend(plain(text).split())
    for words in found.values():
        random.Random(0).shuffle(words)
    return {lang: f" {' '.join(words)} ".encode()[-DICTIONARY_BYTES:] for lang, words in found.items() if words}


@lru_cache(maxsize=256)
def frequencies(data: bytes) -> list[tuple[Counter, Counter, Counter]]:
    """Of runs of 1 to ``ORDER`` bytes of a dictionary: their counts, and by all but the last byte how often and by how many bytes that goes on."""
    found = []
    for n in range(1, ORDER + 1):
        runs = Counter(data[i : i + n] for i in range(len(data) - n + 1))
        often: Counter[bytes] = Counter()
        for run, count in runs.items():
            often[run[:-1]] += count
        found.append((runs, often, Counter(run[:-1] for run in runs)))
    return found


class Compressor:
    """A language's compressor: whole bytes, and for texts too short for those the bits of an ideal code by the dictionary's frequencies."""

    def __init__(self, data: bytes):
        self.data = data
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **SETTINGS)
        raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=settings)
        self.compress = zstandard.ZstdCompressor(dict_data=raw, compression_params=settings).compress

    def bits(self, text: bytes) -> float:
        """Each byte is coded by what follows the bytes before it in the dictionary, shorter contexts mixed in by Witten and Bell's rule."""
        total, tables = 0.0, frequencies(self.data)
        for i in range(len(text)):
            share = 1 / 256
            for n, (runs, often, kinds) in enumerate(tables):
                if n > i:
                    break
                before = text[i - n : i]
                if before not in often:
                    break
                share = (runs[text[i - n : i + 1]] + kinds[before] * share) / (often[before] + kinds[before])
            total -= math.log2(share)
        return total


def compressors(dictionaries: dict[str, bytes]) -> dict[str, Compressor]:
    return {lang: Compressor(data) for lang, data in sorted(dictionaries.items())}


def judged(text: str | None, by_language: dict[str, Compressor], least_margin: float = LEAST_MARGIN) -> tuple[str, float, bool]:
    """The language whose dictionary makes the whole text smallest, its margin over the next (0 to 1), and whether that is too narrow.

    Where a byte is more than ``least_margin`` of the size, texts that come out equal in bytes go by bits, in size and margin alike.
    """
    letters = plain(text) if text else ""
    if not letters or not by_language:
        return "und", 0.0, True
    blocks = [f" {letters[i : i + BLOCK_CHARS]} ".encode() for i in range(0, len(letters), BLOCK_CHARS)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in by_language.items())
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    if sizes[0][0] == sizes[1][0] and sizes[1][0] * least_margin < 1:
        sizes = sorted((sum(by_language[lang].bits(b) for b in blocks), lang) for size, lang in sizes if size == sizes[0][0])
    score = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], score, score < least_margin


def judge(text: str | None, by_language: dict[str, Compressor]) -> tuple[str, float]:
    """The language whose dictionary makes the whole text smallest, and its margin over the next (0 to 1)."""
    return judged(text, by_language)[:2]


def identified(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = LEAST_MARGIN) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``rejected`` to ``docs(text, ...)``; reads no other column to decide.

    ``lang_pred`` is the language whose dictionary compresses the whole text best, ``und`` for null texts and texts
    without a letter. ``score`` is the share by which the best is smaller than the next, in bytes, or in bits where short texts come out
    equal. ``rejected`` marks ``und`` and margins under ``least_margin``, at every length;
    ties in bits as well go to the language that comes first by name and are rejected. Columns of ``docs`` called as the three new ones are replaced. Only the text
    travels to Python, with the other columns as they are; an empty table gives no rows, no learned language only ``und``.
    """
    new = ("lang_pred", "score", "rejected")
    base = docs.drop(*new)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def decide(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by_language = compressors(dictionaries)
        for texts in frames:
            yield pd.DataFrame([judged(t, by_language, least_margin) for t in texts], columns=[*new])

    told = base.withColumn("_told", decide(F.col("text")))
    return told.withColumns({c: F.col(f"_told.{c}") for c in new}).drop("_told")


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: ``crc32(doc_id as text) mod 5`` is 0; a null ``doc_id`` counts as the empty text, held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
