"""Ranked lexical search by dense blocked matrix multiplication (operator 13)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.session import cut, release

#: Rows, terms and items of a tile: 16 MB of impacts, 1 MB of item terms, 512 KB of scores.
DOCS_PER_TILE, TERMS_PER_TILE, ITEMS_PER_TILE = 1024, 2048, 64
#: Terms of items that one pass over the documents holds; more items take more passes. One item's terms are never divided.
TERMS_PER_PASS = 1 << 17
#: Bytes of a text whose words are held at a time.
TEXT_AT_ONCE = 1 << 20
#: Sums of whole numbers below this are exact in float64.
EXACT = 1 << 53
#: An impact stays below its weight times this.
TOP = 1_000_000
#: Parts of an item's candidates, ranked apart before all of them are.
PARTS = 64

#: Of ASCII, letters and digits are kept, letters in lower case; bytes of longer characters are kept as they are.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
WORD = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(text: str | None, number: dict[bytes, int], at_once: int = TEXT_AT_ONCE) -> tuple[int, Counter]:
    """How many terms a text has in all, and how often it holds each numbered one."""
    words = (text or "").encode().translate(WORD_BYTES)
    found: Counter = Counter()
    n = begin = 0
    while begin < len(words):
        end = words.find(b" ", begin + at_once)
        end = len(words) if end < 0 else end
        part = words[begin:end].split()
        n += len(part)
        found.update(map(number.get, part))
        begin = end
    found.pop(None, None)
    return n, found


def postings(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``(doc_id, n, terms, tf)`` of every document: all its terms counted, and those of ``terms`` by number with their occurrences."""
    number = docs.sparkSession.sparkContext.broadcast({term.encode(): i for i, term in enumerate(terms)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, held, times = [], [], []
            for text in batch.column("text"):
                count, found = term_counts(text.as_py(), number.value)
                n.append(count)
                held.append(list(found.keys()))
                times.append(list(found.values()))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(read, "doc_id bigint, n bigint, terms array<int>, tf array<bigint>")


def weight(docs_in_all: int, docs_with_term: int) -> int:
    return math.floor(1000 * math.log((2 * docs_in_all + 2) / (2 * docs_with_term + 1)))


@dataclass
class Tile:
    """How often each of some items (columns, from ``first``) holds each of some terms (rows)."""

    first: int
    terms: np.ndarray
    times: np.ndarray


def tiles(queries: Sequence[dict[int, int]], weights: np.ndarray, terms_per_tile: int = TERMS_PER_TILE, items_per_tile: int = ITEMS_PER_TILE, exact: int = EXACT) -> Iterator[Tile]:
    """Tiles of ``queries``, an item's terms and how often it repeats them, over compact vocabularies.

    A tile ends where it is full, or where an item's sum could reach ``exact``, so that no sum of products, in whatever order, is rounded.
    A term that an item repeats too often for that comes in several tiles, with a part of its repeats in each.
    """
    for first in range(0, len(queries), items_per_tile):
        block = queries[first : first + items_per_tile]
        here: dict[int, list[tuple[int, int]]] = {}
        for j, query in enumerate(block):
            for term, times in query.items():
                here.setdefault(term, []).append((j, times))
        terms, columns, bound = [], [], np.zeros(len(block), dtype=object)

        def tile() -> Tile:
            return Tile(first, np.array(terms, np.int64), np.array(columns, np.float64).reshape(len(terms), len(block)))

        for term in sorted(here):
            most = int(weights[term]) * TOP
            if not most:
                continue  # it adds nothing
            left = np.zeros(len(block), dtype=object)
            for j, times in here[term]:
                left[j] = times
            while left.any():
                now = np.minimum(left, (exact - 1) // most)
                if len(terms) == terms_per_tile or (bound + now * most >= exact).any():
                    yield tile()
                    terms, columns, bound = [], [], np.zeros(len(block), dtype=object)
                terms.append(term)
                columns.append(now.astype(np.float64))
                bound, left = bound + now * most, left - now
        if terms:
            yield tile()


class Best:
    """The ``k`` highest scores of each item so far, equal ones by ascending document, null first; what a task keeps."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.named = np.zeros(0, bool)

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray, named: np.ndarray) -> None:
        """``scores`` of ``docs`` (rows; ``named`` where not null) for the items from ``first`` on (columns).

        All scores that equal the k-th are looked at, so that ties are settled by their documents.
        """
        here = slice(first, first + scores.shape[1])
        least = self.least[here]
        if len(scores) > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=0)[-self.k])
        row, column = np.nonzero(scores >= least)
        item, score = np.concatenate([self.item, column + first]), np.concatenate([self.score, scores[row, column]])
        doc, named = np.concatenate([self.doc, docs[row]]), np.concatenate([self.named, named[row]])
        order = np.lexsort((doc, named, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        stay = order[place < self.k]
        self.item, self.score, self.doc, self.named = item[stay], score[stay], doc[stay], named[stay]
        last = place[place < self.k] == self.k - 1
        self.least[self.item[last]] = self.score[last]


def scored(found: DataFrame, queries: Sequence[dict[int, int]], weights: np.ndarray, docs_in_all: int, terms_in_all: int, k: int, docs_per_tile: int = DOCS_PER_TILE) -> DataFrame:
    """``(item, doc_id, score)``: the best ``k`` documents of each item, by its place in ``queries``, in each partition of :func:`postings`.

    Impacts of a block of documents on a vocabulary tile are one dense matrix, the items' repeats another; their product holds
    partial scores, added up as 64-bit integers over the vocabulary tiles.
    """
    shared = found.sparkSession.sparkContext.broadcast(([list(g) for _, g in groupby(tiles(queries, weights), key=lambda t: t.first)], weights))
    vocabulary, items = len(weights), len(queries)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, weights = shared.value
        best = Best(items, k)
        column_of = np.full(vocabulary, -1, np.int64)
        for batch in batches:
            docs, named = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            m = 75 + 25 * batch.column("n").to_numpy() * docs_in_all // terms_in_all
            ends = batch.column("terms").offsets.to_numpy()
            ends = ends - ends[0]
            terms, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "tf"))
            row = np.repeat(np.arange(len(docs)), np.diff(ends))
            impact = weights[terms] * (1000 * TOP * tf // (1000 * tf + 12 * m[row]))
            for begin in range(0, len(docs), docs_per_tile):
                end = min(begin + docs_per_tile, len(docs))
                span = slice(ends[begin], ends[end])
                for block in blocks:
                    sums = np.zeros((end - begin, block[0].times.shape[1]), np.int64)
                    for tile in block:
                        column_of[tile.terms] = np.arange(len(tile.terms))
                        column = column_of[terms[span]]
                        column_of[tile.terms] = -1
                        inside = column >= 0
                        impacts = np.zeros((end - begin, len(tile.terms)))
                        impacts[row[span][inside] - begin, column[inside]] = impact[span][inside]
                        sums += (impacts @ tile.times).astype(np.int64)
                    best.add(block[0].first, sums, docs[begin:end], named[begin:end])
        doc = pa.array(best.doc, mask=~best.named)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), doc, pa.array(best.score)], ["item", "doc_id", "score"])

    return found.mapInArrow(score, "item bigint, doc_id bigint, score bigint")


def item_terms(items: DataFrame) -> DataFrame:
    """``(item, term, times)`` of ``items(item, text)``."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), 1)
    return items.select("item", F.explode(words).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))


def best_documents(docs: DataFrame, items: DataFrame, k: int = 20, terms_per_pass: int = TERMS_PER_PASS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` highest-scoring documents above 0 of each row of ``items(item_id, text)``.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case. One pass reads the texts and keeps the
    occurrences of the items' terms, from which their document counts and weights follow; a second one multiplies tiles. Each task keeps its ``k``
    best of each item, and these are ranked in parts, then together. The items come in passes of about ``terms_per_pass`` terms each (a hundred bytes a term),
    which is what is collected and broadcast at a time; a single item with more is a pass of its own size.

    Null or blank texts have no terms: such documents count nowhere, such items have no rows. Rows that repeat a ``doc_id`` are documents of
    their own, with ranks of their own; a null ``doc_id`` comes before others of the same score. Rows that repeat an ``item_id``, or have none, are
    items of their own. Empty tables give no rows. Other columns are ignored.
    """
    asked = cut(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()))
    triples = cut(item_terms(asked))
    passes = max(1, -(-triples.count() // terms_per_pass))
    found = None
    for number in range(passes):
        rows = triples.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).collect()  # terms_per_pass, but for chance
        names, words = sorted({r.item for r in rows}), sorted({r.term for r in rows})
        item_at, word_at = {name: i for i, name in enumerate(names)}, {word: i for i, word in enumerate(words)}
        queries: list[dict[int, int]] = [{} for _ in names]
        for r in rows:
            queries[item_at[r.item]][word_at[r.term]] = r.times
        held = cut(postings(docs, words))
        docs_in_all, terms_in_all = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        held_by = dict(held.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row a term of this pass
        weights = np.array([weight(docs_in_all, held_by.get(i, 0)) for i in range(len(words))], np.int64)
        part = scored(held.where(F.size("terms") > 0), queries, weights, docs_in_all, max(1, terms_in_all), k)
        spark = docs.sparkSession
        part = part.join(spark.createDataFrame(list(enumerate(names)), "at bigint, name bigint"), F.col("item") == F.col("at")).select(F.col("name").alias("item"), "doc_id", "score")
        part = cut(part)
        release(held)
        found = part if found is None else found.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    apart = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    first = found.withColumn("rank", F.row_number().over(apart)).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
