"""N-gram Jaccard join by T-occurrence search (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.components import connected_components, with_links
from treeline.llm.prefix_pairs import LINK, beside, contested, cross_pairs, leader_pairs, likely, of_like_size, star_pairs
from treeline.session import cut, release

WORDS = 5
#: Shingles are counted in so many buckets; the counts order shingles from rare to frequent.
BUCKETS = 1 << 18
CHUNK = 1 << 12
#: Bytes of text that a task hashes at a time; numpy holds some 40 bytes for each.
BYTES_AT_ONCE = 1 << 19
#: One common short list more is asked for per so many shingles that have to be shared.
SPARE = 16
#: Rounds that hold each list's members against its most central one, before all pairs between components are taken.
LEADERS = 1

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: A random odd number for each byte, none for a blank; what a place in a word multiplies by; A-Z in lower case and white space as blanks.
BYTES = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BYTES[0x20] = 0
POWER = np.uint64(0x9FB21C651E98DF25)
PLAIN = bytes(0x20 if b in b"\t\n\x0b\x0c\r" else b for b in range(256)).lower()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted, distinct 64-bit shingle hashes of each text.

    Words are what ASCII white space separates, A-Z in lower case; a shingle is five words in a row, or the whole
    sequence of a text with fewer. Null and blank texts have none.
    """
    for shingles in every_shingle(texts):
        yield np.unique(shingles)


def every_shingle(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The shingles of each text, as often as they occur."""
    lot: list[bytes] = []
    held = 0
    for text in texts:
        lot.append((text or "").encode().translate(PLAIN))
        held += len(lot[-1])
        if held >= BYTES_AT_ONCE:
            yield from _shingles(lot)
            lot, held = [], 0
    yield from _shingles(lot)


def _shingles(lot: list[bytes]) -> Iterator[np.ndarray]:
    starts, hashes = word_hashes(b" ".join(lot))
    windows = np.zeros(len(hashes), dtype=np.uint64)
    padded = np.concatenate([hashes, np.zeros(WORDS - 1, np.uint64)])
    for k in range(WORDS):
        windows += padded[k : k + len(hashes)] * FACTORS[k]
    windows = _mixed(windows)
    ends = np.searchsorted(starts, np.cumsum([len(text) + 1 for text in lot]))
    at = 0
    for end in ends.tolist():
        n = end - at
        if n >= WORDS:
            yield windows[at : end - WORDS + 1]
        else:
            yield _mixed((hashes[at:end] * FACTORS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) if n else np.zeros(0, np.uint64)
        at = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` begin, which has no white space but blanks, and their 64-bit hashes.

    A word's hash is a polynomial in a random number per byte; the arrays over bytes are made for one stretch of ``BYTES_AT_ONCE`` at a time.
    """
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = data.find(b" ", at + BYTES_AT_ONCE)
        end = len(data) if end < 0 else end
        part = np.frombuffer(data, np.uint8, end - at, at)
        word = part != 0x20
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        first = np.flatnonzero(begins)
        if len(first):
            place = np.arange(len(part)) - first[np.maximum(np.cumsum(begins) - 1, 0)]
            powers = np.cumprod(np.full(int(place.max()) + 1, POWER))
            sums = np.add.reduceat(BYTES[part] * powers[np.maximum(place, 0)], first)
            starts.append(first + at)
            hashes.append(_mixed(sums))
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How often each bucket's shingles occur in all texts, repeats included: ``BUCKETS`` numbers, whatever the data."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for frame in frames:
            for found in every_shingle(frame[text].tolist()):
                np.add.at(total, (found & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        yield pd.DataFrame({"chunk": range(BUCKETS // CHUNK), "counts": list(total.reshape(-1, CHUNK))})

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [key[0]], "counts": [np.sum(np.stack(frame["counts"].tolist()), axis=0)]})

    schema = "chunk int, counts array<bigint>"
    summed = docs.select(text).mapInPandas(count, schema).groupBy("chunk").applyInPandas(add, schema).collect()
    total = np.zeros((BUCKETS // CHUNK, CHUNK), np.int64)
    for chunk, counts in summed:
        total[chunk] = counts
    return total.ravel()


def spare(overlap):
    """Common short lists asked for when ``overlap`` shingles have to be shared: one, and one more per ``SPARE``."""
    return 1 + overlap // SPARE if not isinstance(overlap, Column) else F.floor(overlap / SPARE) + 1


def short_lists(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A text's rarest shingles: all but the ``T - spare(T)`` most frequent, whose long lists are left for probing.

    Two texts that share ``T`` shingles share ``spare(T)`` of these at least, since all texts order shingles alike.
    """
    least = -(-len(found) * LINK // 100)
    order = np.argsort(counts[(found & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")  # equal counts by hash, as ``found`` is
    return found[order[: len(found) - least + spare(least)]] if len(found) else found


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        one, two = _mixed(found).sum(dtype=np.uint64), _mixed(found * FACTORS[0] + FACTORS[1]).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


#: Columns of a set's parity, 64 bits each: every shingle turns one of all bits over.
ODD = ("odd0", "odd1", "odd2", "odd3")


def parity(found: np.ndarray) -> list[int]:
    turned = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=64 * len(ODD)) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").view("<i8").tolist()


PROFILE = "doc_id string, mark bigint, n int, one bigint, two bigint, odd0 bigint, odd1 bigint, odd2 bigint, odd3 bigint, lists array<bigint>"


def profiles(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """Size, fingerprint and short lists of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def profile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, mark, found in zip(frame["doc_id"], frame["mark"], shingle_sets(frame["text"].tolist()), strict=True):
                rows.append((doc_id, mark, len(found), *fingerprint(found), *parity(found), short_lists(found, shared.value).view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "mark", "n", "one", "two", *ODD, "lists"])

    rows = docs.select(F.col("doc_id").cast("string"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInPandas(profile, PROFILE).withColumn("doc_id", F.col("doc_id").cast("long"))


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, items)``: the sorted shingles of the wanted classes ``(id, doc_id, n, one, two)``, from their texts."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for (key, n, one, two), found in zip(frame[["id", "n", "one", "two"]].itertuples(index=False, name=None), shingle_sets(frame["text"].tolist()), strict=True):
                if len(found) == n and fingerprint(found) == (one, two):  # else another row of the same doc_id
                    rows.append((key, found.tobytes()))
            yield pd.DataFrame(rows, columns=["id", "items"])

    texts = docs.where(likely("doc_id", wanted)).select(F.col("doc_id").alias("_doc"), "text").join(wanted, F.col("_doc").eqNullSafe(F.col("doc_id"))).select("id", "n", "one", "two", "text")
    return texts.mapInPandas(read, "id bigint, items binary").dropDuplicates(["id"])


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets link: the smaller set's shingles are probed in the larger by binary search."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):  # read where they lie, not copied
                small, large = sorted((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)), key=len)
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * common >= LINK * (len(small) + len(large) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_x = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    return with_x.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(probe, "a bigint, b bigint")


def verified(docs: DataFrame, pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pairs that link, on the whole sets of the classes that occur in them."""
    pairs = cut(pairs)
    if pairs.isEmpty():
        return pairs
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    chosen = cut(wanted.join(needed, "id", "left_semi"))
    sets = cut(whole_sets(docs, chosen))
    links = cut(linked(pairs, sets))
    release(sets, chosen, pairs)
    return links


def joined_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows ``(row, doc_id, mark, n, one, two)`` and the classes ``(n, one, two, component, component_id)`` of :func:`near_copies`."""
    profile = cut(profiles(docs, shingle_counts(docs, "text")).withColumn("row", F.monotonically_increasing_id()))
    set_key = ["n", "one", "two"]
    classes = profile.where("n > 0").groupBy(*set_key).agg(F.min("row").alias("id"), F.min("doc_id").alias("least"))
    classes = cut(classes)
    firsts = profile.join(classes.select(F.col("id").alias("row")), "row", "left_semi").withColumnRenamed("row", "id")
    postings = firsts.select("id", "n", F.posexplode("lists").alias("pos", "token"))
    lists = contested(postings)
    wanted = firsts.drop("lists", *ODD)
    # a set with many common rare shingles is near the middle of its group: a changed copy has rare ones of its own instead
    about = firsts.select("id", "n", *ODD).join(lists.groupBy("id").agg(F.count("*").alias("shared")), "id", "left")
    about = cut(about)
    stars = star_pairs(lists, "first", spare).unionByName(star_pairs(lists, "last", spare)).distinct()
    links = verified(docs, of_like_size(stars, about, ODD), wanted)
    components = cut(connected_components(links))
    for turn in range(LEADERS + 1):
        placed = about.drop("n").join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        here = lists.join(placed, "id")
        spans = here.groupBy("token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("token")
        here = here.join(spans, "token", "left_semi").drop("first", "last")
        here = cut(here if turn < LEADERS else beside(here))
        if turn < LEADERS:
            pairs = of_like_size(leader_pairs(here, "component", "shared", spare), about, ODD)
        else:
            pairs = cross_pairs(here, lambda x, y: F.col(f"{x}.component") != F.col(f"{y}.component"), spare, ODD)
        links = verified(docs, pairs, wanted)
        release(here)
        if not links.isEmpty():
            before, components = components, with_links(components, links)
            release(before, links)
    release(lists, about)
    joined = classes.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return profile, joined.join(named, "component").select(*set_key, "component", "component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs(doc_id, text)``.

    Two texts link when the Jaccard similarity of their shingle sets is 0.8 or more; ``component_id`` is the smallest
    ``doc_id`` that links reach. Texts with equal sets are one class from the start. A class searches the others by T-occurrence:
    its shingles are divided into the rarest, whose short inverted lists are merged and counted, and the
    frequent rest, whose long lists would only be probed. Candidates that reach the count are verified on
    their whole sets by binary probing.

    Lists are merged in rounds. The first pairs each class with the first and the last of its lists, the next with the most central one of each, if that is of another component;
    these are linear and connect groups of near copies of any size. The last takes all pairs that are still in different components, within
    lists that span several: a list of one large group of near copies has none left. A pair makes a row where it
    first meets, not one for each common list. No link between components is lost, and none within one is needed.

    Null and blank texts have no shingles and link with nothing. Rows that repeat a ``doc_id`` are rows of their own, linked by their
    texts only; a null ``doc_id`` never names a component that has another. An empty table gives no rows. Other columns are ignored.
    """
    rows = _with_class(*joined_classes(docs))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_class(profile: DataFrame, classes: DataFrame) -> DataFrame:
    told = classes.withColumnsRenamed({"n": "_n", "one": "_one", "two": "_two"})
    match = (F.col("n") == F.col("_n")) & (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two"))
    return profile.join(told, match, "left")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest ``doc_id``. Rows without shingles all stay."""
    rows = _with_class(*joined_classes(docs))
    first = F.min(F.struct("doc_id", "mark", "row"))
    stay = rows.groupBy(F.coalesce("component", -1 - F.col("row"))).agg(first.alias("at")).select(F.col("at.doc_id").alias("_doc"), F.col("at.mark").alias("_mark"))
    return docs.join(stay.distinct(), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_mark")), "left_semi")
