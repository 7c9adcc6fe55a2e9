"""Mixing sources to target weights by a low-discrepancy schedule (operator 10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.session import cut

#: Words of a block; slots of the schedule hand out whole blocks.
BLOCK_WORDS = 4096
#: A source's shuffled rows are numbered in so many parts, none of which has to hold a whole source.
PARTS = 1024
#: Slots of the schedule ranked by one task at a time.
SLOTS_PER_CHUNK = 1 << 16

GOLDEN = 0.6180339887498949
#: White space between words, besides the space.
SPACES = "\t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return F.when(spaced == "", F.lit(0)).otherwise(F.size(F.split(spaced, " +"))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, ceiling: float) -> DataFrame:
    """``(source, source_size, target)`` from one row per source ``(source, source_size)``.

    Sources by code point, null last, take the weights in turn. They share ``budget`` times all sizes by
    weight; a target stops at ``ceiling`` times its source's size, and the excess goes to the others by
    weight until none is above. That is one water level: sources in the order of ceiling per weight are
    full up to the first that the rest of the budget no longer fills. Works on the list of sources, one row each.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    listed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    listed = listed.withColumn("_cap", F.col("source_size") * ceiling).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    listed = (
        listed.withColumn("_total", F.sum("source_size").over(every) * budget)
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_weights"))
        .withColumn("_full", F.col("_ratio") <= F.col("_level"))
    )
    level = F.min(F.when(~F.col("_full"), F.struct("_ratio", "_level"))).over(every)["_level"]
    return listed.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(level * F.col("_w")).alias("target"))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(slot, source, rank)``: which source each slot of the mix takes its next block from.

    Slot ``t`` is the golden-ratio point ``frac((t + 0.5) * g)`` mapped through the cumulative targets, so every
    stretch of the mix holds each source in proportion. ``rank`` numbers a source's slots from 0. A source needs
    a slot per block of each round through it that its target begins; the sequence is a little longer than all needs, what a source does not need is
    left out, and the few slots that the sequence owes a source follow at its end. Slots are ranked in chunks, so
    no task holds a source's whole schedule.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rounds = F.floor(F.col("target") / F.col("source_size"))
    rest = F.ceil((F.col("target") - rounds * F.col("source_size")) / block_words)
    need = (rounds * F.ceil(F.col("source_size") / block_words) + rest).cast("long")
    listed = targets.where("target > 0").select("source", need.alias("_need"), "target")
    upto = listed.select("source", "_need", F.sum("target").over(by_name).alias("_to"), F.sum("target").over(Window.partitionBy()).alias("_all"))
    shares = upto.select("source", "_need", (F.col("_to") / F.col("_all")).alias("_to"))
    shares = shares.withColumn("_from", F.coalesce(F.lag("_to").over(Window.orderBy("_to", F.col("source").isNull(), F.col("source").cast("binary"))), F.lit(0.0)))
    spark = targets.sparkSession
    slots = shares.agg(F.sum("_need")).first()[0] or 0
    slots += slots // 64
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * GOLDEN % 1.0).alias("_point"))
    drawn = points.join(_cells(shares), F.floor(F.col("_point") * CELLS) == F.col("_cell")).where("_point >= _from and _point < _to")
    chunk = F.floor(F.col("slot") / SLOTS_PER_CHUNK)
    drawn = drawn.select("slot", "source", "_need", chunk.alias("_chunk"))
    key = [F.col("source").isNull(), F.coalesce("source", F.lit(""))]
    counted = drawn.groupBy("source", "_chunk").agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select(F.col("source").alias("_s"), F.col("_chunk").alias("_c"), F.coalesce(start, F.lit(0)).alias("_start"))
    ranked = drawn.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "_chunk").orderBy("slot")) - 1)
    ranked = ranked.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    ranked = ranked.select("slot", "source", (F.col("_start") + F.col("_r")).alias("rank"), "_need").where("rank < _need")
    had = counted.groupBy("source").agg(F.sum("_n").alias("_n")).withColumnRenamed("source", "_s")
    owed = shares.join(had, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_n", F.coalesce("_n", F.lit(0))).where("_n < _need")
    owed = owed.select("source", F.explode(F.sequence("_n", F.col("_need") - 1)).alias("rank"))
    return ranked.select("slot", "source", "rank").unionByName(owed.select((F.lit(slots) + F.col("rank")).alias("slot"), "source", "rank"))


#: The unit interval is cut into cells, and each lists the sources that reach into it.
CELLS = 1024


def _cells(shares: DataFrame) -> DataFrame:
    """Sources by cell: at most one row per source and one per cell, so as small as the list of sources."""
    last = F.least(F.floor(F.col("_to") * CELLS), F.lit(CELLS - 1))
    return shares.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") * CELLS), last)))


def shuffled_blocks(sized: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds ``_start``: the words of its source in front of a row, in the source's shuffled order.

    The order is that of an MD5 of ``key``. Rows are summed by the hash's leading bits first, so a source with
    a third of all rows is numbered by many tasks.
    """
    mark = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]))
    parts = sized.withColumn("_order", mark).withColumn("_part", F.conv(F.substring("_order", 1, 4), 16, 10).cast("int") % PARTS)
    parts = cut(parts)
    name = [F.col("source").isNull(), F.coalesce("source", F.lit(""))]
    sums = parts.groupBy("source", "_part").agg(F.sum("size").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*name).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*name, "_part").orderBy("_order", *key).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    parts = parts.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    return parts.withColumn("_start", F.col("_ahead") + F.col("_in")).drop("_s", "_p", "_ahead", "_in", "_part", "_order")


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, ceiling: float = 2.0, block_words: int = BLOCK_WORDS, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs(doc_id, text, source)``: ``(rows, pieces)``.

    ``rows`` has ``doc_id, size, source_size, target, taken`` (and ``keep``) for every row of ``docs``. ``pieces`` has one
    row per part of a document in the mix: ``_row`` (as in ``rows``), ``slot``, ``round`` through the source, ``from_word`` and ``n_words``; the mix
    is the pieces in the order of their slots, and in a block by ``block_word``.

    A source's shuffled rows form a stream of words that is cut into blocks of ``block_words``. The schedule's slot of
    rank ``r`` takes block ``r`` modulo their number, so a second round starts when the first is through, and the last slot stops at
    the target: each source gives its target, rounded down to a word, and with ``ceiling`` 2 no word comes more than twice.

    Null text has no words; a null source is one of its own; rows of equal ``doc_id`` are rows of their own, ordered by
    size; rows without words are taken 0 times. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep)
    placed = shuffled_blocks(sized.withColumn("_row", F.monotonically_increasing_id()), ["doc_id", "size", *keep])
    placed = cut(placed)
    sources = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sources, weights, budget, ceiling))
    plan = schedule(targets, block_words)
    named = targets.withColumnRenamed("source", "_s")
    plan = plan.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    blocks = F.ceil(F.col("source_size") / block_words)
    epoch, block = F.floor(F.col("rank") / blocks), F.col("rank") % blocks
    left = F.floor("target") - epoch * F.col("source_size")
    plan = plan.select(F.col("source").alias("_s"), "slot", epoch.alias("round"), block.alias("_block"), F.least(left, (block + 1) * block_words, "source_size").alias("_until")).where(F.col("_until") > F.col("_block") * block_words)
    spans = placed.where("size > 0").select("_row", "source", "size", "_start")
    last = F.floor((F.col("_start") + F.col("size") - 1) / block_words)
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_start") / block_words), last)))
    met = spans.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_block")))
    begin = F.greatest("_start", F.col("_b") * block_words)
    words = F.least(F.col("_start") + F.col("size"), "_until") - begin
    pieces = met.select("_row", "slot", "round", (begin - F.col("_start")).alias("from_word"), words.cast("long").alias("n_words"), (begin - F.col("_b") * block_words).alias("block_word")).where("n_words > 0")
    pieces = cut(pieces)
    taken = pieces.groupBy("_row").agg(F.sum("n_words").alias("taken"))
    rows = placed.join(named, F.col("source").eqNullSafe(F.col("_s"))).join(taken, "_row", "left")
    rows = rows.select("_row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *keep)
    return rows, pieces


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row per document and round through its source, with the words taken.

    A text taken whole is unchanged; one at a source's target is cut there, its words separated by single spaces. Documents
    that the mix does not take, those without words among them, are left out. ``n_chars``, if there is one, follows the text. Rows that repeat ``doc_id`` and
    text count in the sizes, and each returns as one of them.
    """
    rows, pieces = mixed(docs.withColumn("_mark", F.xxhash64("text")), keep=("_mark",), **options)
    spans = pieces.groupBy("_row", "round").agg(F.min("from_word").alias("_from"), F.sum("n_words").alias("_words"))
    spans = spans.join(rows.select("_row", F.col("doc_id").alias("_doc"), F.col("_mark").alias("_m"), F.col("size").alias("_size")), "_row")
    texts = docs.withColumn("_mark", F.xxhash64("text")).dropDuplicates(["doc_id", "_mark"])
    joined = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_mark") == F.col("_m")))
    joined = joined.withColumn("_split", F.when(F.col("_words") < F.col("_size"), F.split(F.trim(F.translate("text", SPACES, " " * len(SPACES))), " +")))
    part = F.array_join(F.slice("_split", (F.col("_from") + 1).cast("int"), F.col("_words").cast("int")), " ")
    joined = joined.withColumn("text", F.when(F.col("_split").isNull(), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)
