"""Candidate pairs from inverted lists of ordered prefixes; shared by the two set-similarity joins.

A posting says that set ``id`` of size ``n`` holds ``token`` at place ``pos`` (from 0) of an order that is the same for all sets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.session import cut

#: Jaccard similarity that links two sets, in hundredths: 100 * intersection >= LINK * union.
LINK = 80


def least_overlap(n: Column) -> Column:
    """Tokens that a set of ``n`` shares with any set it links with."""
    return F.floor((n * LINK + 99) / 100)


def pair_overlap(n: Column, m: Column) -> Column:
    """Tokens that sets of ``n`` and ``m`` have to share: intersection / (n + m - intersection) >= LINK / 100."""
    return F.floor(((n + m) * LINK + 99 + LINK) / (100 + LINK))


def contested(postings: DataFrame) -> DataFrame:
    """Postings of tokens that more than one set holds, with the list's smallest and largest ``id``.

    Lists are measured by a map-side combined aggregation and met by an equi-join, never collected.
    """
    lists = postings.groupBy("token").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    return cut(postings.join(lists, "token"))


def star_pairs(postings: DataFrame, leader: str, enough: Callable[[Column], Column]) -> DataFrame:
    """``(a, b)``: each set with the one that ``leader`` names in its lists; as many rows as postings at most.

    A pair needs ``enough`` common lists for what the smallest set that the length filter lets through has to share.
    """
    met = postings.where(f"id <> {leader}").groupBy(F.col("id").alias("a"), F.col(leader).alias("b")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    return met.where(F.col("c") >= enough(least_overlap(least_overlap(F.col("n"))))).select("a", "b")


def may_overlap(n: Column, m: Column, odd: Sequence[tuple[Column, Column]]) -> Column:
    """The parity filter: each element turns one bit over, so sets differ by at least as many elements as their parities by bits.

    Sets of ``n`` and ``m`` that link differ by ``n + m`` less twice what they share at most. No link is turned away.
    """
    apart = reduce(Column.__add__, [F.bit_count(x.bitwiseXOR(y)) for x, y in odd], F.lit(0))
    return apart <= n + m - 2 * pair_overlap(n, m)


def leader_pairs(postings: DataFrame, group: str, weight: str, enough: Callable[[Column], Column]) -> DataFrame:
    """``(a, b)``: each set with the one of most ``weight`` in each of its lists, if that is of another ``group``.

    As many rows as postings at most; counted as in :func:`star_pairs`.
    """
    chosen = postings.groupBy("token").agg(F.max_by(F.struct("id", group), F.struct(weight, "id")).alias("_l"))
    met = postings.join(chosen.select("token", F.col("_l.id").alias("_leader"), F.col(f"_l.{group}").alias("_group")), "token").where(F.col(group) != F.col("_group"))
    counted = met.groupBy(F.col("id").alias("a"), F.col("_leader").alias("b")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    return counted.where(F.col("c") >= enough(least_overlap(least_overlap(F.col("n"))))).select("a", "b")


#: Tokens ahead of a posting's that tell whether two sets have met already.
BEFORE = 4


def beside(postings: DataFrame) -> DataFrame:
    """Adds ``before``: the ``BEFORE`` tokens that a posting's set has ahead of it among these postings."""
    ahead = Window.partitionBy("id").orderBy("pos").rowsBetween(-BEFORE, -1)
    return postings.withColumn("before", F.collect_list("token").over(ahead))


def meetings(postings: DataFrame, apart: Callable[[str, str], Column], odd: Sequence[str] = ()) -> DataFrame:
    """``(a, b, n, m)`` of all pairs that meet in a list of :func:`beside`, are ``apart``, and pass the length, positional and parity filters.

    Sets that share many tokens share them in a row: a pair that has a common token just before has met there, and makes no row here. So
    its rows are few, whatever the number of its common lists, and the first common token always makes one.
    """
    x, y = postings.alias("x"), postings.alias("y")
    n, m, i, j = (F.col(c) for c in ("x.n", "y.n", "x.pos", "y.pos"))
    length = (n * 100 >= m * LINK) & (m * 100 >= n * LINK)
    place = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1) >= pair_overlap(n, m)
    near = may_overlap(n, m, [(F.col(f"x.{c}"), F.col(f"y.{c}")) for c in odd])
    unmet = ~F.arrays_overlap("x.before", "y.before")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & apart("x", "y") & length & place & near & unmet)
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), n.alias("n"), m.alias("m"))


def cross_pairs(postings: DataFrame, apart: Callable[[str, str], Column], enough: Callable[[Column], Column], odd: Sequence[str] = ()) -> DataFrame:
    """``(a, b)`` of the :func:`meetings` that pass the count filter too; common lists are counted once a pair, on the tokens of both.

    At a common token, sets share at most what both hold before it, the token, and what both hold after it. All that they share up to
    the end of the prefix that ends first is among their common lists; what follows is no more than the rest of that set.
    """
    rest = lambda size: least_overlap(size) - enough(least_overlap(size))
    held = postings.groupBy("id").agg(F.collect_list("token").alias("tokens"))  # a set's part of its own short lists
    side = lambda end: held.select(F.col("id").alias(end), F.col("tokens").alias(f"_{end}"))
    pairs = cut(meetings(postings, apart, odd).distinct())
    counted = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("c", F.size(F.array_intersect("_a", "_b")))
    bound = pair_overlap(F.col("n"), F.col("m")) - F.greatest(rest(F.col("n")), rest(F.col("m")))
    return counted.where((F.col("c") >= enough(least_overlap(F.least("n", "m")))) & (F.col("c") >= bound)).select("a", "b")


#: Bits of the filter that spares a join the rows without a partner; a constant of 256 KB, whatever the data.
FILTER_BITS = 1 << 21


def likely(column: str, wanted: DataFrame) -> Column:
    """True for all values of ``column`` that are among those of ``wanted(column)``, and false for most others.

    A bitmap of a fixed size over hashes: it never hides a partner, and where it fills up it merely lets more rows through to the join.
    """
    place = F.xxhash64(column).bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = [0] * (FILTER_BITS // 64)
    for at, word in wanted.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit)).collect():  # a row a word
        words[at] = word
    bits = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return F.getbit(F.get(bits, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1


def of_like_size(pairs: DataFrame, sizes: DataFrame, odd: Sequence[str] = ()) -> DataFrame:
    """The pairs ``(a, b)`` that pass the length and parity filters by ``sizes(id, n, odd...)``."""
    one = sizes.select(F.col("id").alias("a"), *[F.col(c).alias(f"_x_{c}") for c in ("n", *odd)])
    two = sizes.select(F.col("id").alias("b"), *[F.col(c).alias(f"_y_{c}") for c in ("n", *odd)])
    n, m = F.col("_x_n"), F.col("_y_n")
    near = may_overlap(n, m, [(F.col(f"_x_{c}"), F.col(f"_y_{c}")) for c in odd])
    met = pairs.join(one, "a").join(two, "b")
    return met.where((n * 100 >= m * LINK) & (m * 100 >= n * LINK) & near).select("a", "b")
