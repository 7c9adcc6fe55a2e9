"""Line deduplication by an exact set-similarity join (operator 9). DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.prefix_pairs import LINK, least_overlap, likely, pair_overlap
from treeline.session import cut, release

#: Tokens are counted in so many buckets; the counts order tokens from rare to frequent.
BUCKETS = 1 << 16
#: A token's place in the order is its bucket's count in front of so many bits of its hash.
HASH_BITS = 42
MOST = (1 << 20) - 1
#: What separates words, each as a space.
SPACES = "\t\n\x0b\x0c\r"
#: Sets above this size have a parity of 128 bits, others of 64.
LONG = 64
#: Tokens at each end of a set, in the order of their hashes, that near copies often have in common.
ENDS = 3


def words_of(line: str) -> Column:
    """The words of a line in lower case, and empty ones between separators in a row."""
    spaced = reduce(Column.__or__, [F.contains(F.col(line), F.lit(c)) for c in SPACES if c != "\n"])
    return F.split(F.lower(F.when(spaced, F.translate(line, SPACES, " " * len(SPACES))).otherwise(F.col(line))), " ")


def with_tokens(lines: DataFrame) -> DataFrame:
    """Adds ``tokens``: the hashes of a line's distinct words in lower case, sorted."""
    hashes = F.transform(words_of("line"), lambda w: F.xxhash64(w))
    return lines.withColumn("tokens", F.sort_array(F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))))


def lines_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, mark, tokens)`` of every line; ``mark`` tells lines of rows that share a ``doc_id`` apart."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return with_tokens(lines).select("doc_id", "line_no", F.xxhash64("line").alias("mark"), "tokens")


def bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit(BUCKETS - 1))


def rarity(lines: DataFrame) -> Column:
    """The count of each bucket in all lines, shifted by ``HASH_BITS``, as one constant array of ``BUCKETS`` numbers, whatever the data."""
    counted = lines.select(F.explode("tokens").alias("t")).groupBy(bucket(F.col("t")).alias("id")).agg(F.count("*").alias("n"))
    counts = [0] * BUCKETS
    for at, n in counted.collect():  # one row a bucket
        counts[at] = min(n, MOST) << HASH_BITS
    return F.split(F.lit(",".join(map(str, counts))), ",").cast("array<bigint>")


def prefix_length(n: Column) -> Column:
    """Of two sets that link, the first common token is among the first so many of each."""
    return (n - least_overlap(n) + 1).cast("int")


def parity(tokens: str, kind: str) -> Column:
    """64 bits that each token turns over: ``all`` tokens, or those of one ``half``, which tell 128 bits from 64."""
    one = lambda t: F.lit(1).cast("bigint") if kind == "all" else F.shiftright(t, 6).bitwiseAND(F.lit(1).cast("bigint"))
    bit = lambda t: F.call_function("shiftleft", one(t), t.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda held, t: held.bitwiseXOR(bit(t)))


def may_link(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """The length and parity filters on two sets: they differ by at least as many tokens as their parities by bits. None turns a link away."""
    n, m = x["n"], y["n"]
    every, half = x["odd0"].bitwiseXOR(y["odd0"]), x["odd1"].bitwiseXOR(y["odd1"])
    apart = F.when(F.least(n, m) > LONG, F.bit_count(every.bitwiseXOR(half)) + F.bit_count(half)).otherwise(F.bit_count(every))
    return (n * 100 >= m * LINK) & (m * 100 >= n * LINK) & (apart <= n + m - 2 * pair_overlap(n, m))


def first_pairs(classes: DataFrame) -> DataFrame:
    """``(a, b)``: each class with the first, and with the one before it, of those that have the same tokens at an end of their sets.

    At most four rows a class, whatever the size of a group; these need not be all pairs that link.
    """
    facts = ("n", "odd0", "odd1")
    ends = classes.where("n > 3").select("id", *facts, F.explode(F.array("low", "high")).alias("end"))
    along = Window.partitionBy("end").orderBy("id")
    here = {c: F.col(c) for c in facts}
    met = ends
    for name, found in (("first", lambda c: F.first(c).over(along)), ("last", lambda c: F.lag(c).over(along))):
        met = met.withColumns({f"_{name}_{c}": found(c) for c in ("id", *facts)})
    near = lambda at: F.when((F.col("id") > F.col(f"_{at}_id")) & may_link(here, {c: F.col(f"_{at}_{c}") for c in facts}), F.col(f"_{at}_id"))
    both = met.select(near("first").alias("_x"), near("last").alias("_y"), F.col("id").alias("b")).where("_x is not null or _y is not null")
    return both.select(F.explode(F.array("_x", "_y")).alias("a"), "b").where("a is not null").distinct()


def with_gone(classes: DataFrame, gone: DataFrame) -> DataFrame:
    """Adds ``gone``, true for the ids that ``gone`` holds; only rows that a small filter lets through are joined."""
    perhaps = likely("id", gone)
    rest = classes.where(perhaps).join(gone.withColumn("_gone", F.lit(True)), "id", "left").withColumn("gone", F.coalesce("_gone", F.lit(False)))
    return classes.where(~perhaps).withColumn("gone", F.lit(False)).unionByName(rest.select(*classes.columns, "gone"))


def postings(classes: DataFrame) -> DataFrame:
    """``(token, before, id, size, odd0, odd1)``: a row for each token of a class's prefix, none of them null, so that the sides of a join stay alike.

    ``token`` is a number of 32 bits, by which tokens meet, and ``before`` that of the one ahead. ``size`` holds the set's size, the token's place and, lowest,
    whether the class is gone.
    """
    rows = classes.select("id", "n", "odd0", "odd1", "gone", "prefix", F.posexplode("prefix").alias("pos", "rank"))
    size = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.shiftleft(F.col("pos").cast("bigint"), 1)).bitwiseOR(F.col("gone").cast("bigint"))
    sure = lambda c, name: F.coalesce(c, F.lit(0).cast("bigint")).alias(name)
    wide = [sure(F.col("id"), "id"), sure(size, "size"), sure(F.col("odd0"), "odd0"), sure(F.col("odd1"), "odd1")]
    return rows.select(F.hash("rank").alias("token"), F.hash(F.get("prefix", F.col("pos") - 1)).alias("before"), *wide)


def open_pairs(posted: DataFrame) -> DataFrame:
    """``(a, b)`` of all classes that meet in a list of :func:`postings` and pass the filters, the later of which is not gone yet.

    The positional filter: at their first common token, sets hold too few before it to lose the link; at any, they share at most what both hold before it,
    the token, and what both hold after it. Sets that share tokens one after the other meet at the first of them, where a pair that links passes. Both sides read the same columns and share one shuffle.
    """
    x, y = posted.alias("x"), posted.alias("y")
    size = lambda end: F.col(f"{end}.size")
    n, m = F.shiftright(size("x"), 32), F.shiftright(size("y"), 32)
    place = lambda end: F.shiftright(size(end), 1).bitwiseAND(F.lit((1 << 31) - 1))
    i, j = place("x"), place("y")
    later = F.col("x.id") < F.col("y.id") - F.when(size("x").isNotNull() & (size("y").bitwiseAND(F.lit(1)) == 1), F.col("y.id")).otherwise(F.lit(0))
    need = pair_overlap(n, m)
    shared = (i <= n - need) & (j <= m - need) & (F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1) >= need)
    began = (F.least(i, j) == 0) | (F.col("x.before") != F.col("y.before"))
    odd = lambda end, size: {"n": size, "odd0": F.col(f"{end}.odd0"), "odd1": F.col(f"{end}.odd1")}
    fits = (n * 100 >= m * LINK) & (m * 100 >= n * LINK)  # first: it turns most away, and costs least
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & fits & later & began & shared & may_link(odd("x", n), odd("y", m)))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def deduplicated_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, mark, n_tokens, kept)`` of every line of ``docs(doc_id, text)``; ``mark`` tells lines of rows that share a ``doc_id`` apart.

    A line's tokens are its distinct words, in lower case, as white space of ASCII separates them. A line goes when an earlier one, by ``doc_id`` and
    place, has token sets of Jaccard similarity 0.8 or more with it, whether that one stays or not. Lines with equal sets, by two hashes of their
    whole tokens, are one class, whose first line stands for it. Tokens are ordered by rarity (the count of their bucket in all lines, then their hash);
    classes meet in the lists of their prefix tokens under the length, positional and parity filters; candidates are verified on the tokens of
    their texts. First each class is held against two of those that begin or end with the same tokens, which is linear; then those that still stay against all
    earlier members of their lists. Classes are numbered in the order of their first lines, so that only the later one of a pair may have to go.

    Blank lines have no tokens and stay. Null text is one blank line. A null ``doc_id`` comes first. Rows that repeat a ``doc_id`` count as
    one document where they agree in a line and its place, and as different lines elsewhere. An empty table gives no rows. Other columns are ignored.
    """
    lines = cut(lines_of(docs))
    counts = rarity(lines)
    rank = lambda t: F.coalesce(F.get(counts, bucket(t).cast("int")).bitwiseOR(t.bitwiseAND(F.lit((1 << HASH_BITS) - 1))), F.lit(0).cast("bigint"))  # noqa: E731  never null: sorted as plain numbers
    size = F.size("tokens")
    prefix = F.when(size >= 4, F.slice(F.sort_array(F.transform("tokens", rank)), 1, prefix_length(size)))  # smaller sets link with equal ones only
    odd1 = F.when(size > LONG, parity("tokens", "half")).otherwise(F.lit(0).cast("bigint"))
    ends = [F.when(size >= 4, F.xxhash64(F.slice("tokens", start, ENDS))).alias(name) for name, start in (("low", 1), ("high", -ENDS))]
    table = lines.select(
        "doc_id", "line_no", "mark", size.alias("n"), F.xxhash64("tokens").alias("one"), F.xxhash64(F.lit("second"), "tokens").alias("two"),
        prefix.alias("prefix"), parity("tokens", "all").alias("odd0"), odd1.alias("odd1"), *ends,
    )
    ranked = cut(table)
    release(lines)
    key = ["one", "two", "n"]
    place = ("doc_id", "line_no", "mark")
    # what follows from the set is the same for all of a class; combined map-side, it moves once
    facts = ("prefix", "odd0", "odd1", "low", "high")
    classes = ranked.where("n > 0").groupBy(*key).agg(F.min(F.struct(*place)).alias("at"), *[F.first(c).alias(c) for c in facts])
    classes = classes.select("n", *[F.col(f"at.{c}").alias(c) for c in place], *facts).orderBy(*place)
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))  # in order of the place
    told = classes.select("id", *place, "n")
    links = verified(docs, first_pairs(classes), told)
    gone = cut(links.select(F.col("b").alias("id")).distinct())
    links = verified(docs, open_pairs(postings(with_gone(classes.select("id", "n", "odd0", "odd1", "prefix"), gone))), told)
    gone = gone.union(links.select(F.col("b").alias("id"))).distinct()
    stay = classes.join(gone, "id", "left_anti").select(*[F.col(c).alias(f"_{c}") for c in place])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("line_no") == F.col("_line_no")) & (F.col("mark") == F.col("_mark"))
    joined = ranked.select(*place, "n").join(stay, same, "left")
    return joined.select(*place, F.col("n").alias("n_tokens"), ((F.col("n") == 0) | F.col("_mark").isNotNull()).alias("kept"))


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The linked pairs ``(a, b)``, on the tokens of the lines themselves."""
    pairs = cut(pairs)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = classes.join(needed, "id", "left_semi").select("id", F.col("doc_id").alias("_doc"), "line_no", "mark")
    wanted = cut(wanted)
    by_doc = wanted.groupBy("_doc").agg(F.collect_set(F.struct("line_no", "mark", "id")).alias("_lines"))
    hits = docs.where(likely("doc_id", wanted.select(F.col("_doc").alias("doc_id"))))
    texts = hits.select("doc_id", "text").join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc")))
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    found = texts.select("doc_id", F.explode("_lines").alias("l"), split.alias("s")).select("doc_id", "l.*", F.get("s", F.col("l.line_no")).alias("line"))
    found = found.where(F.xxhash64("line") == F.col("mark")).dropDuplicates(["id"])
    sets = cut(with_tokens(found).select("id", "tokens"))
    one = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    link = common * 100 >= (F.size("x") + F.size("y") - common) * LINK
    links = cut(pairs.join(one, "a").join(two, "b").where(link).select("a", "b"))
    release(sets, wanted, pairs)
    return links


def without_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``docs`` with the lines that ``lines`` (of :func:`deduplicated_lines`) does not keep taken out of ``text``.

    A document none of whose lines stays has an empty text; null stays null. Line places and marks are met as
    numbers in arrays of one document's length.
    """
    code = lambda i, mark: F.shiftleft(i.cast("long"), 32).bitwiseOR(mark.bitwiseAND(F.lit((1 << 32) - 1)))
    out = lines.where("not kept").groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(code(F.col("line_no"), F.col("mark"))).alias("_out"))
    joined = docs.join(out, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").withColumn("_split", F.split("text", "\n"))
    every = F.transform("_split", lambda line, i: code(i, F.xxhash64(line)))
    left = F.transform(F.array_except(every, F.col("_out")), lambda k: F.get(F.col("_split"), F.shiftright(k, 32).cast("int")))
    text = F.when(F.col("_out").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("text", text).select(*docs.columns)
