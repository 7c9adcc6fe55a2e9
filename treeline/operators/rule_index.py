"""Files against the rules of ignore files: an inverted index of rules, met by the keys of tree nodes.

A rule that ends in a plain name, or in one with a single ``*`` in front or behind, holds for a file as soon as one *node* of its path, a
directory above or the file itself, has the right name, beginning, end or path. So rules are keyed by what such a node has to
show, nodes bring their keys, and both meet in one equi-join: what a rule costs is its hits, not the files in its scope. Directories
are nodes once, however many files lie below; their files inherit the result.

=============  =====================================  ============================================
``meets``      a node holds it when                   patterns (also below ``dir/**/``)
=============  =====================================  ============================================
``name``       its name is ``text``                   ``name`` ``name/`` ``**/name``
``tail``       its name ends with ``text``            ``*.ext`` ``*~``
``head``       its name starts with ``text``          ``lit*``
``path``       its path is ``text``                   ``/a/b`` ``a/b/`` ``a/*`` ``a/**``
``tail in``    as ``tail``, directly in ``dir``       ``a/*.ext``
``head in``    as ``head``, directly in ``dir``       ``a/lit*``
``rest``       (the whole path is tested)             everything else, for files below ``dir``
=============  =====================================  ============================================

``rest`` rules have a key as well: the longest literal at the end of the pattern (``shows, literal``), for nodes below ``dir``. Only files on whose
path a node shows it are tested.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.operators import rollup, skew
from treeline.operators.rules import MATCH_TYPE, holds_row, line_end, parsed_lines, text_in_pieces
from treeline.session import cut

#: Where a rule stands in the order of all ignore files.
ORDER = ("depth", "base", "nth")


#: From this many pieces of ignore files on (16 MB, about a million lines), only lines that a node may show are read as rules.
MANY_PIECES = 1 << 12
#: Most words of the bitmap that tells so, 8 MB; where it fills up it merely lets more lines through.
MOST_WORDS = 1 << 20


def _pieces(ignore_files: DataFrame) -> DataFrame:
    """``repo_id, base, text, at`` of the files of :func:`treeline.operators.rules.ignore_file_rules`, which may come in pieces already."""
    texts = ignore_files if "at" in ignore_files.columns else text_in_pieces(ignore_files.select("repo_id", "base", "text"), "text", "at")
    return texts.select("repo_id", "base", "text", "at")


def _lines(pieces: DataFrame) -> DataFrame:
    """``repo_id, depth, base, nth, line, end`` of lines that are not empty; ``nth`` grows with the lines of a file, and is their number in the first piece."""
    of = lambda line, i: F.struct((F.col("at") + i).alias("nth"), line.alias("line"), line_end(line).alias("end"))
    split = pieces.select("repo_id", paths.node_depth(F.col("base")).alias("depth"), "base", F.inline(F.transform(F.split("text", "\n"), of)))
    return split.where(F.trim("line") != "")


def rule_index(ignore_files: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per rule of the files of :func:`treeline.operators.rules.ignore_file_rules`; ``nth`` is its place in the order of its file.

    Pieces of the files are dealt over all cores before they are read, so that a long file, or many in one partition of the corpus, are not one
    task's. With ``files(repo_id, path)``, and ``MANY_PIECES``, rules that hold for none of them are left out as far as :func:`_may_hold` tells.
    """
    pieces = _pieces(ignore_files)
    if files is not None and "at" not in ignore_files.columns:
        pieces = cut(pieces)  # used several times, and may be made of contents
    cores = ignore_files.sparkSession.sparkContext.defaultParallelism
    lines = _lines(pieces.repartition(cores, "repo_id", "base", "at"))
    if files is not None and pieces.select("at").count() >= MANY_PIECES:
        lines = lines.where(_may_hold(pieces, files))
    return parsed_lines(lines.drop("end"))


def _may_hold(pieces: DataFrame, files: DataFrame) -> Column:
    """For the :func:`_lines` of ``pieces``: false only if no file, or directory above one, of its repository shows what a rule asks a node for.

    The keys that nodes show, of the lengths that the lines ask for, are hashed to two bits of a word each, in a bitmap with 16 bits a key or
    more, up to ``MOST_WORDS`` words. Lines of which :func:`treeline.operators.rules.line_end` does not tell are all true, and so are those that cannot be read.
    """
    spark, end = files.sparkSession, F.col("end")
    starred = F.filter(F.split("text", "\n"), lambda line: F.contains(line, F.lit("*")))
    ends = pieces.select("repo_id", F.explode_outer(F.transform(starred, line_end)).alias("end"))  # every repository with a piece
    found = ends.groupBy("repo_id", F.startswith(end, F.lit("*")).alias("tail"), F.endswith(end, F.lit("*")).alias("head"), (F.length(end) - F.lit(1)).alias("n")).count()
    asked = cut(found.groupBy("repo_id").agg(*[F.collect_set(F.when(F.col(kind), F.col("n"))).alias(f"{kind}s") for kind in ("head", "tail")]))
    folders = files.select("repo_id", paths.parent(F.col("path")).alias("path")).distinct()
    names = files.select("repo_id", paths.base_name(F.col("path")).alias("name")).unionByName(folders.select("repo_id", F.explode(F.split("path", "/")).alias("name")))
    both = F.explode(F.array_distinct(F.array("name", F.rtrim("name", F.lit("\n"))))).alias("name")  # as rules with a key, and expressions, see it
    shown = names.select("repo_id", both).distinct().join(asked, "repo_id")
    star = lambda kind: F.when(F.col("shows") == kind, F.lit("*")).otherwise(F.lit(""))
    keyed = shown.select("repo_id", F.inline(_keys(F.col("name")))).select("repo_id", F.concat(star("tail"), "literal", star("head")).alias("end"))
    keys = cut(keyed.select(F.xxhash64("repo_id", "end").alias("key")).distinct())
    words = 1 << 10
    while words < min(keys.count() // 4, MOST_WORDS):
        words *= 2
    place = lambda key: F.shiftrightunsigned(key, 12).bitwiseAND(F.lit(words - 1)).cast("int")
    mask = "shiftleft(1L, cast({0} & 63 as int)) | shiftleft(1L, cast(shiftright({0}, 6) & 63 as int))"
    filled = keys.groupBy(place(F.col("key")).alias("at")).agg(F.bit_or(F.expr(mask.format("key"))).alias("word"))
    every = spark.range(words).select(F.col("id").alias("at")).join(filled, "at", "left").select("at", F.coalesce("word", F.lit(0)).alias("word"))
    bitmap = cut(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]).alias("words"))).scalar()
    asked_for = F.expr(mask.format("xxhash64(repo_id, end)"))
    held = F.get(bitmap, place(F.xxhash64("repo_id", "end"))).bitwiseAND(asked_for) == asked_for
    return F.contains("base", F.lit("\\")) | (end == "") | held


def _wanted_keys(index: DataFrame) -> DataFrame:
    """Per repository with rules, which lengths of tails and heads are asked for: as many numbers as there are lengths."""

    def lengths(meets: str) -> Column:
        return F.collect_set(F.when(F.col("meets") == meets, F.length("text"))).alias(meets)

    return index.where("meets <> 'rest'").groupBy("repo_id").agg(*[lengths(m) for m in ("tail", "head", "tail in", "head in")])


def _met(nodes: DataFrame, index: DataFrame, wanted: DataFrame, is_dir: bool) -> DataFrame:
    """``repo_id, path, depth, base, nth, pattern, include`` of every rule that a node ``(repo_id, path)`` holds."""
    path, none = F.col("path"), F.lit("")
    name, folder = paths.base_name(path), paths.parent(path)

    def key(meets: str, at: Column, text: Column) -> Column:
        return F.struct(F.lit(meets).alias("meets"), at.alias("dir"), text.alias("text"))

    def ends(meets: str, at: Column, cut_off) -> Column:
        return F.transform(F.filter(f"`{meets}`", lambda n: n <= F.length(name)), lambda n: key(meets, at, cut_off(name, n)))

    keys = F.concat(
        F.array(key("path", none, path), key("name", none, name)),
        ends("tail", none, F.right), ends("head", none, F.left), ends("tail in", folder, F.right), ends("head in", folder, F.left),
    )
    shown = nodes.join(wanted, "repo_id").select("repo_id", "path", F.inline(keys))
    met = shown.join(index.where("meets <> 'rest'"), ["repo_id", "meets", "dir", "text"])
    under = (F.col("below") == "") | F.startswith("path", F.concat("below", F.lit("/")))
    held = met.where(under if is_dir else under & ~F.col("inside"))
    return held.select("repo_id", "path", *ORDER, "pattern", "include").distinct()


@dataclass(frozen=True)
class Hits:
    """What rules of ignore files hold for which files.

    ``by_directory`` (``repo_id, path, depth, base, nth, pattern, include``): the rules that every file directly in a directory inherits,
    from it and from those above. ``by_file``: the rules a file meets by itself, some of which it may inherit too. ``crowded``: directories
    with more files than one task should hold, for salted joins on ``(repo_id, _parent)``.
    """

    by_directory: DataFrame
    by_file: DataFrame
    crowded: DataFrame

    def _inherit(self, files: DataFrame, right: DataFrame, how: str) -> DataFrame:
        met = files.withColumn("_parent", paths.parent(F.col("path")))
        return skew.salted_join(met, right.withColumnRenamed("path", "_parent"), ["repo_id", "_parent"], how, F.col("path"), self.crowded).drop("_parent")

    def decide(self, files: DataFrame) -> DataFrame:
        """``files`` with ``_by_files``: the ``include`` of the last rule that holds, NULL without any; maxima, combined map-side."""
        at = F.struct(*ORDER)
        last = F.max(F.struct(at.alias("at"), "include"))
        inherited = self.by_directory.groupBy("repo_id", "path").agg(last.alias("_above"))
        own = self.by_file.groupBy("repo_id", "path").agg(last.alias("_own"))
        decided = self._inherit(files.join(own, ["repo_id", "path"], "left"), inherited, "left")
        latest = F.greatest("_above", "_own")  # skips NULL
        return decided.withColumn("_by_files", latest["include"]).drop("_above", "_own")

    def rows(self, files: DataFrame) -> DataFrame:
        """Every rule that holds for each of ``files`` once: ``files`` columns, order, ``pattern, include``."""
        rules = ["repo_id", "path", *ORDER, "pattern", "include"]
        own = files.join(self.by_file.select(*rules), ["repo_id", "path"])
        return self._inherit(files, self.by_directory, "inner").unionByName(own).distinct()

    def lists(self, files: DataFrame) -> DataFrame:
        """``repo_id, path, _found``: the rules of a file in their order, for displays; as long as rules hold for one file."""
        ordered = F.array_sort(F.collect_list(F.struct(*ORDER, F.struct(F.lit("gitignore").alias("origin"), "pattern", "include").cast(MATCH_TYPE).alias("match"))))
        held = self.rows(files.select("repo_id", "path"))
        return held.groupBy("repo_id", "path").agg(F.transform(ordered, lambda h: h["match"]).alias("_found"))

    def credits(self, judged: DataFrame) -> DataFrame:
        """``repo_id, pattern, hits``: how many files each rule's pattern is credited for.

        Files are counted per directory and verdict first, so an inherited rule costs a row per directory; only what files meet by themselves,
        and do not inherit, comes one by one.
        """
        told = judged.where(~F.col("is_binary")).select("repo_id", "path", F.col("is_ignored").alias("include"))
        counts = told.groupBy("repo_id", paths.parent(F.col("path")).alias("path"), "include").agg(F.count("*").alias("hits"))
        above = self.by_directory.join(counts, ["repo_id", "path", "include"]).select("repo_id", "pattern", "hits")
        own = self.by_file.join(told, ["repo_id", "path", "include"]).withColumn("_parent", paths.parent(F.col("path")))
        inherited = self.by_directory.select("repo_id", F.col("path").alias("_parent"), *ORDER)
        alone = own.join(inherited, ["repo_id", "_parent", *ORDER], "left_anti")
        every = above.unionByName(alone.groupBy("repo_id", "pattern").agg(F.count("*").alias("hits")))
        return every.groupBy("repo_id", "pattern").agg(F.sum("hits").alias("hits"))


def match_rules(files: DataFrame, ignore_files: DataFrame, rows_per_key: int = skew.ROWS_PER_KEY, once: bool = False) -> Hits:
    """The hits of all rules on ``files(repo_id, path)``.

    Rules and directories, narrow, are written down on the way, and so are the hits unless they are used but ``once``.
    """
    settle = (lambda df: df) if once else cut
    index = cut(rule_index(ignore_files, files))
    ruled = files.join(index.select("repo_id").distinct(), "repo_id", "left_semi")
    own = cut(rollup.own_totals(ruled, ()))
    folders = rollup.roll_up(own, ())
    wanted = _wanted_keys(index)
    hit = _met(folders.select("repo_id", "path"), index, wanted, True)
    # a directory passes its rules on to all below it
    above = own.select("repo_id", F.col("path").alias("_dir"), F.explode(paths.directories_of(F.col("path"))).alias("path"))
    passed = skew.salted_join(above, hit, ["repo_id", "path"], "inner", F.col("_dir"), rollup.crowded_directories(folders, rows_per_key))
    by_directory = settle(passed.select("repo_id", F.col("_dir").alias("path"), *ORDER, "pattern", "include").distinct())
    crowded = rollup.crowded_directories(own, rows_per_key).withColumnRenamed("path", "_parent")
    by_file = _met(ruled, index, wanted, False).unionByName(_rest(ruled, above, index, crowded))
    return Hits(by_directory, settle(by_file), crowded)


def _shown(name: Column) -> Column:
    return _keys(F.rtrim(name, F.lit("\n")))  # an expression also ends before a last line feed


def _keys(name: Column) -> Column:
    """The keys ``shows, literal`` of a name, for the lengths that ``heads`` and ``tails`` ask for."""
    key = lambda shows, literal: F.struct(F.lit(shows).alias("shows"), literal.alias("literal"))
    ends = lambda shows, cut_off: F.transform(F.filter(f"{shows}s", lambda n: n <= F.length(name)), lambda n: key(shows, cut_off(name, n)))
    return F.concat(F.array(key("name", name)), ends("head", F.left), ends("tail", F.right))


def _rest(files: DataFrame, above: DataFrame, index: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rules whose expression is tried, on the files below their directory that they may hold for.

    The file itself, or a directory on the way to it, has to show the rule's literal: files and directories meet rules by equi-joins.
    """
    told = (*ORDER, "pattern", "include", "kind", "key")
    rest = index.where("meets = 'rest'").select("repo_id", F.col("dir").alias("_scope"), *told, "shows", "literal")
    lengths = [F.collect_set(F.when(F.col("shows") == shows, F.length("literal"))).alias(f"{shows}s") for shows in ("head", "tail")]
    asked = rest.groupBy("repo_id", "_scope").agg(*lengths)
    scoped = above.select("repo_id", F.col("_dir").alias("_parent"), F.col("path").alias("_scope")).join(asked, ["repo_id", "_scope"])
    on = ["repo_id", "_scope", "shows", "literal"]

    beneath = F.when(F.col("_scope") == "", F.col("_parent")).otherwise(F.substring("_parent", F.length("_scope") + 2, F.length("_parent")))
    names = F.when(F.col("_parent") == F.col("_scope"), F.array().cast("array<string>")).otherwise(F.split(beneath, "/"))
    inside = scoped.select("repo_id", "_parent", "_scope", "heads", "tails", F.explode(names).alias("_name"))
    entered = inside.select("repo_id", "_parent", "_scope", F.inline(_shown(F.col("_name")))).join(rest, on).select("repo_id", "_parent", *told).distinct()

    placed = files.withColumn("_parent", paths.parent(F.col("path")))
    below = skew.salted_join(placed, entered, ["repo_id", "_parent"], "inner", F.col("path"), crowded)
    own = skew.salted_join(placed, scoped, ["repo_id", "_parent"], "inner", F.col("path"), crowded)
    shown = own.select("repo_id", "path", "_scope", F.inline(_shown(paths.base_name(F.col("path"))))).join(rest, on)
    met = below.select("repo_id", "path", *told).unionByName(shown.select("repo_id", "path", *told))
    return met.where(holds_row(F.col("path"), F.struct("kind", "key"))).select("repo_id", "path", *ORDER, "pattern", "include").distinct()
