"""Corpus tables over the given test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.sources.tables import addresses, files_table, one_per_path

#: So many parts have their rules put together in one task, in :func:`documents_with_many_rules`.
PARTS_IN_SLICE = 10_000
EXTENSIONS = (".md", ".log", ".py", ".PY", ".png", "", ".tar.gz", ".ipynb", ".json", ".pyc", ".txt")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _doc_path() -> F.Column:
    extension = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    return F.concat("lang", F.lit("/b"), (F.col("doc_id") % 7).cast("string"), F.lit("/doc_"), F.col("doc_id").cast("string"), extension)


def documents(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """Every document a file of its source's repository, in one folder per language and batch."""
    return files_table(table(spark, folder, "documents"), F.col("source"), _doc_path(), F.col("text"), keep)


def nested_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document a file of its source's repository, up to 499 levels down in a chain of folders."""
    level = (F.col("doc_id") % 500).cast("int")
    names = F.transform(F.filter(F.sequence(F.lit(0), level), lambda i: i > 0), lambda i: F.concat(F.lit("d"), i.cast("string")))
    path = F.array_join(F.concat(names, F.array(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))), "/")
    return files_table(table(spark, folder, "documents"), F.col("source"), path, F.col("text"))


def rare_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents by turns emptied, with other line ends, fenced, with an end of CDATA, and with a NUL byte at the end."""
    turn, text = F.col("doc_id") % 5, F.col("text")
    edited = (
        F.when(turn == 0, F.lit(""))
        .when(turn == 1, F.concat(text, F.lit("\r\nx\ry")))
        .when(turn == 2, F.concat(F.lit("```"), text, F.lit("\n```")))
        .when(turn == 3, F.concat(text, F.lit("]]>")))
        .otherwise(F.concat(text, F.lit("\0")))
    )
    return files_table(table(spark, folder, "documents"), F.col("source"), _doc_path(), edited)


def documents_with_ignore_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, and in every language folder and root an ignore file."""
    docs = documents(spark, folder)
    folders = docs.select("repo_id", F.substring_index("path", "/", 1).alias("lang")).distinct()
    nested = folders.select(
        "repo_id",
        F.concat("lang", F.lit("/.gitignore")).alias("path"),
        F.concat(F.lit("# batches\nb3/\n*.txt\n!b"), F.length("lang").cast("string"), F.lit("/*.json\nb?/doc_*5*\n")).alias("text"),
    )
    roots = docs.select("repo_id").distinct().select(
        "repo_id", F.lit(".gitignore").alias("path"), F.lit("*.json\r\nen/b1\r\n  /fr/b2/*  \r\n!doc_1*.log\r\n").alias("text")
    )
    extra = files_table(nested.unionByName(roots), F.col("repo_id"), F.col("path"), F.col("text"))
    return docs.unionByName(extra)


def documents_with_many_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, and in the root of every repository an ignore file with five rules for each part."""
    docs, key = documents(spark, folder), F.col("p_partkey").cast("string")
    rules = [
        F.concat(F.lit("doc_"), key, F.lit(".md")),
        F.concat(F.lit("*"), key, F.lit(".py")),
        F.concat(F.lit("/en/b"), (F.col("p_partkey") % 7).cast("string"), F.lit("/doc_"), key, F.lit(".log")),
        F.concat(F.lit("doc_"), key, F.lit("*")),
        F.concat(F.lit("!/de/*/doc_"), key, F.lit(".txt")),
    ]
    parts = table(spark, folder, "part").select("p_partkey")
    slices = parts.count() // PARTS_IN_SLICE + 1  # of the one file, in the order of the parts; one task holds a slice, and then the text
    dealt = parts.repartitionByRange(slices, "p_partkey").withColumn("slice", F.spark_partition_id())
    lines = dealt.select("slice", "p_partkey", F.posexplode(F.array(*rules)).alias("nth", "line"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "nth", "line"))), lambda r: r["line"])
    sliced = lines.groupBy("slice").agg(F.nullif(F.array_join(text, "\n"), F.lit("")).alias("text"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("slice", "text"))), lambda s: s["text"])
    file = sliced.agg(F.array_join(whole, "\n").cast("binary").alias("text"))  # the one file's own text
    # Rows as long as the file: the task that puts it together does not hold theirs, and they are not all in one.
    repos = docs.select("repo_id").distinct().repartition(spark.sparkContext.defaultParallelism, "repo_id")
    extra = files_table(repos.crossJoin(F.broadcast(file)), F.col("repo_id"), F.lit(".gitignore"), F.col("text"))
    return docs.unionByName(extra)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page a file of its host; of several pages at one address the latest stays."""
    raw = table(spark, folder, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]+/?([^?#]*)", 1), "/+$", "")
    files = files_table(raw, host, F.when(path == "", "index.html").otherwise(path), F.col("html"), ["page_id", *addresses()])
    return one_per_path(files, F.col("page_id"), ["_file", "_row"]).drop("page_id", "_file", "_row")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn a Markdown file of its conversation."""
    path = F.concat(F.lit("turn_"), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit("_"), "role", F.lit(".md"))
    return files_table(table(spark, folder, "conversations"), F.col("conv_id"), path, F.col("text"))


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """Events as commits: each touches the document with the number of its user."""
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    docs = table(spark, folder, "documents").select("source", "lang", "doc_id")
    touched = events.join(docs, F.col("user_id") == F.col("doc_id"))
    return touched.select(
        F.col("source").alias("repo_id"),
        _doc_path().alias("path"),
        F.col("event_id").alias("commit_ord"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("author_date"),
    )


def dated_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with an ``mtime`` for those without history: the day numbered by their length."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("n_chars").cast("int"))
    return documents(spark, folder, "n_chars").withColumn("mtime", day.cast("timestamp")).drop("n_chars")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Every order a file below region, nation and market segment; its value is the measure."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, folder, "region")
    placed = (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_custkey", "o_totalprice")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    path = F.concat_ws("/", "r_name", "n_name", "c_mktsegment", F.col("o_orderkey").cast("string"))
    return placed.select(
        F.lit("orders").alias("repo_id"), path.alias("path"), F.col("o_totalprice").cast("decimal(18,2)").alias("value")
    )


def notebooks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document a notebook whose lines are cells: code, Markdown and raw in turn."""
    kinds = F.array(F.lit("code"), F.lit("markdown"), F.lit("raw"))
    cells = F.transform(
        F.split("text", "\n"),
        lambda text, i: F.struct(F.element_at(kinds, (i % 3 + 1).cast("int")).alias("cell_type"), text.alias("source")),
    )
    book = F.to_json(F.struct(F.lit(4).alias("nbformat"), cells.alias("cells")))
    path = F.concat("lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".ipynb"))
    written = table(spark, folder, "documents").select("source", path.alias("path"), book.alias("book"))
    return files_table(written, F.col("source"), F.col("path"), F.col("book"))
