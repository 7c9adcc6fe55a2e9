import pytest
from pyspark.sql import functions as F

from treeline.operators import rollup
from treeline.operators.rules import ignore_file_rules
from treeline.operators.tokens import token_models
from treeline.operators.verdicts import RuleSet, disposition, judge
from treeline.streaming.ingest import arrivals, each_batch, stream_contents
from treeline.plans.project import Selection
from treeline.streaming.judging import RunningVerdicts
from treeline.streaming.running import RunningTotals, running_directories

SCHEMA = "repo_id string, path string, size bigint, content binary"


@pytest.fixture
def drops(corpus, tmp_path):
    """Three deliveries; the second repeats a file of the first."""
    place = tmp_path / "drops"
    deliveries = [
        {"a.txt": "1234", "d/b.log": "x", "i.png": "1"},
        {"a.txt": "1234", "d/c.txt": "12"},
        {"d/e/f.txt": "", "g.ipynb": "{"},
    ]
    for i, files in enumerate(deliveries):
        corpus(files).coalesce(1).write.mode("append").parquet(str(place))
    return str(place)


def drain(writer, state):
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def test_contents_of_a_stream(spark, drops, tmp_path):
    models = token_models(["chars-4"])
    stream = stream_contents(arrivals(spark, drops, SCHEMA, 1), RuleSet(["g.*"]), models, include_binary=True)
    out = str(tmp_path / "out")
    drain(stream.writeStream.format("parquet").option("path", out), str(tmp_path / "state"))
    got = sorted((r.path, r.text, r["tokens:chars-4"]) for r in spark.read.parquet(out).collect())
    assert got == [
        ("a.txt", "1234", 1), ("a.txt", "1234", 1), ("d/c.txt", "12", 1), ("i.png", "binary content (1 bytes)", 6),
    ]


def test_ignore_files_need_a_batch_job(spark, corpus, drops, tmp_path):
    rules = RuleSet((), False, ignore_file_rules(corpus({".gitignore": "*.txt\n!a.txt\n"})))
    stream = arrivals(spark, drops, SCHEMA, 1)
    with pytest.raises(ValueError):
        stream_contents(stream, rules)
    out = str(tmp_path / "out")
    job = lambda batch: disposition(judge(batch, rules)).select("repo_id", "path")
    drain(each_batch(stream, job, out), str(tmp_path / "state"))
    assert sorted(r.path for r in spark.read.parquet(out).collect()) == ["a.txt", "a.txt", "d/b.log", "g.ipynb"]


@pytest.mark.parametrize("watermark", [None, "1 hour"])
def test_running_totals_equal_the_batch(spark, drops, tmp_path, watermark):
    stream = arrivals(spark, drops, SCHEMA, 1).withColumn("mtime", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    running = running_directories(stream.withColumn("created", F.lit("2024-01-01")), watermark=watermark)
    out = str(tmp_path / "out")
    save = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    drain(running.writeStream.outputMode("update").foreachBatch(save), str(tmp_path / "state"))
    last = {}
    for r in spark.read.parquet(out).orderBy("batch").collect():
        last[r.path] = (r.n_files, r.size, r.created)
    files = spark.read.parquet(drops).dropDuplicates(["repo_id", "path"]).withColumn("created", F.lit("2024-01-01"))
    assert last == {r.path: (r.n_files, r.size, r.created) for r in rollup.directories(files).collect()}


TOTALS = "repo_id string, path string, n_files bigint, size bigint, created string"


@pytest.mark.parametrize("watermark", [None, "1 hour"])
def test_a_keyed_table_of_totals(spark, drops, tmp_path, watermark):
    stream = arrivals(spark, drops, SCHEMA, 1).withColumn("mtime", F.lit("2024-01-01 00:00:00").cast("timestamp")).withColumn("created", F.lit("2024-01-01"))
    table = RunningTotals(spark, str(tmp_path / "table"), TOTALS)
    drain(table.follow(stream, watermark), str(tmp_path / "state"))
    files = spark.read.parquet(drops).dropDuplicates(["repo_id", "path"]).withColumn("created", F.lit("2024-01-01"))
    want = {r.path: (r.n_files, r.size, r.created) for r in rollup.directories(files).collect()}
    shown = lambda df: {r.path: (r.n_files, r.size, r.created) for r in df.collect()}
    assert shown(table.totals()) == want
    written = spark.read.parquet(str(tmp_path / "table" / "batches"))
    touched = {(r.batch, r.path) for r in written.collect()}
    assert {p for b, p in touched if b == 1} == {"", "d"}  # the repeated file's directories, and no others
    first = shown(table.totals(upto=0))
    # a batch that is run again changes nothing, before and after a base holds it
    again = files.where("path in ('d/e/f.txt', 'g.ipynb')")
    table.add(again, 2)
    assert shown(table.totals()) == want
    assert table.base() == -1
    table.compact(0)
    assert table.base() == 0 and shown(table.totals()) == want
    table.compact(2)
    table.compact(1)
    assert table.base() == 2 and shown(table.totals()) == want
    table.add(again, 2)
    assert shown(table.totals()) == want
    table.add(files.where("path = 'a.txt'").withColumn("path", F.lit("d/new.txt")), 3)
    assert shown(table.totals())["d"][0] == want["d"][0] + 1 and first[""][0] == 3


DELIVERIES = [
    [("r", "a.txt", "1"), ("r", "d/b.log", "x"), ("r", "d/i.png", "1"), ("s", "a.txt", "1"), ("s", "k.log", "1")],
    [("r", "d/.gitignore", "*.log\n"), ("r", "d/c.log", "12"), ("s", "d/c.log", "12")],
    [("r", ".gitignore", "*.txt\n!a.txt\nd/k*\n"), ("r", "late.txt", "1"), ("r", "d/k1", "1")],
    [("r", "d/.gitignore", "!b.log\n"), ("r", "d/i.png", "2")],
]


def test_rules_that_arrive_late(spark, corpus, tmp_path):
    """After each batch the table is what a batch job makes of all files so far."""
    table = RunningVerdicts(spark, str(tmp_path / "table"), Selection(["!late*"]))
    so_far = {}
    for number, rows in enumerate(DELIVERIES):
        for _ in range(2):  # run twice, as after a failure
            table.add(corpus(rows), number)
        so_far |= {(r, p): (r, p, c) for r, p, c in rows}
        every = corpus(list(so_far.values()))
        want = judge(every, RuleSet.of(every, ["!late*"], True)).select("repo_id", "path", "is_ignored", "is_binary", "reason")
        kept = {tuple(r) for r in disposition(want).collect()}
        assert {tuple(r) for r in table.verdicts().collect()} == kept
    rows = spark.read.parquet(str(tmp_path / "table" / "verdicts"))
    assert rows.where("repo_id = 's' and batch > 1").isEmpty()  # only repositories with new rules are judged again


def test_a_stream_of_verdicts(spark, corpus, tmp_path):
    for rows in DELIVERIES:
        corpus(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "drops"))
    table = RunningVerdicts(spark, str(tmp_path / "table"), Selection(keep="all"))
    drain(table.follow(arrivals(spark, str(tmp_path / "drops"), SCHEMA, 1)), str(tmp_path / "state"))
    every = corpus(list({(r, p): (r, p, c) for rows in DELIVERIES for r, p, c in rows}.values()))
    want = judge(every, RuleSet.of(every, (), True)).select("repo_id", "path", "is_ignored", "is_binary", "reason")
    assert {tuple(r) for r in table.verdicts().collect()} == {tuple(r) for r in want.collect()}
