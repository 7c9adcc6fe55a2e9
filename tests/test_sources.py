import os
import subprocess

import pytest
from pyspark.sql import functions as F

from treeline.operators.binary import SAMPLE_BYTES
from treeline.operators.dates import with_dates
from treeline.plans.project import Selection, show_tree, summarize
from treeline.sources import directory, tables
from treeline.sources.history import parse_log


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "root"
    contents = {
        ".gitignore": "*.log\n",
        ".git/HEAD": "ref",
        "_priv/__init__.py": "",
        "empty": "",
        "a/b/c/deep.txt": "deep",
        "a/x.log": "log",
        "sp ace/é.txt": "ü\n",
        "big": "b" * (SAMPLE_BYTES + 10),
    }
    for path, text in contents.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "emptydir").mkdir()
    os.symlink(root / "a", root / "linked_dir")
    os.symlink(root / "empty", root / "linked_file")
    os.symlink(root / "nowhere", root / "broken")
    os.utime(root / "empty", (1_700_000_000, 1_700_000_000))
    return root


def walked(root):
    return {os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names}


def test_listing_equals_a_walk(spark, folder):
    assert {r.path for r in directory.list_tree(spark, str(folder)).collect()} == walked(folder)


def test_contents(spark, folder):
    rows = {r.path: r for r in directory.read_tree(spark, str(folder), "r").collect()}
    assert rows.keys() == walked(folder)
    assert bytes(rows["sp ace/é.txt"].content).decode() == "ü\n" and rows["sp ace/é.txt"].size == 3
    assert bytes(rows["empty"].content) == b"" and rows["empty"].mtime.year == 2023
    assert (rows["broken"].size, rows["broken"].content) == (0, None)
    assert len(rows["big"].content) == SAMPLE_BYTES + 10


def test_a_tree_named_by_a_uri(spark, folder):
    """Without a mount the same files, sizes and contents are found; links to directories are not followed either."""
    uri = f"file://{folder}"
    assert {r.path for r in directory.list_tree(spark, uri).collect()} == walked(folder) - {"broken"}  # a link to nothing is no file there
    columns = ["path", "size", "mtime", "content"]
    mounted, remote = (directory.read_tree(spark, root, "r").select(columns).orderBy("path").collect() for root in (str(folder), uri))
    mounted = [r for r in mounted if r.path != "broken"]
    assert [(r.path, r.size, r.content) for r in mounted] == [(r.path, r.size, r.content) for r in remote]
    assert [r.mtime and r.mtime.replace(microsecond=0) for r in mounted] == [r.mtime and r.mtime.replace(microsecond=0) for r in remote]
    with pytest.raises(Exception, match="cannot be listed"):
        directory.list_tree(spark, f"{uri}/none").count()


def test_listing_is_narrowed_by_level_and_name(spark, folder):
    every = walked(folder) - {"broken"}
    (folder / "broken").unlink()
    for root in (str(folder), f"file://{folder}"):
        assert {r.path for r in directory.list_tree(spark, root, level=1).collect()} == {p for p in every if p.count("/") <= 1}
        assert {r.path for r in directory.list_tree(spark, root, name="*.txt").collect()} == {p for p in every if p.endswith(".txt")}
    assert {r.path for r in directory.read_tree(spark, str(folder), "r", level=0, name="b*").collect()} == {p for p in every if "/" not in p and p.startswith("b")}


def test_content_options(spark, folder):
    heads = {r.path: r for r in directory.read_tree(spark, str(folder), "r", "head").collect()}
    assert len(heads["big"].head) == SAMPLE_BYTES and heads["big"].content is None and heads["big"].size == SAMPLE_BYTES + 10
    none = directory.read_tree(spark, str(folder), "r", "none")
    assert none.where("content is not null").isEmpty() and none.count() == len(heads)
    with pytest.raises(ValueError):
        directory.read_tree(spark, str(folder), "r", "some")


def test_jobs_on_a_directory(spark, folder):
    files = directory.read_tree(spark, str(folder), "r")
    lines = [r.line for r in show_tree(files, show_stats=False).orderBy("place").collect()]
    assert lines[:2] == [".", "├── _priv/"]
    drawn = "\n".join(lines)
    assert "x.log" not in drawn and "HEAD" not in drawn and ".gitignore" in drawn and "deep.txt" in drawn
    text = "".join(r.chunk for r in summarize(files, Selection(include_dates=True)).orderBy("place", "path").collect())
    assert "## a/b/c/deep.txt\n\n---\ncreated: " in text and "## empty" not in text


# --- dates -------------------------------------------------------------------------------------------


def test_dates(spark):
    files = spark.createDataFrame(
        [("r", p, m) for p, m in (("both", "2024-05-05 23:59:59"), ("none", None), ("mtime", "2024-02-29 00:00:00"), ("history", None), ("half", "2021-01-01 00:00:00"))],
        "repo_id string, path string, m string",
    ).select("repo_id", "path", F.col("m").cast("timestamp").alias("mtime"))
    commits = spark.createDataFrame(
        [
            ("r", "both", 3, "2023-01-01T23:30:00-08:00"), ("r", "both", 1, "2022-06-01T01:00:00+09:00"), ("r", "both", 2, "2024-01-01T00:00:00+00:00"),
            ("r", "history", 1, "2020-01-01T00:00:00+00:00"), ("r", "half", 1, ""), ("q", "mtime", 1, "1999-01-01T00:00:00+00:00"),
        ],
        "repo_id string, path string, commit_ord bigint, author_date string",
    )
    got = {r.path: (r.created, r.modified) for r in with_dates(files, commits).collect()}
    assert got == {
        "both": ("2022-06-01", "2023-01-01"),
        "none": (None, None),
        "mtime": ("2024-02-29", "2024-02-29"),
        "history": ("2020-01-01", "2020-01-01"),
        "half": ("2021-01-01", "2021-01-01"),
    }
    assert {r.created for r in with_dates(files.drop("mtime")).collect()} == {None}


def test_birth_time_gives_created(spark):
    files = spark.sql("SELECT 'r' repo_id, 'a' path, timestamp '2024-02-01 00:00:00' mtime, timestamp '2023-02-01 00:00:00' birthtime")
    assert tuple(with_dates(files).select("created", "modified").first()) == ("2023-02-01", "2024-02-01")


EXPECTED = {"a": ("2020-02-02", "2022-04-04"), "b c": ("2020-02-02", "2020-02-02"), "e": ("2023-05-05", "2023-05-05")}


def test_history_of_a_real_repository(spark, tmp_path):
    def git(*args, date="2024-01-01T00:00:00+00:00"):
        env = os.environ | {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date, "HOME": str(tmp_path)}
        return subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", *args], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout

    git("init", "-q")
    for day, names in (("2020-02-02", ["a", "b c"]), ("2021-03-03", ["a"]), ("2022-04-04", ["a", "d"])):
        for name in names:
            (tmp_path / name).write_text(day)
        git("add", *names)
        git("commit", "-qm", day, date=f"{day}T23:00:00+05:00")
    git("mv", "d", "e")
    git("commit", "-qm", "renamed", date="2023-05-05T01:00:00+05:00")
    # Following renames in reverse order starts at the commit that made the present name.
    for name in ("a", "b c", "e"):
        assert git("log", "--follow", "--format=%aI", "--reverse", "--", name)[:10] == EXPECTED[name][0]
    log = git("log", "--reverse", "--name-only", "--format=%x01%aI")
    lines = spark.createDataFrame([("r", 0, log)], "repo_id string, log_ord bigint, log string")
    files = spark.createDataFrame([("r", p) for p in EXPECTED], "repo_id string, path string")
    got = {r.path: (r.created, r.modified) for r in with_dates(files, parse_log(lines)).collect()}
    assert got == EXPECTED


def test_any_name_comes_through_a_log(spark, tmp_path):
    def git(*args):
        env = os.environ | {"GIT_AUTHOR_DATE": "2024-01-01T00:00:00+00:00", "GIT_COMMITTER_DATE": "2024-01-01T00:00:00+00:00", "HOME": str(tmp_path)}
        return subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", *args], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout

    names = ["two\nlines", '"quoted"', 'in"side', "tab\there", "plain", " blank ", "äö"]
    git("init", "-q")
    for name in names:
        (tmp_path / name).write_text("x")
    git("add", *names)
    git("commit", "-qm", "all")
    git("commit", "-qm", "nothing", "--allow-empty")
    (tmp_path / "plain").write_text("y")
    git("commit", "-qam", "again")
    read = lambda *how: parse_log(spark.createDataFrame([("r", 0, git("log", *how, "--reverse", "--name-only", "--format=%x01%aI"))], "repo_id string, log_ord bigint, log string"))
    got = sorted((r.path, r.commit_ord.nth, r.author_date[:10]) for r in read("-z").collect())
    assert got == sorted([(n, 1, "2024-01-01") for n in names] + [("plain", 3, "2024-01-01")])
    with pytest.raises(Exception, match="quoted path"):
        read().collect()


# --- tables ------------------------------------------------------------------------------------------


def test_one_per_path(corpus):
    rows = [("r", "a", "old"), ("r", "a", "newest"), ("r", "b", "x"), ("q", "a", "y"), ("r", "c", "same"), ("r", "c", "same")]
    files = corpus(rows).withColumn("rank", F.length(F.col("content").cast("string")))
    kept = tables.one_per_path(files, F.col("rank"))
    assert sorted((r.repo_id, r.path, bytes(r.content).decode()) for r in kept.collect()) == [
        ("q", "a", "y"), ("r", "a", "newest"), ("r", "b", "x"), ("r", "c", "same"),
    ]
    assert kept.columns == files.columns


def test_one_per_path_by_address(spark, corpus, tmp_path):
    """Rows of several files: copies, ties of the newest, equal rows, nulls; the winners' contents are read by one scan."""
    rows = [("r", f"p{i % 40}", f"v{i % 7}") for i in range(300)] + [("r", "one", "x"), ("q", "p1", None), ("r", "same", "s"), ("r", "same", "s"), (None, "p1", "n"), (None, "p1", "n")]
    made = corpus(rows).withColumn("rank", F.when(F.col("path") != "p3", F.xxhash64("content") % 3))
    made.repartition(4).write.parquet(str(tmp_path / "made"))
    scan = spark.read.parquet(str(tmp_path / "made"))
    files = tables.files_table(scan, F.col("repo_id"), F.col("path"), F.col("content"), ["rank", *tables.addresses()])
    by_address = tables.one_per_path(files, F.col("rank"), ["_file", "_row"])
    plain = tables.one_per_path(files.drop("_file", "_row"), F.col("rank"))
    order = lambda df: sorted((repr(tuple(r)) for r in df.select("repo_id", "path", "size", F.hex("content"), "rank").collect()))
    assert order(by_address) == order(plain) and by_address.columns == files.columns
    plan = by_address._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("content#") and sum("Relation" in line and "content" in line for line in plan.splitlines()) == 1
    nothing = tables.one_per_path(files.where("false"), F.col("rank"), ["_file", "_row"])
    assert nothing.count() == 0


def test_conflicts(corpus):
    files = corpus({"a": "1", "a/b": "22", "a/c/d": "3", "a/c": "4", "e": "5"})
    assert {(r.path, r.n_below) for r in tables.conflicts(files).collect()} == {("a", 3), ("a/c", 1)}
    assert {r.path for r in tables.without_conflicts(files).collect()} == {"a/b", "a/c/d", "e"}
