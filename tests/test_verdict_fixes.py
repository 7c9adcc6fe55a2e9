import pytest
from pyspark.sql import functions as F

from treeline.operators import contents
from treeline.plans.project import show_tree
from treeline.sources import directory
from treeline.sources.history import parse_log


def test_large_files_are_whole_or_null(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"a" * 6_000_000)
    got = directory.read_tree(spark, str(tmp_path), "r")
    assert contents.with_text(got).select(F.length("text").alias("n")).first().n == 6_000_000
    assert directory.read_tree(spark, str(tmp_path), "r", max_bytes=10).first().content is None


def test_a_missing_root_fails(spark, tmp_path):
    with pytest.raises(Exception, match="cannot be listed"):
        directory.read_tree(spark, str(tmp_path / "none"), "r").count()


def test_repositories_without_kept_files_have_a_root(corpus):
    files = corpus([("r1", "a.log", "gone"), ("r2", "b.txt", "x")])
    assert {(r.repo_id, r.path) for r in show_tree(files).collect()} == {("r1", ""), ("r2", ""), ("r2", "b.txt")}


def test_logs_with_any_name(spark):
    log = "\x012024-01-02T00:00:00+00:00\n\0caf\u00e9 \"x\".txt\0b.txt\0\x012024-01-03T00:00:00+00:00\n\0b.txt\0"
    rows = parse_log(spark.createDataFrame([("r", 0, log)], "repo_id string, log_ord int, log string")).collect()
    assert sorted(r.path for r in rows) == ["b.txt", "b.txt", "caf\u00e9 \"x\".txt"]
    quoted = spark.createDataFrame([("r", 0, '\x01d\n\n"caf\\303\\251.txt"\n')], "repo_id string, log_ord int, log string")
    with pytest.raises(Exception, match="without -z"):
        parse_log(quoted).collect()
