"""Corpus tables of the catalogue, from rows of the tests' own."""

from catalogue import corpora


def test_the_file_of_many_rules_is_put_together_from_slices(spark, tmp_path, monkeypatch):
    """In the order of the parts, null keys left out, keys that come twice kept; the same row for every repository."""
    keys = [None, None, 31, 4, 4, 17, 2, 90, 5, None, 8, 1000, 45]
    spark.createDataFrame([(k,) for k in keys], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    docs = [(i, f"text {i}", "en", f"src{i % 3}") for i in range(7)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = []
    for k in sorted(k for k in keys if k is not None):
        lines.append([f"doc_{k}.md", f"*{k}.py", f"/en/b{k % 7}/doc_{k}.log", f"doc_{k}*", f"!/de/*/doc_{k}.txt"])
    twice = [[line, line] for line in lines[1]]
    want = "\n".join(lines[0] + sum(twice, []) + sum(lines[3:], [])).encode()
    for most in (2, 10_000):
        monkeypatch.setattr(corpora, "PARTS_IN_SLICE", most)
        files = corpora.documents_with_many_rules(spark, str(tmp_path))
        assert files.dtypes == corpora.documents(spark, str(tmp_path)).dtypes
        rows = files.collect()
        found = [r for r in rows if r.path == ".gitignore"]
        assert len(rows) == 7 + 3 and sorted(r.repo_id for r in found) == ["src0", "src1", "src2"]
        assert {(bytes(r.content), r.size) for r in found} == {(want, len(want))}


def test_the_file_of_many_rules_without_parts(spark, tmp_path):
    spark.createDataFrame([], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "x", "en", "s")], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [bytes(r.content) for r in corpora.documents_with_many_rules(spark, str(tmp_path)).collect()] == [b"x", b""]
