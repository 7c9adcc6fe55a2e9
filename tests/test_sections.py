import xml.etree.ElementTree as ET
from dataclasses import replace
from pathlib import Path
from urllib.parse import unquote

import pytest
from conftest import PROJECT
from pyspark.sql import functions as F

from treeline.operators import sections
from treeline.plans import project
from treeline.plans.project import Selection, summarize
from treeline.sources.tables import bucketed, files_table

DRAWN = """.
├── folder_1/
│   └── file_3.txt
├── folder_2/
│   └── file_4.txt
├── file_1.txt
├── file_2.txt
└── README.md
"""
ORDER = sorted(PROJECT)


def document(rows, repo="r"):
    return "".join(r.chunk for r in rows.where(F.col("repo_id") == repo).orderBy("place", "path").collect())


def test_text_document(project):
    body = "".join(f"## {p}\n\n```\n{PROJECT[p]}\n```\n\n" for p in ORDER)
    assert document(summarize(project)) == f"Project Structure:\n```\n{DRAWN}```\n\n{body}"


def test_markdown_document(project):
    body = "".join(f"## {p}\n\n```{p.split('.')[1]}\n{PROJECT[p]}\n```\n\n" for p in ORDER)
    assert document(summarize(project, form="markdown")) == f"# Project Structure\n\n```\n{DRAWN}```\n\n{body}"


def test_xml_document(project):
    body = "".join(
        f'<document index="{i}">\n<source>{p}</source>\n<document_content>\n<![CDATA[\n{PROJECT[p]}\n]]>\n</document_content>\n</document>\n'
        for i, p in enumerate(ORDER, 1)
    )
    want = f"<documents>\n<structure>\n<![CDATA[\n{DRAWN}]]>\n</structure>\n{body}</documents>\n"
    assert document(summarize(project, form="xml")) == want


def test_structure_only(project):
    assert document(summarize(project, only_structure=True)) == f"Project Structure:\n```\n{DRAWN}```\n"


def rendered(spark, look, rows):
    df = spark.createDataFrame([("r", *r) for r in rows], "repo_id string, path string, text string, created string, modified string")
    df = df.withColumn("has_text", F.col("text") != "")
    return {r.path: (r.idx if look.numbered else 0, r.section) for r in sections.sections(df, look).collect()}


ROWS = [
    ("a.py", "x = 1", None, None),
    ("b.py", "y = 2", "2024-01-01", "2024-06-01"),
    ("c.py", "", None, None),
    ("d/style.css", "code ``` with", "2024-01-01", None),
    ("e<&>.xml", "some ]]> content ]]>", "", "2024-06-01"),
    ("noext", "n", None, None),
]


def test_text_sections(spark):
    got = rendered(spark, sections.text_layout(), ROWS)
    assert got == {
        "a.py": (0, "## a.py\n\n```\nx = 1\n```\n\n"),
        "b.py": (0, "## b.py\n\n---\ncreated: 2024-01-01\nmodified: 2024-06-01\n---\n```\ny = 2\n```\n\n"),
        "d/style.css": (0, "## d/style.css\n\n---\ncreated: 2024-01-01\n---\n```\ncode ''' with\n```\n\n"),
        "e<&>.xml": (0, "## e<&>.xml\n\n---\nmodified: 2024-06-01\n---\n```\nsome ]]> content ]]>\n```\n\n"),
        "noext": (0, "## noext\n\n```\nn\n```\n\n"),
    }


def test_own_delimiter(spark):
    got = rendered(spark, sections.text_layout("~~~", "-"), [("a", "x ~~~ ``` y", None, None)])
    assert got["a"][1] == "## a\n\n~~~\nx - ``` y\n~~~\n\n"


def test_markdown_sections(spark):
    got = rendered(spark, sections.markdown_layout(), ROWS)
    assert got["b.py"][1] == "## b.py\n\n---\ncreated: 2024-01-01\nmodified: 2024-06-01\n---\n\n```py\ny = 2\n```\n\n"
    assert got["d/style.css"][1] == "## d/style.css\n\n---\ncreated: 2024-01-01\n---\n\n```css\ncode ``` with\n```\n\n"
    assert got["noext"][1] == "## noext\n\n```\nn\n```\n\n"


def test_xml_sections_parse(spark):
    got = rendered(spark, sections.xml_layout(), ROWS)
    assert len(got) == 5
    tree = ET.fromstring("<documents>" + "".join(s for _, s in got.values()) + "</documents>")
    found = {d.find("source").text: d for d in tree.findall("document")}
    assert found["e<&>.xml"].find("document_content").text.strip() == "some ]]> content ]]>"
    assert found["b.py"].get("index") == "2"
    assert [c.tag for c in found["b.py"].find("metadata")] == ["created", "modified"]
    assert found["a.py"].find("metadata") is None
    assert [c.tag for c in found["e<&>.xml"].find("metadata")] == ["modified"]


def test_unknown_format(project):
    with pytest.raises(ValueError):
        summarize(project, form="html")


def test_numbers_of_a_crowded_repository(spark):
    df = spark.range(300).select(F.lit("r").alias("repo_id"), F.format_string("f%03d", "id").alias("path"))
    got = sections.number_files(df).collect()
    assert sorted((r.idx, r.path) for r in got) == [(i + 1, f"f{i:03d}") for i in range(300)]


def test_written_bundles(spark, corpus, tmp_path):
    files = corpus([("r1", p, c) for p, c in PROJECT.items()] + [("r2", "only.md", "a\n\nb"), ("r3", "x.log", "gone")])
    rows = summarize(files)
    sections.write_bundles(rows, str(tmp_path / "out"), partitions=3)
    for repo in ("r1", "r2"):
        parts = sorted(Path(tmp_path / "out" / f"repo_id={repo}").glob("part-*"))
        assert "".join(p.read_text() for p in parts) == document(rows, repo)
    assert document(rows, "r2").endswith("## only.md\n\n```\na\n\nb\n```\n\n")
    # a repository of which nothing is kept has its root and no sections
    assert document(rows, "r3") == "Project Structure:\n```\n.\n```\n"


def test_a_split_repository_gives_the_same_document(corpus):
    files = corpus({f"d{i % 3}/f{i:02d}.txt": f"text {i}\n" for i in range(40)})
    assert document(summarize(files, rows_per_key=5)) == document(summarize(files))


def test_removed_binaries_and_dates(spark):
    rows = [("r", "a.pyc", "123"), ("r", "b.txt", "t"), ("r", "c.log", "l")]
    raw = spark.createDataFrame(rows, "repo string, path string, text string")
    files = files_table(raw, F.col("repo"), F.col("path"), F.col("text"), mtime=F.lit("2024-03-02 10:00:00").cast("timestamp"))
    text = document(summarize(files, Selection(keep="removed", include_dates=True)))
    assert "## a.pyc\n\n---\ncreated: 2024-03-02\nmodified: 2024-03-02\n---\n```\nbinary content (3 bytes)\n```" in text
    assert "## c.log" in text and "b.txt" not in text
    included = document(summarize(files, Selection(include_binary=True)))
    assert "a.pyc" in included and "c.log" not in included


def test_level_and_all(corpus):
    files = corpus({"a": "1", "d/b": "2", "d/e/c.log": "3"})
    assert "c.log" in document(summarize(files, Selection(keep="all")))
    near = document(summarize(files, Selection(keep="all", level=1)))
    assert "## d/b" in near and "d/e" not in near


def test_ignore_files_below_the_level_still_count(corpus):
    files = corpus({"a": "1", "d/b": "2", "d/.gitignore": "x\n!c\n", "d/e/.gitignore": "y\n", "d/x": "3"})
    text = document(summarize(files, Selection(level=1)))
    assert "## d/b" in text and "d/e" not in text and "## d/x" not in text
    assert "## a" in document(summarize(files, Selection(level=0)))


def nested_corpus(corpus):
    files = {f"{r}/d{i % 4}/f{i}.md": "x" * (i % 9) + f"\nnumber {i} äöü" for i in range(60) for r in ("a", "b")}
    rows = [(r, p, c) for p, c in files.items() for r in ("one", "two words+%", "007")]
    return corpus([*rows, ("one", "a/.gitignore", "f1*.md\n"), ("one", ".gitignore", "/b/d2/\n"), ("empty", "x", "")])


@pytest.mark.parametrize("span", [sections.SPAN, 50])
def test_positions_are_those_of_the_written_files(spark, corpus, tmp_path, monkeypatch, span):
    monkeypatch.setattr(sections, "SPAN", span)
    rows = summarize(nested_corpus(corpus))
    folder = str(tmp_path / "out")
    sections.write_bundles(rows, folder, partitions=7)
    found = sorted(Path(folder).rglob("part-*"))
    listing = spark.createDataFrame([(f"file:{f}", f.stat().st_size) for f in found], "path string, size bigint")
    manifest = sections.positions(rows)
    spans = sections.located(manifest, sections.written_parts(listing)).collect()
    files = {(unquote(f.parent.name.removeprefix("repo_id=")), f.name): f.read_bytes() for f in found}
    chunks = {(r.repo_id, tuple(r.place), r.path): r.chunk.encode() for r in rows.collect()}
    assert len(files) > 4
    got = {(r.repo_id, tuple(r.place), r.path): files[r.repo_id, r.part][r.offset_in_part : r.offset_in_part + r.bytes] for r in spans}
    assert got == chunks
    for repo in {k[0] for k in chunks}:
        whole = b"".join(files[k] for k in sorted(files) if k[0] == repo)
        assert whole == b"".join(c for k, c in sorted(chunks.items()) if k[0] == repo)
        for r in manifest.where(F.col("repo_id") == repo).collect():
            assert whole[r.offset : r.offset + r.bytes] == chunks[r.repo_id, tuple(r.place), r.path]


def test_one_pass_gives_the_documents_of_two(corpus):
    files = nested_corpus(corpus)
    for select in (Selection(["*5.md"]), Selection(keep="removed"), Selection(keep="all", level=1, models=["chars-4"])):
        once = summarize(files, select)
        twice = summarize(files, replace(select, materialise=False))
        for repo in ("one", "two words+%", "007", "empty"):
            assert document(once, repo) == document(twice, repo)


def test_contents_are_scanned_once_and_stay_where_they_are(spark, corpus, tmp_path):
    look = sections.text_layout()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    nested_corpus(corpus).write.parquet(str(tmp_path / "plain"))
    plain = spark.read.parquet(str(tmp_path / "plain")).where("path not like '%gitignore'")
    once = plan(project.kept_with_sections(plain, Selection(["*5.md"]), look))
    assert once.count("FileScan") == 1 and "Exchange" not in once
    table = bucketed(nested_corpus(corpus), "nested_corpus", 3, str(tmp_path / "bucketed"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kept = project.kept_with_sections(table, Selection(), look)
        told = plan(kept)
        assert "SortMergeJoin" in told and "Bucketed: true" in told and told.count("Exchange") == 1  # the decisions, not the contents
        assert kept.where("repo_id = 'one' and path like 'b/d2/%'").isEmpty() and kept.count() > 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table nested_corpus")
