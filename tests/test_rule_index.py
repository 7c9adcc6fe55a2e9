"""Rules met by keys against the general translation, and counted credits against lists."""

import random
import re

import pytest
from pyspark.sql import functions as F

from treeline.operators import report, rule_index, rules, verdicts
from treeline.operators.rules import _path_regex, index_entry, rule_parts
from treeline.operators.verdicts import RuleSet, judge
from treeline.plans import project

ENTRIES = {
    "name": ("name", "", "name", False, ""),
    "name/": ("name", "", "name", True, ""),
    "**/name": ("name", "", "name", False, ""),
    "*.ext": ("tail", "", ".ext", False, ""),
    "a/**/lit*/": ("head", "", "lit", True, "a"),
    "*": ("path", "", "", True, ""),
    "/*": ("path", "", "", True, ""),
    "/a/b": ("path", "", "a/b", False, ""),
    "!a/b/": ("path", "", "a/b", True, ""),
    "a/*": ("path", "", "a", True, ""),
    "a/**/*": ("path", "", "a", True, ""),
    "a/b/*.c": ("tail in", "a/b", ".c", False, ""),
    "/x*": ("head in", "", "x", False, ""),
    "a/?b/c": ("rest", "a", "", False, ""),
    "a?": ("rest", "", "", False, ""),
    "sub//x": ("rest", "sub", "", False, ""),
    "we[i]rd/d/x": ("rest", "", "", False, ""),
}


@pytest.mark.parametrize("line", ENTRIES)
def test_entries(line):
    assert tuple(index_entry(line).values()) == ENTRIES[line]


@pytest.fixture(scope="module")
def many(corpus):
    """A corpus with ignore files at several depths, of rules of every kind."""
    rng = random.Random(17)
    names = ["a", "b", "ab", "a.x", ".x", "b~", "aa.x", "a.x.b"]
    globs = names + ["*", "**", "*.x", "a*", "*b", "?", "[ab]", "a*x", "*~"]

    def line():
        parts = [rng.choice(globs) for _ in range(rng.randint(1, 3))]
        return rng.choice(["", "", "!"]) + rng.choice(["", "", "/"]) + "/".join(parts) + rng.choice(["", "", "/"])

    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(220)})
    paths = [p for p in paths if not any(q.startswith(p + "/") for q in paths)]
    texts = {(r, base): [line() for _ in range(n)] for r, base, n in (("r", "", 120), ("r", "a", 40), ("r", "a/b", 25), ("r", "[ab]", 10), ("s", "", 60), ("s", "ab", 30))}
    files = [(r, p, "x") for r in "rst" for p in paths]
    files += [(r, f"{base}/.gitignore".lstrip("/"), "\n".join(lines)) for (r, base), lines in texts.items()]
    return files, texts


def expected(files, texts):
    """Every rule tried on every file of its repository, by one regular expression each."""
    out = {}
    compiled = []
    for (repo, base), lines in texts.items():
        for nth, line in enumerate(lines):
            mark, body = ("!", line[1:]) if line.startswith("!") else ("", line)
            pattern = f"{mark}{base}/{body}" if base else line
            include, parts, only_inside, floating = rule_parts(pattern)
            regex = re.compile(_path_regex(parts, floating and parts[0] != "**", only_inside).removeprefix("(?d)"))
            compiled.append((repo, (0 if not base else base.count("/") + 1, base, nth), pattern, include, regex))
    compiled.sort(key=lambda c: c[:2])
    for repo, path, _ in files:
        hits = [(pattern, include) for r, _, pattern, include, regex in compiled if r == repo and regex.match(path)]
        ignored = bool(hits) and hits[-1][1]
        out[repo, path] = (ignored, [p for p, include in hits if include == ignored])
    return out


@pytest.mark.parametrize("rows_per_key", [1_000_000, 2])
def test_verdicts_and_credits_against_all_rules(corpus, many, rows_per_key):
    files, texts = many
    df = corpus(files)
    rows = judge(df, RuleSet.of(df, (), False), rows_per_key=rows_per_key).collect()
    want = expected(files, texts)
    assert {(r.repo_id, r.path): (r.is_ignored, r.credited) for r in rows} == want
    assert sum(len(c) > 3 for _, c in want.values()) > 20


def test_counted_credits_are_those_of_the_lists(corpus, many):
    files, texts = many
    df = corpus(files).withColumn("is_binary", F.endswith("path", F.lit("~")))
    select = RuleSet.of(df, ["ab/", "!*.x"], True)
    listed = judge(df, select)
    hits = verdicts.rule_hits(df, select)
    counted = judge(df, select, patterns=False, hits=hits)
    assert {tuple(r) for r in counted.select("repo_id", "path", "is_ignored", "reason").collect()} == {
        tuple(r) for r in listed.select("repo_id", "path", "is_ignored", "reason").collect()
    }
    for by in (("repo_id",), ()):
        assert sorted(map(tuple, report.pattern_hits(counted, by, hits).collect())) == sorted(map(tuple, report.pattern_hits(listed, by).collect()))
        for most in (5, None):
            shown = [sorted(map(tuple, t.collect()), key=str) for t in (report.ignored_files(counted, most, by, hits), report.ignored_files(listed, most, by))]
            assert shown[0] == shown[1]


def test_keyed_rules_are_met_by_equi_joins(spark, corpus):
    """10,000 rules in one file; none is tried by a test of its own."""
    lines = "\n".join(f"f{i}.txt\n*{i}.c\nd/x{i}*\n!/d/f{i}.c\nd/*z{i}" for i in range(2000))
    df = corpus({".gitignore": lines} | {f"d/f{i}.c": "x" for i in range(40)} | {f"f{i}.txt": "x" for i in range(1990, 2010)} | {"d/x77": "x", "d/yz5": "x"})
    index = rules.ignore_file_rules(df).select(F.explode("rules").alias("r"))
    assert index.where("r.meets = 'rest'").count() == 0 and index.count() == 10_000
    judged, _ = project.judged_with_hits(df, project.Selection(use_defaults=False), patterns=False, once=True)
    ignored = {r.path for r in judged.where("is_ignored").collect()}
    assert ignored == {f"f{i}.txt" for i in range(1990, 2000)} | {"d/x77", "d/yz5"}
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_rules_with_inner_wildcards_are_tried_where_their_literal_is_shown(spark, corpus, monkeypatch):
    """2,000 expressions in one file against 300 files below their directory."""
    lines = "\n".join(f"!/d/*/f{i}.c\n/d/?/g{i}*x" for i in range(1000))
    df = corpus({".gitignore": lines} | {f"d/e/f{i}.c": "x" for i in range(100)} | {f"d/e/g{i}/h": "x" for i in range(100)} | {f"d/e/z{i}": "x" for i in range(100)})
    index = rule_index.rule_index(rules.ignore_file_rules(df))
    assert index.where("meets = 'rest'").count() == 2000
    assert index.groupBy(F.spark_partition_id()).count().count() > 1  # one file, but not one task
    monkeypatch.setattr(rule_index, "holds_row", lambda path, rule: F.lit(True))
    tried = rule_index.match_rules(df.select("repo_id", "path"), rules.ignore_file_rules(df), once=True).by_file
    assert tried.count() == 100 + 190  # f{i}.c once; g{i} and, of two digits, its beginning


@pytest.mark.parametrize(
    "line, end",
    [("a/?b/c", ("name", "c")), ("a?", ("head", "a")), ("sub//x", ("name", "x")), ("/d/*/x*yz", ("tail", "yz")), ("a/[bc]/**", ("head", "")), ("*[ab]c]", ("head", "")), (r"d/?/x\*/**", ("head", "x")), ("x/y/**/**/", ("head", ""))],
)
def test_ends(line, end):
    assert tuple(rules.rule_end(line).values()) == end


def test_texts_come_in_pieces_of_whole_lines(spark, corpus, monkeypatch):
    monkeypatch.setattr(rules, "PIECE_BYTES", 8)
    monkeypatch.setattr(rules, "STRETCH_BYTES", 40)
    monkeypatch.setattr(rules, "_LOOK_BYTES", 4)
    rng = random.Random(5)
    texts = {"empty": "", "ends": "\n" * 50, "one": "x" * 300, "long": "a\n" + "y" * 170 + "\nb\n" * 9}
    texts |= {f"t{i}": "".join(rng.choice(["a", "é", "日", "\n", "*"]) for _ in range(rng.randint(1, 200))) for i in range(60)}
    df = spark.createDataFrame([*texts.items(), ("none", None)], "name string, text string")
    for whole in (False, True):
        rows = rules.text_in_pieces(df, "text", "at", whole).collect()
        got = {n: sorted((r.at, r.text) for r in rows if r.name == n and r.at is not None and (r.text or not texts[n])) for n in texts}
        for name, text in texts.items():
            assert "".join(t for _, t in got[name]) == text
            assert all(t.endswith("\n") for _, t in got[name][:-1])
            assert [a for a, _ in got[name]] == [len("".join(t for _, t in got[name][:i]).encode()) for i in range(len(got[name]))]
        assert max(len(t) for _, t in got["ends"]) <= 8 and len(got["ends"]) >= 6
        assert sorted(r.name for r in rows if r.at is None) == sorted([*texts, "none"] if whole else [])


def test_no_written_cell_is_as_long_as_an_ignore_file(corpus, monkeypatch):
    """A file of 200 KB of rules: neither its text nor an array of its lines is ever one cell."""
    lines = "\n".join(f"name_{i}.txt" for i in range(15000))
    df = corpus({".gitignore": lines, "name_7.txt": "x", "name_x.txt": "x", "d/.gitignore": "!name_9.txt", "d/name_9.txt": "x"})
    written = []
    cut = project.cut
    monkeypatch.setattr(project, "cut", lambda table: written.append(cut(table)) or written[-1])
    monkeypatch.setattr(rule_index, "cut", project.cut)
    told = project.ignore_report(df, project.Selection(use_defaults=False))
    assert {(r.pattern, r.hits) for r in told["patterns"].collect()} == {("name_7.txt", 1), ("!d/name_9.txt", 1)}
    longest = [table.agg(*[F.max(F.length(c)) for c, kind in table.dtypes if kind == "string"]).first() for table in written]
    assert len(written) > 3 and max(n or 0 for row in longest for n in row) < 8192


def test_lines_that_no_node_shows_are_not_read(corpus, many, monkeypatch):
    """The same verdicts and credits where only lines are read that a node may show, and few of them."""
    files, texts = many
    monkeypatch.setattr(rule_index, "MANY_PIECES", 0)
    df = corpus(files)
    assert {(r.repo_id, r.path): (r.is_ignored, r.credited) for r in judge(df, RuleSet.of(df, (), False)).collect()} == expected(files, texts)
    lines = "\n".join(f"f{i}.txt\n*{i}.c\n/d/x{i}*\n!/d/*/f{i}.c\nd{i}/" for i in range(2000))
    df = corpus({".gitignore": lines} | {f"d/e/f{i}.c": "x" for i in range(40)} | {"f1999.txt": "x", "d/x77": "x", "d8/z": "x"})
    index = rule_index.rule_index(rules.ignore_file_rules(df), df.select("repo_id", "path"))
    patterns = {r.pattern for r in index.collect()}
    wanted = {"f1999.txt", "d8/", "/d/x7*", "/d/x77*"} | {f"*{i}.c" for i in range(40)} | {f"!/d/*/f{i}.c" for i in range(40)}
    assert wanted <= patterns and len(patterns) < len(wanted) + 60
    with pytest.raises(Exception, match="in the ignore file"):
        judge(df, RuleSet.of(corpus({".gitignore": "a\nx?\\", "b": ""}), (), False)).collect()


def test_ends_of_lines_are_those_of_the_rules(spark):
    rng = random.Random(23)
    signs = ["a", "b", "*", "**", "/", "!", " ", "\t", "?", "[", "]", "\\", "#", "é", "\u2028", ".", "-"]
    lines = sorted({"".join(rng.choice(signs) for _ in range(rng.randint(1, 6))) for _ in range(6000)})
    told = {r.line: r.end for r in spark.createDataFrame([(x,) for x in lines], "line string").withColumn("end", rules.line_end(F.col("line"))).collect()}
    found = 0
    for line, end in told.items():
        for base in ("", "x/y", "*", "#q") if end else ():
            rule = rules._line_rule(base, line)  # all of them can be read
            found += rule is not None
            assert rule is None or rule_parts(rule["pattern"])[1][-1] == end
            assert end.count("*") == 0 or (end.count("*") == 1 and len(end) > 1 and "*" in (end[0], end[-1]))
    assert found > 2000
    assert [told.get(x) or spark.range(1).select(rules.line_end(F.lit(x))).first()[0] for x in ("!/de/*/doc_1.txt", "*1.py", "doc_1*", "a/b/", " x\t")] == ["doc_1.txt", "*1.py", "doc_1*", "b", "x"]
