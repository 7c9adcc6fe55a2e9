import pytest

from treeline.operators import report
from treeline.operators.verdicts import RuleSet, judge
from treeline.plans.project import Selection, ignore_report

FILES = {
    ".gitignore": "*.tmp\n!keep.tmp\n*.log\n",
    "a.tmp": "x",
    "keep.tmp": "x",
    "b.log": "x",
    "c.pyc": "x",
    "d/e.png": "x",
    "d/nul": b"\x00",
    "f.txt": "1234",
    "g.TXT": "12",
}


@pytest.fixture(scope="module")
def tables(corpus):
    return {k: v.collect() for k, v in ignore_report(corpus(FILES), Selection(["f.*", "*.tmp"])).items()}


def test_summary(tables):
    assert {r.category: r["count"] for r in tables["summary"]} == {
        "Total files checked": 9,
        "Files ignored": 7,
        "Binary files found": 3,
        "Binary files blocked": 3,
        "Files included": 2,
    }


def test_patterns_with_the_first_origin_that_holds_them(tables):
    assert {(r.origin, r.pattern): r.hits for r in tables["patterns"]} == {
        ("gitignore", "*.tmp"): 4,
        ("default", "*.log"): 2,
        ("user", "f.*"): 1,
    }


def test_extensions(tables):
    assert {r.binary_extension: (r.files, r.blocked) for r in tables["binary_extensions"]} == {".pyc": (1, 1), ".png": (1, 1)}
    assert "".join(r.extensions for r in sorted(tables["extension_strings"], key=lambda r: r.ordinal)) == "*.png,*.pyc"
    assert {r.extension: (r.files, r.bytes) for r in tables["extensions"]} == {"gitignore": (1, 22), "txt": (1, 2)}


def test_strings(tables):
    assert {r.origin: r.patterns for r in tables["pattern_strings"]} == {"default": "*.log", "gitignore": "*.tmp", "user": "f.*"}


def test_ignored_files(tables):
    assert [(r.line, r.file, r.reason, r.is_binary, r.patterns) for r in sorted(tables["ignored_files"], key=lambda r: r.line)] == [
        (1, "a.tmp", "pattern", False, "*.tmp, *.tmp"),
        (2, "b.log", "pattern", False, "*.log, *.log"),
        (3, "c.pyc", "binary", True, "-"),
        (4, "d/e.png", "binary", True, "-"),
        (5, "d/nul", "binary", True, "-"),
        (6, "f.txt", "pattern", False, "f.*"),
        (7, "keep.tmp", "pattern", False, "*.tmp, *.tmp"),
    ]


@pytest.mark.parametrize("n, last", [(19, "f018.log"), (20, "f019.log"), (21, "... and 1 more"), (27, "... and 7 more")])
def test_overflow_line(corpus, n, last):
    judged = judge(corpus({f"f{i:03d}.log": "x" for i in range(n)}), RuleSet())
    rows = sorted(report.ignored_files(judged).collect(), key=lambda r: r.line)
    assert rows[-1].file == last and len(rows) == min(n, 21)


def test_the_limit_reaches_the_map_side(corpus):
    judged = judge(corpus({"a": "x"}), RuleSet())
    plan = report.ignored_files(judged)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_kept_by_negation_is_credited_to_it(corpus):
    judged = judge(corpus({"a.log": "x", "b.log": "x"}), RuleSet(["!a.*"]))
    assert {(r.origin, r.pattern, r.hits) for r in report.pattern_hits(judged, ()).collect()} == {("user", "!a.*", 1), ("default", "*.log", 1)}


@pytest.mark.parametrize("by", [("repo_id",), ()])
def test_strings_come_item_by_item(corpus, by):
    judged = judge(corpus({f"x.e{i}": b"\x00" for i in range(5)}), RuleSet())
    rows = report.extension_strings(report.binary_extensions(judged, by), by).collect()
    assert "".join(r.extensions for r in sorted(rows, key=lambda r: r.ordinal)) == "*.e0,*.e1,*.e2,*.e3,*.e4"


@pytest.mark.parametrize("by", [("repo_id",), ()])
def test_all_ignored_files(corpus, by):
    judged = judge(corpus({f"f{i:03d}.log": "x" for i in range(50)}), RuleSet())
    rows = report.ignored_files(judged, None, by).collect()
    assert sorted((r.line, r.file) for r in rows) == [(i + 1, f"f{i:03d}.log") for i in range(50)]
