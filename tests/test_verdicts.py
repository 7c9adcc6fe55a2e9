import random
import re

import pytest
from conftest import PROJECT

from treeline.operators import contents, verdicts
from treeline.operators.verdicts import RuleSet, disposition, judge, within_level


def verdict(files, user=(), defaults=False, **options):
    judged = judge(files, RuleSet.of(files, user, defaults), **options)
    return {r.path: r for r in judged.collect()}


def split(files, user=()):
    rows = verdict(files, user)
    return {p for p, r in rows.items() if not r.is_ignored}, {p for p, r in rows.items() if r.is_ignored}


CASES = {
    "names and a folder": ("file_1.txt\nfolder_1/*\n", [], {"file_1.txt", "folder_1/file_3.txt"}),
    "ignore file and user": ("file_1.txt\n", ["file_2.txt"], {"file_1.txt", "file_2.txt"}),
    "the user overrides": ("file_1.txt\n", ["!file_1.txt"], set()),
}


@pytest.mark.parametrize("case", CASES)
def test_project(corpus, case):
    ignore, user, removed = CASES[case]
    kept, gone = split(corpus(PROJECT | {".gitignore": ignore}), user)
    assert gone == removed
    assert kept == set(PROJECT) - removed | {".gitignore"}


def test_last_match_wins_and_credits(corpus):
    rows = verdict(
        corpus({p: "x" for p in ("a.log", "keep.log", "dir/x.py", "plain.txt", "both.json")}),
        ["*.log", "!keep.log", "dir/", "!nothing", "*.json", "both.*", "!plain.*"],
        True,
    )
    assert {p: (r.is_ignored, r.reason, r.credited) for p, r in rows.items()} == {
        "a.log": (True, "pattern", ["*.log", "*.log"]),
        "keep.log": (False, None, ["!keep.log"]),
        "dir/x.py": (True, "pattern", ["dir/"]),
        "plain.txt": (False, None, ["!plain.*"]),
        "both.json": (True, "pattern", ["*.json", "both.*"]),
    }
    assert [(m.origin, m.pattern) for m in rows["keep.log"].matched] == [("default", "*.log"), ("user", "*.log"), ("user", "!keep.log")]


def test_negation_inside_an_ignored_folder(corpus):
    kept, _ = split(corpus({"d/a": "x", "d/b": "x"}), ["d/", "!d/a"])
    assert kept == {"d/a"}


def test_binary_files_meet_no_rule(corpus):
    files = corpus({".git/index": b"\x00", "a.pyc": "x", "b.png": b"", "t.txt": "x", ".git/HEAD": "ref"})
    without = verdict(files, ["t.txt"], True)
    assert {p: (r.is_ignored, r.reason) for p, r in without.items()} == {
        ".git/index": (True, "binary"),
        "a.pyc": (True, "binary"),
        "b.png": (True, "binary"),
        "t.txt": (True, "pattern"),
        ".git/HEAD": (True, "pattern"),
    }
    assert all(r.matched == [] for r in without.values() if r.is_binary)
    included = verdict(files, ["t.txt"], True, include_binary=True)
    assert {p for p, r in included.items() if r.is_ignored} == {"t.txt", ".git/HEAD"}
    assert {p: r.binary_extension for p, r in included.items()} == {
        ".git/index": "", "a.pyc": ".pyc", "b.png": ".png", "t.txt": None, ".git/HEAD": None,
    }


def test_binary_sample(corpus):
    files = corpus(
        {
            "empty": b"",
            "last": b"a" * 65535 + b"\x00",
            "beyond": b"a" * 65536 + b"\x00",
            "unreadable": None,
            "latin": b"caf\xe9",
            "control": bytes(range(1, 32)),
            "UP.PNG": b"text",
            "x.tar.gz": b"text",
            ".zip": b"text",
        }
    )
    rows = verdict(files)
    assert {p for p, r in rows.items() if r.is_binary} == {"last", "beyond", "unreadable", "UP.PNG", "x.tar.gz"}


def test_own_detector(corpus):
    files = corpus({"a": "x", "b": "y"})
    judged = judge(files, RuleSet((), False), detector=lambda path, content: path == "b")
    assert {r.path for r in judged.where("is_binary").collect()} == {"b"}


NESTED = {
    ".gitignore": "*.tmp\nbuild/\n",
    "sub/.gitignore": "x\n/y\n!keep.tmp\nin/*.c\n",
    "sub/deep/.gitignore": "!z.tmp\n*.c\n",
    "[ab]/.gitignore": "f\n",
    "a.tmp": "1",
    "x": "1",
    "y": "1",
    "sub/x": "1",
    "sub/y": "1",
    "sub/deep/x": "1",
    "sub/keep.tmp": "1",
    "sub/deep/keep.tmp": "1",
    "sub/deep/z.tmp": "1",
    "sub/deep/m.c": "1",
    "sub/in/m.c": "1",
    "sub/in/k/m.c": "1",
    "sub/build/o": "1",
    "a/f": "1",
    "[ab]/f": "1",
    "c/f": "1",
}
NESTED_REMOVED = {"a.tmp", "sub/x", "sub/deep/keep.tmp", "sub/deep/m.c", "sub/in/m.c", "sub/build/o", "a/f"}


@pytest.mark.parametrize("rows_per_key", [1_000_000, 1, 3])
def test_nested_ignore_files(corpus, rows_per_key):
    rows = verdict(corpus(NESTED), rows_per_key=rows_per_key)
    assert {p for p, r in rows.items() if r.is_ignored} == NESTED_REMOVED
    assert rows["sub/deep/z.tmp"].credited == ["!sub/deep/z.tmp"]


def test_rules_stay_in_their_repository(corpus):
    files = corpus([("r1", ".gitignore", "a\n"), ("r1", "a", "1"), ("r2", "a", "1"), ("r2", "b", "1")])
    judged = judge(files, RuleSet.of(files, ["b"], False))
    assert {(r.repo_id, r.path) for r in judged.where("is_ignored").collect()} == {("r1", "a"), ("r2", "b")}


def test_measured_table_gives_the_same_verdict(corpus):
    files = corpus(NESTED)
    measured = contents.measure(files)
    judged = judge(measured, RuleSet.of(measured, (), False))
    assert {r.path for r in judged.where("is_ignored").collect()} == NESTED_REMOVED


def test_dispositions_partition_all(corpus):
    judged = judge(corpus({p: "1" for p in ("a.log", "b", "c/d")}), RuleSet(["c/"]))
    parts = [{r.path for r in disposition(judged, k).collect()} for k in ("included", "removed", "all")]
    assert parts[0] | parts[1] == parts[2] and not parts[0] & parts[1]
    assert parts[0] == {"b"}
    with pytest.raises(ValueError):
        disposition(judged, "some")


def test_level(corpus):
    files = corpus({p: "1" for p in ("a", "d/b", "d/e/c")})
    assert {r.path for r in within_level(files, 1).collect()} == {"a", "d/b"}
    assert within_level(files, None).count() == 3


def test_random_rules_against_a_loop(spark, corpus):
    """The verdict against a plain loop over compiled rules in Python."""
    rng = random.Random(3)
    names = ["a", "b", "c.py", "d.log", "e~"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(120)})
    paths = [p for p in paths if not any(q.startswith(p + "/") for q in paths)]
    user = ["a/b", "!a/b/c.py", "*.log", "c.py/", "!d.log", "b/**/a", "/e~", "!*/e~", "a?", "[ab]/d.log"]

    def test(rule, path):
        p, s = path + "/", "/" + path
        return {
            "component": lambda: rule.key in "/" + p,
            "inside": lambda: rule.key in s,
            "anchored": lambda: p.startswith(rule.key),
            "under": lambda: path.startswith(rule.key),
            "regex": lambda: re.match(rule.key.removeprefix("(?d)"), path) is not None,
        }[rule.kind]()

    rules = RuleSet(user, True)
    rows = {r.path: r for r in judge(corpus({p: "x" for p in paths}), rules).collect()}
    for path in paths:
        hits = [r for r in rules.compiled_defaults + rules.compiled_user if test(r, path)]
        ignored = bool(hits) and hits[-1].include
        assert rows[path].is_ignored == ignored, path
        assert rows[path].credited == [h.pattern for h in hits if h.include == ignored], path


def test_no_shuffle_without_ignore_files(corpus):
    judged = verdicts.judge(corpus({"a": "x"}), RuleSet(["*.x"]))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
