import json
import random
import re

import pytest
from pyspark.sql import functions as F

from treeline.operators import rules
from treeline.operators.rules import _path_regex, compile_rule

#: pattern -> kind, paths it matches, paths it does not
CLASSES = {
    "name": ("component", ["name", "a/name", "name/x", "a/name/b"], ["names", "a/xname", "nam"]),
    "*.ext": ("component", ["a.ext", ".ext", "d/a.ext", "a.ext/b"], ["a.extra", "ext", "a.ext2/b"]),
    "lit*": ("component", ["lit", "literal", "a/lit.x", "lit1/b"], ["alit", "a/xlit"]),
    "*~": ("component", ["a~", "d/a~", "a~/x"], ["~a"]),
    "*": ("component", ["a", "a/b", ".x"], []),
    "name/": ("inside", ["name/x", "a/name/x", "name/a/b"], ["name", "a/name", "names/x"]),
    "*.d/": ("inside", ["x.d/f", "a/x.d/f"], ["x.d", "a/x.d"]),
    "/a/b": ("anchored", ["a/b", "a/b/c"], ["x/a/b", "a/bc", "a"]),
    "a/b": ("anchored", ["a/b", "a/b/c"], ["x/a/b", "a/bc"]),
    "/top": ("anchored", ["top", "top/x"], ["a/top", "topper"]),
    "a/b/": ("under", ["a/b/c", "a/b/c/d"], ["a/b", "x/a/b/c"]),
    "/fr/": ("under", ["fr/x"], ["fr", "a/fr/x"]),
    "a/*": ("under", ["a/b", "a/b/c"], ["a", "b/a/c"]),
    "a/**": ("under", ["a/b", "a/b/c"], ["a", "b/a/c"]),
    "/*": ("under", ["a", "a/b"], []),
    "**/x": ("regex", ["x", "a/x", "a/b/x", "x/y"], ["ax", "a/xb"]),
    "a/**/b": ("regex", ["a/b", "a/c/b", "a/c/d/b/e"], ["ab", "x/a/b", "a/cb"]),
    "**": ("regex", ["a", "a/b"], []),
    "**/": ("regex", ["a/b", "a/b/c"], ["a"]),
    "*/": ("regex", ["a/b"], ["a"]),
    ".env.*.local": ("regex", [".env.x.local", "a/.env..local", ".env.x.local/y"], [".env.local", ".env.x/y.local"]),
    "a?c": ("regex", ["abc", "d/axc"], ["ac", "a/c", "abbc"]),
    "[ab].x": ("regex", ["a.x", "d/b.x"], ["c.x", "ab.x"]),
    "[!ab].x": ("regex", ["c.x"], ["a.x"]),
    "[a-c]1": ("regex", ["b1"], ["d1"]),
    "[]x]y": ("regex", ["]y", "xy"], ["y", "ay"]),
    "open[x": ("regex", ["open[x"], ["openx"]),
    r"\!keep": ("regex", ["!keep"], ["keep"]),
    r"\#x": ("regex", ["#x"], ["x"]),
    "a b": ("component", ["a b", "d/a b"], ["a"]),
    "a.b+c": ("component", ["a.b+c"], ["axb+c"]),
    "foo*/bar": ("regex", ["foo1/bar", "foo/bar/x"], ["a/foo/bar", "foo/x/bar"]),
    "sub//x": ("anchored", [], ["sub/x", "x"]),
}


def evaluate(spark, patterns, paths):
    compiled = [compile_rule(p) for p in patterns]
    tests = rules._tests(F.col("p"), compiled)
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    return {r[0]: list(r[1]) for r in df.select("p", F.array(*tests)).collect()}


def test_pattern_classes(spark):
    everything = sorted({p for _, yes, no in CLASSES.values() for p in yes + no})
    held = evaluate(spark, list(CLASSES), everything)
    for i, (pattern, (kind, yes, no)) in enumerate(CLASSES.items()):
        assert compile_rule(pattern).kind == kind, pattern
        for path in yes:
            assert held[path][i], (pattern, path)
        for path in no:
            assert not held[path][i], (pattern, path)


def test_native_tests_agree_with_the_regular_expression(spark):
    """Every shortcut against the general translation, over random patterns and paths."""
    rng = random.Random(7)
    names = ["a", "b", "ab", "a.x", ".x", "b~", "aa.x"]
    globs = names + ["*", "**", "*.x", "a*", "*b", "?", "[ab]", "a*x", "*~"]
    patterns = set()
    while len(patterns) < 250:
        parts = [rng.choice(globs) for _ in range(rng.randint(1, 3))]
        patterns.add(rng.choice(["", "", "/"]) + "/".join(parts) + rng.choice(["", "", "/"]))
    patterns = sorted(patterns)
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(300)})
    held = evaluate(spark, patterns, paths)
    for i, pattern in enumerate(patterns):
        parts = pattern.strip("/").split("/") if pattern.strip("/") else [""]
        floating = len(parts) == 1 and not pattern.startswith("/") and parts[0] != "**"
        regex = re.compile(_path_regex(parts, floating, pattern.endswith("/")).removeprefix("(?d)"))
        for path in paths:
            assert held[path][i] == bool(regex.match(path)), (pattern, path, compile_rule(pattern))


def test_lines_without_a_rule():
    assert [compile_rule(x) for x in ("", "   ", "# note", "/")] == [None] * 4


def test_negation_and_pattern_text():
    rule = compile_rule("!*.json")
    assert (rule.pattern, rule.include, rule.kind, rule.key) == ("!*.json", False, "component", ".json/")


@pytest.mark.parametrize("line", ["!", "//", "ends\\"])
def test_unreadable_rules(line):
    with pytest.raises(ValueError):
        compile_rule(line)


def test_rules_as_data_give_the_same_matches(spark):
    patterns = [p for p in CLASSES if compile_rule(p).kind != "none"]
    compiled = [compile_rule(p) for p in patterns]
    paths = sorted({p for _, yes, no in CLASSES.values() for p in yes + no})
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    inline = df.select("p", F.transform(rules.matches_of_list(F.col("p"), compiled, "user"), lambda m: m["pattern"])).collect()
    as_data = F.from_json(F.lit(json.dumps([rule._asdict() | rules.index_entry(rule.pattern) for rule in compiled])), rules.RULES_TYPE)
    listed = df.select("p", F.transform(F.filter(as_data, lambda r: rules.holds_row(F.col("p"), r)), lambda r: r["pattern"])).collect()
    assert inline == listed
    assert any(len(r[1]) > 3 for r in inline)


def test_ignore_files(corpus):
    files = corpus(
        {
            ".gitignore": "# head\n\n  *.log  \n!keep.log\r\n/\n",
            "sub/.gitignore": "x\n/y\n!z/\n",
            "we[i]rd/d/.gitignore": "x\n",
            "#hash/.gitignore": "x\n",
            "!bang/.gitignore": "x\n",
            "latin/.gitignore": b"\xe9\n",
            "notgitignore": "x\n",
            "x.gitignore": "x\n",
        }
    )
    got = {r.base: [(x.pattern, x.include) for x in r.rules] for r in rules.ignore_file_rules(files).collect() if r.rules}
    assert got == {
        "": [("*.log", True), ("!keep.log", False)],
        "sub": [("sub/x", True), ("sub//y", True), ("!sub/z/", False)],
        "we[i]rd/d": [("we[i]rd/d/x", True)],
        "!bang": [("!bang/x", False)],
    }
