import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline.operators import refresh, rollup, skew, tree
from treeline.operators.tokens import token_models
from treeline.plans.project import Selection, show_tree

DRAWN = """.
├── folder_1/
│   └── file_3.txt
├── folder_2/
│   └── file_4.txt
├── file_1.txt
├── file_2.txt
└── README.md"""

MODELS = token_models(["chars-4"])


def drawn(lines):
    return "\n".join(r.line for r in lines.orderBy("repo_id", "place").collect())


def test_five_files(project):
    assert drawn(show_tree(project, show_stats=False)) == DRAWN
    assert drawn(show_tree(project, show_stats=False, rows_per_key=1)) == DRAWN


def test_labels(project):
    lines = drawn(show_tree(project, Selection(models=["chars-4", "chars-1"]))).split("\n")
    assert lines[0] == ". (77.00 B; chars-4:21; chars-1:77)"
    assert lines[1] == "├── folder_1/ (21.00 B; chars-4:6; chars-1:21)"


def make_files(seed, n=150):
    """Random files: path -> size, tokens, created, modified."""
    rng = random.Random(seed)
    names = ["a", "B", "b", "Ab", "aB", "z.py", "Z.py", ".x", "m1", "m2"]
    files = {}
    while len(files) < n:
        depth = rng.randint(1, 4)
        path = "/".join(rng.choice(names) for _ in range(depth - 1)) + ("/" if depth > 1 else "") + f"{rng.choice(names)}{rng.randint(0, 30)}"
        if any(p.startswith(path + "/") or path.startswith(p + "/") for p in files):
            continue
        day = [None, "", "2024-01-0%d" % rng.randint(1, 4), "2023-05-05"]
        files[path] = (rng.randint(0, 3) * 700, rng.choice([None, 1, 2, 3]), rng.choice(day), rng.choice(day))
    return files


def frame(spark, repos):
    rows = [(repo, p, *v) for repo, files in repos.items() for p, v in files.items()]
    return spark.createDataFrame(rows, "repo_id string, path string, size bigint, `tokens:chars-4` bigint, created string, modified string")


class Node:
    def __init__(self, name, is_dir):
        self.name, self.is_dir, self.children = name, is_dir, {}
        self.size, self.n, self.created, self.modified = 0, None, None, None


def build(files):
    root = Node("", True)
    for path, (size, n, created, modified) in files.items():
        node, parts = root, path.split("/")
        for part in parts[:-1]:
            node = node.children.setdefault(part, Node(part, True))
        leaf = node.children[parts[-1]] = Node(parts[-1], False)
        leaf.size, leaf.n, leaf.created, leaf.modified = size, n, created or None, modified or None

    def total(node):
        for c in node.children.values():
            total(c)
        if node.is_dir:
            kids = node.children.values()
            node.size = sum(c.size for c in kids)
            counts = [c.n for c in kids if c.n is not None]
            node.n = sum(counts) if counts else None
            node.created = min((c.created for c in kids if c.created), default=None)
            node.modified = max((c.modified for c in kids if c.modified), default=None)

    total(root)
    return root


def draw(root, sort_by, stats):
    keys = {
        "name": lambda c: (not c.is_dir, c.name.lower(), c.name),
        "size": lambda c: (not c.is_dir, -c.size, c.name.lower(), c.name),
        "chars-4": lambda c: (not c.is_dir, -(c.n or 0), c.name.lower(), c.name),
        "created": lambda c: (c.is_dir, c.created or "0000-00-00", c.name.lower(), c.name),
        "modified": lambda c: (c.is_dir, c.modified or "0000-00-00", c.name.lower(), c.name),
    }

    def label(node):
        if not stats:
            return ""
        size = f"{node.size:.2f} B" if node.size < 1024 else f"{node.size / 1024:.2f} KB"
        parts = [size]
        if node.n is not None:
            parts.append(f"chars-4:{node.n}")
        if node.created:
            parts.append(f"created: {node.created}")
        if node.modified:
            parts.append(f"modified: {node.modified}")
        return f" ({'; '.join(parts)})"

    lines = ["." + label(root)]

    def walk(node, indent):
        kids = sorted(node.children.values(), key=keys[sort_by], reverse=sort_by in ("created", "modified"))
        for i, c in enumerate(kids):
            last = i == len(kids) - 1
            lines.append(indent + ("└── " if last else "├── ") + c.name + ("/" if c.is_dir else "") + label(c))
            walk(c, indent + ("    " if last else "│   "))

    walk(root, "")
    return lines


@pytest.fixture(scope="module")
def repos():
    return {"r1": make_files(1), "r2": make_files(2, 60), "r3": {"only": (5, 1, "2024-01-01", None)}}


@pytest.mark.parametrize("sort_by", ["name", "size", "chars-4", "created", "modified"])
@pytest.mark.parametrize("rows_per_key", [skew.ROWS_PER_KEY, 4])
def test_against_a_recursive_drawing(spark, repos, sort_by, rows_per_key):
    files = frame(spark, repos)
    nodes = rollup.nodes(files, ["size", MODELS[0].column])
    lines = tree.tree_lines(nodes, sort_by, True, MODELS, rows_per_key)
    got = [(r.repo_id, r.line) for r in lines.orderBy("repo_id", "place").collect()]
    want = [(repo, line) for repo, fs in repos.items() for line in draw(build(fs), sort_by, True)]
    assert got == want


def test_sort_keys_are_checked(project):
    for sort_by in ("created", "modified", "chars-4", "nothing"):
        with pytest.raises(ValueError):
            show_tree(project, Selection(), sort_by)


def test_rank_of_crowded_groups_is_the_plain_rank(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("k"))
    df = df.unionByName(spark.range(20000).select(F.lit(7).cast("bigint").alias("g"), F.xxhash64("id").alias("k")))
    df = df.unionByName(spark.range(1).select(F.lit(None).cast("bigint").alias("g"), F.col("id").alias("k")))
    for group in (["g"], []):
        window = W.partitionBy(*group)
        plain = df.withColumn("rn", F.row_number().over(window.orderBy(F.col("k").desc())).cast("bigint")).withColumn("n", F.count(F.lit(1)).over(window))
        got = skew.rank_within(df, group, [F.col("k").desc()], total="n")
        assert plain.exceptAll(got).isEmpty() and got.count() == 25001


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_is_the_plain_join(spark, how):
    left = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    right = right.unionByName(right.where("k < 3"))
    plain = left.join(right, ["k"], how)
    salted = skew.salted_join(left, right, ["k"], how, F.col("id"), rows_per_key=100)
    assert salted.select("k", "id", "v").exceptAll(plain).isEmpty()
    assert plain.exceptAll(salted.select("k", "id", "v")).isEmpty()


# --- totals ------------------------------------------------------------------------------------------


def as_set(df, *columns):
    return {tuple(r) for r in df.select("repo_id", "path", "n_files", "size", "created", "modified").collect()}


def expected(repos):
    rows = set()
    for repo, files in repos.items():

        def walk(node, path):
            count = 0
            for c in node.children.values():
                below = f"{path}/{c.name}" if path else c.name
                count += walk(c, below) if c.is_dir else 1
            rows.add((repo, path, count, node.size, node.created, node.modified))
            return count

        walk(build(files), "")
    return rows


def test_totals_against_a_recursion(spark, repos):
    assert as_set(rollup.directories(frame(spark, repos))) == expected(repos)


def test_root_is_the_sum_of_files(spark, repos):
    files = frame(spark, repos)
    root = rollup.directories(files).where("path = ''").agg(F.sum("size"), F.sum("n_files")).first()
    assert tuple(root) == (sum(v[0] for fs in repos.values() for v in fs.values()), sum(map(len, repos.values())))


def as_set_of(df):
    return {tuple(sorted(r.asDict().items())) for r in df.collect()}


def test_refresh_multiplies_touched_directories_only(spark, repos):
    old = frame(spark, repos)
    before = refresh.rebuild(old)
    gone = old.where("path = 'no such'")
    plan = refresh.refresh(before, gone, gone).directories._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") == 1  # the totals of before, here not written down; the changes are
    with pytest.raises(ValueError):
        refresh.refresh(before, gone.drop("created"), gone)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_refresh_equals_rebuild(spark, repos, seed):
    rng = random.Random(seed)
    after = {}
    for repo, files in repos.items():
        changed = {p: v for p, v in files.items() if rng.random() > 0.15}
        for p in list(changed):
            if rng.random() < 0.1:
                changed[p] = (rng.randint(0, 9000), 1, rng.choice([None, "2022-01-01", "2024-01-02"]), rng.choice([None, "2025-01-01", "2023-05-05"]))
        changed |= {f"new{seed}/deep/er/{i}": (i, 1, "2020-01-01", "2026-01-01") for i in range(rng.randint(0, 3))}
        after[repo] = changed
    if seed == 3:
        after["r3"] = {}
    old, new = frame(spark, repos), frame(spark, after)
    gone, come = refresh.changes(old, new, ["size", "created", "modified"])
    done = refresh.refresh(refresh.rebuild(old), gone, come)
    assert as_set(done.directories) == as_set(rollup.directories(new))
    days = as_set_of(done.days)
    assert days == as_set_of(refresh.rebuild(new).days) and len(days) > 5
    # and on from there, back to where it began
    back = refresh.refresh(done, come, gone)
    assert as_set(back.directories) == expected(repos) and as_set_of(back.days) == as_set_of(refresh.rebuild(old).days)


def test_refresh_without_change(spark, repos):
    old = frame(spark, repos)
    gone, come = refresh.changes(old, old, ["size", "created", "modified"])
    assert gone.isEmpty() and come.isEmpty()
    assert as_set(refresh.refresh(refresh.rebuild(old), gone, come).directories) == expected(repos)


@pytest.mark.parametrize("order", ["name", "size", "modified"])
def test_line_numbers_are_those_of_the_drawing(spark, repos, order):
    nodes = rollup.nodes(frame(spark, repos))
    drawn = tree.tree_lines(nodes, order).orderBy("repo_id", "place").collect()
    want, at = {}, {}
    for r in drawn:
        at[r.repo_id] = at.get(r.repo_id, 0) + 1
        want[r.repo_id, r.path] = at[r.repo_id]
    assert {(r.repo_id, r.path): r.line_no for r in tree.line_numbers(nodes, order).collect()} == want


def test_lines_of_a_deep_tree(spark):
    rows = [("r", "/".join(f"d{i}" for i in range(n)) + "/f") for n in (1, 5, 60, 120)]
    nodes = rollup.nodes(spark.createDataFrame([(r, p, 1) for r, p in rows], "repo_id string, path string, size bigint"))
    got = {r.path: r.line_no for r in tree.line_numbers(nodes).collect()}
    assert got["d0"] == 2 and got["/".join(f"d{i}" for i in range(120)) + "/f"] == 122 and got["d0/f"] == max(got.values()) == 125


def test_totals_by_doubling_equal_those_by_ancestors(spark):
    files = frame(spark, {"r": make_files(3), "s": make_files(4)})
    sums = ["size", "tokens:chars-4"]
    own = rollup.own_totals(files, sums)
    plain, deep = rollup.roll_up(own, sums), rollup.roll_up_deep(own, sums)
    assert plain.columns == deep.columns
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, deep.collect()), key=str)
    assert rollup.roll_up_deep(own.limit(0), sums).count() == 0
    flat = rollup.own_totals(files.where("path not like '%/%'"), sums)
    assert list(map(tuple, rollup.roll_up_deep(flat, sums).collect())) == list(map(tuple, rollup.roll_up(flat, sums).collect()))


def test_two_thousand_levels(spark):
    """A chain of 2,000 folders with a file in every tenth; folders without a file of their own are summed too."""
    rows = [("r", "/".join([*["d"] * level, "file"]), level) for level in range(0, 2001, 10)]
    files = spark.createDataFrame(rows, "repo_id string, path string, size bigint")
    totals = rollup.roll_up_deep(rollup.own_totals(files))
    got = {(len(r.path) + 1) // 2: (r.n_files, r["size"]) for r in totals.collect()}
    assert got == {d: (sum(1 for _, _, s in rows if s >= d), sum(s for _, _, s in rows if s >= d)) for d in range(2001)}
