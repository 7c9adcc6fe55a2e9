"""Operators against their SQL or brute force on made tables with links, ties, nulls and empty tables."""

import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline
from treeline.llm.oracle import ORACLE
from treeline.llm.queries import QUERIES, RULES
from treeline.llm.slots import sharded
from treeline.llm.url_rules import filtered

FOLDER = "/root/testdata/sf0.001"


def linked_pages(seed, n=120):
    """Pages of hosts with and without rules that name each other as canonical or by refresh, in every form of a link."""
    draw = random.Random(seed)
    hosts = ["a.net", "b.net", "C.net", "x.example.org", "example.org", "shop.com", "ok.org", "d.info", "e.info", "f.info"]
    paths = [f"{p}{k}" for p in ("/", "/en/1", "/es/2", "/fr/3", "/de/4", "/p/5") for k in range(30)]
    url = lambda: f"{draw.choice(['http', 'https'])}://{draw.choice(hosts)}{draw.choice(paths)}{draw.choice(['', '', '?utm_a=1', '?q=1&utm_b=2', '#top', '?q=1&amp;r=2'])}"
    target = lambda: draw.choice([url, url, lambda: f"/en/1{draw.randrange(40)}", lambda: f"other{draw.randrange(40)}", lambda: f"//shop.com/de/{draw.randrange(40)}", lambda: ""])()
    rows = []
    for i in range(n):
        tags = draw.choice(["", "", '<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical>", '<meta http-equiv="refresh" content="0; url={}">', "<meta http-equiv=refresh content='5;URL={}'>", '<link rel=icon href="{}">'])
        rows.append((i // 2 if i % 10 == 0 else i, url(), f"<head>{tags.format(target())}</head><p>{i}"))
    return [*rows, (900, None, None), (901, "", "x"), (902, "no scheme/de/1", '<link rel=canonical href="http://shop.com/de/4">'), (None, "http://a.net/q", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_url_filter_against_sql(spark, seed):
    rows = linked_pages(seed)
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.execute(f"SELECT page_id, host, path, rule, verdict, alias_of FROM ({ORACLE['op1_url_filter']})").fetchall()
    got = [tuple(r) for r in filtered(spark.createDataFrame(rows, "page_id bigint, url string, html string"), RULES).collect()]
    assert Counter(got) == Counter(want)
    by_alias = [r for r in got if r[3] is None and r[4] == "block"]
    assert by_alias and any(r[3] is None and r[4] == "allow" and r[5] for r in got)


def test_shards_by_brute_force(spark):
    """Sizes and checksums of every given row, gapless places, shards equal within the largest slot, equal texts together."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = sharded(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    text = {r.doc_id: (r.text or "").encode() for r in docs}
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t) + 8, zlib.crc32(t)) for i, t in text.items())
    load, places, slot_bytes, homes = Counter(), defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
        slot_bytes[r.shard, r.virtual_slot] += r.size
        homes[text[r.doc_id]].add(r.shard)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    total = sum(load.values())
    weight = Counter()
    for r in got:
        weight[text[r.doc_id]] += r.size
    assert all(len(s) == 1 or weight[t] > total / 48 for t, s in homes.items())
    # no single move of a slot from the fullest to the emptiest shard evens them out any further
    full, empty = max(range(24), key=lambda s: load[s]), min(range(24), key=lambda s: load[s])
    gap = load[full] - load[empty]
    assert not [b for (s, _), b in slot_bytes.items() if s == full and 0 < b < gap]


def test_pipeline_on_an_empty_table(spark):
    """Every stage takes a table without rows, and one whose rows all go, and returns no rows with its columns."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "12 !")], "doc_id bigint, text string")
    nothing = docs.unionByName(nothing, allowMissingColumns=True)
    for given in (docs, nothing):
        current = given
        for name, stage in pipeline.STAGES:
            current = stage(spark, current, FOLDER)
            assert current.count() == 0, name
            assert name == "best-fit packing" or current.columns == docs.columns


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_rows_without_values(spark, stage):
    """Nulls in every column, empty texts and repeated rows crash no stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    nulls = spark.createDataFrame([(None,), (7_000_001,), (7_000_001,)], "doc_id bigint")
    given = docs.unionByName(nulls, allowMissingColumns=True)
    kept = pipeline.STAGES[stage][1](spark, given, FOLDER)
    assert {r.doc_id for r in kept.select("doc_id").collect()} <= {r.doc_id for r in given.select("doc_id").collect()}


def test_registered_queries_with_sql():
    assert {"op1_url_filter", "op5_ngram_join", "op7_exact_dedup", "op9_line_dedup", "op11_fill_in_middle", "op13_lexical_search"} <= set(ORACLE) <= set(QUERIES)
