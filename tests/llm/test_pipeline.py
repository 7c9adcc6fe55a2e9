"""The stages against brute force on a small fixture, and the registered queries on the smallest tables."""

import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline
from treeline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LAST = ["doc_id", "ids_crc32", "length", "offset", "piece", "sequence_id", "start"]


@pytest.fixture(scope="module")
def docs(spark):
    en = "the house of the old man was near the river and nobody in the village knew who had built it there"
    de = "das haus des alten mannes stand am fluss und niemand im dorf wusste wer es dort gebaut hatte und warum"
    rows = [(i, f"{(en, de)[i % 2]} number{i} " + " ".join(f"{'ab'[i % 2]}{i}x{k}" for k in range(12)), ("en", "de")[i % 2], f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[4][1], "en", "s0") for i in range(5)]  # copies
    rows += [(200, rows[6][1] + " end", "en", "s1"), (300, "12345 !!", "en", "s0"), (301, None, None, None), (302, "", "de", "s1")]
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stages(spark, docs):
    assert [len(s) for s in pipeline.STAGES] == [2] * 5
    rows, current = {r.doc_id: r for r in docs.collect()}, docs
    language, exact, near, mix, pack = [f for _, f in pipeline.STAGES]

    current = language(spark, docs, FOLDER)
    assert current.columns == docs.columns
    assert {r.doc_id for r in current.collect()} == set(rows) - {300, 301, 302}
    current = exact(spark, current, FOLDER)
    assert {r.doc_id for r in current.collect()} == set(rows) - {300, 301, 302, 4, 100, 101, 102, 103}
    current = near(spark, current, FOLDER)
    left = set(rows) - {300, 301, 302, 4, 100, 101, 102, 103, 200}
    assert {r.doc_id for r in current.collect()} == left
    mixed = mix(spark, current, FOLDER).collect()
    words, size = Counter(), Counter()
    for r in mixed:
        words[r.source] += len(r.text.split())
    for i in left:
        size[rows[i].source] += len(rows[i].text.split())
    weights = {"s0": 3, "s1": 1, "s2": 2}
    capped = {s for s in size if 1.5 * sum(size.values()) * weights[s] / 6 > 2 * size[s]}
    assert all(words[s] == 2 * size[s] for s in capped) and abs(sum(words.values()) - 1.5 * sum(size.values())) <= 3
    packed = pack(spark, spark.createDataFrame(mixed, docs.schema), FOLDER)
    assert sorted(packed.columns) == LAST and packed.count() >= len(mixed)


def test_run(spark):
    got = pipeline.run(spark, FOLDER)
    assert sorted(got.columns) == LAST and got.count() > 0


@pytest.mark.parametrize("name", ["op2_best_fit_packing", "op3_language_id", "op4_virtual_slots"])
def test_queries_return_the_whole_table(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = QUERIES[name](spark, FOLDER).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs}
    if name.startswith("op3"):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
