"""Operators 11 to 13 against brute force, the tokenizer's own library and exact round trips."""

import hashlib
import math
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from treeline.llm.fill_middle import BoundarySet, Container, cut_text, fill_in_middle, restored
from treeline.llm.lexical import Best, best_documents, tiles
from treeline.llm.queries import op11_fill_in_middle, op13_lexical_search, tokenizer
from treeline.llm.token_counts import PieceCounter, counted

DOCS = "doc_id bigint, text string, n bigint, form string, output string, n_tokens string, item string, score string, rank string, terms string"
TEXTS = [None, "", "x", "plain words", "naïve café 你好 🙂🙂", "a<P>b", "<S>", "half <M", "<<S", "🙂" * 400, "é" * 40000 + "abc" * 30000, "ab\0c\r\n\td", "same", "same", "ﬁ Ａ ▁ ▁▁ x", " ", "   ", "\n\n"]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 7, "f", "o", "k", "i", "s", "r", "t") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=3000), st.sampled_from([1, 7, 300]))
def test_containers_select(bits, repeat):
    member = np.repeat(np.array(bits, dtype=bool), repeat)[: 1 << 16]
    held = Container.of(member)
    at = np.flatnonzero(member)
    assert all(held.select(k) == at[k] for k in range(0, len(at), max(1, len(at) // 50)))


def test_containers_take_three_forms():
    rng = np.random.default_rng(3)
    kinds = [Container.of(m).kind for m in (np.ones(1000, bool), np.arange(65536) % 3 == 0, np.arange(65536) % 900 == 0, rng.random(65536) < 0.5)]
    assert kinds == ["run", "bitmap", "array", "bitmap"]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.sampled_from([1, 900]))
def test_cuts_are_those_of_code_points(text, one, two, repeat):
    text = text.encode("utf-8", "ignore").decode() * repeat
    n, low, middle, p, m, s = cut_text(text.encode(), one, two)
    a, b = sorted((one % (len(text) + 1), two % (len(text) + 1)))
    assert (n, low, middle) == (len(text), a, b - a)
    assert (p.decode(), m.decode(), s.decode()) == (text[:a], text[a:b], text[b:])


def test_boundaries_over_several_containers():
    text = "你" * 30000 + "a" * 170000 + "🙂" * 40000
    data, marks = text.encode(), BoundarySet(text.encode())
    assert {c.kind for c in marks.containers} == {"run", "bitmap"}
    for k in (0, 1, 21845, 21846, 29999, 30000, 65535, 199999, 200000, 239999, 240000):
        assert data[: marks.select(k)].decode() == text[:k]


def middle_filled(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle(spark):
    texts = TEXTS * 6
    ids = [*range(len(texts) - 3), 4, 4, None]
    got = fill_in_middle(frame(spark, texts, ids)).withColumn("again", restored(F.col("form"), F.col("output"))).collect()
    want = Counter((i, *middle_filled(i, t), t or "") for i, t in zip(ids, texts, strict=True))
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in got) == want
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fill_in_middle(frame(spark, [])).collect() == []


def test_registered_fill_in_middle_restores_the_texts(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op11_fill_in_middle(spark, folder).collect()
    assert {r.doc_id: r.restored_sha256 for r in got} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}


@pytest.fixture(scope="module")
def counter():
    return PieceCounter(tokenizer("piece_bpe_32k.model"))


ALPHABET = st.sampled_from(list("ab e.,\n\t\r\0▁ é你🙂ﬁ0<s>") + ["  ", " the", "ing ", "　", "​"])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=60).map("".join), st.integers(1, 12), st.integers(1, 200))
def test_parts_count_as_the_whole(counter, text, chunk, batch):
    assert counter.splits
    want = [len(counter.model.encode(t)) for t in (text, text + text, " " + text)]
    assert counter.counts([text, text + text, " " + text], chunk, batch).tolist() == want


def test_token_counts(spark, counter):
    texts = [*TEXTS, "word " * 30000, "x" * 50000, "你好世界" * 9000, " " * 40000, "<s> </s> <unk> <0x41>"]
    ids = [*range(len(texts) - 2), 3, None]
    got = counted(frame(spark, texts, ids), tokenizer("piece_bpe_32k.model")).collect()
    sizes = [len(counter.model.encode(t or "")) for t in texts]
    want = Counter((i, len((t or "").encode()), n, n > 4096) for i, t, n in zip(ids, texts, sizes, strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert counted(frame(spark, []), tokenizer("piece_bpe_32k.model")).collect() == []


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def searched(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = Counter()
    for item_id, text in items:
        scores = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in words(text) if w in c)
            if score > 0:
                scores.append((-score, i is not None, i))
        for rank, (score, _, i) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out[item_id, rank, i, -score] += 1
    return out


def test_lexical_search(spark):
    rng = np.random.default_rng(11)
    pool = [f"w{i}" for i in range(60)] + ["Ärger", "ärger", "你好", "a_b", "X9", "x9", "co-op", "É"]
    weights = 1 / np.arange(1, len(pool) + 1)
    text = lambda n: " ".join(rng.choice(pool, n, p=weights / weights.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(300)] + [(400 + i, "w3 w5 same text") for i in range(50)]
    docs += [(500, None), (501, ""), (502, "!! --"), (None, "w3 w5 same text"), (7, "w3 w5 same text"), (503, "w1 " * 3000)]
    items = [(i, text(int(rng.integers(1, 25)))) for i in range(150)] + [(900, None), (901, "..."), (5, "W3 w5 w5"), (None, "x9 É"), (902, "nowhere"), (903, "w2 " * 500)]
    table = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in items], "item_id bigint, text string, doc_id string, score string, item string")
    for per_pass in (1 << 17, 300):
        got = best_documents(frame(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(5), table, 20, per_pass)
        assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()) == searched(docs, items, 20)
    assert best_documents(frame(spark, []), table).collect() == []
    assert best_documents(frame(spark, ["a"]), table.limit(0)).collect() == []


def test_tiles_hold_every_repeat_and_stay_exact():
    rng = np.random.default_rng(2)
    queries = [{int(t): int(rng.integers(1, 900)) for t in rng.choice(40, 12, replace=False)} for _ in range(10)]
    weights = rng.integers(0, 9000, 40)
    limit = 10**6 * 9000 * 300
    back = [Counter() for _ in queries]
    for tile in tiles(queries, weights, 7, 4, limit):
        assert len(tile.terms) <= 7 and ((weights[tile.terms] * 10**6) @ tile.times < limit).all()
        for row, term in enumerate(tile.terms):
            for j, times in enumerate(tile.times[row]):
                back[tile.first + j][int(term)] += int(times)
    for query, held in zip(queries, back, strict=True):
        assert {t: n for t, n in held.items() if n} == {t: n for t, n in query.items() if weights[t]}


def test_best_settles_ties_by_document():
    rng = np.random.default_rng(4)
    scores = rng.integers(0, 4, (500, 6))
    docs = rng.permutation(500)
    best = Best(6, 20)
    for begin in range(0, 500, 90):
        best.add(0, scores[begin : begin + 90], docs[begin : begin + 90], np.ones(len(docs[begin : begin + 90]), bool))
    for j in range(6):
        want = sorted((-s, d) for s, d in zip(scores[:, j].tolist(), docs.tolist(), strict=True) if s > 0)[:20]
        assert [(-s, d) for s, d in zip(best.score[best.item == j].tolist(), best.doc[best.item == j].tolist(), strict=True)] == want


def test_registered_search_is_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = searched([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items], 20)
    assert Counter(tuple(r) for r in op13_lexical_search(spark, folder).collect()) == want
