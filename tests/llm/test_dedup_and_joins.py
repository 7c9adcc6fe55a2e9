import hashlib
import itertools
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from treeline.llm import set_join
from treeline.llm.components import connected_components, with_links
from treeline.llm.line_dedup import deduplicated_lines, without_lines
from treeline.llm.quotient import block_bits_of, decode_block, encode_block, exact_duplicates, merge_sorted, without_copies
from treeline.llm.set_join import near_copies, one_of_each, parity, shingle_sets

SCHEMA = "doc_id bigint, text string, source string, n string, id string, token string, keep_id string, _text string"
BASE = "The quick brown fox jumps over the lazy dog while nine more animals watch it from the other side of a river"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, low):
    words = WORD.findall(low(text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def ascii_low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def like(a, b):
    common = len(a & b)
    return bool(common) and 100 * common >= 80 * (len(a) + len(b) - common)


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies in a chain, ties, nulls, blank, short and very long texts, repeated rows, a shared passage."""
    words = (BASE + " " + BASE[::-1]).split()
    chain = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (3, 20, 38)]
    passage = " ".join(f"common{i}" for i in range(30))
    own = [passage + " " + " ".join(f"own{d}x{i}" for i in range(9)) for d in range(8)]
    texts = [BASE, BASE, BASE.upper(), BASE.replace(" ", "\n\t"), *chain, None, None, "", " \t\n", "one", "one", "two words", "ÀB c", "àb c", " ".join(f"w{i}" for i in range(30000)), *own]
    data = [(i, t) for i, t in enumerate(texts)] + [(0, BASE), (None, "one"), (5, "another text under a number that is there already")]
    return [(i, t, "s", "x", "y", "z", "k", "t") for i, t in data]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates(docs, rows, bits):
    got = sorted(map(tuple, exact_duplicates(docs, bits=bits).collect()), key=str)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i is not None and i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_one_row_of_each_text_stays(docs, rows):
    got = without_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r.text or "") for r in got.collect()) == sorted({r[1] or "" for r in rows})


def test_filters_are_lossless():
    rng = np.random.default_rng(1)
    runs = [np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64) >> np.uint64(4)) for _ in range(3)]
    runs = [r[(r >> np.uint64(60)) == 0] for r in runs]
    for r in runs:
        assert (decode_block(0, *encode_block(r, r, 4), 4) == r).all()
    prints, counts = merge_sorted([*runs, runs[0]], [np.ones(len(r), np.int64) for r in [*runs, runs[0]]])
    every = np.concatenate([*runs, runs[0]])
    assert [*zip(prints, counts)] == [*zip(*np.unique(every, return_counts=True))]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(empty).count() == 0
    assert near_copies(empty).count() == 0
    assert deduplicated_lines(empty).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 1), (3, 3), (None, 4), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10), (20, 7)] + [(100, 101 + i) for i in range(50)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {1: 1, 2: 1} | {i: 5 for i in (5, 6, 7, 8, 9, 10, 20)} | {i: 100 for i in range(100, 151)}


def test_near_copies(docs, rows):
    sets = [shingles(t, ascii_low) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if like(sets[a], sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    want = sorted(((i, len(s), least.get(root(k), i)) for k, ((i, *_), s) in enumerate(zip(rows, sets))), key=str)
    assert sorted(map(tuple, near_copies(docs).collect()), key=str) == want
    stay = one_of_each(docs)
    assert stay.columns == docs.columns
    with_words = [r for r in stay.collect() if WORD.search(r.text or "")]
    assert len({(r.doc_id, r.text) for r in with_words}) == len({root(k) for k, s in enumerate(sets) if s})


def test_shingles_are_the_words_of_the_contract():
    texts = ["a b c d e f", "A  b\tc\nd e F", "a b", None, "\x85a b c d e", "É b c d e", "é b c d e"]
    found = [len(s) for s in shingle_sets(texts)]
    assert found == [2, 2, 1, 0, 1, 1, 1]
    a, b, *_, upper, lower = shingle_sets(texts)
    assert (a == b).all() and (upper != lower).all()


def words(line):
    return frozenset(w for w in re.split("[\\x20\\x09-\\x0D]+", line.lower()) if w)


def test_lines_of_the_given_documents_against_brute_force(spark):
    """Every pair of lines, in order; lines, not documents, are what is many here."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    order = sorted((r.doc_id, k, words(x)) for r in docs.collect() for k, x in enumerate((r.text or "").split("\n")))
    want, seen = {}, []
    for i, k, s in order:
        want[i, k] = not s or not any(5 * len(s & t) >= 4 * len(s | t) for t in seen)
        if s:
            seen.append(s)
    got = {(r.doc_id, r.line_no): r.kept for r in deduplicated_lines(docs).collect()}
    assert got == want and 300 < sum(not kept for kept in got.values()) < len(got)


@pytest.mark.parametrize("n", [4, 5, 9, 12, 20, 40, 300])
def test_changed_words_in_long_and_short_lines(spark, n):
    """Lines of n words with ever more of them replaced: all that reach four fifths go, and no others."""
    base = [f"w{i}" for i in range(n)]
    lines = [" ".join([*base[k:], *(f"x{k}y{i}" for i in range(k))]) for k in range(0, max(2, n // 3))]
    lines += [" ".join(base + [f"more{i}" for i in range(k)]) for k in range(1, max(2, n // 2))]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id bigint, text string")
    sets = [words(x) for x in lines]
    want = {i: not any(5 * len(s & t) >= 4 * len(s | t) for t in sets[:i]) for i, s in enumerate(sets)}
    assert {r.doc_id: r.kept for r in deduplicated_lines(docs).collect()} == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "b", "é", "zz", " ", "  ", "\t", "\n", "\x0b", "\x85", "\u3000", "word"]), max_size=60).map("".join), st.sampled_from([1, 7, 1 << 22]))
def test_word_hashes_tell_words_apart(text, at_once):
    data = text.encode()
    want = data.lower().split()
    before, set_join.BYTES_AT_ONCE = set_join.BYTES_AT_ONCE, at_once
    try:
        starts, hashes = set_join.word_hashes(data.translate(set_join.PLAIN))
    finally:
        set_join.BYTES_AT_ONCE = before
    assert len(hashes) == len(want) and len(set(zip(want, hashes.tolist()))) == len(set(want)) == len(set(hashes.tolist()))
    assert [data[s:].lower().split()[0] for s in starts] == want


def test_lines(spark):
    line = BASE
    near = BASE.replace("river", "pond") + " again"
    texts = [
        (2, f"{line}\n\nshort\n{line.upper()}"), (1, f"first line of all with some more words in it\n{near}"), (3, f"short\n{line}\nShort line"),
        (4, None), (5, ""), (6, "\n"), (7, "x " * 3000 + "\n" + "x " * 3000), (None, "short"),
    ]
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id bigint, text string, mark string")
    order = sorted(((-1 if i is None else i, k, x) for i, t in texts for k, x in enumerate((t or "").split("\n"))))
    sets = [words(x) for _, _, x in order]
    kept = [not s or not any(s == sets[j] or like(s, sets[j]) for j in range(k)) for k, s in enumerate(sets)]
    lines = deduplicated_lines(docs)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.line_no, r.kept) for r in lines.collect())
    assert got == [(i, k, keep) for (i, k, _), keep in zip(order, kept)]
    left = {-1 if r.doc_id is None else r.doc_id: r.text for r in without_lines(docs, lines).collect()}
    for i, t in texts:
        key = -1 if i is None else i
        if t is not None:
            assert left[key] == "\n".join(x for (j, _, x), keep in zip(order, kept) if j == key and keep)
    assert left[4] is None


def test_a_group_of_near_copies_and_a_common_passage(spark):
    """Many near copies of one text, and many texts around one passage that do not link."""
    words = [f"w{i}" for i in range(60)]
    near = [(i, " ".join(words[: i % 60] + [f"n{i}"] + words[i % 60 + 1 :])) for i in range(150)]
    passage = " ".join(f"p{i}" for i in range(25))
    apart = [(1000 + i, passage + " " + " ".join(f"q{i}x{k}" for k in range(30))) for i in range(60)]
    docs = spark.createDataFrame(near + apart, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    assert all(got[i] == 0 for i, _ in near)
    assert all(got[i] == i for i, _ in apart)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.integers(0, 300), st.integers(0, 60))
def test_parities_never_hide_a_link(found, left_out, added):
    x = np.array(sorted(found), dtype=np.uint64)
    y = np.union1d(x[min(left_out, len(x) - 1) :], np.arange(added, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    odd = [np.array(parity(s), dtype=np.int64).view(np.uint64) for s in (x, y)]
    apart = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
    common = len(np.intersect1d(x, y))
    assert apart <= len(x) + len(y) - 2 * common
    if 100 * common >= 80 * (len(x) + len(y) - common):
        assert apart <= len(x) + len(y) - 2 * (((len(x) + len(y)) * 80 + 179) // 180)


def test_further_links_join_components(spark):
    """Components after further links are those of all links at once, singles and repeated links included."""
    first, more = [(1, 2), (2, 3), (10, 11), (20, 21)], [(3, 11), (30, 31), (31, 40), (21, 20), (11, 3)]
    schema = "a bigint, b bigint"
    rows = lambda df: sorted(map(tuple, df.select("node", "component").collect()))
    start = connected_components(spark.createDataFrame(first, schema))
    assert rows(with_links(start, spark.createDataFrame(more, schema))) == rows(connected_components(spark.createDataFrame(first + more, schema)))
    assert rows(with_links(start, spark.createDataFrame([], schema))) == rows(start)


def test_short_lines_whose_hashes_agree_in_their_low_bits(spark):
    """Of each pair, the words' token hashes have the same low 42 bits; they are different lines all the same."""
    pairs = [("w81498", "w415582"), ("w57040", "w8869762"), ("w1789493", "w3684965")]
    docs = spark.createDataFrame([(k, f"{a}\n{b}\n{a}") for k, (a, b) in enumerate(pairs)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.line_no, r.kept) for r in deduplicated_lines(docs).collect())
    assert got == [(k, i, i < 2) for k in range(3) for i in range(3)]


def test_blocks_follow_the_number_of_rows(docs):
    """A block has a bounded number of fingerprints, a filter a bounded number of run ends, and nothing is lost."""
    assert [block_bits_of(n) for n in (0, 15_000_000, 1 << 24)] == [10, 10, 10]
    assert all(1 << 13 <= n >> block_bits_of(n) <= 1 << 14 for n in (10**8, 10**9, 10**12))
    prints = np.unique(np.random.default_rng(4).integers(0, 2**64, 2000, dtype=np.uint64))
    for bits in (10, 16, 26):
        for r in ((prints >> np.uint64(bits)) | (np.uint64(5) << np.uint64(64 - bits)),):
            run_ends, remainders = encode_block(r, r, bits)
            assert len(run_ends) << bits <= max(1 << 22, 1 << bits) and (decode_block(5, run_ends, remainders, bits) == r).all()
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(exact_duplicates(docs, block_bits=20)) == rows(exact_duplicates(docs))


def test_sets_with_many_common_lists_meet_once(spark):
    """Twelve sets share forty tokens in a row and have ten of their own in front: 66 pairs, which had 40 rows each."""
    from treeline.llm.prefix_pairs import beside, cross_pairs, meetings

    rows = [(i, 50, p, i * 1000 + p if p < 10 and p % 5 else 10**6 + p) for i in range(12) for p in range(50)]
    postings = beside(spark.createDataFrame(rows, "id bigint, n int, pos int, token bigint"))
    anyway = lambda x, y: F.lit(True)
    met = meetings(postings, anyway).collect()
    assert {(r.a, r.b) for r in met} == set(itertools.combinations(range(12), 2)) and len(met) <= 3 * 66
    counted = lambda least: cross_pairs(postings, anyway, lambda overlap: F.lit(least)).count()
    assert (counted(37), counted(38)) == (66, 0)  # 45 to share, 3 and 2 of them in no common list


def test_lines_that_went_meet_no_others(spark, monkeypatch):
    """Forty near copies behind a line that links with none of them: a few pairs a line, where all pairs of the group were read."""
    from treeline.llm import line_dedup

    def line(i, *out):
        return " ".join(f"x{i}y{k}" if k in out else f"w{k}" for k in range(40))

    lines = [line(0, 0, 1, 2, 3, 4)] + [line(i, i % 10, (i * 7 + 3) % 10) for i in range(1, 41)]
    sets = [words(x) for x in lines]
    want = {i: not any(5 * len(s & t) >= 4 * len(s | t) for t in sets[:i]) for i, s in enumerate(sets)}
    real, taken = line_dedup.verified, []
    monkeypatch.setattr(line_dedup, "verified", lambda docs, pairs, told: taken.append(pairs.count()) or real(docs, pairs, told))
    docs = spark.createDataFrame(list(enumerate(lines))[::-1], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in deduplicated_lines(docs).collect()} == want
    assert sum(taken) <= 4 * len(lines)


def test_postings_of_the_line_join_move_once(spark, monkeypatch):
    """Both sides of the open join read one shuffle of four narrow numbers besides the tokens; before any pair is looked for, a class has two rows, not a prefix."""
    from treeline.llm import line_dedup

    spread, first = [], []
    real_open, real_first = line_dedup.open_pairs, line_dedup.first_pairs

    def watched(posted):
        pairs = real_open(posted)
        spread.append((posted.columns, pairs._jdf.queryExecution().executedPlan().toString()))
        return pairs

    monkeypatch.setattr(line_dedup, "open_pairs", watched)
    monkeypatch.setattr(line_dedup, "first_pairs", lambda classes: first.append(real_first(classes)) or first[0])
    lines = [" ".join(f"w{(i * 7 + k) % 90}" for k in range(20 + i % 100)) for i in range(60)]  # some above LONG
    lines += [x.replace("w1 ", "v1 ") for x in lines]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    sets = [words(x) for x in lines]
    want = {i: not any(5 * len(s & t) >= 4 * len(s | t) for t in sets[:i]) for i, s in enumerate(sets)}
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.kept for r in deduplicated_lines(docs).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and not all(want.values())
    columns, plan = spread[0]
    assert columns == ["token", "before", "id", "size", "odd0", "odd1"] and "ReusedExchange" in plan
    assert first[0].count() <= 4 * len(lines)
