import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from treeline.llm.graph_index import build_graph, beam_search, nearest_neighbours, robust_prune
from treeline.llm.language import compressors, held_out, identified, judge, judged, learn
from treeline.llm.url_rules import filtered
from treeline.llm.tree_matching import Tree, matched
from treeline.llm.wrapper import Page, extracted, named_other, parsed

ENGLISH = "the weather was fine and the children went out to play with their friends in the garden of the house"
GERMAN = "das wetter war gut und die kinder gingen hinaus um mit ihren freunden im garten des hauses zu spielen"


def test_language(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        lang, words = (("en", ENGLISH), ("de", GERMAN))[i % 2]
        rows.append((i, " ".join(rng.choice(words.split(), 40)), lang, "x"))
    odd = [(500, None, "en", "x"), (501, "", None, "x"), (502, "12 34 ?!", "de", "x"), (503, ENGLISH.upper() * 3000, None, "x"), (None, GERMAN, "de", "x"), (0, GERMAN, None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, score string")
    dictionaries = learn(docs, ~held_out(F.col("doc_id")))
    assert sorted(dictionaries) == ["de", "en"]
    found = identified(docs, dictionaries)
    got = found.collect()
    assert sorted(found.columns) == ["doc_id", "lang", "lang_pred", "rejected", "score", "text"] and len(got) == len(rows) + len(odd)
    assert all(r.lang_pred == r.lang and not r.rejected and 0 < r.score <= 1 for r in got if r.doc_id is not None and 0 < r.doc_id < 200)
    by_id = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in got}
    assert all(by_id[i] == ("und", 0.0, True) for i in (500, 501, 502))
    assert by_id[503][0] == "en" and by_id[None][0] == "de"
    assert identified(docs.limit(0), dictionaries).count() == 0
    assert {r.lang_pred for r in identified(docs, {}).collect()} == {"und"}
    # a tie is a narrow margin
    same = compressors({"a": b" x y z ", "b": b" x y z "})
    assert judge("x y z", same) == ("a", 0.0)


def test_short_texts_that_come_out_equal_in_bytes(spark):
    """Single words and pairs are told by finer code lengths, and none is rejected for being short."""
    words = {"de": GERMAN.split() * 3, "en": ENGLISH.split() * 3}
    dictionaries = {lang: f" {' '.join(w)} ".encode() for lang, w in words.items()}
    by_language = compressors(dictionaries)
    one, two = set(words["en"]) - set(words["de"]), set(words["de"]) - set(words["en"])
    texts = [(w, "en") for w in sorted(one)] + [(w, "de") for w in sorted(two)] + [("the th", "en"), ("gut wett", "de")]
    assert any(len({len(c.compress(f" {t} ".encode())) for c in by_language.values()}) == 1 for t, lang in texts if lang == "en")
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id bigint, text string, lang string")
    got = identified(docs, dictionaries).collect()
    assert [(r.text, r.lang_pred, r.rejected) for r in got if r.lang_pred != r.lang or r.rejected] == [] and len(got) == len(texts)


@pytest.mark.parametrize("n", [300, 1500])
def test_texts_between_two_languages_are_rejected(n):
    """Where a word is less than the margin, the mixes that turn from one language to the other are rejected, the texts of one language are not."""
    rng = np.random.default_rng(n)
    by_language = compressors({lang: f" {' '.join(rng.choice(w.split(), 3000))} ".encode() for lang, w in (("de", GERMAN), ("en", ENGLISH))})
    en, de = rng.choice(ENGLISH.split(), n), rng.choice(GERMAN.split(), n)
    told = [judged(" ".join([*en[: n - k], *de[:k]]), by_language) for k in range(0, n + 1, max(1, n // 100))]
    at = [lang for lang, _, _ in told].index("de")
    assert told[at - 1][2] or told[at][2]
    assert told[0][0] == "en" and told[-1][0] == "de" and not told[0][2] and not told[-1][2] and sum(r for _, _, r in told) < len(told) / 4


def test_learning_never_sees_what_is_held_out(spark):
    rows = [(i, "kept" if i % 2 else "secret", "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    data = learn(docs, F.col("doc_id") % 2 == 1)["en"]
    assert b"kept" in data and b"secret" not in data


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "bad.net", "/")]


def verdicts(spark, pages, redirects=None):
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string, host string, rule string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filtered(frame, RULES, redirects).collect()}


def test_rules(spark):
    urls = {
        1: "https://WWW.Example.org/es/1?q=/fr/", 2: "http://example.org/en/1#x", 3: "a.com/de/1", 4: "x://a.com/de/1", 5: "http://a.com", 6: "http://notcom/de/", 7: None, 8: "", 9: "http://ÀB.com/fr/x://y",
        10: "http://org", 11: "http://badexample.org/es/", 12: "http://a.com?x=/de/",
    }
    got = verdicts(spark, [(i, u, None, "h", "r") for i, u in urls.items()])
    assert got == {
        1: ("www.example.org", "/es/1", "example.org/es/", "block"), 2: ("example.org", "/en/1", "org/", "allow"), 3: ("", "", None, "allow"),
        4: ("a.com", "/de/1", "com/de/", "block"), 5: ("a.com", "", None, "allow"), 6: ("notcom", "/de/", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("Àb.com", "/fr/x://y", "com/fr/", "allow"), 10: ("org", "", None, "allow"),
        11: ("badexample.org", "/es/", "org/", "allow"), 12: ("a.com", "", None, "allow"),
    }


def test_decisions_follow_redirects_and_canonical_links(spark):
    link = '<link href="{}" rel=canonical>'
    pages = [
        (1, "http://a.net/1", link.format("https://bad.net/x")),  # a block by way of a target that is no page
        (2, "http://b.net/2#top", '<META HTTP-EQUIV="refresh" content="0; url=/3">'),  # a chain: 2, 3, 1
        (3, "http://b.net/3", link.format("http://a.net/1")),
        (4, "http://c.net/4", link.format("http://ok.org/4")),  # an explicit allow precedes the block beside it
        (5, "http://d.net/5", link.format("http://c.net/4") + link.format("//bad.net/5")),
        (6, "http://ok.org/6", link.format("http://bad.net/6")),  # its own rule stays
        (7, "http://e.net/7", None),
        (8, "http://f.net/8", None),
        (8, "http://f.net/8", None),
    ]
    redirects = spark.createDataFrame([("http://f.net/8", "http://bad.net/8"), (None, "x")], "from_url string, to_url string")
    got = verdicts(spark, [(*p, "h", "r") for p in pages], redirects)
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block"}
    assert verdicts(spark, []) == {}


PAGE = """<html><head><title>t</title><script>var x = "</p>";</script></head><body><header>Site</header><nav><a href=/>{n}</a></nav>
<div class="cookie-notice">We use cookies</div><p>Same everywhere</p>
<article><h1>Title {n}</h1><p>First &amp; <b>bold</b>  text&#33; {n}<p>Second<br>line {n}<ul><li>one {n}<li>two</ul><div class=ad>Buy {n}</div><section class="comments"><p>Nice {n}</p></section></article>
<aside>More</aside><form>Name</form><footer>Foot {n}</footer></body></html>"""


def test_main_text(spark):
    pages = [(i, f"http://h{i % 2}.net/{i}", PAGE.format(n=i)) for i in range(12)]
    pages += [(100, None, None), (101, "http://one.net/", ""), (102, "http://one.net/2", "<p>only</p> loose &lt;text&gt;"), (103, "u", "<div>" * 3000 + "deep" + "</div>" * 10), (3, "http://h1.net/3", PAGE.format(n=3))]
    frame = spark.createDataFrame([(*p, "a", "b") for p in pages], "page_id bigint, url string, html string, host string, template string")
    got = extracted(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(pages)
    texts = {r[0]: r[2] for r in found}
    for i in range(12):
        assert texts[i] == f"Title {i}\nFirst & bold text! {i}\nSecond line {i}\none {i}\ntwo"
    assert texts[100] == texts[101] == "" and texts[102] == "only\nloose <text>" and texts[103] == "deep"
    assert all(r[3] == len(r[2]) for r in found)
    assert extracted(frame.limit(0)).count() == 0


def test_constant_nodes_are_template(spark):
    body = "<div class=top><p>Welcome to our site</p></div><div class=body><p>Story {n} goes on for a while</p></div>"
    assert texts_of(spark, [body.format(n=i) for i in range(5)]) == {i: f"Story {i} goes on for a while" for i in range(5)}
    # copies of one page teach nothing
    assert set(texts_of(spark, [body] * 5).values()) == {"Welcome to our site\nStory {n} goes on for a while"}
    assert Page(parsed("a<p>b")).texts == ["a", "b"]


def best(a, b, x=0, y=0):
    """Simple tree matching by its definition."""
    if a.label[x] != b.label[y]:
        return 0
    xs, ys = a.children[x], b.children[y]
    table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, p in enumerate(xs):
        for j, q in enumerate(ys):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + best(a, b, p, q))
    return 1 + table[-1][-1]


def parents(tree):
    return {c: at for at, below in enumerate(tree.children) for c in below}


def test_tree_matching_against_its_definition():
    rng = np.random.default_rng(4)

    def some_tree():
        depth = [0]
        for _ in range(rng.integers(0, 25)):
            depth.append(int(rng.integers(1, min(depth[-1] + 1, 4) + 1)))
        return Tree(depth, [0, *rng.integers(0, 3, len(depth) - 1).tolist()])

    for _ in range(300):
        a, b = some_tree(), some_tree()
        found = matched(a, b)
        pairs = [(x, y) for x, y in enumerate(found) if y >= 0]
        assert len(pairs) == best(a, b)
        assert all(a.label[x] == b.label[y] for x, y in pairs) and [y for _, y in pairs] == sorted({y for _, y in pairs})
        assert all(found[parents(a)[x]] == parents(b)[y] for x, y in pairs if x)
    deep = Tree(list(range(5000)), [0] * 5000), Tree(list(range(4999)), [0] * 4998 + [1])
    assert sum(y >= 0 for y in matched(*deep)) == 4998
    wide = Tree([0, *[1] * 3000], [0, *rng.integers(0, 9, 3000).tolist()]), Tree([0, *[1] * 2000], [0, *rng.integers(0, 9, 2000).tolist()])
    assert 500 < sum(y >= 0 for y in matched(*wide)) <= 2001
    assert matched(Tree([0], [1]), Tree([0], [2])) == [-1] and matched(Tree([], []), Tree([], [])) == []


def test_names_of_other_parts():
    assert all(map(named_other, ["ad", "ad-slot-3", "x comment-list", "site-header", "cookie-notice", "related-posts", "share_buttons", "banner", "page-footer"]))
    assert not any(map(named_other, ["", "search-results", "share-prices", "notice-board", "article-header", "post-header", "advance", "shadow", "navy", "headline", "commentary"]))


def test_article_text_is_not_dropped_for_its_names(spark):
    pages = [
        '<div class="search-results"><p>What the search found.</p></div>', '<div id="share-prices"><p>Shares rose.</p></div>',
        '<section class="notice-board"><article><h1>News</h1><p>All of it.</p></article></section>', "<div><p>Before</p><p><a href=/x>A paragraph in a link</a></p></div>",
        '<div class=widget><article><h1>Kept</h1><p>Told.</p></article></div><div class=related><article><p>Teaser</p></article></div>',
        "<ul><li><a href=/a>A</a><li><a href=/b>B</a></ul><div><a href=/c>C</a> <a href=/d>D</a></div><p>Story</p>",
    ]
    wanted = ["What the search found.", "Shares rose.", "News\nAll of it.", "Before\nA paragraph in a link", "Kept\nTold.", "Story"]
    assert texts_of(spark, pages) == dict(enumerate(wanted))


def test_a_host_of_many_layouts_learns_each(spark):
    """Thirty layouts of five pages; stories of different shapes, optional parts and lists of different lengths."""
    layouts = [f"<div class=l{k}><p>Standing words of layout {k}</p></div><div class=b{k}>{{x}}</div><div class=e{k}>Thank you, {k}</div>" for k in range(30)]
    parts = ["<p>Story {n} goes on for quite a while</p>", "<h2>Head {n}</h2><p>Story {n} has a heading and goes on</p>", "<p>A {n}</p><ul><li>one {n}<li>two {n}</ul><p>End of story {n}</p>"]
    pages = [layouts[i % 30].format(x=parts[(i // 30) % 3].format(n=i)) for i in range(150)]
    wanted = ["Story {n} goes on for quite a while", "Head {n}\nStory {n} has a heading and goes on", "A {n}\none {n}\ntwo {n}\nEnd of story {n}"]
    assert texts_of(spark, pages) == {i: wanted[(i // 30) % 3].format(n=i) for i in range(150)}


def test_robust_pruning_keeps_diverse_neighbours():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [0, 1.2], [-3, 0]], np.float32)
    assert robust_prune(points, np.array([0]), np.array([[1, 2, 3, 4, 5, -1, 0, 1]]), 4, 1.2).tolist() == [[1, 3, 5, -1]]


def recall(vectors, got, k):
    ids, flat = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], dtype=float)
    hit = total = 0
    for q in {r.query_id for r in got}:
        scores = flat @ flat[ids == q][0]
        want = [i for _, i in sorted(zip(-scores, ids)) if i != q][:k]
        mine = [r for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - scores[ids == r.vec_id][0]) < 1e-6 for r in mine)
        hit, total = hit + len(set(want) & {r.vec_id for r in mine}), total + len(want)
    return hit / total


@pytest.mark.parametrize("scaled", [False, True])
def test_nearest_neighbours(spark, scaled):
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(900, 16)) * (rng.uniform(0.5, 2, (900, 1)) if scaled else 1)
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(flat)]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    got = nearest_neighbours(frame, F.col("vec_id") % 20 == 0, rows_per_shard=300).collect()
    assert len(got) == 45 * 20 and recall(vectors, got, 20) >= 0.9


def test_vectors_that_take_no_part_and_ties(spark):
    same = [(i, [1.0, 0.0], "x") for i in range(60, 0, -1)]
    odd = [(100, None, "x"), (120, [0.0, 0.0], "x"), (140, [1.0, None], "x"), (160, [float("nan"), 1.0], "x"), (180, [float("inf"), 1.0], "x"), (None, [1.0, 1.0], "x"), (200, [], "x"), (20, [1.0, 0.0], "y"), (220, [1.0, 2.0, 3.0], "x")]
    frame = spark.createDataFrame(same + odd, "vec_id bigint, embedding array<float>, score string")
    got = nearest_neighbours(frame, F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in got} == {20, 40, 60}
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 20] == [i for i in range(1, 22) if i != 20]
    assert nearest_neighbours(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_one_point_is_a_graph():
    graph, entry = build_graph(np.ones((1, 3), np.float32))
    assert beam_search(np.ones((1, 3), np.float32), graph, entry, np.zeros((2, 3), np.float32), 4)[0][:, 0].tolist() == [0, 0]


def texts_of(spark, pages):
    frame = spark.createDataFrame([(i, f"http://host.net/{i}", html) for i, html in enumerate(pages)], "page_id bigint, url string, html string")
    return {r.page_id: r.text for r in extracted(frame).collect()}


def test_every_layout_of_a_host_is_learned(spark):
    """Forty pages of five layouts, of which one shares its paths with another one's stories."""
    layouts = [f"<div class=l{k}><p>Standing words of layout {k}</p></div><div class=b{k}><p>Story {{n}} goes on for quite a while, until it ends at {{n}}</p></div>" for k in range(4)]
    layouts.append("<div class=b0><p>Welcome to all</p></div><div class=c><p>Story {n} goes on for quite a while, until it ends at {n}</p></div>")
    got = texts_of(spark, [layouts[i % 5].format(n=i) for i in range(40)])
    assert got == {i: f"Story {i} goes on for quite a while, until it ends at {i}" for i in range(40)}


def test_only_the_standing_text_itself_is_template(spark):
    """A heading that most pages share, and one that a few share: blocks that differ stay."""
    page = "<div class=a><h2>{h}</h2></div><div class=b><h3>{g}</h3><p>Story {n} goes on for a while</p></div>"
    got = texts_of(spark, [page.format(n=i, h="Overview" if i else "Findings", g="Summary" if i < 3 else f"Part {i}") for i in range(20)])
    assert got[0] == "Findings\nSummary\nStory 0 goes on for a while"
    assert got[1] == "Summary\nStory 1 goes on for a while" and got[9] == "Part 9\nStory 9 goes on for a while"


def test_wide_and_deep_pages_are_learned_to_their_end(spark):
    wide = [f"<div class=x>{''.join(f'<p>Line {k} of {i}</p>' for k in range(60))}<div class=end>Thank you all</div></div>" for i in range(4)]
    deep = [f"{'<div>' * 40}<div class=end>Thank you all</div><p>Story {i}</p>" for i in range(4)]
    got = texts_of(spark, wide)
    assert got == {i: "\n".join(f"Line {k} of {i}" for k in range(60)) for i in range(4)}
    assert texts_of(spark, deep) == {i: f"Story {i}" for i in range(4)}
