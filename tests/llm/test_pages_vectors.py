"""Pages and vectors against brute force."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import html_text, rp_forest
from spindrift.llm.common import Scratch
from spindrift.llm.components import components

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body><!-- <p>no</p> -->
<header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Menu</a></li><li>More</li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
{open}<h1>Title &amp; more</h1><p>First   <b>bold</b>&nbsp;text<br>here<p>Second &lt;tag&gt;<form><input value="x"><label>Mail</label></form>
<aside>Side</aside><ul><li>one</li><li>two</li></ul>{body}<div class="share">Share</div>{close}<section id="comments"><p>Reader says</p></section><footer>&copy; x</footer></body></html>"""


def by_wrapper(pages: list[str]) -> list[str]:
    """The texts of one host's pages, with one wrapper inferred by hand: streams aligned one after the other."""
    wrapper, facts = [], {}
    for i, page in enumerate(sorted(set(pages))):
        found = html_text.blocks(page)
        stream = html_text.folded([p for p, _ in found])
        wrapper = stream if not i else html_text.aligned(wrapper, stream)
        for p in {p for p, _ in found}:
            own = [t for q, t in found if q == p]
            facts.setdefault(p, []).append((sum(len(t.split()) for t in own), own))
    main, region = html_text.chosen(wrapper, {p: (len(v), sum(n for n, _ in v), all(t == v[0][1] for _, t in v)) for p, v in facts.items()})
    return [html_text.main_text(page, {html_text.code(p) for p in main}, {html_text.code(p) for p in region}) for page in pages]


def extracted(spark, pages: list[str], url: str = "http://h.example/") -> list[str]:
    df = spark.createDataFrame([(i, url, p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_text.extract(df).orderBy("page_id").collect()]


def test_main_text(spark):
    pages = [PAGE.format(open=a, close=b, body="<p></p>") for a, b in (("<article>", "</article>"), ("<main>", "</main>"), ('<article class="post has-sidebar">', "</article>"))]
    assert extracted(spark, pages) == ["Title & more\n\nFirst bold text here\n\nSecond <tag>\n\none\n\ntwo"] * 3 == by_wrapper(pages)


def test_names_hint_and_words_decide(spark):
    pages = [f"<body><article><h1>On social policy {i}</h1><div class='social'><p>A long text on social policy, number {i}, with <math><mi>x</mi></math> and <label>a label {i} and more words.</div>"
             f"<div class='alert'><p>Also {i}</div><div class='related-work'><p>Work {i}</div><div class='related'><p>See {i}</div></article>" for i in range(6)]
    got = extracted(spark, pages)
    assert got == by_wrapper(pages)
    for i, text in enumerate(got):
        assert text.split("\n\n") == [f"On social policy {i}", f"A long text on social policy, number {i}, with x and a label {i} and more words.", f"Also {i}", f"Work {i}"]


def test_wrapper_decides(spark, monkeypatch):
    pages = [f"<body><div class='story'><p>Own text {i}</p></div><div class='links'><p>Always the same</p></div></body>" for i in range(6)]
    assert extracted(spark, pages) == [f"Own text {i}" for i in range(6)] == by_wrapper(pages)
    monkeypatch.setattr(html_text, "chosen", lambda wrapper, facts: ([], []))
    assert extracted(spark, pages) == [f"Own text {i}\n\nAlways the same" for i in range(6)]


def test_marks_decide(spark):
    """A text that never varies is the template's only where it stands on every page and once."""
    pages = [f"<body><div class='a'><p>Own {i}</p></div>" + ("<div class='b'><p>Seldom</p></div>" if i % 2 else "") + "<div class='c'>" + "<p>Twice</p>" * (1 + i % 3) + "</div><div class='d'><p>Template</p></div></body>" for i in range(12)]
    got = extracted(spark, pages)
    assert got == by_wrapper(pages)
    assert got[0] == "Own 0\n\nTwice" and got[1] == "Own 1\n\nSeldom\n\nTwice\n\nTwice"


def test_wrapper_finds_text_without_articles(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.format(open='<div class="story">', close="</div>", body=f"<p>Own text number {i} of this page, long enough to count.</p>") + "<div class='links'><p>Always the same</p></div>") for i in range(6)]
    pages += [(10, None, None), (11, "not a url", ""), (12, "http://[bad", "<p>plain"), (13, "http://e.example", "no markup &am"), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame([(*p, "t", "h") for p in pages], "page_id long, url string, html string, text string, host string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert "Own text number 3 of this page, long enough to count." in got[3].text.split("\n\n") and "Always the same" not in got[3].text
    assert got[10].text == "" and got[11].text == "" and got[12].text == "plain" and got[13].text == "no markup &am" and got[13].n_chars == 13
    assert html_text.extract(df).count() == len(pages) and html_text.extract(df.limit(0)).count() == 0
    wrapper = html_text.wrappers(df.select(html_text.host(F.col("url")).alias("host"), "html"), Scratch(spark)).where("host = 'h.example'").first()
    assert wrapper.pages == 7 and "(html/body/div.story/ul/li#text)+" in html_text.expression(json.loads(wrapper.wrapper))


def test_no_text_is_lost_without_articles(spark):
    copy = "<body><div class='story'><p>A page that is stored three times.</p></div></body>"
    pages = [("http://c.example", copy)] * 3 + [("http://c.example", f"<body><div class='story'><p>Other {i}</p></div></body>") for i in range(3)]
    pages += [("http://o.example", copy)] * 3
    pages += [("http://s.example", f"<body><div class='one'><p>First part {i}, the longer one of them.</p></div><div class='two'><p>Second part {i}</p></div><div class='foot'><p>Template</p></div></body>") for i in range(4)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = [r.text for r in html_text.extract(df).orderBy("page_id").collect()]
    assert got[:9] == ["A page that is stored three times."] * 3 + [f"Other {i}" for i in range(3)] + ["A page that is stored three times."] * 3
    assert got[9:] == [f"First part {i}, the longer one of them.\n\nSecond part {i}" for i in range(4)]


def test_many_differing_pages_of_a_host(spark, monkeypatch):
    """All shapes differ: rounds of few streams each give one small wrapper, and nothing is lost."""
    monkeypatch.setattr(html_text, "FAN", 8)
    rng = random.Random(9)
    tags = ["p", "pre", "h2", "li", "td"]
    pages = ["<body><article>" + "".join(f"<{t}>{t} {i} {k}</{t}>" for k, t in enumerate(rng.choices(tags, k=rng.randrange(1, 30)))) + "</article></body>" for i in range(700)]
    df = spark.createDataFrame([(i, "http://h.example", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    found = html_text.wrappers(df.select(html_text.host(F.col("url")).alias("host"), "html"), Scratch(spark)).collect()
    assert len(found) == 1 and found[0].pages == 700 and sum(len(g) for g, _, _ in json.loads(found[0].wrapper)) < 60
    for page, text in zip(pages, extracted(spark, pages)):
        assert text == "\n\n".join(t for _, t in html_text.blocks(page))


def test_alignment_generalises():
    w = html_text.aligned(html_text.folded(["a", "p", "p", "z"]), html_text.folded(["a", "b", "p", "z"]))
    assert html_text.expression(w) == "(a#text) (b#text)? (p#text)+ (z#text)"
    assert html_text.expression(html_text.folded(["d", "t", "d", "t", "d"])) == "(d#text t#text)+ (d#text)"


@pytest.mark.parametrize("seed", range(6))
def test_wrapper_matches_its_streams(seed):
    """Brute force on small hosts: the inferred expression matches every stream it was made from."""
    rng = random.Random(seed)
    streams = [rng.choices("abcd", k=rng.randrange(1, 9)) for _ in range(12)]
    wrapper = html_text.folded(streams[0])
    for s in streams[1:]:
        wrapper = html_text.aligned(wrapper, html_text.folded(s))
    text = lambda g, o: "(?:" + "".join(f"(?:{p}){'?' if o and len(g) > 1 else ''}" for p in g) + ")"
    pattern = "".join(text(g, o) + {(0, 0): "", (1, 0): "+", (0, 1): "?", (1, 1): "*"}[bool(r), bool(o)] for g, r, o in wrapper)
    assert all(re.fullmatch(pattern, "".join(s)) for s in streams), pattern


def by_hand(rows, least=0.95):
    ok = {i: v for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in rows}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]):
                x, y = np.array(ok[a]), np.array(ok[b])
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                    links[a].add(b)
    comp = {}
    for i in sorted(k for k in links if k is not None):
        if i not in comp:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in comp:
                    comp[j] = i
                    todo += links[j]
    return {i: (len(links[i]), comp.get(i)) for i in links}


@pytest.mark.parametrize("leaf", [800, 16])
def test_vectors(spark, leaf):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 40] + rng.standard_normal(16) * 0.12]) for i in rng.permutation(300)]
    rows += [(500 + k, rows[k][1]) for k in range(5)] + [(510 + k, rows[0][1]) for k in range(30)]
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [1.0, None] * 8), (605, [float("inf")] * 16), (606, [1.0, 2.0]), (607, [2.0, 4.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, id string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in rp_forest.vector_groups(df, Scratch(spark), leaf=leaf).collect()}
    want = by_hand(rows)
    assert len(got) == len(rows)
    total = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.99 * total and all(got[i][0] <= want[i][0] for i in got)
    if leaf == 800:
        assert got == want
    assert rp_forest.vector_groups(df.limit(0), Scratch(spark)).count() == 0


def test_large_group_of_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(rp_forest, "BLOCK", 300, raising=False)
    rng = np.random.default_rng(11)
    unit = rp_forest.unit
    centre = unit(rng.standard_normal((1, 32)))
    x = np.concatenate([unit(centre + unit(rng.standard_normal((1000, 32))) * 0.2), unit(centre + unit(rng.standard_normal((40, 32))) * 0.4), unit(rng.standard_normal((960, 32)))])
    x = x[rng.permutation(len(x))].astype(np.float32).astype(float)
    hit = unit(x) @ unit(x).T >= 0.95
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in rp_forest.vector_groups(df, Scratch(spark), leaf=40).collect()}
    label = np.arange(len(x))
    while ((least := np.where(hit, label, len(x)).min(axis=1)) != label).any():
        label = least
    assert got == {i: (int(hit[i].sum()) - 1, int(label[i])) for i in range(len(x))}


@pytest.mark.parametrize("sample", [20_000, 300])
def test_recall_of_clusters_and_ties(spark, sample):
    """Pairs, clusters of various sizes and exact ties; with a small sample the lower levels are random directions."""
    rng = np.random.default_rng(21)
    unit = rp_forest.unit
    centres = unit(rng.standard_normal((500, 32)))
    sizes = rng.integers(1, 9, 500)
    x = np.concatenate([unit(c + unit(rng.standard_normal((n, 32))) * 0.2) for c, n in zip(centres, sizes)])
    x = np.concatenate([x, x[:60], unit(rng.standard_normal((3000, 32)))])
    x = x[rng.permutation(len(x))].astype(np.float32).astype(float)
    hit = unit(x) @ unit(x).T >= 0.95
    want = hit.sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in rp_forest.vector_groups(df, Scratch(spark), leaf=100, sample_rows=sample).collect()}
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.99 * want.sum() > 2000


def test_many_lengths(spark):
    """More lengths of vectors than trees are fitted for: those beyond have random directions, and links are found."""
    rng = np.random.default_rng(22)
    rows = []
    for d in range(4, 24):
        a = rng.standard_normal((60, d))
        rows += [(len(rows) + i, v.tolist()) for i, v in enumerate(np.concatenate([a, a + rng.standard_normal((60, d)) * 0.01]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in rp_forest.vector_groups(df, Scratch(spark), leaf=20).collect()}
    want = {i: n for i, (n, _) in by_hand(rows).items()}
    assert sum(got.values()) >= 0.95 * sum(want.values()) and all(got[i] <= want[i] for i in got)


def test_large_leaf_is_split():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 8))
    x[3000:] = x[:3000] + rng.standard_normal((3000, 8)) * 0.01
    unit = rp_forest.unit(x)
    found = {(int(a), int(b)) for i, j in rp_forest.leaf_pairs(unit.astype(np.float32), x, 0.99, np.random.default_rng(0)) for a, b in zip(i, j)}
    hit = sum((k, k + 3000) in found for k in range(3000))
    assert hit >= 0.95 * 3000


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root) if any(x != a or x != b for a, b in links if x in (a, b) and a != b)}


def test_comments_are_out_whatever_their_share(spark):
    comments = "".join(f"<p>Reader {k} says a lot about this and that, and more than the article itself does." for k in range(6))
    pages = [f"<body><article><h1>Title {i}</h1><p>Short text {i}.</p><section class='comments'>{comments}<p>Reply {i}</section><div class='ad'>Buy {i}</div></article>" for i in range(5)]
    assert extracted(spark, pages) == [f"Title {i}\n\nShort text {i}." for i in range(5)] == by_wrapper(pages)


def test_page_of_another_layout(spark):
    pages = [f"<body><article><h1>Title {i}</h1><p>Text {i}.</p></article>" for i in range(5)]
    other = "<body><div class='menu'><p>Home</p><p>About</p></div><div class='cookie-notice'>We use cookies</div><div><p>Old layout text.</p></div>"
    assert extracted(spark, [*pages, other])[-1] == "Old layout text."


def test_hidden_inline_and_blocks():
    page = "<div><p>Seen <span hidden>not <span>this</span> one</span>text<p style='display: none'>Gone<p>Next <b aria-hidden='true'>no</b>one</p><li hidden>Item</li><p hidden>Open</div><p>Last <i class='hidden'>word</i>"
    assert [t for _, t in html_text.blocks(page)] == ["Seen text", "Next one", "Last word"]


def test_planted_vectors_have_links(spark):
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    want = sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({rp_forest.PLANTED_SQL})").fetchall())
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rp_forest.planted_vectors(spark, folder).collect())
    assert got == want and sum(n for _, n, *_ in want) > len(want) / 2
