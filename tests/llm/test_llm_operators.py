"""The operators on small fixtures: brute force, NULLs, empty and very long
texts, ties, repeated rows, empty tables and clashing extra columns."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from erario.llm import (chat, htmltext, langid, linededup, mixing, ngramjoin, packing, quality, queries, urlfilter,
                        vectors)

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows, extra=True):
    """(doc_id, text[, lang, source]) rows with columns whose names clash."""
    full = [(*r, *[None, None][: 4 - len(r)], 0) for r in rows]
    df = spark.createDataFrame(full, DOC)
    if extra:
        clash = ["size", "start", "n_lines", "n_removed", "score", "lang_pred", "held_out", "node", "n", "tokens", "kept",
                 "host", "part", "runs", "_key", "rank", "key", "taken", "sequence_id", "length", "component_id"]
        df = df.select("*", *[F.lit("clash").alias(c) for c in clash])
    return df


def _text(rnd, n, vocabulary=3000):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


# ------------------------------------------------------------------ n-gram join

def _brute_components(rows):
    sets = [set(ngramjoin.shingles(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids and sets[i] else doc))
    return sorted(out, key=str)


def _near(rnd, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_components_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    base, passage = _text(rnd, 120), _text(rnd, 60)
    rows = [(100 + i, _near(rnd, base, rnd.randrange(9))) for i in range(40)]  # near and too far copies
    rows += [(300 + i, base) for i in range(15)]  # exact copies
    rows += [(400 + i, _text(rnd, rnd.randrange(5, 60)) + " " + passage) for i in range(15)]  # a common passage
    rows += [(500 + i, _text(rnd, rnd.randrange(1, 80))) for i in range(20)]
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, "A b"), (604, "a B"), (605, "a b c"),
             (606, _text(rnd, 5000)), (None, base), (None, "lonely text of just these seven words"), (500, base), (300, base)]
    rows += [(700, "one two three four five six seven"), (701, "ONE two three four five six seven")]
    rnd.shuffle(rows)
    got = ngramjoin.ngram_components(_docs(spark, rows))
    assert got.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == _brute_components(rows)


def test_ngram_chains_and_region_free_search(spark, monkeypatch):
    """Chains of links, blocks of a few members, probes in shares."""
    rnd = random.Random(5)
    monkeypatch.setattr(ngramjoin, "BLOCK", 3)
    monkeypatch.setattr(ngramjoin, "PROBES", 2)
    text, rows = _text(rnd, 100), []
    for i in range(30):
        rows.append((i, text))
        text = _near(rnd, text, 1)
    hub = _text(rnd, 90)
    rows += [(100 + i, _near(rnd, hub, 2 + i % 5)) for i in range(30)]
    rnd.shuffle(rows)
    got = ngramjoin.ngram_components(_docs(spark, rows, extra=False), region=0.5)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == _brute_components(rows)


def test_ngram_empty_and_one_per_component(spark):
    empty = _docs(spark, [])
    assert ngramjoin.ngram_components(empty).count() == 0
    t = " ".join(f"a{i}" for i in range(30))
    rows = [(3, t), (2, t), (2, t), (None, t), (9, None), (8, "")]
    kept = ngramjoin.one_per_component(_docs(spark, rows))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 8, 9, None]


# ------------------------------------------------------------------------- pages

def test_page_text_cases():
    page = """<!DOCTYPE html><html><head><title>T</title></head><body class="home"><header><p>Site</p></header>
    <nav><a href=x>Home</a></nav><main><article><header><h1>Head &amp; <em>line</em></h1></header>
    <p>One<b>two</b>\n three<br>four<p>five &#233; &lt;x&gt;<aside>Ad</aside><form>q</form><div class="ad-box">Buy</div>
    <ul><li>a<li>b</ul><script>var s = "<p>no</p>";</script><!-- gone --><div hidden>h</div>
    <div style="display: none">n</div><section id="comments"><p>I like it</p></section></article></main>
    <div role="navigation">m</div><footer>c</footer></body></html>"""
    assert htmltext.main_text(page) == "Head & line Onetwo three four five é <x> a b"
    assert htmltext.main_text("") == "" and htmltext.main_text("just  text") == "just text"
    assert htmltext.main_text("<p>a<nav>b") == "a" and htmltext.main_text("a < b <") == "a < b <"
    assert htmltext.main_text("<div><p>x</p>" * 3000 + "end").startswith("x x")


def test_page_text_odd_quotes_in_tags():
    assert htmltext.main_text('<p>a<img alt="5" screen">b<p title="x">c') == "a b c"
    assert htmltext.main_text("<p title=it's>a<p>it's b") == "a it's b"
    assert htmltext.main_text('<p class="x"">a</p><div " class="ad">no</div><p \'>b') == "a b"
    assert htmltext.main_text("<p title=it's class=ad>no</p><p title = 'a > b' id=\"c>d\">e") == "e"
    assert htmltext.main_text('<a href="/x"class="y">a</a><a href=/x?q="r>b</a> <p alt="c>d') == "ab d"
    assert htmltext.main_text('a<p x="b') == "a"


@pytest.mark.parametrize("page", [
    "<div class='content has-sidebar'><article>{}</article></div>",
    "<article class='post category-legal tag-promo'>{}</article>",
    "<main id='no-sidebar'>{}</main>",
    "<body><div class=menu-open><div id=page-with-ads><main class='comments-open'><article>{}</article></main></div></div>",
    "<div class=share-enabled><aside><article>t</article></aside><article>{}</article></div>",
])
def test_page_text_class_words_do_not_condemn_articles(page):
    assert htmltext.main_text(page.format("<h1>Title</h1><p>Whole text")) == "Title Whole text"


@pytest.mark.parametrize("furniture", [
    "<div class='related-posts'><article>t</article></div>", "<div class=sidebar><article>t</article></div>",
    "<section id=comments class=comments-area><article class=c>t</article></section>",
    "<article class='comment-body'>t</article>", "<article role=complementary>t</article>",
    "<div class=top-story-ads><aside><article>t</article></aside>t</div>", "<div class=my-sidebar>t</div>",
])
def test_page_text_furniture_with_articles_goes(furniture):
    page = f"<main><p>Whole</p>{furniture}<p>text</p></main>"
    assert htmltext.main_text(page).split() == ["Whole", "text"]
    assert htmltext.main_text(f"<article><p>Whole text</p></article>{furniture}") == "Whole text"


def test_style_tree_removes_what_a_site_repeats(spark):
    body = "<html><body><div class=q7>Read our other stories every day</div><div class=story><p>{}</p><p>{}</p></div></body></html>"
    rnd = random.Random(1)
    texts = [(_text(rnd, 30), _text(rnd, 25)) for _ in range(20)]
    rows = [(i, f"http://One.example/{i}", body.format(*t)) for i, t in enumerate(texts)]
    rows += [(50, "http://two.example/", body.format("a b c d e f g", "h")), (51, None, None), (52, "x", ""), (None, None, "<p>t"),
             (0, "http://One.example/0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit(1) for c in ("text", "host", "low", "_host", "n_chars")})
    got = [tuple(r) for r in htmltext.extract(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(i, f"http://One.example/{i}", " ".join(t), len(" ".join(t))) for i, t in enumerate(texts)]
        + [(0, "http://One.example/0", " ".join(texts[0]), len(" ".join(texts[0])))]
        + [(50, "http://two.example/", "Read our other stories every day a b c d e f g h", 48), (51, None, "", 0), (52, "x", "", 0),
           (None, None, "t", 1)], key=str)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_style_tree_keeps_the_text_of_copied_pages(spark):
    """A host of 300 copies and 20 other pages: every page keeps its whole article."""
    body = ("<html><body><script>track({})</script><div class=q7>Read our other stories every day</div>"
            "<article><h1>{}</h1><p>{}</p><p>{}</p><p>{}</p></article></body></html>")
    rnd = random.Random(4)
    article = lambda: [_text(rnd, n) for n in (6, 90, 12, 20)]
    copied = article()
    texts = [copied] * 300 + [article() for _ in range(20)]
    rows = [(i, "http://one.example/", body.format(i, *t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, "http://two.example/", body.format(i, *copied)) for i in range(40)]  # nothing but copies
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert got == {i: " ".join(t) for i, t in enumerate(texts)} | {1000 + i: " ".join(copied) for i in range(40)}


def _neutral(page):
    """The page with articles, menus and footers as plain blocks of neutral, distinct classes."""
    page = re.sub(r"<(nav|article|footer|aside|header|main)[^>]*>", lambda m: f'<div class="k{m[1][::-1]}">', page)
    page = re.sub(r"</(?:nav|article|footer|aside|header|main)>", "</div>", page)
    return page.replace('class="ad"', 'class="kd"')


def test_style_tree_finds_articles_without_names(spark):
    """Pages whose tags and classes tell nothing: where a host has a tree, its
    layouts alone give the article."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("html is not null")
    hosts = pages.groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).count().where("count >= 15").limit(25)
    rows = pages.join(hosts, F.regexp_extract("url", "://([^/?#]*)", 1) == F.col("host"), "left_semi").collect()
    plain = spark.createDataFrame([(r.page_id, r.url, _neutral(r.html)) for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text.split() for r in htmltext.extract(plain).collect()}
    assert len(got) == len(rows) > 400
    both = kept = wanted = 0
    for r in rows:
        want = Counter(htmltext.named_text(r.html).split())
        have = Counter(got[r.page_id])
        assert htmltext.named_text(_neutral(r.html)).split() != list(want)  # names do not help
        both, kept, wanted = both + (want & have).total(), kept + have.total(), wanted + want.total()
    assert both >= 0.95 * kept and both >= 0.95 * wanted


def test_deep_pages_take_time_in_proportion():
    import time

    def seconds(n):
        pages = ["<div>" * n + "text", "<b>" * n + "<p>text" + "</i>" * n, ("<b><div>" + "<i>" * 9 + "</b></b>") * (n // 10) + "text",
                 "<article>" * n + "text", "<p>" * n + "text" + "</p>" * n, "<ul><li>" * n + "text" + "</section>" * n]
        start = time.process_time()
        for page in pages:
            tree = {k: (1.0, 1.0) for k, _, _ in htmltext.style_counts(page)}
            assert htmltext.tree_text(page, tree) == htmltext.named_text(page) == "text"
        return time.process_time() - start

    seconds(1000)
    few, many = seconds(10_000), seconds(100_000)
    assert many < 40 * max(few, 0.05)


def test_style_tree_removes_branches_with_empty_elements(spark):
    body = ("<html><body><div class=q7>Follow us<br>on X<hr></div><div class=story>{}<div class=t1><img src=a.png>"
            "<p><span></span><i class=icon> </i>Read more<wbr></p></div><p>{}<br>{}</p><p></p>{}</div></body></html>")
    rnd = random.Random(6)
    texts = [[_text(rnd, n) for n in (9, 30, 25, 8)] for _ in range(20)]
    rows = [(i, "http://one.example/", body.format(*t)) for i, t in enumerate(texts)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(t) for i, t in enumerate(texts)}


# -------------------------------------------------------------------- URL filters

def test_url_filter_cases(spark):
    urls = ["http://a.net/x", "http://a.net", "https://WWW.Example.NET/en/1?q#f", "ftp://example.com/de/x", "http://badexample.com/de/",
            "http://x.org/fr/", "http://x.org/fr", None, "", "no scheme", "http://", "http://casino.example.org/", "http://x.org/a/casino-b",
            "http://x.org/casinos", "http://cheap-pills.example.org/fr/1", "a://b://c.net/en/", "http://É.net/é"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    df = df.withColumns({"host": F.lit(1), "verdict": F.lit(2), "token": F.lit(3), "rule": F.lit("r")})
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict)
           for r in urlfilter.filter_urls(df, queries.URL_RULES).orderBy("page_id").collect()]
    assert got == [
        (0, "a.net", "/x", "net/", "block"), (0, "a.net", "/x", "net/", "block"), (1, "a.net", "", None, "allow"),
        (2, "www.example.net", "/en/1", "example.net/en/", "allow"), (3, "example.com", "/de/x", "example.com/de/", "block"),
        (4, "badexample.com", "/de/", None, "allow"), (5, "x.org", "/fr/", "org/fr/", "allow"), (6, "x.org", "/fr", None, "allow"),
        (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"), (10, "", "", None, "allow"),
        (11, "casino.example.org", "/", None, "block"), (12, "x.org", "/a/casino-b", None, "block"),
        (13, "x.org", "/casinos", None, "allow"), (14, "cheap-pills.example.org", "/fr/1", "org/fr/", "allow"),
        (15, "b:", "//c.net/en/", None, "allow"), (16, "É.net", "/é", "net/", "block")]
    assert urlfilter.filter_urls(df, []).where("verdict != 'allow'").count() == 0
    assert urlfilter.filter_urls(df.limit(0), queries.URL_RULES).count() == 0
    rule = urlfilter.host_rule("block", "a.net/fo")  # 'fo' may go on: no whole token
    assert rule.tokens == ("a", "net")


# ------------------------------------------------------------------ vector search

@pytest.mark.parametrize("seed", [1, 2, 3])
def test_top_k_matches_brute_force(spark, seed):
    rnd = np.random.default_rng(seed)
    n, d = 300, 6
    if seed == 3:  # one direction, so coordinates prune
        m = np.outer(rnd.random(n) * 50 + 1, np.ones(d)) + rnd.normal(size=(n, d)) * 0.1
    else:
        m = rnd.normal(size=(n, d)) * np.exp(rnd.normal(size=(n, 1)) * (2 if seed == 1 else 0.01))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * d), (1003, [float("inf")] * d), (1004, []), (None, [1.0] * d),
             (1006, rows[7][1]), (1007, [1e7] * 3), (1008, rows[8][1]), (1008, rows[8][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "cell": F.lit(2)})
    v = vectors.quantised(df, "embedding")
    got = [tuple(r) for r in vectors.top_k(v.where("vec_id % 10 = 0"), v, 5, query_block=7, bucket_rows=16, cell_buckets=2).collect()]
    exact = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows
             if i is not None and e is not None and None not in e and all(np.isfinite(e))]
    want = []
    for q, a in exact:
        if q % 10 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in exact if c != q)[:5]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(found, 1)]
    assert sorted(got) == sorted(want)
    assert vectors.top_k(v.limit(0), v).count() == 0 and vectors.top_k(v, v.limit(0)).count() == 0


def test_top_k_joins_only_cells_that_can_hold_a_better_vector(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    m = rnd.normal(size=(800, 4)) * np.exp(rnd.normal(size=(800, 1)) * 2)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    v = vectors.quantised(df, "embedding")
    joined, plain = [], vectors._pairs

    def counted(blocks, ends, first):
        out = plain(blocks, ends, first)
        joined.append((out.count(), blocks.count() * (max(ends) - first)))
        return out

    monkeypatch.setattr(vectors, "_pairs", counted)
    got = [tuple(r) for r in vectors.top_k(v.where("vec_id % 5 = 0"), v, 5, query_block=8, bucket_rows=16, cell_buckets=2).collect()]
    q = np.floor(256 * m).astype(int)
    want = [(i, k, c, s) for i in range(0, 800, 5) for k, (s, c) in enumerate(
        sorted(((int(q[i] @ q[c]), c) for c in range(800) if c != i), key=lambda x: (-x[0], x[1]))[:5], 1)]
    assert sorted(got) == want
    (some, every), = joined
    assert 0 < some < every / 2


# --------------------------------------------------------------------- line dedup

def _brute_lines(docs):
    """Per document the lines to delete: every window of 50 words against the
    first place that holds it, compared line by line both ways."""
    seqs = {i: [(k, tuple(x.split())) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in docs}
    first, gone = {}, {i: set() for i in seqs}
    for d in sorted(seqs):
        a = [w for _, w in seqs[d]]
        for i in range(len(a)):
            end = next((e for e in range(i + 1, len(a) + 1) if sum(map(len, a[i:e])) >= 50), None)
            if end is None:
                continue
            e, j = first.setdefault(tuple(a[i:end]), (d, i))
            if (e, j) == (d, i):
                continue
            b = [w for _, w in seqs[e]]
            lo = hi = 0
            while i - lo > 0 and j - lo > 0 and a[i - lo - 1] == b[j - lo - 1]:
                lo += 1
            while i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
                hi += 1
            gone[d] |= set(range(seqs[d][i - lo][0], seqs[d][i + hi - 1][0] + 1))
    return gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    lines = [_text(rnd, n) for n in (3, 5, 8, 12, 20, 30, 55, 60, 10, 6, 40, 1)]
    blocks = [[rnd.choice(lines) for _ in range(rnd.randrange(1, 7))] for _ in range(6)]
    docs = []
    for i in range(60):
        own = [_text(rnd, rnd.randrange(1, 30)) for _ in range(rnd.randrange(4))]
        body = own + rnd.choice(blocks) + [""] * rnd.randrange(2) + [_text(rnd, 4)] + rnd.choice(blocks)
        docs.append((i, "\n".join(body)))
    df = _docs(spark, docs + [(100, None), (101, ""), (102, "\n\n"), (None, docs[0][1]), (103, "w " * 40000)])
    got = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert linededup.dedup_lines(df).columns == [*df.drop("n_lines", "n_removed").columns, "n_lines", "n_removed"]
    gone = _brute_lines(docs)
    assert sum(map(len, gone.values())) > 20
    for i, t in docs:
        old = t.split("\n")
        assert (got[i].text, got[i].n_lines, got[i].n_removed) == (
            "\n".join(x for k, x in enumerate(old) if k not in gone[i]), len(old), len(gone[i]))
    assert (got[100].text, got[101].text, got[102].text) == (None, "", "\n\n") and got[None].n_removed > 0
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_keeps_first_and_short(spark):
    long, short = " ".join(f"a{i}" for i in range(60)), "short common line"
    docs = [(5, f"x\n{long}\ny"), (2, f"{short}\n{long}"), (7, f"{short}\nz"), (8, f"{long}\nq\n{long}"), (2, f"{short}\n{long}")]
    got = sorted((r.doc_id, r.text) for r in linededup.dedup_lines(_docs(spark, docs)).collect())
    assert got == [(2, f"{short}\n{long}"), (2, f"{short}\n{long}"), (5, "x\ny"), (7, f"{short}\nz"), (8, "q")]


# ------------------------------------------------------------------------- mixing

def test_mixing_edges(spark):
    rnd = random.Random(3)
    rows = [(i, _text(rnd, rnd.randrange(0, 50)), None, rnd.choice(["b", "a", "c", None, "B", "é"])) for i in range(300)]
    rows += [(i, _text(rnd, 40), None, "hot") for i in range(1000, 1200)]
    rows += [(2000, None, None, "empty"), (2001, "", None, "empty"), (2002, "word", None, "tiny"), (None, "no id here", None, "a"),
             (7, rows[7][1], None, rows[7][3]), (2003, "x " * 30000, None, "long")]
    df = _docs(spark, rows)
    once = sorted((tuple(r) for r in mixing.mix_sources(df).collect()), key=str)
    assert len(once) == len(rows)
    assert once == sorted((tuple(r) for r in mixing.mix_sources(df.repartition(7)).collect()), key=str)
    names = sorted({r[3] for r in rows} - {None}, key=lambda s: s.encode()) + [None]
    size = {s: sum(len(r[1].split()) for r in rows if r[3] == s and r[1]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, total = {}, set(names), sum(size.values())
    while True:  # share, stop the ones above their cap, share the rest again
        free = total - sum(target.values())
        share = {s: free * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] >= 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * size[s] for s in over}
        left -= over
    taken = dict.fromkeys(names, 0)
    for _, source, n, source_size, t, _, k, slots in once:
        assert sorted(slots) == slots and (len(slots) > 0) == (k > 0) and len(slots) <= 3
        assert source_size == size[source] and abs(t - target[source]) < 1e-6 and 0 <= k <= 3 * n
        taken[source] += k
    assert all(abs(taken[s] - target[s]) <= 1 + target[s] / 100 for s in names)
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.mix_sources(df.where("source = 'empty'")).count() == 2
    copies = {r.doc_id: r["count"] for r in mixing.apply_mix(df.select("doc_id", "text", "source")).groupBy("doc_id").count().collect()}
    assert max(copies.values()) <= 6 and 2000 not in copies


def test_every_stretch_of_the_mix_holds_each_source_in_its_share(spark):
    rnd = random.Random(8)
    rows = [(i, _text(rnd, 30), None, "abcde"[min(4, int(rnd.expovariate(0.9)))]) for i in range(900)]
    sized = _docs(spark, rows, extra=False).select("source", mixing.word_count(F.col("text")).alias("size"))
    plan = mixing._plan(mixing.source_targets(sized), 3, 16, 1024)
    total = {r.source_no: r.slots for r in plan.collect()}
    slots = sorted((r.slot, r.source_no, r["rank"], r["pass"], r.block) for r in mixing.schedule(plan, chunk=64).collect())
    assert len(slots) == sum(total.values()) and len({s[0] for s in slots}) == len(slots)
    bits = plan.first().bits
    seen = dict.fromkeys(total, 0)
    for i, (slot, source, rank, _, _) in enumerate(slots, 1):
        assert rank == seen[source]  # ranks follow the slots
        seen[source] += 1
        # an interval of n points has n * (slot + 1) / 2^bits of them before a slot, but for one a bit
        assert all(abs(seen[s] - total[s] * (slot + 1) / 2 ** bits) <= bits + 1 for s in total)


def test_the_mix_is_a_stream_in_slot_order(spark):
    rnd = random.Random(9)
    rows = [(i, _text(rnd, 20 + i % 60), None, rnd.choice("ab")) for i in range(200)]
    df = _docs(spark, rows).withColumns({"_times": F.lit("t"), "_again": F.lit(7), "slots": F.lit("s"), "mix slot": F.lit(1),
                                         "row": F.lit("r"), "slot": F.lit("x"), "row_key": F.lit("k")})
    slots = {r.doc_id: r.slots for r in mixing.mix_sources(df).collect()}
    stream = mixing.apply_mix(df)
    assert stream.columns == df.columns
    got = stream.collect()  # partitions in order
    want = sorted((s, d) for d, places in slots.items() for s in places)
    assert [r.doc_id for r in got] == [d for _, d in want] and len({tuple(r)[5:] for r in got}) == 1


def test_copies_belong_to_rows(spark):
    """Rows of one id, or of none, from several sources; equal rows."""
    rows = [(1, "a " * 50, None, "big"), (1, "b " * 50, None, "small"), (None, "c " * 50, None, "big"),
            (None, "d " * 50, None, "small"), *[(5, "e " * 50, None, "small")] * 4, (6, None, None, "big"), (6, "", None, None)]
    rows += [(100 + i, _text(random.Random(i), 50), None, "big") for i in range(30)]
    df = _docs(spark, rows)
    wanted = {}
    for r in mixing.mix_sources(df).collect():
        key = (r.doc_id, r.source)
        wanted[key] = wanted.get(key, 0) + len(r.slots)
    got = {}
    for r in mixing.apply_mix(df).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    assert got == {k: n for k, n in wanted.items() if n}
    assert mixing.apply_mix(df.limit(0)).collect() == []


# --------------------------------------------------------------------------- chat

def test_quotes_are_linked_and_removed(spark):
    rows = [(1, 0, "user", "First question here\nsecond line"), (1, 1, "bot", "An answer."), (1, 2, "user", "Other topic"),
            (1, 5, "bot", "Ana wrote:\n> First question here\n>> older words\n> SECOND line!\nMy reply"),
            (1, 6, "user", "> my reply\nthanks > all"), (1, 7, None, "> never said\nhm"), (1, 7, None, "> never said\nhm"),
            (2, 0, "user", None), (2, 1, "bot", ""), (2, 300, "user", "far\n> unknown"), (3, 0, "user", "> First question here"),
            (None, 1, "user", "> a\nb"), (4, None, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {"position": F.lit(1), "root": F.lit(2), "depth": F.lit(3), "passage": F.lit(4), "level": F.lit(5)})
    got = {(r.conv_id, r.turn, r.text): r for r in chat.thread(df).collect()}
    want = [  # reply_to, root, depth, n_quoted, max_level, position
        (1, 0, "First question here\nsecond line", None, 0, 0, 0, 0, 0), (1, 1, "An answer.", 0, 0, 1, 0, 0, 1),
        (1, 2, "Other topic", 1, 0, 2, 0, 0, 2), (1, 5, "My reply", 0, 0, 1, 2, 2, 3), (1, 6, "thanks > all", 5, 0, 2, 1, 1, 4),
        (2, 0, "", None, 0, 0, 0, 0, 0), (2, 1, "", 0, 0, 1, 0, 0, 1), (2, 300, "far", 1, 0, 2, 0, 1, 2),
        (3, 0, "", None, 0, 0, 0, 1, 0), (None, 1, "b", None, 1, 0, 0, 1, 0), (4, None, "c", None, None, 0, 0, 0, 0)]
    for conv, turn, text, *rest in want:
        r = got[(conv, turn, text)]
        assert [r.reply_to, r.root, r.depth, r.n_quoted, r.max_level, r.position] == rest, r
    twice = [r for r in chat.thread(df).collect() if r.turn == 7]
    assert sorted(r.position for r in twice) == [5, 6] and {r.role for r in twice} == {"user"}
    assert got[(1, 5, "My reply")].formatted == "<|bot|>\nMy reply"
    assert chat.thread(df.limit(0)).count() == 0


def test_quotes_of_deeper_levels_and_other_line_breaks_are_linked(spark):
    rows = [(1, 0, "First question here, a long one that goes on"), (1, 1, "Thanks"), (1, 2, "An answer\nin two lines.\n\nThanks"),
            (1, 3, "Other topic"), (1, 4, ">> First question here, a long one that goes on\nhm"),  # level 2 alone
            (1, 5, "> not in the table\n>> Other topic\nso"),  # level 1 has no source
            (1, 6, "> First question here,\n> a long one\n> that goes on\nyes"),  # wrapped
            (1, 7, "> An answer in two lines.\n>\n> Thanks\nwelcome"),  # 'Thanks' within the run, not of turn 1
            (1, 8, "> Thanks\nok"), (1, 9, "> an answer\n> left out\n>\n> other\n> topic\n>> Thanks\nend")]
    df = spark.createDataFrame([(*r[:2], "user", r[2]) for r in rows], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.reply_to, r.n_quoted, r.max_level) for r in chat.thread(df).collect()}
    assert got == {0: (None, 0, 0), 1: (0, 0, 0), 2: (1, 0, 0), 3: (2, 0, 0), 4: (0, 1, 2), 5: (3, 1, 2), 6: (0, 3, 1),
                   7: (2, 2, 1), 8: (1, 1, 1), 9: (3, 3, 2)}


# ------------------------------------------------------------------------ quality

def test_quality_cases(spark):
    clean = " ".join(f"word{i} and other{i}, but" for i in range(20)) + " end."
    texts = [None, "", "few words", clean, "!! ".join(clean.split()) + "!!", clean.upper(), "%%% ".join(clean.split()),
             "the " * 60, "\n".join(clean.split()[:8] for _ in ()) or "\n".join([clean] * 3), " ".join(f"9{i}" for i in range(40)),
             clean + " " + "y" * 100000]
    df = _docs(spark, [(i, t) for i, t in enumerate(texts)] + [(3, clean), (None, clean)])
    got = [(r.doc_id, r.base_failed, r.kept) for r in quality.judge(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(0, True, False), (1, True, False), (2, True, False), (3, False, True), (3, False, True), (None, False, True),
         (4, False, False), (5, False, False), (6, False, False), (7, True, False), (8, True, False), (9, False, False),
         (10, False, False)], key=str)
    assert quality.judge(df.limit(0)).count() == 0
    orders = [quality.rule_order(df), [r.name for r in reversed(quality.RULES)]]
    a, b = ([(r.doc_id, r.kept) for r in quality.judge(df, order=o).collect()] for o in orders)
    assert sorted(a, key=str) == sorted(b, key=str) and sorted(orders[0]) == sorted(orders[1])


def test_repeated_words_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        w = [rnd.choice("ab") if rnd.random() < 0.5 else str(rnd.randrange(6)) for _ in range(rnd.randrange(60))]
        wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        covered = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(8)}
        assert quality.repeated_words(w) == len(covered)


# ------------------------------------------------------------------------ packing

def test_tokenizer_equals_the_vocabulary():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(queries.vocabulary()), packing.WordTokenizer(queries.vocabulary())
    rnd = random.Random(6)
    letters = "aAzZéÉßüçŒΑΣσςПжЖ中٣²Ⅷ½_-'’`\"!?.,<>|/0129 \t\n\r  ​̧́\x85\x1c\x0b🙂ﬁẞİıªµ™…"
    for _ in range(3000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(14)))
        assert own.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
    for t in ("a<|endoftext|>b", "<|startoftext|>", "don't they're 's", "x" * 5000):
        assert own.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_edges(spark):
    rnd = random.Random(7)
    rows = [(i, _text(rnd, rnd.randrange(0, 400))) for i in range(60)] + [(None, "no id"), (70, None), (71, ""), (72, "a"), (72, "a"),
                                                                       (73, _text(rnd, 3000))]
    got = packing.pack(_docs(spark, rows).repartition(5), queries.vocabulary(), length=256, open_windows=4).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 256
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    assert sum(r.start == 0 for r in got) == len(rows)
    one = {r.doc_id: r for r in got if r.doc_tokens == 1}
    assert set(one) == {70, 71} | {i for i, t in rows[:60] if not t}
    assert packing.pack(_docs(spark, []), queries.vocabulary()).count() == 0


# -------------------------------------------------------------------- language ID

def test_language_edges(spark):
    rnd = random.Random(8)
    words = {"xx": ["lorem", "ipsum", "dolor", "amet"], "yy": ["один", "два", "три", "пять"]}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(12)), k) for i, k in enumerate(["xx", "yy"] * 60)]
    rows += [(500, None, "xx"), (501, "", "yy"), (502, "12 34 ²!", "xx"), (None, "lorem dolor ipsum", None), (503, "два " * 20000, None),
             (504, "три два", "zz"), (504, "три два", "zz")]
    got = {r.doc_id: r for r in langid.predict_languages(_docs(spark, [(a, b, c, None) for a, b, c in rows])).collect()}
    assert all(got[i].lang_pred == k and 0 < got[i].score <= 1 for i, k in enumerate(["xx", "yy"] * 60))
    assert [(got[i].lang_pred, got[i].score) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert got[None].lang_pred == "xx" and got[None].held_out is False and got[503].lang_pred == "yy"
    none = langid.predict_languages(_docs(spark, [(1, "some text", None, None), (2, "more", None, None)])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.predict_languages(_docs(spark, [])).count() == 0


# ------------------------------------------------------------- clashing names

def test_names_that_clash_with_the_operators_own(spark):
    """Each pipeline stage and the URL filter keep columns named like theirs."""
    rnd = random.Random(12)
    rows = [(i, _text(rnd, 60), None, "ab"[i % 2]) for i in range(30)] + [(None, None, None, None), (3, "", None, "a")]
    extra = ["_v", "_id", "_p", "_again", "_times", "row", "found", "slots", "slot", "row_key", "end", "c0"]
    df = _docs(spark, rows, extra=False).select("*", *[F.lit(f"own {c}").alias(c) for c in extra])

    def intact(out):
        assert out.select(*extra).distinct().collect() == [tuple(f"own {c}" for c in extra)]
        return out

    assert intact(langid.predict_languages(df)).count() == len(rows)
    assert intact(linededup.dedup_lines(df)).count() == len(rows)
    assert intact(ngramjoin.one_per_component(df)).count() == len(rows)
    assert 0 < intact(mixing.apply_mix(df)).count() <= 3 * len(rows)
    urls = df.select("*", F.concat(F.lit("http://x.example.net/"), "source").alias("url"))
    got = intact(urlfilter.filter_urls(urls, queries.URL_RULES))
    assert sorted(Counter(r.rule for r in got.collect()).items(), key=str) == [("net/", 31), (None, 1)]


@pytest.mark.parametrize("rows", [
    [], [(None, None)], [(1, None), (2, "")], [(1, "a b c")] * 3 + [(None, "a b c")], [(1, "a"), (1, "b"), (1, None)]])
def test_pipeline_stages_on_edge_tables(spark, rows):
    """Empty tables, NULL and empty texts, repeated ids and rows, through all five stages."""
    import corpus_pipeline

    docs = _docs(spark, [(d, t, None, "s") for d, t in rows], extra=False)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/none")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != "pack":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept = [(d, t) for d, t in rows if t and re.search(r"[^\W\d_]", t)]
    assert docs.count() <= 4 * len(kept)
    if not kept:
        assert docs.collect() == []


def test_a_loaded_vocabulary_keeps_no_memory_of_its_file(monkeypatch):
    from erario.llm import packing, queries

    freed = []
    monkeypatch.setattr(packing, "release_memory", lambda: freed.append(1))
    tokenizer = packing.WordTokenizer(queries.vocabulary())
    assert freed == [1] and tokenizer.encode("the word") == tokenizer.words.whole("the word")
