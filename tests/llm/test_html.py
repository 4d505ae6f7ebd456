"""HTML extraction: examples, tree matching against brute force, odd and hostile pages."""

import functools
import random
import time

import pytest
from pyspark.sql import functions as F

from voxmeter.llm import html


PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><div class='ad box'>Buy!</div><article><h1>T&amp;{n}</h1><p>One {n}<br>two<p>Three <b>bold</b> {n}.<div>Follow us for more</div><ul><li>x{n}<li>y</ul><script>var a='</p>'</script><!-- c --></article><section id=comments><p>Nice</p></section><form>Mail</form><footer>c</footer></body></html>"


def test_html(spark):
    rows = [(i, "http://a.example/x", PAGE.format(n=i)) for i in range(6)] + [(6, "http://a.example/x", PAGE.format(n=5))]
    rows += [(7, "https://u@B.example:80/", PAGE.format(n=7)), (8, None, "<p>plain &lt;b&gt; text"), (9, "odd", None), (10, "http://c.example/", ""), (None, "http://c.example/", "<b>open <i>mark")]
    out = {r["page_id"]: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("marks", F.lit("m"))).collect()}
    # What all pages of a host say in one place is template; a host of one page has none.
    assert out[0]["text"] == "T&0\n\nOne 0 two\n\nThree bold 0.\n\nx0"
    assert out[6]["text"] == "T&5\n\nOne 5 two\n\nThree bold 5.\n\nx5"
    assert out[7]["text"] == "T&7\n\nOne 7 two\n\nThree bold 7.\n\nFollow us for more\n\nx7\n\ny"
    assert out[8]["text"] == "plain <b> text"
    assert (out[9]["text"], out[10]["text"], out[None]["text"]) == ("", "", "open mark")
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_of_copies_keeps_their_text(spark):
    rows = [(i, "http://a.example/x", PAGE.format(n=1)) for i in range(8)]
    out = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["text"] for r in out.collect()} == {"T&1\n\nOne 1 two\n\nThree bold 1.\n\nFollow us for more\n\nx1\n\ny"}


def test_html_counts_distinct_pages_whatever_the_partitions(spark):
    text = "<article><p>Long {n}</p><p>Only here {n}</p></article>"
    rows = [(i, "http://a.example/x", text.format(n=1)) for i in range(10)] + [(10, "http://a.example/x", "<article><p>Long 2</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 11):
        out = {r["page_id"]: r["text"] for r in html.main_text(df.repartition(parts, "page_id")).collect()}
        assert out[0] == "Long 1\n\nOnly here 1"


def test_html_template_forgives_a_tenth_of_the_pages(spark):
    page = lambda i: f"<article><p>One {i}</p>" + ("" if i < 3 else f"<div>{'Follow us' if i != 20 else 'Follow them'}</div>") + f"<h2>Two {i}</h2></article>"
    df = spark.createDataFrame([(i, "http://a.example/x", page(i)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    out = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert all(out[i] == f"One {i}\n\n{'Follow them' + chr(10) * 2 if i == 20 else ''}Two {i}" for i in range(40))


def test_html_template_behind_long_lists(spark):
    page = lambda i: "<article>" + "".join(f"<p>{i} {j}</p>" for j in range(70 + 40 * (i % 9))) + "<p>About us</p></article>"
    df = spark.createDataFrame([(i, "http://a.example/x", page(i)) for i in range(9)], "page_id long, url string, html string")
    assert not [r for r in html.main_text(df).collect() if "About us" in r["text"]]


def tree(text):
    return html.skeleton(html.parse(text))[0]


def brute(a, i, b, j):
    """The textbook recursion of simple tree matching."""
    if a.label[i] != b.label[j]:
        return 0
    x, y = a.children[i], b.children[j]

    @functools.cache
    def best(m, n):
        return 0 if not m or not n else max(best(m - 1, n), best(m, n - 1), best(m - 1, n - 1) + brute(a, x[m - 1], b, y[n - 1]))

    return 1 + best(len(x), len(y))


def random_page(rng, depth=0):
    kind = rng.choice(["ul", "div", "p", "section", "div class=x"])
    inner = "".join(random_page(rng, depth + 1) if depth < 4 and rng.random() < 0.6 else f"<h2>{rng.randint(0, 3)}</h2>" for _ in range(rng.randint(0, 4)))
    return f"<{kind}>{inner}</{kind.split()[0]}>"


def test_tree_matching_by_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        a, b = (tree("".join(random_page(rng) for _ in range(rng.randint(1, 3)))) for _ in range(2))
        assert html.matched(a, 0, b, 0, html.Memo()) == brute(a, 0, b, 0)
        met = [(i, j) for j, i in enumerate(html.slots(b, a, html.Memo())) if i >= 0]
        # An alignment keeps order, ancestors and labels, one to one.
        assert len({i for i, _ in met}) == len(met)
        assert met == sorted(met, key=lambda p: p[1])
        assert all(a.label[i] == b.label[j] for i, j in met)
        assert all(not j or (a.parent[i], b.parent[j]) in met for i, j in met)


def best_total(reference, x, page, y):
    @functools.cache
    def best(m, n):
        if not m or not n:
            return 0
        p, q = x[m - 1], y[n - 1]
        w = brute(reference, p, page, q) * (1 + html.EQUAL * (reference.whole[p] == page.whole[q]))
        return max(best(m - 1, n), best(m, n - 1), best(m - 1, n - 1) + w)

    return best(len(x), len(y))


@pytest.mark.parametrize("cells", [1, 12, html.CELLS])
def test_alignment_is_best_however_tables_are_divided(cells, monkeypatch):
    monkeypatch.setattr(html, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(60):
        a, b = (tree("".join(f"<{rng.choice(['p', 'h2'])}>{rng.randint(0, 5)}" for _ in range(rng.randint(1, 14)))) for _ in range(2))
        met = [(i, j) for j, i in enumerate(html.slots(b, a, html.Memo())) if i in a.children[0]]
        total = sum(brute(a, i, b, j) * (1 + html.EQUAL * (a.whole[i] == b.whole[j])) for i, j in met)
        assert total == best_total(a, a.children[0], b, b.children[0])


HOSTILE = ["<div>" * 100_000 + "x", "<span>" * 100_000 + "x", '<a "' * 250_000, '<a "' * 250_000 + ">x", '<a "' * 250_000 + '">"x', "<a '\">" * 150_000, "<" * 1_000_000, "<!" * 500_000, "<div>" * 50_000 + "</section>" * 50_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000, "<script>" * 100_000, "<p>x" * 50_000, "<a" * 500_000, "<!--" * 250_000, "&#" * 500_000, "<p " + "a=" * 500_000 + ">x"]


@pytest.mark.parametrize("text", HOSTILE, ids=range(len(HOSTILE)))
def test_hostile_pages_take_linear_time(text):
    began = time.time()
    html.extract(text)
    assert time.time() - began < 20


def test_hostile_pages_of_one_host(spark):
    """Depth 100,000, open quotes, long lists: aligned with one another, and with whatever page is the reference."""
    pages = ["<div>" * 100_000 + "x", "<div>" * 60_000 + "<p>y" * 3000, '<a "' * 250_000, "<p>x" * 20_000, "<article><p>one</p><p>same</p></article>", "<article><p>two</p><p>same</p></article>"]
    out = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame([(i, "http://h.example/", t) for i, t in enumerate(pages)], "page_id long, url string, html string")).collect()}
    assert out[0] == "x"
    assert out[1].count("y") == 3000
    assert out[2] == pages[2]
    assert out[4] == "one\n\nsame"


def test_html_reads_tags_as_browsers_do():
    assert html.extract('<p title="a > b">one</p><p title=\'">\'>two') == "one\n\ntwo"
    assert html.extract("a < b <c> d") == "a < b d"
    assert html.extract("<p>one<b>two</p>three") == "onetwo\n\nthree"
    assert html.extract("<ul><li>a<li>b<ul><li>c</ul></ul>d") == "a\n\nb\n\nc\n\nd"
    assert html.extract("<table><tr><td>a<td>b<tr><td>c</table>") == "a\n\nb\n\nc"
    assert html.extract("x<!-- <p>gone --><!doctype html><?php no ?>y") == "xy"


def test_constant_block_between_lists_of_any_length(spark):
    """Paragraphs before and behind differ in number, from 5 to 300; the constant one between them is template."""
    page = lambda i: "<article>" + "".join(f"<p>{i} a{j}</p>" for j in range(5 + 30 * (i % 10))) + "<p>Subscribe today</p>" + "".join(f"<p>{i} b{j}</p>" for j in range(5 + 37 * (i % 7))) + "</article>"
    df = spark.createDataFrame([(i, "http://a.example/x", page(i)) for i in range(20)], "page_id long, url string, html string")
    want = {i: "\n\n".join([*(f"{i} a{j}" for j in range(5 + 30 * (i % 10))), *(f"{i} b{j}" for j in range(5 + 37 * (i % 7)))]) for i in range(20)}
    for parts in (1, 50):
        assert {r["page_id"]: r["text"] for r in html.main_text(df.repartition(parts, "page_id")).collect()} == want


ARTICLES = {
    "plain": "<article><p>{i} a</p><p>Follow us</p></article>",
    "id": '<article id="post-{i}"><p>{i} a</p><p>Follow us</p></article>',
    "class": '<article class="post post-{i}"><p>{i} a</p><p>Follow us</p></article>',
    "ids within": '<article><p id="p{i}">{i} a</p><p id="q{i}">Follow us</p></article>',
    "slug": '<div class="entry about-word{i}"><div><p>{i} a</p></div><div id="x{i}"><p>Follow us</p></div></div>',
}


@pytest.mark.parametrize("kind", ARTICLES)
def test_names_of_single_pages_do_not_hide_the_template(spark, kind):
    df = spark.createDataFrame([(i, "http://a.example/x", ARTICLES[kind].format(i=i)) for i in range(20)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.main_text(df).collect()} == {i: f"{i} a" for i in range(20)}


def sections(n, shift, odd=1):
    return "<article>" + "".join(f'<section><h2 id="s{k}-{shift}">{k} {shift}</h2>' + "".join(f"<p>{k} {j} {shift}" for j in range(1 + (k * odd + shift) % 7)) + "</section>" for k in range(n)) + "</article>"


LARGE = {
    "300 sections": lambda s: sections(300, s),
    "1000 sections": lambda s: sections(1000, s, 3),
    "2000 classes": lambda s: "<article>" + "".join(f'<div><p class="c{k}-{s}">{k} {s}</p></div>' for k in range(2000)) + "</article>",
    "20000 paragraphs": lambda s: "<article>start" + "".join(f"<p>{k} {s}</p>" for k in range(20_000 + s)) + "end</article>",
    "20000 paragraphs, half of them equal": lambda s: "<article>" + "".join(f"<p>{k} {s if k % 2 else 0}</p>" for k in range(20_000 + s)) + "</article>",
    "as many forms as children": lambda s: "<article>" + "".join("<ul>" + "<li>x" * (k + s) + "</ul>" for k in range(400)) + "</article>",
    "nested forms": lambda s: "<article>" + "".join("<div>" + "".join("<ul>" + "<li>x" * ((k * 7 + m * 3 + s) % 40) + "</ul>" for m in range(60)) + "</div>" for k in range(60)) + "</article>",
    "mixed kinds": lambda s: "<article>" + "".join(f"<{t}>{k} {s}</{t}>" for k in range(8000) for t in [("p", "h2", "ul", "pre")[(k * k // 3 + s) % 4]]) + "</article>",
}


@pytest.mark.parametrize("kind", LARGE)
def test_large_pages_align_in_bounded_time(kind):
    a, b, began = tree(LARGE[kind](0)), tree(LARGE[kind](1)), time.time()
    memo = html.Memo()
    at = html.slots(b, a, memo)
    assert time.time() - began < 10 and len(memo) < 500_000
    met = [(i, j) for j, i in enumerate(at) if i >= 0]
    assert len(met) > len(b.parent) / 4 and len({i for i, _ in met}) == len(met)
    assert all(a.label[i] == b.label[j] and (not j or (a.parent[i], b.parent[j]) in set(met[:1]) or at[b.parent[j]] == a.parent[i]) for i, j in met)


def test_longest_rising_runs_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        js = rng.sample(range(20), rng.randint(0, 9))
        best = max((len(s) for m in range(1 << len(js)) if (s := [j for k, j in enumerate(js) if m >> k & 1]) == sorted(s)), default=0)
        got = html.rising(list(enumerate(js)))
        assert len(got) == best and got == sorted(got) and [j for _, j in got] == sorted(j for _, j in got)


def digits(ks):
    """Lists of as many forms: an item for each binary digit, of one of two kinds."""
    return "".join("<ul>" + "".join("<li>x</li>" if c == "0" else "<li><p>x</p></li>" for c in f"{k:b}") + "</ul>" for k in ks)


def test_matching_is_exact_beyond_any_number_of_forms():
    """Over 70 forms a side, out of step, so pairing the nth with the nth is far from best."""
    rng = random.Random(5)
    ks = [*range(1, 72)]
    rng.shuffle(ks)
    a, b = tree(f"<div>{digits(ks)}</div><p>a</p>"), tree(f"<div>{digits([*range(100, 105), *ks[:40], 1, 2, *ks[40:]])}</div><p>b</p>")
    assert html.matched(a, 0, b, 0, html.Memo()) == brute(a, 0, b, 0)
    at = html.slots(b, a, html.Memo())
    x, y = a.children[a.children[0][0]], b.children[b.children[0][0]]
    total = sum(brute(a, at[q], b, q) * (1 + html.EQUAL * (a.whole[at[q]] == b.whole[q])) for q in y if at[q] >= 0)
    assert total == best_total(a, x, b, y)
    # All lists of the one page are in the other, in order.
    assert [at[q] for q in y if at[q] >= 0 and a.whole[at[q]] == b.whole[q]] == x


def test_alignment_of_large_pages_is_that_of_small_ones():
    """A block that moved among others finds its place as well among thousands as among a few."""
    for n in (10, 1500):
        a, b = (tree("".join(f"<p>{k} {s}</p>" for k in range(n)) + "<p>same</p><p>same</p>" + "".join(f"<h2>{k} {s}</h2>" for k in range(more)) + f"<p>{s}</p>") for s, more in ((0, n), (1, 2 * n)))
        at = html.slots(b, a, html.Memo())
        met = [(i, j) for j, i in enumerate(at) if i in a.children[0]]
        assert len(met) == 2 * n + 3
        assert sum(a.whole[i] == b.whole[j] for i, j in met) == 2
        # A small equal block outweighs a large one of other text, whatever its size.
        a, b = (tree("<p>keep</p>" * before + "<div>" + f"<h2>{before}</h2>" * n + "</div>" + "<p>keep</p>" * (1 - before)) for before in (0, 1))
        keep = [[p for p in t.children[0] if t.label[p] == html.label_mark("p")][0] for t in (a, b)]
        assert html.slots(b, a, html.Memo())[keep[1]] == keep[0]


def test_alignment_does_not_depend_on_how_tables_are_kept(monkeypatch):
    rng = random.Random(8)
    pages = [tree("".join(f"<{rng.choice(['p', 'h2'])}>{rng.randint(0, 3)}" if rng.random() < 0.5 else random_page(rng) for _ in range(rng.randint(1, 40)))) for _ in range(80)]
    found = []
    for cells, parts, kept in ((1 << 18, 64, 1 << 25), (1, 2, 0), (12, 3, 100), (50, 64, 1)):
        for name, value in (("CELLS", cells), ("PARTS", parts), ("KEPT_ROWS", kept)):
            monkeypatch.setattr(html, name, value, raising=False)
        found.append([html.slots(b, a, html.Memo()) for a, b in zip(pages[::2], pages[1::2], strict=True)])
    assert all(f == found[0] for f in found)
