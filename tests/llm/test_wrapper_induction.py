"""Page text against a separate reading of the pages, matching against brute force, template slots, edge cases."""

import itertools
import random
import re
import time
from html import unescape

from brickledger.llm import queries
from brickledger.llm import wrapper_induction as wi


def plain_article(html):
    """Blocks of the article by a plain reading that suits the given pages only."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)
    if not body:
        return ""
    cut = re.sub(r"<[^>]*\Z", "", body[1])
    parts = re.split(r"</?(?:p|h\d)\b[^>]*>", cut)
    texts = (re.sub(r"\s+", " ", unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p)))).strip() for p in parts)
    return "\n\n".join(t for t in texts if t)


def test_query_equals_plain_reading(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.registered()["op10_wrapper_induction"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url
        assert r.text == plain_article(pages[r.page_id].html), r.page_id
        assert r.n_chars == len(r.text)


def test_template_alone_finds_the_text(spark, sf_dir):
    """Element and class names set aside, slots that hold text which varies and is no link are what is left."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in wi.main_text(pages, names=False).collect()}
    assert len(got) == len(want) and sum(got[i] == t for i, t in want.items()) >= 0.9 * len(want)


def tree(rng, depth=3):
    slot = wi.Slot("r", "div")
    for label in rng.sample("abcd", rng.randint(0, 4)) if depth else []:
        slot.children[label] = tree(rng, depth - 1)
    return slot


def plain_matching(a, b):
    """Simple tree matching by trying every order-preserving choice."""
    def best(x, y):
        if not x or not y:
            return 0
        skip = max(best(x[1:], y), best(x, y[1:]))
        if x[0] == y[0]:
            skip = max(skip, plain_matching(a.children[x[0]], b.children[y[0]]) + best(x[1:], y[1:]))
        return skip

    return 1 + best(list(a.children), list(b.children))


def test_matching_is_the_largest():
    rng = random.Random(2)
    for _ in range(200):
        a, b = tree(rng), tree(rng)
        size, partner = wi.match(a, b)
        assert size == plain_matching(a, b) == len(partner)
        # partners keep ancestors and order
        stack = [a]
        while stack:
            node = stack.pop()
            order = list(partner[id(node)].children)
            own = [(label, c) for label, c in node.children.items() if id(c) in partner]
            assert all(partner[id(c)] is partner[id(node)].children[label] for label, c in own)
            assert [order.index(label) for label, _ in own] == sorted(order.index(label) for label, _ in own)
            stack += [c for _, c in own]


def test_rising_choice_is_the_heaviest():
    rng = random.Random(3)
    for _ in range(200):
        pairs = [(p, rng.randint(1, 9)) for p in rng.sample(range(12), rng.randint(0, 8))]
        rising = [c for k in range(len(pairs) + 1) for c in itertools.combinations(range(len(pairs)), k)
                  if all(pairs[x][0] < pairs[y][0] for x, y in zip(c, c[1:]))]
        total, chosen = wi.heaviest_rise(pairs)
        assert total == max(sum(pairs[i][1] for i in c) for c in rising) == sum(pairs[i][1] for i in chosen)
        assert tuple(chosen) in rising


def test_template_grows_and_reads_back():
    pages = ["<body><div class=a><p>x</p></div><div class=c></div></body>", "<body><div class=a><h2>t</h2><p>y</p></div><div class=b><p>z</p></div><div class=c></div></body>"]
    template = wi.template_of(pages)
    paths = lambda slot: [(p, s.label) for p, s in wi.numbered(slot)]
    assert {"div.a", "div.b", "div.c", "h2.", "p."} <= {s.label for _, s in wi.numbered(template)}
    again, parents = wi.unpacked(wi.packed(template))
    assert paths(again) == paths(template) and parents == [p for p, _ in wi.numbered(template)]
    assert paths(wi.template_of(pages[::-1])) == paths(template)
    for html in pages:
        top, _ = wi.drawn_together(wi.parse(html))
        assert wi.match(top, template)[0] == len(wi.numbered(top))


def test_many_siblings_take_no_time():
    begin = time.perf_counter()
    for html in ("<body>" + "<p>a</p><div>b</div>" * 5_000, "<body>" + "".join(f"<div class=k{i}>t{i}</div>" for i in range(10_000)),
                 "<body>" + "".join(f"<div class=k{i}>t{i}</div>" for i in reversed(range(10_000)))):
        template = wi.template_of([html, "<body><div class=k7><p>x</p></div></body>"])
        number = {id(slot): i for i, (_, slot) in enumerate(wi.numbered(template))}
        assert len(wi.blocks_of(wi.parse(html), template, number)) == 10_000
    assert time.perf_counter() - begin < 10


def test_the_article_is_kept_whole(spark):
    inner = ("<h2 id='related-work'>Related work</h2><p>One</p><figure><img><figcaption>A caption</figcaption></figure>"
             "<section id='discussion'><p>Two</p></section><div class='search-results-analysis'><p>Three</p></div>"
             "<p>With <math><mi>x</mi></math></p><object>Four</object>")
    apart = ("<div class='ad-banner'>buy</div><section class='comments'><p>nice</p></section><aside>side</aside><form>f</form>"
             "<div class='cookie-notice'>cookies</div><nav>menu</nav><div role='complementary'>more</div>")
    html = f"<html><body><div class='menu'>m</div><article>{inner}{apart}</article><footer>f</footer></body></html>"
    got = run(spark, [(1, "http://one.example/", html)] + [(i, "http://many.example/", html.replace("One", f"One {i}")) for i in range(2, 9)])
    want = "Related work\n\nOne\n\nA caption\n\nTwo\n\nThree\n\nWith x\n\nFour"
    assert got[1] == want and all(got[i] == want.replace("One", f"One {i}") for i in range(2, 9))


def page(i, article, ad):
    return (f"<html><head><title>T {i}</title></head><body><nav><a href=x>Home</a> <a>Shop {i}</a></nav><div class='top'>Our slogan</div>"
            f"<div class='story'>{article}</div><div class='box'>Call us now</div><div class='ad-slot'>{ad}</div>"
            f"<form>Mail <input></form><section id='comments'><p>nice {i}</p></section><footer>(c) {i}</footer></body></html>")


SCHEMA = "page_id long, url string, html string, text string, host string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "t", "h") for r in rows], SCHEMA)
    return {r.page_id: r.text for r in wi.main_text(df).collect()}


def test_constant_slots_are_template_and_varying_ones_content(spark):
    rows = [(i, f"http://a.example/{i}", page(i, f"<h2>Head {i}</h2><p>One {i}</p><p>Two  {i}</p>", f"buy {i}")) for i in range(8)]
    got = run(spark, rows)
    for i in range(8):
        assert got[i] == f"Head {i}\n\nOne {i}\n\nTwo {i}"


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://b.example/", page(0, "<p>Same story</p>", "x")) for i in range(30)]
    assert set(run(spark, rows).values()) == {"Our slogan\n\nSame story\n\nCall us now"}


def test_a_line_that_many_pages_share_stays(spark):
    rows = [(i, "http://c.example/", page(i, f"<p>{'Common line' if i % 4 else 'Rare'}</p><p>Text {i}</p>", "x")) for i in range(12)]
    got = run(spark, rows)
    assert got[1] == "Common line\n\nText 1" and got[4] == "Rare\n\nText 4"


def test_edge_pages(spark):
    deep = "<div>" * 30_000 + "deep" + "</div>" * 30_000
    rows = [(1, None, None), (2, "", ""), (3, "no host", "just text &amp; more &lt;b&gt;"), (4, "http://x.example", "<article><p>cut <b>off</b> he"),
            (5, "http://x.example", "<article><p>a</p><p>b<p>c</article><p>after"), (6, "http://x.example", "<p>tag cut</p><p cla"),
            (7, "http://y.example", "<body><p>w " + "word " * 200_000 + "</p></body>"), (8, "http://z.example", deep),
            (5, "http://x.example", "<article><p>a</p><p>b<p>c</article><p>after"), (9, "http://y.example", "<script>var a='</p>';</script><p>x<!-- c --></p><style>p{}"),
            (10, "http://y.example", "<ul><li>one<li>two &eacute;&#233;&nbsp;x</ul>"), (None, "http://y.example", "<p>no id</p>")]
    got = run(spark, rows)
    assert got[1] == got[2] == ""
    assert got[3] == "just text & more <b>"
    assert got[4] == "cut off he" and got[5] == "a\n\nb\n\nc" and got[6] == "tag cut"
    assert got[7] == "w " + " ".join(["word"] * 200_000)
    assert got[8] == "deep" and got[9] == "x" and got[10] == "one\n\ntwo éé x" and got[None] == "no id"
    df = spark.createDataFrame([(*r, "t", "h") for r in rows], SCHEMA)
    assert wi.main_text(df).count() == len(rows)
    assert wi.main_text(df.limit(0)).count() == 0


def test_template_is_counted_over_all_pages(spark):
    """Twelve layouts of one host are all in its template, in the order of the pages, however the rows are dealt."""
    kinds = [f"k{i:02d}" for i in range(12)]
    pages = [(f"<body><div class=top>t</div>{f'<div class={kinds[i % 12]}><p>{i}</p></div>' * (i % 3 + 1)}<div class=end>e</div></body>")
             for i in range(240)]
    df = spark.createDataFrame([("h", html) for html in pages] + [("plain", "no element"), ("h", "<body><div class=rare>once</div></body>")],
                               "host string, html string")
    found = {}
    for parts in (1, 7):
        for r in wi.templates(df.repartition(parts)).collect():
            found.setdefault(r.host, set()).add(r.template)
    assert all(len(texts) == 1 for texts in found.values())  # the same for both dealings
    body = wi.unpacked(found["h"].pop())[0].children["body."]
    labels = list(body.children)
    assert labels[0] == "div.top" and labels[-1] == "div.end" and sorted(labels[1:-1]) == [f"div.{k}" for k in kinds]  # 1 page of 241 is no layout
    assert all(list(body.children[f"div.{k}"].children) == ["p."] for k in kinds)
    assert wi.numbered(wi.unpacked(found["plain"].pop())[0])[0][0] == -1
    assert set(wi.templates(df.where("html like '%rare%'")).collect()[0].template.split('"')) >= {"div.rare"}


def test_text_of_rare_layouts_is_kept(spark):
    rows = [(i, "http://r.example/", f"<body><div class={'rare' if i == 5 else 'story'}><p>Text {i}</p></div></body>") for i in range(80)]
    got = run(spark, rows)
    assert all(got[i] == f"Text {i}" for i in range(80))


def test_order_of_slots_follows_the_pages():
    rng = random.Random(4)
    for _ in range(200):
        order = rng.sample(range(1, 30), rng.randint(1, 12))
        pages = [[x for x in order if rng.random() < 0.6] for _ in range(6)] + [order]
        lefts = {x: {} for x in order}
        for page in pages:
            for left, x in zip([0, *page], page):
                lefts[x][left] = lefts[x].get(left, 0) + 1
        assert wi.in_order({x: (rng.random(), lefts[x]) for x in order}) == order
    assert sorted(wi.in_order({1: (0.0, {2: 1}), 2: (0.5, {1: 3})})) == [1, 2]  # pages that contradict each other
    assert wi.in_order({1: (0.0, {2: 1}), 2: (0.5, {1: 3})}) == [1, 2]
