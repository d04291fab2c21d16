import json
import random
import re
import time
from html import unescape

from pyspark.sql import functions as F

from quirel.llm import html, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav>
<div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>One  <b>bo</b>ld<br>two &lt;3<p class="x">Three&nbsp;four<form><input>Sign up</form>
<aside>Related</aside><script>x</script></article>
<section id="comments"><article class="comment">Nice post</article></section><footer>&copy; me</footer></body></html>"""


def test_article_only():
    assert html.extract(PAGE) == "Head & line One bold two <3 Three four"


def test_odd_input():
    for h in ("", "<", "plain & text", "<p>cut <b", "</p></p>", "<!-- open", "<div><div>" * 400 + "x", "<script>never ends", "&amp", "<a b='>'>q</a>"):
        html.extract(h)
    assert html.extract("plain &amp; text") == "plain & text" and html.extract("<a b='>'>q</a>") == "q"


def test_markup_as_browsers_read_it():
    assert html.extract("<article><p data-x=it's>alpha</p><p>it's beta</p></article>") == "alpha it's beta"
    assert html.extract('<article><p title="a>b" x=\'c>d\' y = "e">one</p><p =odd "stray>two</p></article>') == "one two"
    assert html.extract("<article>a <math>x</math> <object>o</object> <canvas>c</canvas> <button>b</button> <map>m</map> z</article>") == "a x o c b m z"
    assert html.extract("<head><title>T</title><body>one</body></html>two<!-- > --><!-->three</>four< five") == "onetwothreefour< five"
    assert html.extract("<p title='never closed><p>x") == "" and html.extract("a<br/>b<script/>c</script >d") == "a bd"


def test_long_and_deep_pages_take_time_in_proportion():
    n = 100_000
    hard = ["<div>" * n + "x", "<span>" * n + "x<p>y", "<ul><li>" * n + "x", "<i></b>" * n, "<p>" * n + "x", "".join(f"<div class=c{i}>x</div>" for i in range(n)), "<a " + "b='c' " * n + ">x", "<!--" * n, "<" * n, "&amp" * n]
    for h in hard:
        began = time.process_time()
        html.extract(h)
        tree = html.reference([h, h + "<p>1", "<b>2</b>" + h])
        html.slot_texts(h, json.dumps({"tree": tree}))
        assert time.process_time() - began < 60, h[:30]
    assert html.extract(hard[0]) == "x"


def as_rows(tree):
    return tree.marks, tree.children


def brute_size(a, b, x=0, y=0):
    """Nodes of the largest simple matching, by trying all."""
    if a.marks[x] != b.marks[y]:
        return 0
    xs, ys = a.children[x], b.children[y]
    best = {(0, 0): 0}
    for i in range(len(xs) + 1):
        for j in range(len(ys) + 1):
            if i and j:
                best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + brute_size(a, b, xs[i - 1], ys[j - 1]))
            else:
                best[i, j] = 0
    return 1 + best[len(xs), len(ys)]


def random_page(rng, depth=0):
    return "".join(f"<{t}>{random_page(rng, depth + 1) if depth < 3 else 'x'}</{t}>" for t in rng.choices(["div", "section", "p"], k=rng.randrange(4)))


def check_order(a, b, found):
    for x, row in enumerate(a.children):
        met = [(b.children[found[x]].index(found[c])) for c in row if c in found] if x in found else []
        assert met == sorted(set(met)) and all(a.marks[x] == b.marks[y] for x, y in found.items())


def test_tree_match_equals_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        a, b = (html.Tree(html.parse(random_page(rng))) for _ in range(2))
        found = html.tree_match(*as_rows(a), *as_rows(b))
        assert len(found) == brute_size(a, b)
        check_order(a, b, found)
        check_order(a, b, html.tree_match(*as_rows(a), *as_rows(b), limit=0))


def test_runs_are_folded():
    tree = html.Tree(html.parse("<ul><li>a<li>b<li>c<ul><li>d<li>e</ul><li>f<ul><li>g</ul></ul><p>x<p>y"))
    first = [x for x, c in enumerate(tree.canon) if x == c]
    assert [tree.marks[x] for x in first] == ["html", "ul", "li", "li", "ul", "li", "p"]


POOL = ["Buy the best shoes in town today.", "Sign the letter now, friends.", "Our shop has new hats again.", "Rain is expected on all days."]


def unnamed(i, site="acme.example", words=60):
    """A page whose parts don't name themselves: links, an advert, an article, a last line."""
    rng = random.Random(i)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    title, parts = f"{word()} {word()}", [" ".join(word() for _ in range(words)) for _ in range(1 + i % 4)]
    links = "".join(f"<div><a href=/{k}>{rng.choice(POOL)[:9]}</a></div>" for k in range(5))
    text = f"<p>{title}</p>" + "".join(f"<p>{p}</p>" for p in parts)
    page = f"<body><div>{links}</div><div>{rng.choice(POOL)}</div><div>{text}</div><div>&copy; {site} all rights {rng.choice(POOL)}</div></body>"
    return page, " ".join([title, *parts])


def test_wrapper_finds_what_nothing_names(spark):
    made = {i: unnamed(i, f"s{i % 2}.example") for i in range(40)}
    pages = spark.createDataFrame([(i, f"http://s{i % 2}.example/{i}", p) for i, (p, _) in made.items()], "page_id long, url string, html string")
    rows = html.main_text(pages).collect()
    assert {r.page_id: r.text for r in rows} == {i: t for i, (_, t) in made.items()}
    # Without the wrapper the same pages are read as a whole.
    assert all(html.extract(p) != t and t in html.extract(p) for p, t in made.values())


def test_constants_within_a_named_article_go(spark):
    page = lambda i: f"<article><h1>Title {i}</h1><div>Share this with your friends</div><p>{'story ' * 20}{i}</p><section><p>{'more ' * i}end {i}</p></section></article>"
    pages = spark.createDataFrame([(i, "http://a.example", page(i)) for i in range(9)], "page_id long, url string, html string")
    for r in html.main_text(pages).collect():
        i = r.page_id
        assert r.text == " ".join(f"Title {i} {'story ' * 20}{i} {'more ' * i}end {i}".split())


def test_every_slot_is_content_and_few_pages_have_no_wrapper(spark):
    page = lambda i: f"<body><div class=top>Acme</div><div class=page><h1>Title {i}</h1><div class=lead>{i}{i} Lead</div><div class=text><p>{'word ' * 30}{i}</p></div><ul><li>{i} item</ul></div><div class=end>All rights</div></body>"
    pages = spark.createDataFrame([(i, "http://a.example" if i < 20 else "http://b.example", page(i)) for i in range(22)], "page_id long, url string, html string")
    for r in html.main_text(pages).collect():
        i = r.page_id
        whole = f"Title {i} {i}{i} Lead {'word ' * 30}{i} {i} item"
        assert r.text == " ".join((whole if i < 20 else f"Acme {whole} All rights").split())


def plain(i, text):
    return f"<html><body><div class=top><p>Acme daily</p></div><div class=story><p>{text}</p><p>more {i}</p></div><div class=end><p>All rights reserved</p></div></body></html>"


def truth(page):
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    return " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", m[1]))).split())


def test_query_equals_plain_reading(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op9_html(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, truth(pages[r.page_id].html), len(r.text))


def test_nulls_repeats_clashes_and_salted_join(spark, monkeypatch):
    rows = [(i, f"http://a.example/{i}", plain(i, f"words {i} " * 9)) for i in range(20)] + [(7, None, None), (7, "odd", ""), (None, "http://b.example", "<p>x</p>"), (7, "http://a.example/7", plain(7, "words 7 " * 9))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "text": F.lit(2), "wrapper": F.lit(3)})
    near = sorted(map(str, html.main_text(pages).collect()))
    monkeypatch.setattr(html, "BROADCAST_CHARS", 0)
    assert sorted(map(str, html.main_text(pages).collect())) == near and len(near) == 24
    assert html.main_text(pages.where("false")).collect() == []


def film(i):
    return f"<body><section class=bar><p>Acme films</p></section><section class=film><p>film {i} {'scene ' * 9}</p></section><section class=foot><p>Write to the desk</p></section></body>"


def test_every_layout_of_a_host_is_known_however_few_its_pages(spark):
    made = [(i, f"film {i} {'scene ' * 9}".strip() if i % 50 == 7 else f"words {i} {'and ' * 9}more {i}") for i in range(400)]
    rows = [(i, f"http://a.example/{i}", film(i) if i % 50 == 7 else plain(i, text.removesuffix(f" more {i}"))) for i, text in made]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.main_text(pages).collect()} == dict(made)
    # Of a host whose content names itself, too.
    named = [(i, u, h.replace("<div class=story>", "<article>").replace("</div><div class=end>", "</article><div class=end>")) for i, u, h in rows]
    pages = spark.createDataFrame(named, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.main_text(pages).collect()} == dict(made)


def varied(i):
    rng = random.Random(i)
    body = "".join(f"<{t}>{t} {i} {rng.random()}</{t[:6].split()[0]}>" for t in rng.choices(["p", "h2", "ul", "pre", "table"], k=rng.randrange(2, 9)))
    return f"<body><div class=top>Acme</div><div class=page>{body}<div class=only{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}>{i}</div></div><div class=end>All rights</div></body>"


def test_all_different_pages_make_the_reference_tree_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(html, "FAN", 4)
    pages = {(f"h{i % 2}", varied(i)) for i in range(120)}
    rows = spark.createDataFrame([*pages, *pages, ("few", "<p>x"), ("few", "<p>y")], "host string, html string")
    found = {r.host: json.loads(r.tree) for r in html.reference_trees(rows).collect()}
    assert set(found) == {"h0", "h1"}
    for host, tree in found.items():
        held = [p for h, page in pages if h == host for p in set(html.paths(html.folded(page)))]
        # Every path that two pages have, and no other, as in one merging of all pages.
        assert set(html.paths(tree)) == {p for p in held if held.count(p) > 1} == set(html.paths(html.reference([page for h, page in pages if h == host])))
        assert all(p < x for x, p in enumerate(tree["parents"])) and len(tree["flags"]) == len(tree["marks"])
    monkeypatch.setattr(html, "FAN_CHARS", 1)
    assert {r.host for r in html.reference_trees(rows).collect()} == {"h0", "h1"}


def test_merged_trees_count_pages():
    a, b = (html.folded(h) for h in ("<div>x</div><p>y</p>", "<section role=navigation>z</section><p>y</p>"))
    tree = html.merged([(html.merged([(a, 3)]), 1), (b, 2)])
    assert dict(zip(tree["marks"], zip(tree["seen"], tree["aside"]))) == {"html": (5, 0), "div": (3, 0), "section": (2, 2), "p": (5, 0)}
    assert html.flagged(tree) == {"marks": tree["marks"], "parents": [-1, 0, 0, 0], "flags": [int(m == "section") for m in tree["marks"]]}


def test_wide_rows_are_matched_the_same(monkeypatch):
    rng = random.Random(4)
    wide = [html.Tree(html.parse("".join(f"<{t}><b>x</b></{t}>" for t in rng.choices(["div", "section", "p", "ul", "pre"], k=60)))) for _ in range(2)]
    near = html.tree_match(*as_rows(wide[0]), *as_rows(wide[1]))
    monkeypatch.setattr(html, "WIDE", 1000)
    assert html.tree_match(*as_rows(wide[0]), *as_rows(wide[1])) == near and len(near) > 20


def test_long_wrappers_begin_their_hosts_parts(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/{i}", plain(i, f"words {i} " * 9)) for i in range(60)] + [(60, "http://none.example", plain(1, "alone")), (61, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    near = sorted(map(str, html.main_text(pages).collect()))
    monkeypatch.setattr(html, "LONG", 0)
    assert sorted(map(str, html.main_text(pages).collect())) == near and len(near) == 62


def test_large_trees_are_matched_as_well_as_small_ones():
    rng = random.Random(9)
    for _ in range(150):
        a, b = (html.Tree(html.parse(random_page(rng))) for _ in range(2))
        found = html.tree_match(*as_rows(a), *as_rows(b), limit=0)
        assert len(found) == brute_size(a, b)
        check_order(a, b, found)
    # A block more in front of many takes none of their places, however many there are.
    block = lambda k: f"<div class=c{k % 7}><p>x</p>{'<ul><li>y</ul>' * (k % 3 > 0)}</div>"
    rows = "".join(block(k) for k in range(900))
    a, b = html.Tree(html.parse(rows)), html.Tree(html.parse(block(3) + block(5) + rows + block(2)))
    found = html.tree_match(*as_rows(a), *as_rows(b))
    assert len(found) == len({*a.canon})
    check_order(a, b, found)
