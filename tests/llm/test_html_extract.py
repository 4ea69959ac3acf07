"""Main texts of pages built from known parts, with wrappers induced per host."""

from __future__ import annotations

import html
import random
import re
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import html_extract as H


def page(article: str, extra: str = "", wrap: str = "article") -> str:
    return (
        '<!DOCTYPE html><html><head><title>Title</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
        f'<!-- note --><div class="ad">Buy &amp; save</div><{wrap}>{article}</{wrap}>{extra}<div class="comments"><p>First!</p></div><form><input value="x"><button>Go</button></form><footer>&copy; Site</footer></body></html>'
    )


def extracted(spark, rows: list[tuple]) -> dict:
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = H.html_extract(pages, ["page_id", "url"]).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def test_blocks_and_references(spark):
    rows = [
        (1, "http://a/1", page("<h1>Head  line</h1><p>One <b>bold</b>\n two &amp; three&nbsp;&eacute;<p>Next<br>line<ul><li>x<li>y</ul>")),
        (2, "http://a/2", page("<p>if 1 &lt; 2 &gt; 0</p><script>no()</script><style>no{}</style><aside>side</aside><p>end</p>")),
        (3, "http://b/1", page("<header><h1>Own title</h1></header><p>Text</p>", wrap="main")),
        (4, "http://b/2", page("<p>No article here</p>", wrap="div")),
        (5, None, None),
        (6, "", ""),
        (7, "http://c/", "plain text, no markup & more"),
        (8, "http://c/", "<p>cut <b"),
        (9, "http://c/", "<nav>only menus</nav>"),
    ]
    assert extracted(spark, rows) == {
        1: "Head line One bold two & three é Next line x y", 2: "if 1 < 2 > 0 end", 3: "Own title Text", 4: "No article here", 5: "", 6: "", 7: "plain text, no markup & more", 8: "cut", 9: "",
    }


def test_wrappers_of_a_host(spark):
    """Texts that nearly all pages of a host repeat at one place go; what varies, or rests on few pages, stays."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        body = [prose(30), prose(20)]
        rows.append((i, f"http://big.example/{i}", page(f"<p>Subscribe to our letter</p><p>{body[0]}</p><p>{body[1]}</p>", wrap="div")))
        want[i] = " ".join(body)
    for i in range(40, 44):
        body = prose(30)
        rows.append((i, f"http://small.example/{i}", page(f"<p>Same first line</p><p>{body}</p>")))
        want[i] = f"Same first line {body}"
    copy = prose(50)
    for i in range(44, 60):  # copies of one page are no template
        rows.append((i, f"http://copies.example/{i}", page(f"<p>{copy}</p>")))
        want[i] = copy
    assert extracted(spark, rows) == want


def test_constant_text_after_many(spark):
    """A text on every page is template after 3, 12 or 30 varying paragraphs, in and out of articles; one on half the pages is not."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows, want = [], {}
    for many in (3, 12, 30):
        for wrap in ("article", "div"):
            for i in range(40):
                body = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(many)] + ["On half the pages"] * (i % 2)
                paragraphs = "".join(f"<p>{t}</p>" for t in [*body, "All of this is our own opinion"])
                k = len(rows)
                rows.append((k, f"http://{wrap}{many}.example/{i}", page(paragraphs, wrap=wrap)))
                want[k] = " ".join(body)
    assert extracted(spark, rows) == want


def test_short_articles_under_a_long_menu(spark):
    """The template goes however short the article is; a page that is nothing else keeps it."""
    menu = "".join(f"<li>Department number {k} of the house</li>" for k in range(12))
    rows, want = [], {}
    for i in range(40):
        body = " ".join(["word"] * (i * 3 + 1)) + f" {i}"
        rows.append((i, f"http://plain.example/{i}", f"<html><body><div><ul>{menu}</ul></div><div><p>{body}</p></div></body></html>"))
        want[i] = body
    rows.append((40, "http://plain.example/40", f"<html><body><div><ul>{menu}</ul></div></body></html>"))
    want[40] = " ".join(f"Department number {k} of the house" for k in range(12))
    assert extracted(spark, rows) == want


def test_supplied_pages(spark, sf_dir):
    """The supplied pages keep their article between its tags."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()
    got = {r.page_id: r.text for r in H.query(spark, sf_dir).collect()}
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html or "", re.S)
        assert article, "the supplied pages have one article each"
        plain = html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", article[1])))
        assert got[r.page_id] == " ".join(plain.split())


def test_long_page_and_empty_table(spark):
    body = "".join(f"<div><p>paragraph {i}</p>" for i in range(5000))
    got = extracted(spark, [(1, "http://x/", page(body)), (2, "http://x/", "<" * 20000), (3, "http://x/", "<p " * 20000)])
    assert got[1] == " ".join(f"paragraph {i}" for i in range(5000))
    assert H.html_extract(spark.createDataFrame([], "page_id long, url string, html string"), ["page_id"]).count() == 0


LABELS = st.recursive(st.just({}), lambda kids: st.dictionaries(st.sampled_from("abcd"), kids, max_size=4), max_leaves=9)


def built(tree: dict) -> H.Tree:
    out = H.Tree()
    todo = [(0, tree)]
    while todo:
        node, kids = todo.pop()
        todo += [(out.child(node, label, H.NOTHING), below) for label, below in kids.items()]
    return out


def brute_matching(a: dict, b: dict) -> int:
    """Simple tree matching of two trees whose roots correspond, by its recursion over the children's lists."""

    def forest(x: list, y: list) -> int:
        if not x or not y:
            return 0
        (p, below), (q, under) = x[-1], y[-1]
        return max(forest(x[:-1], y), forest(x, y[:-1]), forest(x[:-1], y[:-1]) + (brute_matching(below, under) if p == q else 0))

    return 1 + forest(list(a.items()), list(b.items()))


@settings(max_examples=300, deadline=None)
@given(LABELS, LABELS)
def test_simple_tree_matching(a, b):
    left, right = built(a), built(b)
    matched = H.aligned(left, dict(zip(right.keys, right.places, strict=True)))
    assert sum(matched) == brute_matching(a, b)
    assert all(matched[left.parents[i]] for i in range(1, len(matched)) if matched[i])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=9, unique_by=lambda x: x[0]))
def test_heaviest_increasing(rows):
    ranks, weights = [r for r, _ in rows], [w for _, w in rows]
    best = 0
    for mask in range(1 << len(rows)):
        at = [k for k in range(len(rows)) if mask >> k & 1]
        if all(ranks[x] < ranks[y] for x, y in zip(at, at[1:], strict=False)):
            best = max(best, sum(weights[k] for k in at))
    total, places = H.heaviest(ranks, weights)
    assert total == best == sum(weights[k] for k in places)
    assert all(ranks[x] < ranks[y] for x, y in zip(places, places[1:], strict=False))


def alone(body: str) -> str:
    """The main text of a page that is its host's only one."""
    tree = H.parse(body)
    counts = next(iter(H._counted([H.pa.RecordBatch.from_arrays([H.pa.array(["h"]), H.pa.array([body])], names=["host", "html"])])))
    nodes = [tuple(r.values())[1:] for r in counts.to_pylist()]
    assert len(nodes) == len(tree.keys)
    return H.main_text(body, H.Wrapper(*H.decided(nodes)))


def test_roles_are_those_of_elements():
    """Siblings that begin alike have roles of their own, hidden parts end where their element ends, names are read whole."""
    cases = {
        '<div class="block text">Hello</div><div class="block sidebar">SIDE</div>': "Hello",
        '<div class="block ad">Buy</div><div class="block text">Hello</div>': "Hello",
        "<div hidden>no</div><div>yes</div>": "yes",
        "<div>yes</div><div hidden>no</div>": "yes",
        "<p>one <span hidden>x</span> two</p>": "one two",
        "<p>one <span hidden>x <span>y</span> z</span> two</p>": "one two",
        '<p>one <b style="display: none">x</p><p>two</p>': "one two",
        '<article><p class="share-price">12 points</p><div class="share-buttons">Share</div><div class="side-by-side">Both</div></article>': "12 points Both",
        '<div class="widget">W</div><p class="banner-theory">B</p>': "B",
        '<body class="has-sidebar"><p>text</p></body>': "text",
        "<aside><article>teaser</article></aside><article>text</article>": "text",
        '<div class="ad">Buy<article>text</article>': "text",
        "<form><article>text</article><input>Name</form>": "text",
        '<article>text<section class="comments"><article class="comment">First!</article></section></article>': "text",
        "a<!-- <p>no</p> -->b <i title='1 > 0'>c</i> <p title=it's>d</p>": "ab c d",
        "<div><ul><li><a href=/>Home</a><li><a href=/b>Blog</a><li><a href=/c>Contact</a></ul></div><p>A <a href=/d>link</a> in text.</p>": "A link in text.",
        "<p>x</p><script>if (a</b) '</p>'</SCRIPT ><p>y</p><style>p{}": "x y",
    }
    assert {k: alone(k) for k in cases} == cases


def test_broken_markup_takes_seconds():
    began = time.perf_counter()
    for piece in ("<script ", '<p a="', "<p ", "<", "<div>", "</p>", "<p><b>", "<!--", "<a href='", "<h1><td><li>", "<p><div><h1>", "<title>", "<x1><div hidden>", "a&amp;<b>"):
        text = piece * (1_000_000 // len(piece))
        for body in (text, text + ">"):
            H.main_text(body, H.Wrapper([], [], [], False))
    assert time.perf_counter() - began < 90


def site(seed: int, pages: int) -> list[tuple[str, list[str]]]:
    """(html, texts in order) of a site without article tags or telling names: a menu, notices and varying texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    notices = [prose(rng.randint(2, 9)) for _ in range(3)]
    out = []
    for _ in range(pages):
        texts = [prose(rng.randint(1, 40)) for _ in range(rng.randint(1, 30))]
        slots = [f"<p>{t}</p>" for t in texts]
        for note in notices:
            if rng.random() < 0.95:
                slots.insert(rng.choice([0, len(slots)]), f"<p>{note}</p>")
        out.append((f'<html><body><div class="x{rng.randint(0, 9)}"><h2>{notices[0]}</h2></div><div>{"".join(slots)}</div><div><span>{notices[1]}</span></div></body></html>', re.findall(r"<(?:p|h2|span)>(.*?)</", f"<h2>{notices[0]}</h2>{''.join(slots)}<span>{notices[1]}</span>")))
    return out


def test_generated_sites_as_brute_force(spark):
    """Texts that at least 8 pages and 0.8 of a host's pages have at one place go, counted plainly; without wrappers all stay."""
    rows, want = [], {}
    for host in range(6):
        made = site(host, [3, 9, 20, 40, 40, 80][host])
        times = Counter(t for _, texts in made for t in set(texts))
        for body, texts in made:
            k = len(rows)
            rows.append((k, f"http://site{host}.example/{k}", body))
            shared = {t for t in texts if times[t] >= H.SUPPORT and times[t] >= H.CONSTANT * len(made)}
            want[k] = " ".join(t for t in texts if t not in shared) or " ".join(texts)
    got = extracted(spark, rows)
    assert got == want
    off = {k: H.main_text(body, None) for k, _, body in rows}
    assert sum(off[k] == want[k] for k in want) < 0.1 * len(want)


def test_order_of_pages_does_not_matter(spark):
    rows = [(k, f"http://h{k % 2}.example/", body) for k, (body, _) in enumerate(site(11, 40))]
    assert extracted(spark, rows) == extracted(spark, rows[::-1])


def test_wrappers_decide_on_the_supplied_pages(spark, sf_dir):
    """Every supplied host has a wrapper, and without it the texts are others."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    wrappers = H.induce(H.with_host(rows)).collect()
    assert {w.host for w in wrappers} == {r[0] for r in H.with_host(rows).select("__host").distinct().collect()}
    got = {r.page_id: r.text for r in H.html_extract(rows, ["page_id"]).collect()}
    assert all(H.main_text(r.html, None) != got[r.page_id] for r in rows.collect())


def test_clashing_columns_and_no_id(spark):
    """Other columns are kept, those named like an output are replaced, repeated rows and null ids stay."""
    rows = [(None, "http://a/", page("<p>one</p>"), "kept", "old"), (None, "http://a/", page("<p>one</p>"), "kept", "old"), (3, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, node string, Text string")
    got = H.html_extract(pages, ["page_id", "node", "Text"])
    assert got.columns == ["page_id", "node", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, "kept", "one", 3), (None, "kept", "one", 3), (3, None, "", 0)], key=str)
