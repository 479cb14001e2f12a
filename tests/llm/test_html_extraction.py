"""HTML extraction: the reader on odd pages, classes against plain loops, whole hosts."""

import html as references
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from ratecard.llm.common import table
from ratecard.llm.html_blocks import CLOSE, OPEN, Page, main_blocks
from ratecard.llm.html_extraction import LEAST_PAGES, SHARE, class_orders, class_places, equivalence_classes, extract_pages, host_column, op12_html_extraction, ordered_classes, page_tokens
from pyspark.sql import functions as F
from tests.conftest import SF01


def article_of(page):
    """The text between article tags, by patterns that know these pages' markup."""
    body = page[page.index("<article>") + 9 : page.rindex("</article>")]
    blocks = (" ".join(references.unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_op12_on_all_pages(spark):
    got = {r.page_id: r for r in op12_html_extraction(spark, SF01).collect()}
    rows = table(spark, SF01, "pages").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = article_of(r.html)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))


CASES = [
    ("", []),
    ("just text &amp; more", ["just text & more"]),
    ("<p>a<p>b<ul><li>1<li>2</ul>x<br>y <b>z", ["a", "b", "1", "2", "x y z"]),
    ("<article><header><h1>T</h1></header><p>x</p><footer>by me</footer></article><footer>f</footer>", ["T", "x"]),
    ("<header><h1>site</h1></header><div>x</div><aside>s</aside><form>f<input></form>", ["x"]),
    ("<main><p>m</p><article><p>a</p></article></main>", ["a"]),
    ("<div role=main><p>m</p><div class='share-buttons'>s</div></div><div>other</div>", ["m"]),
    ("<article><p>a</p><article class='comment'>c</article><section id=comments><p>c</p></section></article>", ["a"]),
    ("<article>a<span class=ad>x <span>y</span></span>b<div class='cookieNotice'>c</div></article>", ["ab"]),
    ("<article><script>if (a < b) '</p>'</script><style>p{}</style><!-- <p>no</p> -->ok</article>", ["ok"]),
    ("<title>t</title><p>a&nbsp;&#8212;&#x41;&copyb &lt;p&gt;</p>", ["a —A©b <p>"]),
    ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]),
    ("a < b <3 c", ["a < b <3 c"]),
    ("<p title='>'>a</p><p title=\"<p>\">b</p>", ["a", "b"]),
    ("<div class='content with-sidebar'>a</div><div class='sidebar'>b</div><div class='footnotes'>c</div>", ["a", "c"]),
    ("<p>open <p", ["open"]),
    ("<article>x</article><p>after</p>", ["x"]),
    ("<article></article><p>only</p>", ["only"]),
]


def test_blocks():
    for page, want in CASES:
        assert main_blocks(page) == want, page


PIECES = ["<p>", "</p>", "<div>", "</div>", "<div class=ad>", "<article>", "</article>", "<li>", "<ul>", "</ul>", "<td>", "<table>", "</table>", "<span class=ad>", "</span>", "<span>", "<a href=x>", "</a>", "<h1>", "</h1>", "<br>", "<!--", "-->", "<script>", "</script>", "<body>", "<head>", "text", " ", "&amp;", "<", "\"", "'", "<nav>", "</nav>", "\U0001f600", "<hr>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_any_page_nests(pieces):
    page = Page("".join(pieces))
    opened = []
    for kind, role in zip(page.kinds, page.roles):
        if kind == OPEN:
            opened.append(role)
        elif kind == CLOSE:
            assert opened.pop() == ~role
    assert not opened
    assert all(t == " ".join(t.split()) and t for k, t in zip(page.kinds, page.texts) if k not in (OPEN, CLOSE))


def soup(i, pages=12):
    """Pages of a host that names nothing: the same promise inside the text, menus of links, a line at the end."""
    words = " ".join(f"w{i}x{j}" for j in range(40))
    return (
        f"<html><body><div class=x1><a href=/{i}>go {i}</a> <a href=/b>there {i}</a></div><div class=x2><h1>title {i}</h1><p>{words}</p>"
        + "<div class=x5>Our promise stays the same</div>"
        + "".join(f"<p>more {i} {k} {words}</p>" for k in range(i % 3))
        + f"</div><div class=x3>seen {i} times</div><div class=x4>Some firm, some street</div></body></html>"
    )


def expected_soup(i):
    words = " ".join(f"w{i}x{j}" for j in range(40))
    return "\n\n".join([f"title {i}", words, *(f"more {i} {k} {words}" for k in range(i % 3))])


def test_a_host_without_names(spark):
    rows = [(i, f"https://soup.example/{i}", soup(i)) for i in range(12)]
    rows += [(100 + i, f"http://copies.example:80/{i}", "<div class=a><p class=b>all the same words</p></div>") for i in range(12)]
    rows += [(200, "http://alone.example/", soup(1)), (201, "no host", soup(2)), (202, None, "<p>x</p>"), (203, "http://copies.example", None), (204, "http://copies.example", ""), (5, "https://soup.example/5", soup(5))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' as host", "'t' as text", "1 as main")
    got = defaultdict(list)
    for r in extract_pages(pages).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    assert len(got[5]) == 2 and sum(map(len, got.values())) == len(rows)
    for i in range(12):
        assert set(got[i]) == {expected_soup(i)}, i
        assert got[100 + i] == ["all the same words"]
    assert "Some firm" in got[200][0] and got[202] == ["x"] and got[203] == got[204] == [""]  # one page alone has no template
    assert extract_pages(pages.limit(0)).count() == 0


def test_a_repeated_passage_is_no_template(spark):
    page = lambda i: f"<article><h1>t{i}</h1><p>own {i}</p><p>a passage that all pages hold</p>" + "<p>x</p>" * (i % 2) + "</article>"
    pages = spark.createDataFrame([(i, "http://h.example/", page(i)) for i in range(10)], "page_id long, url string, html string")
    assert all("a passage that all pages hold" in r.text for r in extract_pages(pages).collect())


def test_classes_against_plain_loops(spark):
    rows = [(i, f"http://soup.example/{i}", soup(i)) for i in range(12)] + [(50 + r.page_id, r.url, r.html) for r in table(spark, SF01, "pages").limit(120).collect()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    tokens = page_tokens(pages.select(host_column(F.col("url")).alias("host"), "url", "html"))
    got = {(r.host, frozenset(m.role for m in r.members)) for r in equivalence_classes(tokens).collect()}
    hosts = defaultdict(list)
    for _, url, html in rows:
        hosts[url.split("/")[2].split(":")[0]].append(Page(html).roles)
    want, ordered = set(), set()
    for host, held in hosts.items():
        counts = [Counter(x) for x in held]
        vectors = defaultdict(set)
        for role in set().union(*counts):
            vectors[tuple(c[role] for c in counts)].add(role)
        for vector, roles in vectors.items():
            support = sum(v > 0 for v in vector)
            if len(held) >= LEAST_PAGES and support >= LEAST_PAGES and 100 * support >= SHARE * len(held) and len(roles) >= 2:
                want.add((host, frozenset(roles)))
                orders = set()
                for x in held:
                    row = [r for r in x if r in roles]
                    orders |= {tuple(row[i : i + len(roles)]) for i in range(0, len(row), len(roles))}
                if len(orders) == 1 and set(orders.pop()) == roles:
                    ordered.add((host, frozenset(roles)))
    assert got == want and want
    assert {(r.host, frozenset(m.role for m in r.members)) for r in ordered_classes(tokens, equivalence_classes(tokens)).collect()} == ordered


def test_orders_and_places():
    classes = {1: (1, 2), 2: (1, 2), 5: (5, 2), 6: (5, 2), 9: (9, 1)}
    assert None not in class_orders([1, 5, 6, 2, 1, 2], classes).values()
    assert class_orders([1, 2, 2, 1], classes)[1] is None and class_orders([1, 2, 1], classes)[1] is None
    inside = class_places([1, 5, 6, 5, 6, 2, 9], classes)
    assert len(inside[5][0]) == 1 and not inside[5][1] and inside[9][0] == {0}
    assert len(class_places([1, 5, 6, 2, 5, 6], classes)[5][0]) == 2  # in a gap, and outside
    assert class_places([1, 5, 2, 6], classes)[5][1]  # crossed
