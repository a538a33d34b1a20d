import random
from html import unescape

import numpy as np
import pytest

from stockloom.llm import html_extract
from stockloom.llm.html_extract import blocks


@pytest.mark.parametrize(("html", "text"), [
    ("<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A&amp;B</h1><p>x  \n y<br>z<p>w</article><footer>f</footer>", "A&B\nx y z\nw"),
    ("<article><p>a<aside>no</aside><form>no<input></form><div class='comment-list'>no</div><script>var t='</p>';</script><p>b", "a\nb"),
    ("<article><p>cut <b>off &am", "cut off &am"),
    ("<main><div>one<span> two</span></div><div hidden>no</div><style>p{}</style><!-- no --><ul><li>a<li>b</ul></main>", "one two\na\nb"),
    ("<article>a<!-- open", "a"), ("<article>1 < 2 &lt; 3 &copy;</article>", "1 < 2 < 3 ©"),
    ("<body class='no-sidebar'><article class='post ad-free'>a&nbsp;b</article>", "a b"),
    ("<ARTICLE><P>A</P></ARTICLE><div class=\"ad\"><article>sold</article></div>", "A"),
    ("<article><p>a</div></section></p>b</article> c", "a\nb"), ("<article></article>", None),
    ("<main><p>intro</p><article>a</article><section class=related><article>b</article></section></main>", "a"),
    ("<article>a<article class='comment' id=c1>no</article><div id='comments'>no</div>b</article>", "a\nb"),
    ("<div role=main>a<div class='site-nav'>no</div></div>", "a"), ("<div class='articleBody'>a</div><p>b</p>", "a"),
])
def test_article(html, text):
    found = blocks(html)
    top = max((b.level for b in found), default=0)
    found = [b.text for b in found if top and b.level == top]
    assert ("\n".join(found) if found else None) == text


@pytest.mark.parametrize(("html", "found"), [
    (f"<select>{'<option>x' * 300}</select><article><p>a</article><p>b", [("a", 2), ("b", 0)]),
    (f"<aside><table>{'<tr><td>x' * 200}</table></aside><p>b", [("b", 0)]),
    (f"<article><table>{'<tr><td>x' * 200}</table><p>a</article><p>b", [*[("x", 2)] * 200, ("a", 2), ("b", 0)]),
    (f"<article>{'<b>' * 400}<p>a</article><p>b", [("a", 2), ("b", 0)]),
    ("<table><tr><td class=ad>no<td>a<tr><td><table><tr><td class=ad>no</table><td>b<tbody><tr><th>c</table>", [("a", 0), ("b", 0), ("c", 0)]),
    ("<ul><li class=ad><div>no<li>a<ul><li class=ad>no</ul>b</ul>", [("a", 0), ("b", 0)]), ("<dl><dt class=ad><p>no<dd>a<dt>b</dl>", [("a", 0), ("b", 0)]),
])
def test_elements_without_end_tags(html, found):
    assert [(b.text, b.level) for b in blocks(html)] == found


PROSE_NAMES = """<article><h2 class="section-header">a</h2><p class="social-science">b</p><p class="form-factor">c</p><p class="ad-hoc">d</p>
<div class="related-work">e</div><p id="search-algorithms">f</p><section id="comments-on-kant">g</section><p>h</p></article>"""


def test_names_of_content_stay():
    assert [b.text for b in blocks(PROSE_NAMES)] == list("abcdefgh")


@pytest.mark.parametrize("name", [
    "ad", "ads", "ad-slot-3", "adBox", "comments", "comment-list", "comment_item", "related", "share", "share-buttons", "newsletter", "newsletter-signup",
    "cookie-banner", "site-nav", "post-footer", "sidebar-left", "breadcrumbs", "sponsored-links", "header", "social", "search",
])
@pytest.mark.parametrize("tag", ["div", "section", "ul"])
def test_names_of_other_parts_go(tag, name):
    assert [b.text for b in blocks(f"<article>a<{tag} class='{name}'>no</{tag}>b<{tag} id={name}>no</{tag}></article>")] == ["a", "b"]


def test_links_settle_a_doubt():
    html = "<article>a<div class='related-work'><a href=x>one</a> <a href=y>two</a> by</div><div class='related-work'>long own words <a>one</a></div></article>"
    assert [b.text for b in blocks(html)] == ["a", "long own words one"]


def test_repetition_settles_a_doubt(spark):
    page = "<article><p>own {0}</p><div class='search-hints'>{1}</div><p>end</p></article>"
    same, other = "one two three four five six", "seven eight nine ten eleven {0} twelve"
    rows = [(i, "http://a.example.org/", page.format(i, (same if i % 2 else other).format(i))) for i in range(1, 7)]
    rows.append((9, "http://b.example.org/", page.format(9, same)))
    got = {r.page_id: r.text for r in html_extract.extract(table(spark, rows).repartition(3), run=4).collect()}
    assert got[1] == "own 1\nend" and got[9] == f"own 9\n{same}\nend" and got[2] == "own 2\nend"  # five of seven words repeat


def tree(rng, depth):
    """A random page part: a text, or (tag, attributes, parts)."""
    if depth == 0 or rng.random() < 0.35:
        return " ".join(rng.choices(["one", "two &lt; 3", "größe", "a&amp;b", "\n  x", "&#233;", "&nbsp;"], k=rng.randint(1, 3)))
    tag = rng.choice(["div", "section", "b", "span", "em", "nav", "aside", "form", "h2", "blockquote", "script", "div", "div", "comment", "br"])
    attributes = rng.choice(["", "", "", " class='ad'", ' id="comments"', " hidden", " class=post data-x='>'", " class='social-science'"])
    return tag, attributes, [tree(rng, depth - 1) for _ in range(rng.randint(0, 3))]


def written(part):
    if isinstance(part, str):
        return part
    tag, attributes, parts = part
    if tag in ("comment", "br"):
        return "<!-- <p>no</p> -->" if tag == "comment" else "<br>"
    return f"<{tag}{attributes}>{'if (a < b) no()' if tag == 'script' else ''.join(map(written, parts))}</{tag}>"


def plain_blocks(part):
    """Texts of a part, None where a block ends."""
    if isinstance(part, str):
        return [unescape(part)]
    tag, attributes, parts = part
    inside = [x for p in parts for x in plain_blocks(p)]
    wall = [None] if tag in ("div", "section", "nav", "aside", "form", "h2", "blockquote") else []
    if tag == "comment" or tag == "br":
        return [" "] if tag == "br" else []
    if tag in ("nav", "aside", "form", "script") or any(x in attributes for x in ("'ad'", "comments", "hidden")):
        return wall
    return [*wall, *inside, *wall]


@pytest.mark.parametrize("seed", range(300))
def test_generated_pages_against_their_trees(seed):
    rng = random.Random(seed)
    parts = [tree(rng, 5) for _ in range(6)]
    want, line = [], []
    for x in [*(x for p in parts for x in plain_blocks(p)), None]:
        if x is None:
            want += [" ".join("".join(line).split())] if "".join(line).strip() else []
            line = []
        else:
            line.append(x)
    html = f"<html><body><nav>no</nav><article>{''.join(map(written, parts))}</article><footer>no</footer></body></html>"
    assert [b.text for b in blocks(html)] == want


def plain_unique(pages, run):
    """Blocks of each page without words in runs that another page of the host holds."""
    grams = {}
    for host, uid, rest in pages:
        ws = " ".join(rest).split()
        for i in range(len(ws) - run + 1):
            grams.setdefault((host, tuple(ws[i : i + run])), set()).add(uid)
    out = {}
    for host, uid, rest in pages:
        ws = " ".join(rest).split()
        gone = set()
        for i in range(len(ws) - run + 1):
            if len(grams[host, tuple(ws[i : i + run])]) > 1:
                gone.update(range(i, i + run))
        at, lines = 0, []
        for text in rest:
            own = text.split()
            kept = [w for k, w in enumerate(own, at) if k not in gone]
            at += len(own)
            lines += [" ".join(kept)] if kept else []
        out[uid] = "\n".join(lines)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "kept") for r in rows], "page_id long, url string, html string, host string")


def test_pages_without_an_article_lose_what_the_host_repeats(spark):
    rng = random.Random(4)
    shared = [" ".join(rng.choices("abcd", k=n)) for n in (4, 7, 3, 9)]
    rows, plain = [], []
    for i in range(60):
        host = rng.choice(["x.example.org", "y.example.org"])
        rest = rng.choices([*shared, f"own {i} words {i} here", "a b"], k=rng.randint(1, 5))
        rows.append((i, f"http://{host}/{i}", "".join(f"<div>{t}</div>" for t in rest)))
        plain.append((host, i, rest))
    got = html_extract.extract(table(spark, rows).repartition(5), run=4).collect()
    assert {r.page_id: r.text for r in got} == plain_unique(plain, 4)


def test_suffix_array_orders_by_runs():
    codes = np.array([3, 1, 2, 3, 1, 2, 4, 3, 1], np.uint64)
    order, rank = html_extract.sorted_suffixes(codes, 2)
    heads = [tuple(codes[i : i + 2]) for i in order]
    assert heads == sorted(heads) and all((a == b) == (x == y) for a, b, x, y in zip(heads, heads[1:], rank, rank[1:]))


def test_awkward_rows(spark):
    page = "<article><p>text</p></article>"
    rows = [
        (1, None, page), (None, "http://a.example.org/", page), (2, "http://a.example.org/", None), (3, "x", ""), (4, "http://a.example.org/", page),
        (4, "http://a.example.org/", page), (5, "http://a.example.org/", f"<article>{'<p>long words here</p>' * 20_000}</article>"), (6, "u", "<nav>only</nav>"),
    ]
    got = html_extract.extract(table(spark, rows)).collect()
    texts = sorted(((r.page_id, r.text[:20]) for r in got), key=str)
    assert texts == sorted([(1, "text"), (None, "text"), (2, ""), (3, ""), (4, "text"), (4, "text"), (5, "long words here\nlong"), (6, "")], key=str)
    assert max(len(r.text) for r in got) == 20_000 * 16 - 1


def test_repeated_rows_are_one_page(spark):
    words = "<div>one two three four five six seven eight nine</div>"
    got = html_extract.extract(table(spark, [(1, "u", words), (1, "u", words)])).collect()
    assert [r.text for r in got] == ["one two three four five six seven eight nine"] * 2


def test_empty_table(spark):
    assert html_extract.extract(table(spark, [])).count() == 0
