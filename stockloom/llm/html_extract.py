"""Main text of web pages, with a host-wide suffix array for boilerplate that has no tell-tale markup.

A page is cut into blocks. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments, by tag or role, are left out; so are elements whose class or id is the name of
such a part, alone or with words that say nothing of the content (``comment-list``, not ``comments-on-kant``).
If the page marks its article, the blocks within make up the text, whatever other pages hold: copies of an
article are articles. The main part of a page counts as its article if no article is marked.

A name that only begins or ends with such a word raises a doubt, which the content settles: the element goes
if at least half of its characters are links, and each of its blocks goes if at least half of its words lie
in runs that other pages of the host repeat. Else it stays.

If a page marks no article, repetition decides on all its blocks. The words of all blocks outside an
article, and of those in doubt, form the page's token stream; the streams of a host's pages are concatenated
and sorted as a suffix array, in which runs of ``run`` tokens that occur on more than one page stand
next to each other. Words that such a run covers are boilerplate and go; what is unique to the page stays.

A host may hold any number of pages, so the array is built for the pages a task has at hand, and
gives one row for each distinct run with the least and greatest page that holds it. Merging these
rows by run finds every run that two pages of the host share, however the pages were dealt out.

Defined cases: a null or empty page has no text; a url without a host, or null, makes one host of
its own; pages equal in page_id, url and html count as one page for repetition, and each gives its
row; markup cut off in the middle ends with the page; other columns are ignored. White space is
what Unicode calls so, a line break element included; blocks without text are dropped.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh64_intdigest

from stockloom.llm.common import query, salted_join, stored, table
from stockloom.llm.url_filter import host_of

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(?P<end2>/)?(?P<name2>[a-zA-Z][^\s/>]*+)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S,
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset("head nav header footer aside form menu dialog button select option svg math object canvas audio video label input search".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NAMES = frozenset(
    "nav navigation navbar menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription comment comments disqus respond reply replies "
    "share sharing social breadcrumb breadcrumbs related recommended pagination pager toolbar widget skip form search login signup".split()
)
#: Words that leave the meaning of a name as it is.
PLAIN = frozenset(
    "site page list box container block section area item items bar link links slot unit zone panel row col inner outer top bottom left right button "
    "buttons icons post posts primary secondary global mobile desktop card group holder".split()
)
#: Names that are as sure with plain words; the others also name parts of articles.
SURE = NAMES - frozenset("header form search notice notices aside promotion social related widget skip".split())
#: Elements that hold running text: only a name on its own counts.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dd dt td th figcaption".split())
#: Parts of a class name that turn its meaning round.
BUT = frozenset("no not has with without free main content body article wrapper".split())
ARTICLE_NAMES = frozenset(("articlebody", "postcontent", "entrycontent", "articlecontent", "postbody", "storybody", "maincontent"))
#: Names that make even an article element something else.
NO_ARTICLE = frozenset("comment comments reply replies related teaser ad ads advert advertisement sponsored promo".split())
CLOSES_P = BLOCK - {"body", "html", "head"}
#: Open elements that may do without an end tag, by the element that ends them if no other part of a page is opened in between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup")}
#: The same for parts of a table, whatever else is open within the innermost table.
CELLS, SECTIONS = ("td", "th"), ("tr", "td", "th", "caption", "thead", "tbody", "tfoot")
TABLE_ENDS = {"td": CELLS, "th": CELLS, "tr": ("tr", "caption", *CELLS), "thead": SECTIONS, "tbody": SECTIONS, "tfoot": SECTIONS}
NO_WALL = frozenset(("address", "div", "p"))


class Block(NamedTuple):
    """``level``: of what it is inside of (see ``marks``); ``doubt``: number of the element in doubt it is inside of, or 0; ``linked``: characters in links."""

    text: str
    level: int
    doubt: int
    linked: int


def named(name: str, value: str, level: int) -> tuple[bool, bool, int]:
    """What a class or id makes of an element: whether it is left out, whether it is in doubt, and its level."""
    out = doubt = False
    for one in value.split():
        parts = [x.lower() for x in PART.findall(one) if not x.isdigit()]
        if not parts:
            continue
        level = max(level, 2 * ("".join(parts) in ARTICLE_NAMES))
        if not BUT.isdisjoint(parts):
            continue
        known = NO_ARTICLE if level else NAMES
        sure = known if level else SURE
        others = [x for x in parts if x not in sure]
        if "".join(parts) in known or (name not in PROSE and len(others) < len(parts) and PLAIN.issuperset(others)):
            out = True
        elif parts[0] in known or parts[-1] in known:
            doubt = True
    return out, doubt, level


def marks(name: str, attributes: str) -> tuple[bool, bool, int]:
    """Whether an element is left out, whether it is in doubt, and how surely it holds the main text: 2 as an article, 1 as the main part, else 0."""
    out, doubt, level = name in LEFT_OUT, False, {"article": 2, "main": 1}.get(name, 0)
    if attributes and not attributes.isspace() and name not in ("html", "body"):
        for found in ATTRIBUTE.finditer(attributes):
            key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
            if key == "role":
                out |= value.lower() in ROLES and not level
                level = max(level, {"article": 2, "main": 1}.get(value.lower(), 0))
            elif key == "hidden":
                out = True
            elif key == "aria-hidden":
                out |= value.lower() == "true"
            else:
                gone, unsure, level = named(name, value, level)
                out, doubt = out or gone, doubt or unsure
    return out, doubt, 0 if out else level


def blocks(html: str) -> list[Block]:
    """Text blocks in page order that no markup rules out."""
    out: list[Block] = []
    text: list[str] = []
    stack: list[tuple[str, bool, int, int]] = []  # name, left out, level, doubt
    places: defaultdict[str, list[int]] = defaultdict(list)  # where the open elements of a name are on the stack
    open_blocks: list[int] = []
    walls: list[int] = []  # the blocks that an implied end doesn't reach through
    skip, within, doubt, doubts, linked = False, 0, 0, 0, 0

    def add(part: str) -> None:
        nonlocal linked
        text.append(part)
        if places["a"]:
            linked += len(part.strip())

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, within, doubt, linked))
            text.clear()
            linked = 0

    def close(depth: int) -> None:
        nonlocal skip, within, doubt
        if not skip and (open_blocks and open_blocks[-1] >= depth or doubt != (stack[depth - 1][3] if depth else 0)):
            flush()
        for name, *_ in stack[depth:]:
            places[name].pop()
        for held in (open_blocks, walls):
            while held and held[-1] >= depth:
                held.pop()
        del stack[depth:]
        _, skip, within, doubt = stack[-1] if stack else ("", False, 0, 0)

    at = 0
    while at < len(html):
        found = MARKUP.search(html, at)
        if found is None:
            if not skip:
                add(html[at:])
            break
        if not skip and found.start() > at:
            add(html[at : found.start()])
        at = found.end()
        name = found["name"] or found["name2"]
        if name is None:
            continue
        name = name.lower()
        if found["end"] or found["end2"]:
            if name in BLOCK and not skip:
                flush()
            if places[name]:
                close(places[name][-1])
            continue
        if name in TABLE_ENDS and places["table"]:
            least = places["table"][-1]
            depth = min((places[x][-1] for x in TABLE_ENDS[name] if places[x] and places[x][-1] > least), default=None)
            if depth is not None:
                close(depth)
        while name in ENDS and walls and stack[walls[-1]][0] in ENDS[name]:
            close(walls[-1])
        if name in CLOSES_P and open_blocks and stack[open_blocks[-1]][0] == "p":  # an open paragraph ends before a block begins
            close(open_blocks[-1])
        if name in BLOCK and not skip:
            flush()
        if name == "br" and not skip:
            text.append(" ")
        if name in VOID or (found["attributes"] or "").endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        left, unsure, level = marks(name, found["attributes"] or "")
        if unsure and name in BLOCK and not left and not skip and not doubt:
            doubts += 1
            doubt = doubts
        skip, within = skip or left, max(within, level)
        places[name].append(len(stack))
        if name in BLOCK:
            open_blocks.append(len(stack))
            if name not in NO_WALL:
                walls.append(len(stack))
        stack.append((name, skip, within, doubt))
    flush()
    return without_link_lists(out)


def without_link_lists(found: list[Block]) -> list[Block]:
    """The blocks without elements in doubt that are links by half or more."""
    sizes: defaultdict[int, list[int]] = defaultdict(lambda: [0, 0])
    for block in found:
        sizes[block.doubt][0] += len(block.text)
        sizes[block.doubt][1] += block.linked
    return [b for b in found if not b.doubt or 2 * sizes[b.doubt][1] < sizes[b.doubt][0]]


def host_words(host: str, texts: list[str]) -> np.ndarray:
    """Codes of all words of a page's blocks, different for every host."""
    seed = xxh64_intdigest(host.encode("utf-8"))
    return np.fromiter((xxh64_intdigest(w.encode("utf-8"), seed & 0xFFFFFFFF) ^ seed for t in texts for w in t.split()), np.uint64)


def run_keys(codes: np.ndarray, run: int) -> np.ndarray:
    """One number for each run of ``run`` codes."""
    n = len(codes) - run + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(run):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        key ^= key >> np.uint64(29)
    return key


def sorted_suffixes(codes: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``codes`` as far as ``run`` codes tell suffixes apart: their order, and for each
    place in it the rank, equal for suffixes that share their first ``run`` codes (a power of two)."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < run:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-reach] = rank[reach:] + 1
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    order = np.argsort(rank, kind="stable")
    return order, rank[order]


def shared_runs(pages: list[tuple[int, np.ndarray]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the given streams: key, and the least and greatest page that holds it."""
    pages = [(page, codes) for page, codes in pages if len(codes) >= run]
    if not pages:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    # a run never crosses pages: only suffixes that begin ``run`` codes before a page's end count
    streams = np.concatenate([codes for _, codes in pages])
    owner = np.concatenate([np.full(len(codes), page, np.int64) for page, codes in pages])
    keys = np.concatenate([np.concatenate((run_keys(codes, run), np.zeros(run - 1, np.uint64))) for _, codes in pages])
    whole = np.concatenate([np.arange(len(codes)) <= len(codes) - run for _, codes in pages])
    order, rank = sorted_suffixes(streams, run)
    order, rank = order[whole[order]], rank[whole[order]]
    starts = np.flatnonzero(np.diff(rank, prepend=-1))
    held = owner[order]
    return keys[order[starts]], np.minimum.reduceat(held, starts), np.maximum.reduceat(held, starts)


def unique_text(texts: list[str], covered: np.ndarray) -> str:
    """Blocks without their covered words."""
    out, at = [], 0
    for text in texts:
        ws = text.split()
        kept = [w for w, gone in zip(ws, covered[at : at + len(ws)]) if not gone]
        at += len(ws)
        if kept:
            out.append(" ".join(kept))
    return "\n".join(out)


def article_text(article: list[str], rest: list[str], places: list[int], covered: np.ndarray) -> str:
    """Blocks of an article without those in doubt that are covered by half or more. ``places``: of each block of
    ``rest`` its number in the article, or -1."""
    gone, at = set(), 0
    for text, place in zip(rest, places):
        n = len(text.split())
        if place >= 0 and 2 * covered[at : at + n].sum() >= n:
            gone.add(place)
        at += n
    return "\n".join(t for i, t in enumerate(article) if i not in gone)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, uid (tells pages apart), article (its blocks, null if the page marks none), rest (the other
    blocks, and those in doubt), and places (of each block of rest its number in the article, or -1)."""
    kept = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("uid"), "html")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                article, rest, places = [], [], []
                for html in batch.column("html"):
                    found = blocks(html.as_py() or "")
                    top = max((b.level for b in found), default=0)  # an article within the main part is all of it
                    inside = [b for b in found if b.level == top] if top else []
                    judged = [(b.text, -1) for b in found if not b.level] + [(b.text, i) for i, b in enumerate(inside) if b.doubt]
                    article.append([b.text for b in inside] if top else None)
                    rest.append([text for text, _ in judged])
                    places.append([place for _, place in judged])
                columns = [*batch.columns[:4], *(pa.array(x, pa.list_(k)) for x, k in ((article, pa.string()), (rest, pa.string()), (places, pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "uid", "article", "rest", "places"])

    kind = kept.schema["page_id"].dataType.simpleString()
    return kept.mapInArrow(rows, f"page_id {kind}, url string, host string, uid long, article array<string>, rest array<string>, places array<int>")


def repeated_runs(pages: DataFrame, run: int) -> DataFrame:
    """Runs that more than one page of a host holds: key and n (rows that hold it, at most)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("host", "uid", "rest"))
            key, lo, hi = shared_runs([(uid, host_words(host, rest)) for host, uid, rest in zip(*columns)], run)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(lo), pa.array(hi)], names=["key", "lo", "hi"])

    runs = pages.select("host", "uid", "rest").mapInArrow(rows, "key long, lo long, hi long")
    return runs.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("key")


def extract(pages: DataFrame, run: int = 8) -> DataFrame:
    """page_id, url and text of every row of ``pages`` (page_id, url, html). ``run``: least length of
    boilerplate in words, a power of two."""
    if run < 1 or run & (run - 1):
        raise ValueError("run must be a power of two")
    found = stored(parsed(pages), "pages")
    repeated = repeated_runs(found, run)
    judged = "size(rest) > 0 and (article is null or exists(places, x -> x >= 0))"
    open_pages = found.filter(judged)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("host", "uid", "rest"))
            uids, ats, keys = [], [], []
            for host, uid, rest in zip(*columns):
                key = run_keys(host_words(host, rest), run)
                uids.append(np.full(len(key), uid, np.int64))
                ats.append(np.arange(len(key)))
                keys.append(key.view(np.int64))
            columns = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (uids, ats, keys)]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "at", "key"])

    spots = stored(open_pages.select("host", "uid", "rest").mapInArrow(positions, "uid long, at long, key long").distinct(), "runs")
    counts = stored(spots.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(repeated, "key", "left_semi"), "repeated-runs")
    covered = salted_join(spots, counts, ["key"], "n", ["uid", "at"], "inner").groupBy("uid").agg(F.collect_list("at").alias("ats"))
    left = open_pages.join(covered, "uid", "left").select("page_id", "url", "article", "rest", "places", "ats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for article, rest, places, ats in zip(*(batch.column(c).to_pylist() for c in ("article", "rest", "places", "ats"))):
                gone = np.zeros(sum(len(t.split()) for t in rest) + 1, np.int64)
                for at in ats or []:
                    gone[at] += 1
                    gone[at + run] -= 1
                covered = np.cumsum(gone)[:-1] > 0
                texts.append(unique_text(rest, covered) if article is None else article_text(article, rest, places, covered))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = found.schema["page_id"].dataType.simpleString()
    rest = left.mapInArrow(cut, f"page_id {kind}, url string, text string")
    text = F.array_join(F.coalesce("article", F.array().cast("array<string>")), "\n")
    marked = found.filter(f"not ({judged})").select("page_id", "url", text.alias("text"))
    return marked.unionByName(rest)


@query("op6_html_extract")
def op6_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
