"""HTML main-text extraction (operator 4).

Method: nearest-URL page differencing.  Pages of a host are ordered by URL path and each is paired
with the neighbour whose path is nearest; the text lines (blocks) of the two are aligned by a
longest common subsequence, and lines outside a main container that both share are deleted.

Differencing alone cannot tell a page's own advert, menu words or notice from its article, since
they need not recur on the nearest page, and it would delete an article that a mirror repeats.  So
marked-up chrome goes first (navigation, header, footer, aside, form and similar elements, and
elements whose class, id or role says so, but none that wraps the page's article), and a page that marks its article (``article`` or ``main``)
is reduced to it.  Within such a container differencing decides on lines of nothing but link text: those that the neighbour
shares are a menu that nothing marks, unless the neighbour shares most of the other lines too, which makes it a copy of the article.  Other
lines of a container stay though shared, since articles quote each other's.

Pages are dealt out by ranges of (host, path, id), so a host of any size is spread, and the first
and last page of a range also go to the ranges beside it.

Defined results: a null or empty page has an empty text; pages without a URL form a host of their
own; a neighbour with the same lines (a mirror or a repeated row) is passed over; a page without
another neighbour loses nothing to differencing; repeated rows give repeated rows; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import arrow_map, prepare, task_count

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                 r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^'\">])*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = frozenset("script style textarea title noscript iframe template svg annotation annotation-xml select canvas video audio noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav footer aside form menu dialog button fieldset head".split())
CONTAINER = frozenset({"article", "main"})
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td
    tfoot th thead title tr ul""".split())
#: An open element on the left ends where one on the right begins.
ENDS = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
        "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}, "a": {"a"}}
WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar menu menus nav navbar
    navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal
    overlay newsletter subscribe subscription signup login comment comments commentlist disqus replies respond share sharing
    social related recommended recommendations widget toolbar pagination pager skip copyright legal disclaimer""".split())
#: Words that also name parts of an article within one.
MILD = frozenset("header masthead banner notice notices alert legal disclaimer".split())
#: Parts of a class name that leave a hint what it is: ``site-footer``, ``ad_box_2``.
PLAIN = frozenset("site page global main primary secondary left right top bottom box slot unit list area block bar wrapper container links".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist replies respond disqus".split())
#: Chrome that may list other articles.
TEASERS = COMMENTS | frozenset("related recommended recommendations sidebar widget nav footer aside menu dialog button head".split())


def _hints(names: str) -> set[str]:
    """Hint words of a class or id: those that are a whole name, or one with nothing but plain parts beside them."""
    found: set[str] = set()
    for name in names.lower().split():
        parts = {x for x in re.split(r"[^a-z]+", name) if x}
        if parts <= WORDS | PLAIN:
            found |= parts & WORDS
    return found


def _chrome(tag: str, attributes: str, inside: bool) -> set[str]:
    """What makes an element chrome: its name, hint words, ``hidden`` or ``role``."""
    why = {tag} if tag in CHROME or (tag == "header" and not inside) else set()
    if not attributes.strip() or tag in ("html", "body"):
        return why
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    hints = _hints(f"{a.get('class', '')} {a.get('id', '')}")
    if tag in CONTAINER:
        return hints & COMMENTS
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        why.add("hidden")
    if a.get("role", "").lower() in ROLES:
        why.add("role")
    return why | (hints - MILD if inside else hints)


def blocks(html: str) -> tuple[list[str], list[bool]]:
    """Text blocks of a page without its marked-up chrome, in page order, and whether each lies in a main container."""
    return linked_blocks(html)[:2]


def linked_blocks(html: str) -> tuple[list[str], list[bool], list[bool]]:
    """``blocks``, and whether each is nothing but link text.

    An element that holds the page's main container is no chrome, whatever its name; nor is a form that holds all of its text.
    """
    texts, inside, linked, seen = _blocks(html)
    if "container" in seen and not any(inside):
        texts, inside, linked, seen = _blocks(html, "container")
    if "form" in seen and not texts:
        texts, inside, linked, seen = _blocks(html, "form")
    return texts, inside, linked


def _blocks(html: str, kept: str = "") -> tuple[list[str], list[bool], list[bool], set[str]]:
    """``linked_blocks``, and whether chrome held a container or a form was chrome; with ``kept``, such chrome stays."""
    texts, inside, linked, parts = [], [], [], []
    seen: set[str] = set()
    open_tags: list[tuple[str, set[str]]] = []  # name, what makes it chrome
    chrome = main = links = 0
    plain = False  # whether the block has text outside links
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal plain
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            texts.append(text)
            inside.append(main > 0)
            linked.append(not plain)
        plain = False

    def close(depth: int) -> None:
        nonlocal chrome, main, links
        while len(open_tags) > depth:
            name, off = open_tags.pop()
            chrome -= bool(off)
            links -= name == "a"
            main -= name in CONTAINER and not off

    while at < n:
        m = TAG.search(html, at)
        if m is None:
            break
        if not chrome and m.start() > at:
            parts.append(html[at:m.start()])
            plain = plain or not links and not parts[-1].isspace()
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            flush()
        if m[1]:
            for depth in range(len(open_tags) - 1, -1, -1):
                if open_tags[depth][0] == tag:
                    close(depth)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.IGNORECASE).search(html, at)
            at = end.end() if not m[3].rstrip().endswith("/") or tag not in ("svg", "math") else at
            continue
        if tag in VOID:
            continue
        while open_tags and tag in ENDS.get(open_tags[-1][0], ()):
            close(len(open_tags) - 1)
        if tag in BLOCK:  # an unclosed inline element does not keep its paragraph open
            for depth in range(len(open_tags) - 1, -1, -1):
                name, off = open_tags[depth]
                if off or (name in BLOCK and name != "p"):
                    break
                if name == "p" and tag in ENDS["p"]:
                    close(depth)
                    break
        off = _chrome(tag, m[3], main > 0)
        if kept == "form":
            off -= {"form", "fieldset"}
        if tag in CONTAINER and not off and chrome:
            # what wraps a container is no chrome, unless it lists other articles or comments
            wraps = [why for _, why in open_tags if why]
            if not any(why & COMMENTS for why in wraps):
                seen.add("container")
                if kept == "container" or not main and (tag == "main" or not any(why & TEASERS for why in wraps)):
                    open_tags = [(name, set()) for name, _ in open_tags]
                    chrome = 0
        if off & {"form", "fieldset"}:
            seen.add("form")
        open_tags.append((tag, off))
        chrome += bool(off)
        main += tag in CONTAINER and not off
        links += tag == "a"
    if not chrome and at < n:
        parts.append(html[at:])
        plain = plain or not links and not parts[-1].isspace()
    flush()
    return texts, inside, linked, seen


def _rows(a: list, b: list) -> list[int]:
    """Bit-parallel longest common subsequences: after each line of ``a``, the bits of ``b`` that add nothing."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    v, out = every, []
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & every
        out.append(v)
    return out


def common(a: list, b: list, bits: int = 1 << 28) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``; memory is bounded by halving ``a``."""
    if not a or not b:
        return []
    if len(a) * len(b) <= bits or len(a) == 1:
        rows, out = _rows(a, b), []
        i, j = len(a), len(b)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if i == 0 or rows[i - 1] >> (j - 1) & 1:
                out.append(i)
                j -= 1
        return out[::-1]
    half = len(a) // 2

    def gains(x: list, y: list) -> np.ndarray:
        v, places, every = (1 << len(y)) - 1, {}, (1 << len(y)) - 1
        for j, t in enumerate(y):
            places[t] = places.get(t, 0) | 1 << j
        for t in x:
            u = v & places.get(t, 0)
            v = ((v + u) | (v - u)) & every
        raw = np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8)
        return np.r_[0, np.cumsum(1 - np.unpackbits(raw, bitorder="little")[:len(y)].astype(np.int64))]

    cut = int(np.argmax(gains(a[:half], b) + gains(a[half:][::-1], b[::-1])[::-1]))
    return common(a[:half], b[:cut], bits) + [half + i for i in common(a[half:], b[cut:], bits)]


def place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].rpartition("@")[2].lower(), m[2]) if m else ("", (url or "").split("?")[0].split("#")[0])
    return host.removeprefix("www."), re.sub(r"(\.html?|/)+$", "", path)


def _nearness(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def main_text(lines: list[str], inside: list[bool], neighbour: list[str] | None, linked: list[bool] | None = None) -> list[str]:
    """Lines that stay: those that the neighbour does not share.  If there is a main container, only its lines, and of those that the neighbour shares
    only what is nothing but link text goes, as long as the neighbour is no copy of the rest."""
    shared = set(common(lines, neighbour)) if neighbour else set()
    if any(inside):
        own = [i for i, x in enumerate(inside) if x]
        text = [i for i in own if not (linked and linked[i])]
        if not text or 2 * len(shared.intersection(text)) > len(text):
            return [lines[i] for i in own]
        return [lines[i] for i in own if i not in shared or not linked or not linked[i]]
    return [x for i, x in enumerate(lines) if i not in shared]


def extract(df: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for pages ``(page_id, url, html)``: the main text's blocks, joined by one space.

    The driver sees the first and last key of each range, two for each task.
    """
    spark = df.sparkSession
    prepare(spark)
    parts = task_count(df)
    rows = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def key_of(page_id, url) -> str:
        return "\0".join((*place(url), f"{-1 if page_id is None else page_id + (1 << 63):020d}"))

    @F.pandas_udf("string")
    def key(page_id: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([key_of(None if pd.isna(i) else int(i), u) for i, u in zip(page_id.astype("Int64"), url, strict=True)], dtype=object)

    keys = rows.select(key("page_id", "url").alias("key")).repartitionByRange(parts, "key")
    ranges = sorted(r["low"] for r in keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("low")).collect())
    ends = sorted((r["low"], r["high"]) for r in rows.select(key("page_id", "url").alias("key")).groupBy(F.pandas_udf(
        lambda k: pd.Series([bisect_right(ranges, x) for x in k], dtype="int32"), "int")("key").alias("r")).agg(
            F.min("key").alias("low"), F.max("key").alias("high")).collect())
    lows = [low for low, _ in ends]
    first = {low: k for k, (low, _) in enumerate(ends)}
    last = {high: k for k, (_, high) in enumerate(ends)}

    def parse(batch: pa.RecordBatch) -> pa.Table:
        out: list[tuple] = []
        for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k = key_of(page_id, url)
            own = bisect_right(lows, k) - 1
            found = linked_blocks(html)
            out.append((own, False, k, page_id, url, *found))
            if first.get(k, 0) > 0:
                out.append((own - 1, True, k, page_id, url, *found))
            if last.get(k, len(ends)) < len(ends) - 1:
                out.append((own + 1, True, k, page_id, url, *found))
        kinds = [pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.bool_())]
        names = ["part", "extra", "key", "page_id", "url", "lines", "inside", "linked"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the pages with equal lines that came last, and the (path, lines) of the page of their host before them
        like, same, before = None, [], None
        done: list[tuple] = []

        def settle(after: tuple | None) -> None:
            near = [x for x in (before, after) if x is not None]
            texts: dict = {}  # by neighbour: at most two
            for page_id, url, path in same:
                k = max(range(len(near)), key=lambda k: _nearness(path, near[k][0]), default=None)
                if k not in texts:
                    texts[k] = " ".join(main_text(like[2], like[3], None if k is None else near[k][1], like[4]))
                done.append((page_id, url, texts[k]))

        def batch_of() -> pa.RecordBatch:
            out = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            done.clear()
            return pa.record_batch(out, names=["page_id", "url", "text"])

        last_path = ""
        for batch in batches:
            for part, extra, key, page_id, url, lines, inside, linked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host, path, _ = key.split("\0")
                if like != (part, host, lines, inside, linked):
                    beside = like is not None and like[:2] == (part, host)
                    settle((path, lines) if beside else None)
                    before = (last_path, like[2]) if beside else None
                    like, same = (part, host, lines, inside, linked), []
                last_path = path
                if not extra:
                    same.append((page_id, url, path))
            if done:
                yield batch_of()
        settle(None)
        if done:
            yield batch_of()

    parsed = arrow_map(rows, parse, "part int, extra boolean, key string, page_id long, url string, lines array<string>, inside array<boolean>, linked array<boolean>")
    return (parsed.repartition(parts, "part").sortWithinPartitions("part", "key", "extra").mapInArrow(run, "page_id long, url string, text string"))
