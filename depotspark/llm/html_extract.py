"""HTML extraction by equivalence classes of template tokens.

A page is a sequence of tokens: elements, each with the path of elements around it (names, class words, ids, roles;
digits count as 0) and text blocks. For each host, a token's occurrence vector over the host's different pages is kept
as sums of hashes of (page, count), so vectors compare without being gathered. Tokens with equal vectors form a class.
A class is valid if it has two tokens or more on two pages or more (and on a twentieth of the host's pages), its tokens
stand in the same order on all of its pages, and its span crosses that of no other class. The elements of valid classes
nest into the host's template. What lies between them are slots: a block belongs to the innermost element of a valid
class around it.

The template decides, on hosts with pages of three different contents or more:

* a block that itself belongs to a valid class which is on all pages is part of the template and goes (other blocks bound
  no slots);
* a slot most of whose text, over all pages of the host, is links, is navigation and goes, unless it holds most of the
  text that varies;
* a slot that element and class names call a menu, header, footer, sidebar, notice, advert, form or reader comments
  goes as well, but stays where a host would keep next to no text that varies.

On other hosts names decide alone: elements called one of the above go, and where an article or main element exists
only what lies in it stays. A class, id or role says something only as a whole name (or where each part of it does),
and not on the root nor around the page's article.

Pages are parsed twice, each alone and in linear time: once for the tokens, which travel as hashes, once for the texts.
Equal pages are one row of tokens. A host's template is a short list of hashes.

Defined cases: null html is empty and gives an empty text; a null url has the empty host; pages of the same text outside
menus and the like have the same contents, so copies of an article are no template; blocks on all pages that are over
three quarters of a host's text come from near copies and are no template either; repeated rows count once for the template and
are returned as often as they occur; unclosed elements end with the page; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotspark.llm.common import materialize, release, table
from depotspark.llm.url_filter import host_path

#: Templates are broadcast while they have fewer bytes than this; more of them go through a shuffle.
MAX_BROADCAST = 32 << 20
CONTENTS = 3  # different contents that a host needs for a template
SUPPORT = 0.05  # share of a host's pages that a template's token is on, so that a template is not longer than twenty pages
LINKS = 0.6  # share of link text that makes a slot navigation

_START = re.compile(r"</?[a-zA-Z][a-zA-Z0-9:-]*|<!--|<!\[CDATA\[|<[!?]")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>")  # one without < in it: looks no further than the next <
_SPECIAL = re.compile("[>\"']")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img", "label"}
_CHROME = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"}
_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "related", "replies", "reply", "share", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "complementary", "contentinfo", "dialog", "search"}
_ROOT = {"html", "body", "main", "article"}
_HEAD_WORDS = {"header", "masthead", "topbar"}
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CLOSED_BY = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
PAGE = 2  # the token that stands for the page itself


def _hash(text: str, seed: int) -> int:
    """Signed 64-bit hash, even: of an element. The next odd number stands for a text."""
    return -2 & ((xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=seed & 0xFFFFFFFFFFFFFFFF) + (1 << 63)) % (1 << 64)) - (1 << 63)


class Block:
    """token: of the text; element: token of the element around; links: characters of text in links."""

    __slots__ = ("token", "element", "text", "links", "chrome", "main")

    def __init__(self, element: int, text: str, links: int, chrome: bool, main: int):
        self.token, self.element, self.text, self.links, self.chrome, self.main = _hash(text, PAGE) + 1, element, text, min(links, len(text)), chrome, main


def _names(attrs: str) -> list[str]:
    """Class names, id and role, lower-cased."""
    if "=" not in attrs:
        return []
    return [x for m in _ATTR.finditer(attrs) if m[1].lower() in ("class", "id", "role") for x in (m[2] or m[3] or m[4] or "").lower().split()]


@functools.lru_cache(1 << 16)
def _step(tag: str, names: tuple[str, ...], element: int) -> int:
    return _hash(tag + "".join("." + _DIGITS.sub("0", x) for x in names), element)


def _named(names: list[str], words: set[str]) -> bool:
    """A whole name is one of the words, or all its parts are."""
    return bool(names) and any((parts := {y for y in _SPLIT.split(x) if y}) and parts <= words for x in names)


class Scanner:
    """The tags of a page, one after the other. What a search to the end of the page has found is remembered, so that all
    searches together are linear in the page, whatever stands in it."""

    def __init__(self, page: str):
        self.page, self.absent, self.special = page, set(), None

    def _prepare(self) -> None:
        page = self.page
        self.special = [m.start() for m in _SPECIAL.finditer(page)]  # where tags end and values begin or end
        kinds = [page[at] for at in self.special]
        self.after: list[int] = [0] * len(kinds)  # place after the same quote's next occurrence, 0: none
        seen: dict[str, int] = {}
        for k in range(len(kinds) - 1, -1, -1):
            self.after[k] = seen.get(kinds[k], -1) + 1
            seen[kinds[k]] = k
        self.ends: dict[int, int] = {}

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at `at`: the first > outside quoted values; -1: nowhere."""
        if self.special is None:
            self._prepare()
        k, chain = bisect.bisect_left(self.special, at), []
        while True:
            if k in self.ends:
                end = self.ends[k]
                break
            if k >= len(self.special):
                end = -1
                break
            chain.append(k)
            if self.page[self.special[k]] == ">":
                end = self.special[k]
                break
            k = self.after[k]
            if not k:  # a quote that nothing closes
                end = -1
                break
        for c in chain:
            self.ends[c] = end
        return end

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, tag, whether it closes, attributes) of the first tag or comment (tag "") from `at` on."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if m := _TAG.match(page, at):
                return at, m.end(), m[2].lower(), bool(m[1]), m[3]
            if not (m := _START.match(page, at)):
                at += 1
                continue
            start, at, head = m.start(), m.end(), m[0]
            if head[1] in "!?":
                closed = {"<!--": "-->", "<![CDATA[": "]]>"}.get(head)
                end = page.find(closed or ">", at) if (closed or ">") not in self.absent else -1
                if end >= 0:
                    return start, end + len(closed or ">"), "", False, ""
                self.absent.add(closed or ">")
                if closed:
                    return start, len(page), "", False, ""
            elif (end := self._end(at)) >= 0:
                close = head[1] == "/"
                return start, end + 1, head[1 + close :].lower(), close, page[at:end]
        return None

    def past(self, tag: str, at: int) -> int:
        """Behind the next closing tag of that name; -1: there is none."""
        if tag in self.absent:
            return -1
        m = _closing(tag).search(self.page, at)
        if not m:
            self.absent.add(tag)
        return m.end() if m else -1


@functools.lru_cache(256)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


class Page:
    """Tokens of a page in order of first appearance, and its text blocks."""

    def __init__(self, html: str):
        self.tokens: dict[int, int] = {PAGE: 0}  # place in the lists below
        self.count, self.last, self.parent = [1], [0], [-1]
        self.blocks: list[Block] = []
        self.steps = 0
        self._parse(html)

    def _see(self, token: int, parent: int) -> None:
        self.steps += 1
        at = self.tokens.setdefault(token, len(self.count))
        if at == len(self.count):
            self.count.append(0), self.last.append(0), self.parent.append(self.tokens[parent])
        self.count[at] += 1
        self.last[at] = self.steps

    def _parse(self, page: str) -> None:
        stack: list[tuple[str, int, int, int]] = []  # tag, token, chrome (2: by element, 1: by class), main (2: article, 1: main)
        buffer: list[str] = []
        element, chrome, main, article, links, linked = PAGE, 0, 0, False, 0, 0

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join(_html.unescape("".join(buffer)).split())
                if text:
                    block = Block(element, text, linked, bool(chrome), main)
                    self.blocks.append(block)
                    self._see(block.token, element)
                buffer.clear()
            linked = 0

        def say(text: str) -> None:
            nonlocal linked
            buffer.append(text)
            linked += len(text) if links else 0

        def settle() -> None:
            nonlocal element, chrome, main
            element, chrome, main = stack[-1][1:] if stack else (PAGE, 0, 0)

        at, n, scan, opened = 0, len(page), Scanner(page), Counter()  # opened: how often each tag is on the stack
        while at < n:
            m = scan.next(at)
            if not m:
                say(page[at:])
                break
            start, end, tag, closing, attrs = m
            if start > at:
                say(page[at:start])
            at = end
            if not tag:
                continue
            names = [] if closing or not attrs else _names(attrs)
            if tag in _INLINE:
                if tag == "br":
                    buffer.append(" ")
                if tag == "a":
                    links = max(0, links + (-1 if closing else 1))
                if not closing and tag not in _VOID and _named(names, _WORDS):
                    # an inline element that is chrome by name is skipped as a whole
                    end = scan.past(tag, at)
                    at, links = max(end, at), max(0, links - (tag == "a" and end >= 0))
                continue
            flush()
            if closing:
                if opened[tag]:
                    while stack:
                        opened[stack[-1][0]] -= 1
                        if stack.pop()[0] == tag:
                            break
                links = 0
                settle()
                continue
            if tag in _RAW:
                self._see(_hash(tag, element), element)
                end = scan.past(tag, at)
                at = end if end >= 0 else n
                continue
            if tag in _CLOSED_BY:
                while stack and stack[-1][0] in _CLOSED_BY[tag]:
                    opened[stack.pop()[0]] -= 1
            elif stack and stack[-1][0] == "p":
                opened[stack.pop()[0]] -= 1
            settle()
            token = _step(tag, tuple(names), element)
            self._see(token, element)
            if tag in _VOID or attrs.rstrip().endswith("/"):
                continue
            inside = max(main, 2 if tag == "article" else 1 if tag == "main" else 0)
            if inside > main and chrome == 1 and not article:
                # a class around the page's article says nothing
                stack = [(t, x, 0, *rest) for t, x, _, *rest in stack]
                settle()
            bad = chrome
            if tag in _CHROME or (not main and tag == "header"):
                bad = 2
            elif not bad and tag not in _ROOT and (_named(names, _WORDS) or (not main and _named(names, _HEAD_WORDS))):
                bad = 1
            article = article or (inside > 0 and not bad)
            stack.append((tag, token, bad, inside))
            opened[tag] += 1
            settle()
        flush()

    def content(self) -> int:
        """Hash of the text outside menus and the like: copies of an article agree."""
        return _hash("\n".join(x.text for x in self.blocks if not x.chrome), 0)


_PARSED = "host long, page long, content long, tokens array<long>, count array<int>, last array<int>, parent array<int>, block array<int>, around array<int>, chars array<int>, links array<int>, chrome array<boolean>"


def parsed(pages: DataFrame) -> DataFrame:
    """One row for each different page of a host: tokens in order of first appearance with count, last place and the place of
    the element around, and of each block the places of its token and its element, characters, characters in links and whether names call it chrome."""
    fields = [f.split(" ") for f in _PARSED.split(", ")]
    types = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in fields]
            for host, page, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                p = Page(text or "")
                row = (host, page, p.content(), list(p.tokens), p.count, p.last, p.parent, [p.tokens[x.token] for x in p.blocks], [p.tokens[x.element] for x in p.blocks], [len(x.text) for x in p.blocks], [x.links for x in p.blocks], [x.chrome for x in p.blocks])
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, types[t]) for v, (_, t) in zip(out, fields)], names=[f for f, _ in fields])

    rows = pages.select("host", F.xxhash64("html").alias("page"), "html").mapInArrow(run, _PARSED)
    others = [f for f, _ in fields[2:]]
    return rows.groupBy("host", "page").agg(F.first(F.struct(*others)).alias("x")).select("host", "page", "x.*")


def _with_host(rows: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """rows joined with one row for each host; the side is broadcast while it is small, as hosts can hold very many rows."""
    size = side.agg(F.sum(F.length(F.to_json(F.struct("*")))).alias("s")).first().s or 0
    return rows.join(F.broadcast(side) if size <= MAX_BROADCAST else side, "host", how)


def classes(seen: DataFrame, least: int = 2) -> DataFrame:
    """(host, frame, class_of, fixed): of each host with enough contents the tokens of valid classes, their classes, and those of them that are on all pages."""
    pages = seen.groupBy("host", "content").agg(F.count("*").alias("n")).groupBy("host").agg(F.sum("n").alias("all"), F.count("*").alias("contents")).where(F.col("contents") >= CONTENTS)
    each = seen.select("host", "page", F.explode(F.arrays_zip("tokens", "count")).alias("t")).select("host", "page", "t.tokens", "t.count")
    h = lambda seed: F.pmod(F.xxhash64("page", "count", F.lit(seed)), F.lit(1 << 31))
    one = each.groupBy("host", F.col("tokens").alias("token")).agg(F.count("*").alias("pages"), F.sum(h(1)).alias("f1"), F.sum(h(2)).alias("f2")).where(F.col("pages") >= least)
    # a text that isn't on all pages bounds no slot and is no template
    text = F.pmod("token", F.lit(2)) == 1
    one = one.join(pages, "host").where((F.col("pages") >= F.col("all") * SUPPORT) & (~text | (F.col("pages") == F.col("all"))))
    one = one.select("host", "token", (F.col("pages") == F.col("all")).alias("every"), F.xxhash64("pages", "f1", "f2").alias("class"))
    groups = one.groupBy("host", "class").agg(F.collect_set("token").alias("tokens"), F.first("every").alias("every")).where(F.size("tokens") > 1)
    groups = materialize(groups)
    side = groups.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("frame"), F.flatten(F.collect_list(F.transform("tokens", lambda t: F.col("class")))).alias("class_of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            known: dict[int, dict[int, int]] = {}  # of this batch
            for at, (host, tokens, last) in enumerate(zip(*[b.column(k).to_pylist() for k in range(3)])):
                if host not in known:
                    known[host] = dict(zip(b.column(3)[at].as_py(), b.column(4)[at].as_py()))
                for c, (order, crossed) in _orders(tokens, last, known[host]).items():
                    out[0].append(host), out[1].append(c), out[2].append(order), out[3].append(crossed)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["host", "class", "order", "crossed"])

    checked = _with_host(seen.select("host", "tokens", "last"), side, "inner").select("host", "tokens", "last", "frame", "class_of").mapInArrow(run, "host long, class long, order long, crossed boolean")
    valid = checked.groupBy("host", "class").agg(F.min("order").alias("lo"), F.max("order").alias("hi"), F.max("crossed").alias("crossed")).where((F.col("lo") == F.col("hi")) & ~F.col("crossed"))
    kept = groups.join(valid, ["host", "class"], "left_semi").groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("frame"), F.flatten(F.collect_list(F.when(F.col("every"), F.col("tokens")))).alias("fixed"))
    out = materialize(pages.select("host").join(kept, "host", "left").select("host", *[F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("frame", "fixed")]))
    release(groups)
    return out


def _orders(tokens: list[int], last: list[int], class_of: dict[int, int]) -> dict[int, tuple[int, bool]]:
    """Of each class on a page: a hash of the order of its tokens, and whether its span crosses that of another class."""
    spans: dict[int, list[int]] = {}
    order: dict[int, int] = {}
    for at, (t, z) in enumerate(zip(tokens, last)):
        c = class_of.get(t)
        if c is not None:
            order[c] = hash((order.get(c, 0), t))  # of integers: the same in every process
            s = spans.setdefault(c, [at, at])
            s[1] = at
    crossed = set()
    open_: list[tuple[int, int]] = []
    for c, (a, z) in sorted(spans.items(), key=lambda x: x[1][0]):
        while open_ and open_[-1][1] < a:
            open_.pop()
        if open_ and open_[-1][1] < z:
            # the outer class goes on after the inner one began: only a class around both may do that
            crossed |= {c}
        else:
            open_.append((c, z))
    return {c: (order[c], c in crossed) for c in spans}


def templates(pages: DataFrame) -> DataFrame:
    """(host, frame, fixed, drop, keep): elements that bound slots, blocks of the template, slots that are navigation, slots kept against their names."""
    seen = materialize(parsed(pages))
    frames = classes(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            known: dict[int, tuple[set[int], set[int]]] = {}  # of this batch
            for row, (host, tokens, parent, block, around, chars, links, chrome) in enumerate(zip(*[b.column(k).to_pylist() for k in range(8)])):
                if host not in known:
                    known[host] = set(b.column(8)[row].as_py()), set(b.column(9)[row].as_py())
                (frame, fixed), sums = known[host], {}
                slots = _slots(tokens, parent, frame)
                for at, element, n, m, bad in zip(block, around, chars, links, chrome):
                    static = tokens[at] in fixed
                    s = sums.setdefault((0 if static else slots[element], bad, static), [0, 0])
                    s[0] += n
                    s[1] += m
                for (slot, bad, static), (n, m) in sums.items():
                    for column, value in zip(out, (host, slot, bad, static, n, m)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()))], names=["host", "slot", "chrome", "static", "chars", "links"])

    named = ["host", "tokens", "parent", "block", "around", "chars", "links", "chrome"]
    slots = _with_host(seen.select(*named), frames, "inner").select(*named, "frame", "fixed").mapInArrow(run, "host long, slot long, chrome boolean, static boolean, chars long, links long")
    slots = slots.groupBy("host", "slot", "chrome", "static").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    chars = lambda where: F.sum(F.when(where, F.col("chars")).otherwise(0))
    every = slots.groupBy("host").agg(chars(~F.col("static")).alias("all"), chars(~F.col("static") & ~F.col("chrome")).alias("plain"), chars(F.col("static") & ~F.col("chrome")).alias("same"))
    every = materialize(every)
    slots = slots.where(~F.col("static")).join(every, "host")
    most = F.col("chars") * 2 > F.col("all")
    drop = ~F.col("chrome") & (F.col("links") >= F.col("chars") * LINKS) & ~most
    keep = F.col("chrome") & (F.col("plain") * 10 < F.col("all")) & most & (F.col("links") < F.col("chars") * LINKS)
    sides = slots.groupBy("host").agg(F.collect_set(F.when(drop, F.col("slot"))).alias("drop"), F.collect_set(F.when(keep, F.col("slot"))).alias("keep"))
    nothing = F.array().cast("array<long>")
    both = frames.join(every, "host", "left").join(sides, "host", "left")
    fixed = F.when(F.col("same") <= 3 * F.col("plain"), F.col("fixed")).otherwise(nothing)
    out = materialize(both.select("host", "frame", fixed.alias("fixed"), F.coalesce("drop", nothing).alias("drop"), F.coalesce("keep", nothing).alias("keep")))
    release(seen, frames, every)
    return out


def _slots(tokens: list[int], parent: list[int], frame: set[int]) -> list[int]:
    """For each token that of the innermost element of the frame around it, itself included; the page itself is the outermost."""
    out = tokens[:1]
    for token, around in zip(tokens[1:], parent[1:]):  # an element stands before what is in it
        out.append(token if token in frame else out[around])
    return out


def _read(page: str, template: tuple | None) -> str:
    p = Page(page)
    if template is None:
        left = [x for x in p.blocks if not x.chrome]
        if any(x.main for x in left):
            left = [x for x in left if x.main]
        return "\n".join(x.text for x in left)
    frame, fixed, drop, keep = template
    slots, left = _slots(list(p.tokens), p.parent, frame), []
    for x in p.blocks:
        if x.token in fixed:
            continue
        slot = slots[p.tokens[x.element]] if drop or keep else PAGE
        if slot in keep if x.chrome else slot not in drop:
            left.append(x.text)
    return "\n".join(left)


def extract(pages: DataFrame, use_template: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html); use_template=False reads by names alone."""
    host = F.xxhash64(host_path(F.col("url"))[0])
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host)
    side = ["frame", "fixed", "drop", "keep"]
    rows = _with_host(pages, templates(pages), "left") if use_template else pages.select("*", *[F.lit(None).cast("array<long>").alias(c) for c in side])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            known: dict[int, tuple] = {}  # of this batch
            texts = []
            for page, host, *t in zip(b["html"], b["host"], *[b[c] for c in side]):
                if t[0] is not None and host not in known:
                    known[host] = tuple(set(np.asarray(x).tolist()) for x in t)
                texts.append(_read(page if isinstance(page, str) else "", known.get(host)))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.select("page_id", "url", "html", "host", *side).mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
