"""Main text of web pages, with wrappers inferred for each host.

A wrapper is a union-free regular expression over the tokens of a host's pages: tags, fixed
texts, text slots, optional groups and repeated groups. It is inferred from all distinct pages
of the host, small groups of pages first and then their wrappers, in a tree: where a page and
the wrapper differ in a text, the text becomes a slot; where they differ in tags, a run that
repeats what stands before it becomes a repeated group, and what only one side has becomes
optional.

The wrapper decides what is main text (:class:`Guide`). Of the containers that every page
of the host has, the content is the innermost that still holds most of the text outside links;
in it, texts that the wrapper holds fixed are the host's own and go, and so do elements that
are notices, adverts and the like by name if they stand in the same place of several pages.
Where a host has a single distinct page there is nothing to compare, and the names of elements
decide alone: the article or main element, or the body, without what menus and the like are called.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import lookup, text_of, written

#: Pages that make a first wrapper, wrappers that are merged at once, tokens looked ahead for a group.
PAGES, MERGED, AHEAD = 32, 8, 200
#: Hashes of a guide that is broadcast, at most: with 1000 guides, 16 MB in all.
GUIDE = 2000
#: The share of a host's text that its content holds, and the share of the content that fixed texts may have.
HELD, OWN = 0.75, 0.25
TOKEN = re.compile(r"""(?s)<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
ATTRIBUTE = re.compile(r"""(?s)\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
NUMBER = re.compile(r"[0-9]+")
#: Elements whose content is no markup, elements without content, and elements that begin a block.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements, roles and words in class or id that are no main text.
NO_TEXT = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "datalist", "svg", "canvas", "object", "dialog", "menu", "search", "audio", "video", "map", "math"} | RAW
NO_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
NO_WORD = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments disqus reply replies respond related recommended footer".split()
)
NO_WORD_OUTSIDE = {"header", "masthead", "toolbar", "topbar"}
CONTENT = {"article", "main"}
ARTICLE = r"(article|main)(?![a-z0-9-])"
#: Elements that can hold a page's content.
CONTAINERS = CONTENT | {"body", "div", "section", "table", "tbody", "tr", "td", "center"}


@dataclass
class Node:
    """An open element: its tag, path, nearest container (its place in the tree of containers, and what it holds so far) and article; whether it is dropped, whose name is doubtful, and whether it is in a link."""

    tag: str
    path: str
    box: str
    inner: dict[str, int]
    content: str
    dropped: bool
    named: str
    link: bool


@dataclass
class Block:
    """A run of text without a block edge in it: where it stands and what it says."""

    box: str
    content: str
    dropped: bool
    named: str
    parts: list[str] = field(default_factory=list)


@dataclass
class Page:
    """A page as it is read: tokens for the inference - (tag or "", path or text) -, blocks, text outside links by container, and elements with a doubtful name."""

    tokens: list[tuple[str, str]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    weights: dict[str, int] = field(default_factory=dict)
    named: set[str] = field(default_factory=set)


@dataclass(frozen=True)
class Guide:
    """What a host's wrapper says: the place of its content ("": none) and how many containers of that name stand side by side there, hashes of its fixed texts, hashes of the named elements it confirms."""

    content: str = ""
    alike: int = 0
    fixed: frozenset[int] = frozenset()
    named: frozenset[int] = frozenset()


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


def is_dropped(tag: str, attrs: dict[str, str], content: str) -> bool:
    """Whether an element is no main text by its tag, role or style; content is the article or main it is in."""
    if tag in NO_TEXT or (tag == "header" and not content):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True
    return attrs.get("role", "").lower() in NO_ROLE


def is_named(tag: str, attrs: dict[str, str], content: str) -> bool:
    """Whether the class or id of an element calls it a notice, an advert or the like."""
    if not attrs or tag in CONTENT or tag in ("html", "body"):
        return False
    words = {w.lower() for w in WORD.findall(attrs.get("class", "") + " " + attrs.get("id", ""))}
    return bool(words & NO_WORD) or (not content and bool(words & NO_WORD_OUTSIDE))


def boxed(box: str, inner: dict[str, int], name: str) -> tuple[str, dict[str, int]]:
    """The place of a container with that name in the container box, which holds inner: the second and later ones of a name are numbered."""
    inner[name] = inner.get(name, 0) + 1
    return f"{box}>{name}" + (f":{inner[name]}" if inner[name] > 1 else ""), {}


def scan(html: str) -> Page:
    """A page, read as far as it goes if it is broken: end tags without a start are skipped, an
    end tag closes what is open inside its element, and a block closes an open paragraph.
    Numbers in classes and ids are all the same, as they tell pages of a host apart.
    """
    stack = [Node("", "", "", {}, "", False, "", False)]
    page = Page()
    tokens, blocks = page.tokens, page.blocks
    current: Block | None = None
    at = 0

    def text(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        top = stack[-1]
        if current is None or current.dropped != top.dropped or current.content != top.content or current.named != top.named or current.box != top.box:
            current = Block(top.box, top.content, top.dropped, top.named)
            blocks.append(current)
        current.parts.append(raw)
        if not raw.isspace():
            told = " ".join(unescape(raw).split())
            tokens.append(("", told))
            if not (top.dropped or top.link or top.named):
                page.weights[top.box] = page.weights.get(top.box, 0) + len(told)

    def close(tag: str) -> None:
        nonlocal current
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                if any(n.tag in BLOCKS for n in stack[k:]):
                    current = None
                del stack[k:]
                tokens.append((f"/{tag}", ""))
                return
            if tag not in BLOCKS and stack[k].tag in ("article", "main", "body"):
                return

    while (m := TOKEN.search(html, at)) is not None:
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if m[1]:
            close(m[1].lower())
        elif m[2]:
            tag = m[2].lower()
            if tag in VOID:
                if tag == "hr":
                    current = None
                elif tag == "br":
                    text(" ")
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag in BLOCKS:
                current = None
                if any(n.tag == "p" for n in stack):
                    k = max(i for i, n in enumerate(stack) if n.tag == "p")
                    if not any(n.tag in BLOCKS and n.tag != "p" for n in stack[k:]):
                        del stack[k:]
                        tokens.append(("/p", ""))
                if tag in ("li", "td", "th", "tr", "dt", "dd") and stack[-1].tag == tag:
                    stack.pop()
                    tokens.append((f"/{tag}", ""))
            top = stack[-1]
            attrs = attributes(m[3])
            name = tag
            if attrs:
                name += NUMBER.sub("0", "".join(f".{w}" for w in sorted(attrs.get("class", "").split())) + (f"#{attrs['id']}" if attrs.get("id") else ""))
            path = f"{top.path}>{name}"
            dropped = top.dropped or is_dropped(tag, attrs, top.content) or (tag == "article" and top.content == "article")
            named = top.named
            if not named and is_named(tag, attrs, top.content):
                named = path
                page.named.add(path)
            box, inner = boxed(top.box, top.inner, name) if tag in CONTAINERS else (top.box, top.inner)
            stack.append(Node(tag, path, box, inner, tag if tag in CONTENT and top.content != "article" else top.content, dropped, named, top.link or tag == "a"))
            tokens.append((name, path))
    text(html[at:])
    return page


# --- wrappers: lists of ("tag", name), ("text", fixed or None), ("opt", part), ("rep", part)


def as_wrapper(tokens: list[tuple[str, str]]) -> list[tuple]:
    return [("tag", name) if name else ("text", value) for name, value in tokens]


def reads(part: list[tuple], page: list[tuple], at: int) -> int:
    """Where page, read from `at`, leaves the expression part; -1 if it doesn't fit."""
    for kind, value in part:
        if kind == "opt":
            stop = reads(value, page, at)
            at = stop if stop >= 0 else at
        elif kind == "rep":
            while (stop := reads(value, page, at)) > at:
                at = stop
        elif at < len(page) and page[at][0] == kind and (kind == "text" or page[at][1] == value):
            at += 1
        else:
            return -1
    return at


def shape(part: list[tuple]) -> list[tuple]:
    """part with every text as a slot."""
    return [(k, None) if k == "text" else (k, v) for k, v in part]


def square(side: list[tuple], at: int, last: tuple) -> int:
    """The end of a run from `at` that ends in the token `last`; -1 if there is none near."""
    for k in range(at, min(len(side), at + AHEAD)):
        if side[k] == last:
            return k + 1
    return -1


def repeated(out: list[tuple], side: list[tuple], at: int) -> tuple[list[tuple], int, int] | None:
    """A run of side from `at` that repeats the end of out: its expression, its length in out, its end."""
    if not out or out[-1][0] != "tag" or not out[-1][1].startswith("/") or at >= len(side) or side[at][0] != "tag" or side[at][1].startswith("/"):
        return None
    stop = square(side, at, out[-1])
    if stop < 0:
        return None
    run = shape(side[at:stop])
    for k in range(len(out) - 1, max(-1, len(out) - AHEAD), -1):
        if out[k] == side[at]:
            if reads(run, out[k:], 0) == len(out) - k:
                return run, len(out) - k, stop
            return None
    return None


def generalise(wrapper: list[tuple], page: list[tuple]) -> list[tuple]:
    """A wrapper that reads what wrapper reads and page too; page may be a wrapper itself."""
    out: list[tuple] = []
    i = j = 0
    while i < len(wrapper) or j < len(page):
        w, p = wrapper[i] if i < len(wrapper) else None, page[j] if j < len(page) else None
        if w and w[0] in ("opt", "rep"):
            stop = reads(w[1], page, j)
            while stop > j:
                j = stop
                stop = reads(w[1], page, j) if w[0] == "rep" else -1
            out.append(w)
            i += 1
        elif p and p[0] in ("opt", "rep"):
            if not out or out[-1] != p:
                out.append(p)
            j += 1
        elif w and p and w[0] == p[0] == "text":
            out.append(w if w[1] == p[1] else ("text", None))
            i, j = i + 1, j + 1
        elif w and p and w == p:
            out.append(w)
            i, j = i + 1, j + 1
        elif (found := repeated(out, page, j)) is not None:
            run, length, j = found
            out[len(out) - length :] = [("rep", run)]
            while (stop := reads(run, page, j)) > j:
                j = stop
        elif (found := repeated(out, wrapper, i)) is not None:
            run, length, i = found
            out[len(out) - length :] = [("rep", run)]
            while (stop := reads(run, wrapper, i)) > i:
                i = stop
        else:
            in_page = next((k for k in range(j, min(len(page), j + AHEAD)) if w and page[k] == w), None)
            in_wrapper = next((k for k in range(i, min(len(wrapper), i + AHEAD)) if p and wrapper[k] == p), None)
            if in_page is not None and (in_wrapper is None or in_page - j <= in_wrapper - i):
                out.append(("opt", shape(page[j:in_page])))
                j = in_page
            elif in_wrapper is not None:
                out.append(("opt", wrapper[i:in_wrapper]))
                i = in_wrapper
            elif w is not None:
                out.append(("opt", [w]))
                i += 1
            else:
                out.append(("opt", shape([p])))
                j += 1
    return out


def infer(pages: list[str]) -> list[tuple]:
    """The wrapper of a host's pages, in the given order; empty for fewer than two."""
    streams = [as_wrapper(scan(p).tokens) for p in pages]
    if len(streams) < 2:
        return []
    wrapper = streams[0]
    for s in streams[1:]:
        wrapper = generalise(wrapper, s)
    return wrapper


def fixed_texts(wrapper: list[tuple]) -> list[int]:
    """Hashes of the texts that a wrapper holds fixed outside optional and repeated groups.

    A wrapper without a slot or group is one page, however often copied: nothing in it is
    told from the page's own text, so none of it is fixed.
    """
    if not any(k in ("opt", "rep") or v is None for k, v in wrapper):
        return []
    return sorted({hashed(v) for k, v in wrapper if k == "text" and v})


def opened(wrapper: list[tuple]) -> Iterator[tuple[str, str, str]]:
    """(kind, value, box) of the tokens that every page of a wrapper has: what a text or tag is in."""
    stack = [("", "", {})]
    for kind, value in wrapper:
        if kind == "tag" and value.startswith("/"):
            if k := next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == value[1:]), 0):
                del stack[k:]
        elif kind == "tag":
            tag = re.split(r"[.#]", value, maxsplit=1)[0]
            stack.append((tag, *(boxed(*stack[-1][1:], value) if tag in CONTAINERS else stack[-1][1:])))
            yield kind, tag, stack[-1][1]
        elif kind == "text":
            yield kind, value, stack[-1][1]


def containers(wrapper: list[tuple]) -> list[str]:
    """The containers that every page of a wrapper has, outermost first."""
    return list(dict.fromkeys(box for kind, tag, box in opened(wrapper) if kind == "tag" and tag in CONTAINERS))


def within(path: str, outer: str) -> bool:
    return path == outer or path.startswith(outer + ">")


def pruned(wrapper: list[tuple], weights: dict[str, int]) -> dict[str, int]:
    """weights by the innermost container of the wrapper around each."""
    known = set(containers(wrapper))
    out: dict[str, int] = {}
    for path, n in weights.items():
        while path and path not in known:
            path = path.rpartition(">")[0]
        out[path] = out.get(path, 0) + n
    return out


def named_as(box: str) -> str:
    """box without its number among containers of one name."""
    return re.sub(r":[0-9]+$", "", box)


def content_in(guide: Guide, blocks: list[Block], told: list[Block]) -> list[Block]:
    """Of the blocks told, those in a page's content. A page with more or fewer containers of the
    content's name than most has is out of step with their numbers: there the one with most text is it."""
    content = guide.content
    if side_by_side(blocks).get(named_as(content), guide.alike) != guide.alike:
        weights: dict[str, int] = {}
        for b in told:
            at = ">".join(b.box.split(">")[: content.count(">") + 1])
            if named_as(at) == named_as(content):
                weights[at] = weights.get(at, 0) + sum(len(p.strip()) for p in b.parts)
        content = max(weights, key=lambda at: (weights[at], at == content), default=content)
    return [b for b in told if within(b.box, content)]


def content_of(wrapper: list[tuple], weights: dict[str, int]) -> str:
    """The innermost container that holds most of the text; an article or main is not looked into."""
    total, at = sum(weights.values()), ""
    if not total:
        return ""
    held = {p: sum(n for q, n in weights.items() if within(q, p)) for p in containers(wrapper)}
    while True:
        inner = [p for p in held if p != at and within(p, at) and held[p] >= HELD * total] if at else [p for p in held if held[p] >= HELD * total]
        if not inner or re.match(ARTICLE, at.rpartition(">")[2]):
            return at
        at = min(inner, key=lambda p: (p.count(">"), -held[p], p))


@dataclass
class Found:
    """A wrapper and what its distinct pages say: how many, their text by container, how many have each named element, and how many have each number of containers side by side."""

    wrapper: list[tuple]
    pages: int
    weights: dict[str, int]
    named: dict[str, int]
    rows: dict[tuple[str, int], int]

    def joined(self, other: Found) -> Found:
        wrapper = generalise(self.wrapper, other.wrapper)
        weights, named, rows = dict(self.weights), dict(self.named), dict(self.rows)
        for to, more in ((weights, other.weights), (named, other.named), (rows, other.rows)):
            for path, n in more.items():
                to[path] = to.get(path, 0) + n
        return Found(wrapper, self.pages + other.pages, pruned(wrapper, weights), named, rows)

    def guide(self) -> Guide | None:
        """None where there is nothing to compare: one distinct page."""
        if self.pages < 2:
            return None
        content = content_of(self.wrapper, self.weights)
        fixed = fixed_texts(self.wrapper)
        if re.match(ARTICLE, content.rpartition(">")[2]):
            held = sum(n for q, n in self.weights.items() if within(q, content))
            if self.pages * sum(len(v) for k, v, box in opened(self.wrapper) if k == "text" and v and within(box, content)) > OWN * held:
                fixed = []  # pages that are copies but for a few words: what they share is their text
        alike = max((m, -n) for (p, n), m in [*self.rows.items(), (("", 0), 0)] if p in ("", named_as(content)))[1]
        return Guide(content, -alike, frozenset(fixed), frozenset(hashed(p) for p, n in self.named.items() if n > 1))


def side_by_side(blocks: list[Block]) -> dict[str, int]:
    """How many containers with text there are by place and name."""
    boxes: set[str] = set()
    for box in {b.box for b in blocks}:
        while box and box not in boxes:
            boxes.add(box)
            box = box.rpartition(">")[0]
    out: dict[str, int] = {}
    for box in sorted(boxes):
        out[named_as(box)] = out.get(named_as(box), 0) + 1
    return out


def found_in(html: str) -> Found:
    page = scan(html)
    wrapper = as_wrapper(page.tokens)
    return Found(wrapper, 1, pruned(wrapper, page.weights), dict.fromkeys(sorted(page.named), 1), dict.fromkeys(side_by_side(page.blocks).items(), 1))


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def main_text(html: str, guide: Guide | None = None) -> str:
    """The main text of a page: its blocks joined by line feeds. guide: what the host's wrapper says, if it has one.

    What would leave no text at all is not done: content without text gives way to the article
    or main element, that to the whole page, and fixed texts stay if nothing else is there.
    """
    blocks = scan(html).blocks
    told = [b for b in blocks if not b.dropped and not (b.named and (guide is None or hashed(b.named) in guide.named))]
    full = lambda blocks: any(not p.isspace() for b in blocks for p in b.parts)
    if guide and guide.content and full(inside := content_in(guide, blocks, told)):
        told = inside
    for content in ("article", "main"):
        if full(inside := [b for b in told if b.content == content]):
            told = inside
            break
    lines = [x for b in told if (x := " ".join(unescape("".join(b.parts)).split()))]
    own = [x for x in lines if hashed(x) not in guide.fixed] if guide else lines
    return "\n".join(own or lines)


def host(url: str = "url"):
    """The host of a URL in lower case; a null or odd URL has the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, content, alike, fixed, named (null for hosts with one distinct page), pages: the guide of each host.

    Every distinct page of a host takes part, as its tokens: about PAGES of them, dealt by a
    digest, make a first wrapper, and MERGED wrappers make one until the host has one, so no
    task holds the pages of a host with most of them. Copies go in the task that reads them,
    or else in their group. The number of pages of a host counts them all.
    """
    rows = pages.select(host().alias("host"), text_of("html").alias("html"))
    sizes = written(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")

    def streams(batches):
        seen = set()
        for batch in batches:
            hosts, digests, tokens = [], [], []
            for name, html in zip(batch.column(0), batch.column(1), strict=True):
                name, raw = name.as_py(), pickle.dumps(found_in(html.as_py()))
                digest = hashlib.md5(raw).hexdigest()
                if (name, digest) not in seen:
                    seen.add((name, digest))
                    hosts.append(name)
                    digests.append(digest)
                    tokens.append(zlib.compress(raw, 1))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.string()), pa.array(tokens, pa.binary())], ["host", "digest", "tokens"])

    def joined(group: pd.DataFrame, part: int, order: str) -> pd.DataFrame:
        found: Found | None = None
        for tokens in group.sort_values(order)["tokens"]:
            one = pickle.loads(zlib.decompress(tokens))
            found = one if found is None else found.joined(one)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "part": [part], "tokens": [zlib.compress(pickle.dumps(found), 1)]})

    def first(group: pd.DataFrame) -> pd.DataFrame:
        return joined(group.drop_duplicates("digest"), int(group["part"].iloc[0]), "digest")

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        return joined(group, int(group["part"].iloc[0]) // MERGED, "part")

    kind = "host string, part long, tokens binary"
    distinct = rows.where("html <> ''").mapInArrow(streams, "host string, digest string, tokens binary")
    dealt = lookup(distinct, sizes, "host", ["pages"], "pages", F.concat(F.lit("#"), F.col("digest")))
    part = F.pmod(F.xxhash64("digest"), F.ceil(F.col("pages") / PAGES).cast("long"))
    told = dealt.select("host", part.alias("part"), "digest", "tokens").groupBy("host", "part").applyInPandas(first, kind)
    left = -(-(sizes.agg(F.max("pages")).first()[0] or 0) // PAGES)
    while left > 1:
        told = told.groupBy("host", F.floor(F.col("part") / MERGED).alias("_to")).applyInPandas(merged, kind)
        left = -(-left // MERGED)

    def brief(batches):
        for batch in batches:
            guides = [pickle.loads(zlib.decompress(w.as_py())).guide() for w in batch.column(1)]
            cols = [[g and g.content for g in guides], [g and g.alike for g in guides], [g and sorted(g.fixed) for g in guides], [g and sorted(g.named) for g in guides]]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["host", "content", "alike", "fixed", "named"])

    guides = written(told.select("host", "tokens").mapInArrow(brief, "host string, content string, alike long, fixed array<long>, named array<long>"), "wrappers")
    return guides.join(sizes, "host")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, from its whole html.

    by_wrapper says whether the host's wrapper named the content the text is from. A null html
    has no text. Pages without a host share one wrapper with each other. Copies of a page are one
    for the wrapper and keep their text; repeated rows give repeated rows; pages of any length
    are read whole; an empty table gives none; other columns, whatever their names, are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"), host().alias("host"))
    small = F.coalesce(F.size("fixed"), F.lit(0)) + F.coalesce(F.size("named"), F.lit(0)) <= GUIDE
    told = lookup(rows, wrappers(pages), "host", ["content", "alike", "fixed", "named"], "pages", F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string")), fits=small)

    def extracted(batches):
        guides: dict[str, Guide | None] = {}
        for batch in batches:
            texts, by = [], []
            for html, name, content, alike, fixed, named in zip(*batch.columns[2:], strict=True):
                if (name := name.as_py()) not in guides:
                    if len(guides) > 1000:
                        guides.clear()
                    guides[name] = None if content.as_py() is None else Guide(content.as_py(), alike.as_py(), frozenset(fixed.as_py()), frozenset(named.as_py()))
                texts.append(main_text(html.as_py(), guides[name]))
                by.append(bool(guides[name] and guides[name].content))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(by, pa.bool_())], ["page_id", "url", "text", "n_chars", "by_wrapper"])

    return told.select("page_id", "url", "html", "host", "content", "alike", "fixed", "named").mapInArrow(extracted, "page_id long, url string, text string, n_chars long, by_wrapper boolean")
