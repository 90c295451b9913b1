"""HTML extraction with a suffix array for each host.

A page is read into blocks of text. Structure says which blocks are the article: those of an article (or main) element that
nothing condemns, MAIN, are kept whole, also where pages share them. All blocks of a host's pages are its token streams, with a
suffix at every token: a page has one stream of its article, and one of all its other blocks, one after the other, so that what
stands around an article meets. What the array decides are the blocks of these kinds:

* OPEN: blocks of pages without an article, headings and paragraphs ahead of one that nothing names, and blocks in an article under
  a class or id that names furniture ("tags", "related") or has such a word among others ("ad-hoc"). What repeats goes, what is
  unique, as a headline above the article, stays. Behind the first text of an article, a block is held against the articles of
  the other pages too: what is another's article is a teaser there. The other OPEN blocks aren't, as a page without an article
  element, or a line ahead of one, may be what another page has as its article.
* NAMED: blocks under such a name elsewhere, other blocks outside the article, adverts and reader comments. What repeats goes by the
  array; the rest goes too, as an advert or comment that only one page has is none of the article. `n_named` counts these.

Menus, page headers, footers, asides, forms and hidden elements (CLOSED, by tag, role or style) go in any case; their tokens are
in the array as evidence against the others.

The order of suffixes matters here only as far as their first MIN_TOKENS tokens: a token lies in a substring of MIN_TOKENS or
more tokens that another page has just if a suffix begins at most MIN_TOKENS - 1 tokens before it whose first MIN_TOKENS tokens
begin a suffix of another page. So suffixes are cut there, whole tokens and no hashes, and equal ones (neighbours in the array)
are one group, which sums to its smallest and largest page before the shuffle. Pages ask for their own suffixes by a join that
adaptive execution splits where a menu is on a million pages.

A block of an OPEN kind loses its runs of LONG or more covered tokens, or goes if MOST of its tokens are covered; what then
stands between the cuts stays if it has MIN_TOKENS tokens. A page whose OPEN blocks would all go, and that has no other text, is
a copy of another page and not furniture: it keeps them.

White space inside a block becomes one space; blocks are joined by one line feed; br is white space. Null and empty pages, and
an empty table, give the empty text and no rows. Pages without a host share the empty host. Rows are results of their own, also
repeated ones; for "another page", rows with one (page_id, url) are one page. Long pages are read whole. Further columns, of any
name, are left away.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import cut

#: Tokens of the shortest repeat; of a repeat that is cut out of a block; share of covered tokens with which a block goes.
MIN_TOKENS, LONG, MOST = 6, 20, 0.8
#: Bits of the table that tells which suffixes of articles are asked for (a multiple of 64).
SLOTS = 1 << 24

# Names of elements and of classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select option datalist title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split())
FURNITURE = frozenset("nav footer aside form dialog menu button fieldset search".split())
ARTICLE_ROLES = frozenset("main article".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
FURNITURE_NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising adsense sponsor sponsored promo "
    "promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist discussion disqus replies respond "
    "share sharing social related recommended recommendations pagination pager toolbar masthead skip widget widgets tags".split()
)
#: Of these, names of adverts, of readers' words and of appeals: nothing under them is the article's, unique or not.
NEVER_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist discussion disqus replies respond".split()
)
#: Classes and ids of elements that hold the article.
ARTICLE_NAMES = frozenset("article-body article-content article-text post-content post-body entry-content story-body story-content main-content".split())
#: Words beside which a name says what a page has, not what the element is ("with-sidebar"), and names of an article's own header.
MODIFIERS, OWN = frozenset("with has no without".split()), frozenset("article post entry story content".split())
#: Words of layout: beside these the names above mean the same ("ad-slot", "comment-list", "post-comments"); beside others they don't.
LAYOUT = frozenset(
    "slot box unit block container wrapper wrap outer inner area section zone list item items content bar panel top bottom left right main site page global header body text title link links button btn "
    "form field primary secondary mobile desktop js wide small large module region row col column group card holder frame inline sticky fixed thread count user reader article post entry story media third party google".split()
)
#: Elements whose text is prose where nothing else is said.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote".split())
#: Elements that an element of the same kind ends when it begins.
ENDS_ITSELF = frozenset("p li dt dd tr td th option".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z0-9]+")

MAIN, OPEN, NAMED, CLOSED = 0, 1, 2, 3
_PLAIN, _TEXT = -1, -2


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _furniture(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    """CLOSED or NAMED if the element is furniture, OPEN if its name only says so inside an article, else MAIN."""
    if tag in FURNITURE or (tag == "header" and not in_article) or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return CLOSED
    role = attributes.get("role", "").lower()
    if role in FURNITURE_ROLES and not (in_article and role == "banner"):
        return CLOSED
    if not attributes or tag in ("html", "body", "article", "main"):
        return MAIN
    style = attributes.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return CLOSED
    names: set[str] = set()
    vague = False
    for one in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = set(_NAME.findall(one))
        if parts & FURNITURE_NAMES and any(not p.isdigit() for p in parts - FURNITURE_NAMES - LAYOUT - MODIFIERS):
            vague |= not parts & MODIFIERS
        elif not parts & MODIFIERS:
            names |= parts
    if names & NEVER_ARTICLE:
        return NAMED
    if names & FURNITURE_NAMES:
        return OPEN if in_article else NAMED
    if vague:
        return OPEN
    return NAMED if not in_article and "header" in names and not names & OWN else MAIN


def _holds_article(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("article", "main") or attributes.get("role", "").lower() in ARTICLE_ROLES or "articleBody" in attributes.get("itemprop", ""):
        return True
    return bool(attributes) and not ARTICLE_NAMES.isdisjoint(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split())


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, MAIN, OPEN, NAMED or CLOSED) of each block of text, in page order; scripts and the like are left away.

    Plain blocks outside of an article are OPEN if the page has none with text, or if they are headings or paragraphs that come
    before it; else they are NAMED.
    """
    page = page or ""
    found: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # (tag, in an article, kind of the furniture it is in)
    held: list[str] = []
    at = 0

    def state() -> tuple[bool, int]:
        return stack[-1][1:] if stack else (False, MAIN)

    def flush() -> None:
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                inside, out = state()
                ahead = any(tag in PROSE for tag, _, _ in stack) and not any(kind == MAIN for _, kind in found)
                found.append((text, out or (MAIN if inside else _TEXT if ahead else _PLAIN)))
            held.clear()

    def end(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                if tag in INLINE and stack[i][2] != (stack[i - 1][2] if i else MAIN):
                    flush()
                del stack[i:]
                return

    def end_before(tag: str) -> None:
        """What the start of a block ends without an end tag."""
        if tag in ("article", "main"):  # a menu or page header that was never closed doesn't hold it
            for i, (t, _, out) in enumerate(stack):
                if out and t in ("nav", "header", "menu"):
                    del stack[i:]
                    return
                if out:
                    return
        for kind in {tag, "p"} & ENDS_ITSELF:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == kind:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE and stack[i][0] not in ENDS_ITSELF:
                    break

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        closing, tag, rest = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
        elif closing:
            if tag not in INLINE:
                flush()
            end(tag)
        elif tag in RAW:
            if not rest.rstrip().endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = over.end() if over else len(page)
        else:
            attributes = _attributes(rest)
            if tag not in INLINE or _furniture(tag, attributes, state()[0]):
                flush()
            if tag not in INLINE:
                end_before(tag)
            if tag not in VOID:
                inside, out = state()
                inside |= _holds_article(tag, attributes)
                stack.append((tag, inside, max(out, _furniture(tag, attributes, inside))))
    held.append(page[at:])
    flush()
    plain = NAMED if any(kind == MAIN for _, kind in found) else OPEN
    return [(t, {_PLAIN: plain, _TEXT: OPEN}.get(kind, kind)) for t, kind in found]


# ---- the suffix array ----


def stream(found: list[tuple[str, int]]) -> tuple[list[str], list[int], list[int], list[str]]:
    """(tokens of all blocks but MAIN ones, beginnings of the suffixes with a token in front that the array is to decide, of those
    that are held against articles too, tokens of the MAIN blocks)."""
    tokens: list[str] = []
    article: list[str] = []
    asked: list[int] = []
    teased: list[int] = []
    for text, kind in found:
        own = text.split(" ")
        if kind == MAIN:
            article += own
            continue
        if kind != CLOSED:
            asked += range(max(len(tokens) - MIN_TOKENS + 1, asked[-1] + 1 if asked else 0), len(tokens) + len(own))
        if kind == OPEN and article:
            teased += range(len(tokens), len(tokens) + len(own) - MIN_TOKENS + 1)
        tokens += own
    return tokens, [i for i in asked if i + MIN_TOKENS <= len(tokens)], teased, article


def _streams(df: DataFrame) -> DataFrame:
    """(k1, k2, page, host, tokens, asked, teased): rows of which the array has, or is asked, something outside of articles."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.drop(columns=["html"])
            found = [stream(blocks(page)) for page in b["html"]]
            out["tokens"], out["asked"], out["teased"] = ([f[i] for f in found] for i in range(3))
            yield out[[len(f[0]) >= MIN_TOKENS for f in found]]

    return df.select("k1", "k2", "page", "host", "html").mapInPandas(each, "k1 long, k2 long, page long, host string, tokens array<string>, asked array<int>, teased array<int>")


def _articles(df: DataFrame) -> DataFrame:
    """(page, host, tokens): the streams of the articles."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.drop(columns=["html"])
            out["tokens"] = [stream(blocks(page))[3] for page in b["html"]]
            yield out[[len(t) >= MIN_TOKENS for t in out["tokens"]]]

    return df.select("page", "host", "html").mapInPandas(each, "page long, host string, tokens array<string>")


def covered(streams: DataFrame, articles: DataFrame) -> DataFrame:
    """(k1, k2, places): where suffixes begin whose first MIN_TOKENS tokens another page of the host has too, outside of its article
    or, for teased ones, in it.

    Articles are most of the pages, so of their suffixes only those leave the scan that begin like a teased one, or share the
    remainder of its hash: a table of SLOTS bits, in rows of 64, tells which remainders there are.
    """
    head = lambda i: F.array_join(F.slice("tokens", i + 1, F.lit(MIN_TOKENS)), " ")
    heads = lambda df: df.select("page", "host", F.explode(F.transform(F.sequence(F.lit(0), F.size("tokens") - MIN_TOKENS), head)).alias("head"))
    pages = [F.min("page").alias("low"), F.max("page").alias("high")]
    asks = lambda c: streams.select("k1", "k2", "page", "host", F.explode(F.transform(c, lambda i: F.struct(i.alias("at"), head(i).alias("head")))).alias("s")).select("k1", "k2", "page", "host", "s.at", "s.head")
    repeated = heads(streams).groupBy("host", "head").agg(*pages).filter("low <> high").select("host", "head")
    found = asks("asked").drop("page").join(repeated.hint("merge"), ["host", "head"], "left_semi").select("k1", "k2", "at")
    teased = cut(asks("teased"), "html-teased")
    if not teased.isEmpty():
        wanted = cut(teased.select("host", "head").distinct(), "html-wanted")
        slot = F.pmod(F.xxhash64("host", "head"), F.lit(SLOTS))
        at, bit = F.shiftright(slot, 6).alias("at"), slot.bitwiseAND(F.lit(63)).cast("int")
        listed = wanted.select(at, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
        near = heads(articles).select("page", "host", "head", at, bit.alias("bit")).join(F.broadcast(listed), "at").filter(F.call_function("getbit", "bits", "bit") == 1)
        # wanted is distinct; a semi join would be pushed below the filter.
        told = near.join(wanted, ["host", "head"]).groupBy("host", "head").agg(*pages)
        other = teased.join(told.hint("merge"), ["host", "head"]).filter("low <> page OR high <> page")
        found = found.unionByName(other.select("k1", "k2", "at"))
    return found.groupBy("k1", "k2").agg(F.collect_set("at").alias("places"))


def decided(found: list[tuple[str, int]], places: list[int]) -> tuple[str, int, int]:
    """(text, number of blocks out of which the array took something, number of NAMED blocks that it left)."""
    n = sum(len(t.split(" ")) for t, kind in found if kind != MAIN)
    hit = bytearray(n)
    for i in places:
        hit[i : i + MIN_TOKENS] = b"\1" * MIN_TOKENS
    at = n_repeated = n_named = 0
    out, open_ = [], []
    for text, kind in found:
        if kind == MAIN:
            out.append(text)
            continue
        tokens = text.split(" ")
        own = bytes(hit[at : at + len(tokens)])
        at += len(tokens)
        if kind == OPEN:
            open_.append(text)
            kept = [text]
            if sum(own) >= MOST * len(own):
                kept = []
            elif cuts := [m.span() for m in re.finditer(rb"\x01{%d,}" % LONG, own)]:
                edges = [0, *(x for c in cuts for x in c), len(own)]
                kept = [" ".join(tokens[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= MIN_TOKENS]
            n_repeated += kept != [text]
            out += kept
        elif kind == NAMED:
            taken = sum(own) >= MOST * len(own)
            n_repeated += taken
            n_named += not taken
    return "\n".join(out or open_), n_repeated, n_named


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, n_repeated, n_named."""
    df = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    # What rows are told apart by is made of their values, so that it is the same when a lost task is run again.
    keys = {f"k{n}": F.xxhash64(F.lit(n), "page_id", "url", "html") for n in (1, 2)}
    df = df.withColumns({**keys, "page": F.xxhash64("page_id", "url"), "host": host})
    places = covered(cut(_streams(df), "html-streams"), _articles(df)).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "places")
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["page_id", "url", "k1", "k2"]].copy()
            found = [blocks(h) for h in b["html"]]
            # Blocks hold no line feed. Compressed, as every page's text goes through the exchange to meet its places.
            out["texts"] = [zlib.compress("\n".join(t for t, _ in f).encode("utf-8", "surrogatepass"), 1) for f in found]
            out["kinds"] = [bytes(k for _, k in f) for f in found]
            yield out

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for texts, own, places in zip(b["texts"], b["kinds"], b["places"], strict=True):
                each = zlib.decompress(texts).decode("utf-8", "surrogatepass").split("\n")
                found.append(decided(list(zip(each, own, strict=False)), [] if places is None else list(places)))
            out = b[["page_id", "url"]].copy()
            out["text"], out["n_repeated"], out["n_named"] = ([f[i] for f in found] for i in range(3))
            yield out

    df = df.mapInPandas(read, f"{kinds}, k1 long, k2 long, texts binary, kinds binary")
    # Both sides grow with the pages, so neither is to be broadcast, however few there are.
    df = df.join(places.hint("merge"), (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")), "left").select("page_id", "url", "texts", "kinds", "places")
    out = df.mapInPandas(decide, f"{kinds}, text string, n_repeated long, n_named long")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated", "n_named")
