"""Main text of web pages by equivalence-class template deduction.

A page is a stream of tokens: an element start with its path (tags and names of all open
elements), and a text block with its path. Over the distinct pages of one host every token has an
occurrence vector: how often it occurs on each page. Tokens with the same vector that hang under the same element of
another vector form an equivalence class. Classes on enough pages, each hanging from an element of a kept class, nest into the
template (:func:`nest`). Its elements are the slots; its text tokens, whose vector is that of a class around them, are words that
the site itself puts on its pages. :func:`article_slot` walks down the nested classes to the slot that holds what varies from
page to page, and a page's text is what stands in that slot, without the template's own words and without elements
that are menus, notices, adverts, comments and the like by their tag or by the whole name of a container. A page that doesn't
fit its host's template, or is alone on its host, is read by the template of itself: the walk over its own elements.

Vectors are never gathered: a vector is known by the number of pages, a sum and an exclusive or of
hashes of (page, count), which Spark aggregates with map-side combine however hot a host is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_MARKUP = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_QUOTED_OR_END = re.compile(r"=\s*([\"'])|>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_PARTS = re.compile(r"[a-z]+")
# Elements by their meaning in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg select".split())
_BLOCK = frozenset(
    """html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 header hgroup hr br legend li main menu nav ol optgroup option p plaintext listing pre search section summary table caption colgroup tbody td tfoot th thead tr ul""".split()
)
_BOILERPLATE_TAGS = frozenset("nav header footer aside form button menu dialog fieldset head".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_CLOSES = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_SCOPES = frozenset("ul ol table dl article section div main body".split())
#: Elements that hold other blocks: only these can be boilerplate by name, never a paragraph or a heading.
_CONTAINERS = frozenset("div section ul ol dl table details figure center span".split())
#: Running text: no slot of its own.
_TEXT_TAGS = frozenset("p pre blockquote table ul ol dl li dd dt h1 h2 h3 h4 h5 h6 figure figcaption address".split())
# A container is boilerplate if its whole name consists of words of these two lists, at least one of the first.
_BOILERPLATE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsors sponsored promo promotion promotions banner nav navbar navigation menu breadcrumb breadcrumbs
    header masthead footer sidebar aside cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login comment
    comments disqus discussion respond reply replies share sharing social related recommended recommendations widget widgets toolbar pagination pager search skip outbrain taboola""".split()
)
_NEUTRAL_WORDS = frozenset(
    """a and area bar block body bottom box button buttons center col column container content controls end form group holder icons id inner item items js layer left link links
    list main middle mobile module nr outer page pane panel post posts right row section site slot small space spot strip tab text thread title to top unit wrap wrapper""".split()
)
#: A token belongs to the template if it occurs on this share of a host's distinct pages, and on at least two.
SUPPORT = 0.5
#: With fewer distinct pages, text that all of them share isn't the site's own.
_OWN_PAGES = 3
#: In a slot, the site's own words are at most this share of a page's; with more, the page is a near copy of others.
_OWN_SHARE = 0.5
#: A host whose pages vary in less than this share of their text holds near copies: none of it is the site's own.
_VARYING = 0.1
#: The walk goes on into an element that holds this share of the slot's varying text; into one marked as article or main text, this one.
_ROOT_SHARE, _MARKED_SHARE = 0.8, 0.3


class _Element:
    __slots__ = ("boilerplate", "chars", "inside", "links", "sig", "tag")

    def __init__(self, tag, sig, boilerplate, inside):
        self.tag, self.sig, self.boilerplate, self.inside, self.chars, self.links = tag, sig, boilerplate, inside, 0, 0


def _is_boilerplate_name(value: str) -> bool:
    for name in value.lower().split():
        words = _PARTS.findall(name)
        if words and all(w in _BOILERPLATE_WORDS or w in _NEUTRAL_WORDS for w in words) and any(w in _BOILERPLATE_WORDS for w in words):
            return True
    return False


def _names(tag: str, attributes: str) -> tuple[str, bool, str]:
    """(names for the path, whether role or whole name say boilerplate, role)."""
    if "=" not in attributes:
        return "", False, ""
    kept, bad, role = [], False, ""
    for k, v in _ATTRIBUTE.findall(attributes):
        k = k.lower()
        if k not in ("class", "id", "role"):
            continue
        v = unescape(v.strip("\"'"))
        kept.append(f"{k}={' '.join(_PARTS.findall(v.lower()))}")
        if k == "role":
            role = v.strip().lower()
            bad = bad or role in _BOILERPLATE_ROLES
        elif tag in _CONTAINERS:
            bad = bad or _is_boilerplate_name(v)
    return ";".join(kept), bad, role


def _tag_end(html: str, at: int) -> int:
    """The position after the ``>`` that ends a tag; those in quoted values don't count."""
    while m := _QUOTED_OR_END.search(html, at):
        if not m[1]:
            return m.end()
        close = html.find(m[1], m.end())
        if close < 0:  # a quote without an end: the next bracket ends the tag
            close = html.find(">", m.end())
            return close + 1 if close >= 0 else len(html)
        at = close + 1
    return len(html)


def parse(html: str, root: int = -1) -> tuple[list[tuple], dict[int, list]]:
    """(blocks, elements) of a page.

    A block is (text, path, boilerplate, whether it stands inside the element with path ``root``). Elements maps a
    path to [parent path, tag, marked as article or main text, boilerplate, count, characters of text inside, of those in links].
    """
    blocks: list[tuple] = []
    elements: dict[int, list] = {}
    stack, open_ = [_Element("", 0, False, root == 0)], {"": 1}
    parts: list[str] = []
    link_chars = 0
    in_link = 0
    at = 0

    def flush():
        nonlocal link_chars
        if parts:
            text = " ".join(_decode("".join(parts)).split())
            parts.clear()
            if text:
                e = stack[-1]
                e.chars += 0 if e.boilerplate else len(text)
                e.links += 0 if e.boilerplate else min(link_chars, len(text))
                blocks.append((text, e.sig, e.boilerplate, e.inside))
        link_chars = 0

    def pop():
        nonlocal in_link
        e = stack.pop()
        open_[e.tag] -= 1
        in_link -= e.tag == "a"
        up = stack[-1]
        up.chars += e.chars
        up.links += e.links
        if e.sig in elements:
            elements[e.sig][5] += e.chars
            elements[e.sig][6] += e.links

    def push(tag, attributes):
        nonlocal in_link
        up = stack[-1]
        names, bad, role = _names(tag, attributes)
        sig = xxhash.xxh64_intdigest(f"{tag} {names}", up.sig & 0xFFFFFFFF) >> 1
        marked = tag in ("article", "main") or role in ("article", "main")
        bad = up.boilerplate or tag in _BOILERPLATE_TAGS or (bad and not marked)
        e = _Element(tag, sig, bad, up.inside or sig == root)
        known = elements.get(sig)
        if known is None:
            elements[sig] = [up.sig, tag, marked, bad, 1, 0, 0]
        else:
            known[4] += 1
        stack.append(e)
        open_[tag] = open_.get(tag, 0) + 1
        in_link += tag == "a"

    n, lower = len(html), None
    while at < n:
        m = _MARKUP.search(html, at)
        start = m.start() if m else n
        if start > at:
            parts.append(html[at:start])
            if in_link:
                link_chars += start - at
        if m is None:
            break
        at = m.end()
        if not m[2]:
            end = html.find("-->", at) if html.startswith("<!--", start) else html.find(">", at)
            at = n if end < 0 else end + (3 if html.startswith("<!--", start) else 1)
            continue
        tag = m[2].lower()
        end = _tag_end(html, at)
        attributes, at = html[at : end - 1] if end > at else "", end
        inline = tag not in _BLOCK
        if m[1]:
            if open_.get(tag, 0) > 0:
                if not inline:
                    flush()
                while stack[-1].tag != tag:
                    if stack[-1].tag in _BLOCK:
                        flush()
                    pop()
                pop()
            elif not inline:
                flush()
            continue
        if tag in _RAW:
            if tag not in ("svg", "select"):
                flush()
            if attributes.endswith("/") and tag == "svg":
                continue
            lower = lower if lower is not None else html.lower()
            end = lower.find(f"</{tag}", at) if len(lower) == n else html.find(f"</{tag}", at)
            at = n if end < 0 else _tag_end(html, end + len(tag) + 2)
            continue
        if not inline:
            flush()
        if tag in _VOID:
            continue
        if inline:
            push(tag, attributes)
            if attributes.endswith("/") and tag not in ("a", "b", "i", "em", "strong", "span"):
                pop()  # an empty element of mathematics, say
            continue
        for closed in _CLOSES.get(tag, ()):  # the end tags that HTML lets authors leave out
            if open_.get(closed, 0) > 0:
                depth = len(stack) - 1
                while stack[depth].tag not in _SCOPES and stack[depth].tag != closed and depth:
                    depth -= 1
                if stack[depth].tag == closed:
                    while len(stack) > depth:
                        pop()
        if open_.get("p", 0) > 0:
            depth = len(stack) - 1
            while stack[depth].tag != "p" and stack[depth].tag not in _SCOPES and depth:
                depth -= 1
            if stack[depth].tag == "p":
                while len(stack) > depth:
                    pop()
        push(tag, attributes)
    flush()
    while len(stack) > 1:
        pop()
    return blocks, elements


def _decode(text: str) -> str:
    return unescape(text) if "&" in text else text


def _text_token(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text, path & 0xFFFFFFFF) >> 1


_TOKENS = pa.schema([("host", pa.string()), ("token", pa.int64()), ("parent", pa.int64()), ("tag", pa.string()), ("marked", pa.bool_()), ("boilerplate", pa.bool_()), ("n", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()), ("page", pa.int64())])


def page_tokens(html: str) -> list[tuple]:
    """(token, parent, tag, marked, boilerplate, n, chars, links) of each distinct token of a page."""
    blocks, elements = parse(html)
    rows = [(sig, *e) for sig, e in elements.items()]
    texts: dict[int, list] = {}
    for text, path, bad, _ in blocks:
        t = texts.setdefault(_text_token(path, text), [path, bad, 0, 0])
        t[2] += 1
        t[3] += 0 if bad else len(text)
    return rows + [(t, path, "#text", False, bad, n, chars, 0) for t, (path, bad, n, chars) in texts.items()]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, html) -> a row for each distinct token of a page."""
    for b in batches:
        rows: list[tuple] = []
        for host, page, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows += [(host, *t, page) for t in page_tokens(html)]
            if len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TOKENS, strict=True)], schema=_TOKENS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TOKENS, strict=True)], schema=_TOKENS)


def nest(tokens: list[dict]) -> tuple[dict[int, int], dict[int, tuple], set[int]]:
    """(parent of each kept element, its class, the template's text tokens).

    ``tokens`` are those on enough of a host's pages, each with its vector ``vec``. A class is (vector, slot): the tokens of one
    vector under the nearest enclosing element of another. A class nests if its slot belongs to a kept class (or is the
    page); what hangs loose is left out. A text token is the template's if an element around it has its vector: it comes
    with every repetition of that element's class.
    """
    elements = {t["token"]: t for t in tokens if t["tag"] != "#text"}
    parent: dict[int, int] = {}
    slot: dict[int, tuple] = {0: (None, 0)}
    loose: set[int] = set()
    for sig in sorted(elements):
        chain = []
        while sig in elements and sig not in slot and sig not in loose:
            chain.append(sig)
            sig = elements[sig]["parent"]
        good = sig in slot
        for s in reversed(chain):
            if not good:
                loose.add(s)
                continue
            up, vec = elements[s]["parent"], elements[s]["vec"]
            parent[s] = up
            slot[s] = (vec, slot[up][1] if slot[up][0] == vec else up)
    own = set()
    for t in tokens:
        if t["tag"] == "#text":
            up = t["parent"]
            while up in parent and slot[up][0] != t["vec"]:
                up = slot[up][1]  # from class to enclosing class
            if up in parent:
                own.add(t["token"])
    return parent, slot, own


def article_slot(tokens: list[dict], host_pages: int = 1) -> tuple[int, set[int]]:
    """(path of the slot that holds the article, 0 for the page; the template's text tokens).

    From the page down, the walk goes into the element with the most varying text (less that in links), as long as it
    occurs once a page, or is marked as an article, and holds most of the slot's.
    """
    parent, _, own = nest(tokens)
    by = {t["token"]: t for t in tokens}
    whole = sum(by[s]["chars"] for s in parent if parent[s] == 0)
    if host_pages < _OWN_PAGES or sum(by[o]["chars"] for o in own) > (1 - _VARYING) * whole:
        own = set()
    fixed: dict[int, int] = {}
    for o in own:
        up = by[o]["parent"]
        while up in parent and by[o]["chars"]:
            fixed[up] = fixed.get(up, 0) + by[o]["chars"]
            up = parent[up]
    children: dict[int, list[int]] = {}
    for s in sorted(parent):
        children.setdefault(parent[s], []).append(s)

    def weight(s: int) -> int:
        t = by[s]
        return max(0, t["chars"] - fixed.get(s, 0) - 2 * t["links"])

    root, total = 0, None
    while True:
        # elements of running text, and those that repeat on a page, are content of the slot
        fit = [s for s in children.get(root, ()) if not by[s]["boilerplate"] and by[s]["tag"] in _BLOCK and by[s]["tag"] not in _TEXT_TAGS and (by[s]["times"] == by[s]["pages"] or by[s]["marked"])]
        if not fit:
            return root, own
        total = total if total is not None else sum(weight(s) for s in children[0])
        best = max(fit, key=lambda s: (weight(s), by[s]["marked"], -s))
        marked = [s for s in fit if by[s]["marked"]]
        if weight(best) < _ROOT_SHARE * total:
            best = max(marked, key=lambda s: (weight(s), -s), default=None)
            if best is None or weight(best) < _MARKED_SHARE * total:
                return root, own
        root, total = best, weight(best)


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host -> (host, root, own)."""
    schema = pa.schema([("host", pa.string()), ("root", pa.int64()), ("own", pa.list_(pa.int64()))])

    def done(host, rows):
        root, own = article_slot(rows, rows[0]["host_pages"])
        return pa.RecordBatch.from_pydict({"host": [host], "root": [root], "own": [sorted(own)]}, schema=schema)

    last, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if held and r["host"] != last:
                yield done(last, held)
                held = []
            last = r["host"]
            r["vec"] = (r["pages"], r["vec"], r["part"])
            held.append(r)
    if held:
        yield done(last, held)


def host_of(url_col: str):
    """The host in a URL, lower-case; '' without one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def deduce_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", support: float = SUPPORT) -> DataFrame:
    """(host, root, own): the article's slot and the own text of every host with two distinct pages or more."""
    # a page is known by a hash of what it holds, so that copies of a page on a host have one vote; tokens are shuffled for that, not pages
    p = pages.select(host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).select("host", F.xxhash64("html").alias("page"), "html")
    tokens = p.mapInArrow(_tokens, "host string, token long, parent long, tag string, marked boolean, boilerplate boolean, n long, chars long, links long, page long").dropDuplicates(["host", "token", "page"])
    seen = F.xxhash64("page", "n")
    found = tokens.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("times"), F.bit_xor(seen).alias("vec"), F.sum(seen.bitwiseAND(F.lit(0xFFFFFFFF))).alias("part"), F.min("parent").alias("parent"),
        F.min("tag").alias("tag"), F.min("marked").alias("marked"), F.min("boilerplate").alias("boilerplate"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
    )
    hosts = p.groupBy("host").agg(F.count_distinct("page").alias("host_pages"))
    # at most 1 / support times the tokens of a mean page stay for a host
    enough = found.join(hosts, "host").where((F.col("pages") >= 2) & (F.col("pages") >= support * F.col("host_pages")))
    return enough.repartition("host").sortWithinPartitions("host", "token").mapInArrow(_templates, "host string, root long, own array<long>")


def _without(slot: list[tuple], own: frozenset | set) -> list[tuple]:
    """A slot's blocks without the site's own; all of them if the own ones are over _OWN_SHARE of it."""
    left = [b for b in slot if _text_token(b[1], b[0]) not in own] if own else slot
    return left if sum(len(b[0]) for b in left) >= (1 - _OWN_SHARE) * sum(len(b[0]) for b in slot) else slot


def page_text(html: str, root: int, own: frozenset | set) -> str:
    """A page's text from its host's template; a page that doesn't fit it, from its own elements (``root`` -1: no template)."""
    blocks: list[tuple] = []
    if root >= 0:
        blocks, _ = parse(html, root)
    inside = [b for b in blocks if b[3] and not b[2]]
    if not inside:
        alone = [dict(zip(("token", "parent", "tag", "marked", "boilerplate", "times", "chars", "links"), t, strict=True), pages=1) for t in page_tokens(html) if t[2] != "#text"]
        for t in alone:
            t["vec"] = (t["times"],)
        blocks, _ = parse(html, article_slot(alone)[0])
        inside = [b for b in blocks if b[3] and not b[2]]
    return "\n".join(b[0] for b in _without(inside, own))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [page_text(h, -1 if r is None else r, frozenset(o or ())) for h, r, o in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every page.

    Null and empty pages have the empty text. Pages without a host in their URL (null URLs too)
    count as pages of one nameless host. Null and repeated ids, and repeated rows, are returned as they
    come, and repeats don't change what is found. Other columns aren't looked at; an empty table gives an empty result.
    """
    kind = pages.select(F.col(id_col)).schema[0].dataType.simpleString()
    templates, _ = materialize(deduce_templates(pages, url_col, html_col), "html-templates")
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(url_col).alias("host"))
    j = p.join(templates, "host", "left").select("id", "url", "html", "root", "own")
    out = j.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
