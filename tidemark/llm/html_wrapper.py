"""Main text of web pages by wrappers: union-free regular expressions inferred from the token streams of one host.

1. Every page becomes a stream of tokens. A token is an element (named by its tag, first class or id, and its parent's
   token) or the text directly in one. Elements of one name under one parent are one token, counted.
2. Inference. Two streams are aligned by their common tokens, in order. A token that one of them lacks becomes an optional
   group at its place, one that occurs more often than its parent a repeated group; text that differs becomes a slot, text
   that agrees stays constant. All pages of a host are merged into its wrapper, first inside tasks, then salted by host,
   then by host, so that a host with a third of all pages is no single group. A wrapper grows with the different names
   in the templates of a host (names with digits count as their tag alone), not with its pages.
3. The wrapper names the content: the article or main elements; without any, the innermost group, not repeated, that holds
   most of the host's slot text outside links. Menus, headers, footers, sidebars, notices, adverts, forms and comments are
   left out: by their element, by a class or id made of nothing but words for such parts, or by one that only holds such
   a word where the wrapper shows that the part is constant on several pages or mostly links. An article or main element
   is never left out by its class.
4. The wrapper is matched against each page, token by token, and the matched content is read in order: blocks of text,
   each with single spaces, joined by line feeds. A page without any of its wrapper's content is read by its own stream.

Defined cases: null or empty html gives an empty text; truncated pages are read as far as they go; unclosed elements end
where HTML ends them; a null url counts as a host of its own; repeated rows are read one by one; an empty table gives an
empty result; pages are never cut, however long or deeply nested.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|object|head)(?=[\s/>])(?:.*?</\1\s*>|.*?(?=<body[\s>])|.*\Z)|<[!?][^>]*>|<(/?)([a-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*|[^>]*)>""", re.S | re.I)
MARK = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Elements, roles and class words that mark what is not the article, and words that say nothing either way.
OUTSIDE_TAGS = frozenset(["nav", "header", "footer", "aside", "form", "button", "dialog", "menu"])
OUTSIDE_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"])
CONTENT_ROLES = frozenset(["main", "article", "articlebody"])
OUTSIDE_WORDS = frozenset(
    """ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices alert popup modal overlay newsletter subscribe subscription signup menu nav navbar navigation
    breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended share sharing social comment comments
    commentlist discussion respond replies reply disqus footer header masthead pagination pager login search toolbar skip
    copyright""".split()
)
NEUTRAL_WORDS = frozenset(
    """site page main top bottom left right global primary secondary list item items box area section block bar wrapper
    wrap container inner outer content text posts post links link user reader form button buttons""".split()
)
LEAVES = INLINE | {"p", "h1", "h2", "h3", "li", "td"}
#: Pages on which a text must stand alike to count as part of the template.
LEAST_PAGES = 3


class Element:
    __slots__ = ("above", "content", "in_content", "inline", "kids", "label", "name", "outside", "tag", "weak")

    def __init__(self, tag: str, name: str, above: str, outside: bool, weak: bool, content: bool, in_content: bool):
        self.tag, self.name, self.above, self.outside, self.weak, self.content, self.in_content = tag, name, above, outside, weak, content, in_content
        self.label = label_of(above, name) if name else ""
        self.inline, self.kids = tag in INLINE, []


def label_of(parent: str, name: str) -> str:
    return hashlib.blake2b(f"{parent}/{name}".encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def marks(tag: str, attributes: str, in_content: bool) -> tuple[str, bool, bool, bool]:
    """(name, lies outside the article, perhaps does, is article-like)."""
    name, weak, content = "", False, tag in ("article", "main")
    outside = tag in OUTSIDE_TAGS and not (tag == "header" and in_content)  # there it is the headline of the article itself
    if attributes and "=" in attributes:
        for kind, *values in MARK.findall(attributes):
            value = next((v for v in values if v), "").lower()
            if kind.lower() in ("role", "itemprop"):
                outside |= kind.lower() == "role" and value in OUTSIDE_ROLES
                content |= value in CONTENT_ROLES
                continue
            for token in value.split():
                if not name and token.isascii() and not any(c.isdigit() for c in token):
                    name = token
                parts = [x for x in re.split(r"[^a-z]+", token) if x]
                some = not OUTSIDE_WORDS.isdisjoint(parts)
                weak |= some
                outside |= some and all(x in OUTSIDE_WORDS or x in NEUTRAL_WORDS for x in parts) and tag not in ("html", "body", "article", "main")
    if content and tag in ("article", "main"):
        outside = weak = False
    return (f"{tag}.{name}" if name else tag), outside, weak and tag not in ("html", "body"), content and not outside


def parse(page: str) -> Element:
    """The page's tree; texts are plain strings among the kids."""
    root = Element("", "", "", False, False, False, False)
    stack, at, open_ = [root], 0, Counter()

    def close(i: int) -> None:
        for x in stack[i:]:
            open_[x.tag] -= 1
        del stack[i:]

    for m in TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if open_[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in CLOSES_P and open_["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if not stack[i].inline:
                    break
        elif tag in ENDED_BY and any(open_[x] for x in ENDED_BY[tag][0]):
            ends, stops = ENDED_BY[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stops:
                    break
                if stack[i].tag in ends:
                    close(i)
                    break
        if tag == "br":
            stack[-1].kids.append(" ")
            continue
        above = stack[-1]
        name, outside, weak, content = marks(tag, m[4], above.in_content)
        one = Element(tag, name, above.label, outside, weak, content, above.in_content or content)
        above.kids.append(one)
        if tag not in VOID:
            stack.append(one)
            open_[tag] += 1
    if at < len(page):
        stack[-1].kids.append(page[at:])
    return root


# A token of a wrapper, by its label: label of its parent, name, depth, pages that have it, occurrences, characters outside
# links, characters in links, hash of its own text while that is alike on all pages, outside, weak, content.
PARENT, NAME, LEVEL, PAGES, TIMES, CHARS, LINKED, CONSTANT, OUTSIDE, WEAK, CONTENT = range(11)
Wrapper = dict[str, list]


def stream(page: Element) -> Wrapper:
    """The token stream of one page, in the order of the page: a wrapper of one page."""
    out: Wrapper = {}
    texts: dict[str, list[str]] = {}
    stack = [(page, 0, False)]
    while stack:
        element, level, link = stack.pop()
        link = link or element.tag == "a"
        node = out.setdefault(element.label, [element.above, element.name, level, 1, 0, 0, 0, None, element.outside, element.weak, element.content])
        node[TIMES] += 1
        own = texts.setdefault(element.label, [])
        for kid in element.kids:
            if isinstance(kid, str) and (text := " ".join(kid.split())):
                own.append(text)
                node[LINKED if link else CHARS] += len(text)
        stack += [(kid, level + 1, link) for kid in reversed(element.kids) if not isinstance(kid, str)]
    for label, own in texts.items():
        out[label][CONSTANT] = hashlib.blake2b("\n".join(own).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    return out


def merged(a: Wrapper, b: Wrapper) -> Wrapper:
    """The wrapper for what a and b stand for: common tokens are merged in the order of a, the others follow the one before them."""
    after: dict[str | None, list[str]] = {}
    place = None
    for label in b:
        if label in a:
            place = label
        else:
            after.setdefault(place, []).append(label)
    out: Wrapper = {label: b[label] for label in after.get(None, ())}
    for label, x in a.items():
        y = b.get(label)
        if y is not None:
            constant = x[CONSTANT] if x[CONSTANT] == y[CONSTANT] else None
            sums = [i + j for i, j in zip(x[PAGES:CONSTANT], y[PAGES:CONSTANT], strict=True)]
            flags = [i or j for i, j in zip(x[OUTSIDE:], y[OUTSIDE:], strict=True)]
            x = [*x[:PAGES], *sums, constant, *flags]
        out[label] = x
        out.update((other, b[other]) for other in after.get(label, ()))
    return out


def optional(wrapper: Wrapper, label: str) -> bool:
    """Whether pages that have the token's parent may lack it."""
    return wrapper[label][PAGES] < wrapper[wrapper[label][PARENT]][PAGES]


def repeated(wrapper: Wrapper, label: str) -> bool:
    """Whether the token occurs more often than its parent."""
    return wrapper[label][TIMES] > wrapper[wrapper[label][PARENT]][TIMES]


def left_out(wrapper: Wrapper) -> set[str]:
    """The tokens that are not of the article by themselves."""
    below: dict[str, list[int]] = {}
    for label in sorted(wrapper, key=lambda x: -wrapper[x][LEVEL]):
        node = wrapper[label]
        own = below.setdefault(label, [0, 0, 0])  # characters that differ between pages, that are alike, in links
        same = node[CONSTANT] is not None and node[PAGES] >= LEAST_PAGES
        own[1 if same else 0] += node[CHARS]
        own[2] += node[LINKED]
        if node[LEVEL]:
            above = below.setdefault(node[PARENT], [0, 0, 0])
            for i in range(3):
                above[i] += own[i]
    return {x for x, node in wrapper.items() if node[OUTSIDE] or (node[WEAK] and not node[CONTENT] and below[x][0] <= below[x][2] + below[x][1])}


def content_of(wrapper: Wrapper) -> tuple[set[str], set[str]]:
    """The tokens that hold the article, and those in them that are left out."""
    out = left_out(wrapper)
    order = sorted(wrapper, key=lambda x: wrapper[x][LEVEL])
    gone: set[str] = set()
    for label in order:
        if label in out or wrapper[label][PARENT] in gone and wrapper[label][LEVEL]:
            gone.add(label)
    slots = {x: 0 for x in wrapper}
    kids: dict[str, list[str]] = {}
    inner = dict.fromkeys(wrapper, 0)  # slot characters of the nearest article-like tokens below
    for label in reversed(order):
        node = wrapper[label]
        if label in gone:
            continue
        if node[CONSTANT] is None or node[PAGES] < LEAST_PAGES:
            slots[label] += node[CHARS]
        if node[LEVEL]:
            slots[node[PARENT]] += slots[label]
            inner[node[PARENT]] += slots[label] if node[CONTENT] else inner[label]
            kids.setdefault(node[PARENT], []).append(label)
    chosen: set[str] = set()
    within: set[str] = set()
    for label in order:  # of nested article-like tokens the inner ones, if they hold half of the outer's slots
        node = wrapper[label]
        if label in gone or node[PARENT] in within and node[LEVEL]:
            within.add(label)
        elif node[CONTENT] and slots[label] and (2 * inner[label] < slots[label] or not inner[label]):
            chosen.add(label)
            within.add(label)
    if not chosen:
        label = order[0]
        while True:  # down to the innermost group with most of the slots
            best = max((x for x in kids.get(label, ()) if not repeated(wrapper, x)), key=slots.get, default=None)
            if best is None or wrapper[best][NAME].split(".")[0] in LEAVES or slots[best] < 0.6 * slots[label]:
                chosen = {label}
                break
            label = best
    return chosen, out


def main_text(page: Element, chosen: set[str], out: set[str], known: Wrapper) -> str | None:
    """Blocks of the page's elements that match the chosen tokens; None if it has none of them."""
    blocks: list[str] = []
    line: list[str] = []
    seen = False

    def end() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    stack: list[tuple[Element | str | None, bool]] = [(page, False)]
    while stack:
        element, on = stack.pop()
        if element is None:
            end()
        elif isinstance(element, str):
            if on:
                line.append(element)
        else:
            now = on or element.label in chosen
            seen |= now
            if now and not element.inline:
                end()
                stack.append((None, True))
            if element.label in out or element.outside and element.label not in known:
                continue
            stack += [(kid, now) for kid in reversed(element.kids)]
    end()
    return "\n".join(blocks) if seen else None


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def infer(pages: DataFrame, salts: int = 64) -> DataFrame:
    """(host, wrapper): the wrapper of each host as JSON, from all its pages."""

    def rows(held: dict[str, Wrapper]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"host": list(held), "wrapper": [json.dumps(x) for x in held.values()]})

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = stream(parse(page))
                held[name] = merged(held[name], own) if name in held else own
            if len(held) > 500:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def across(part: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for text in sorted(part["wrapper"]):
            whole = json.loads(text) if whole is None else merged(whole, json.loads(text))
        return pd.DataFrame({"host": [part["host"].iloc[0]], "wrapper": [json.dumps(whole)]})

    parts = pages.where("html is not null and html <> ''").select(host(F.col("url")).alias("host"), "html").mapInArrow(within, "host string, wrapper string")
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    return parts.groupBy("host", "salt").applyInPandas(across, "host string, wrapper string").groupBy("host").applyInPandas(across, "host string, wrapper string")


def extract(pages: DataFrame, most_broadcast: int = 50_000_000) -> DataFrame:
    """(page_id, url, text, n_chars) per page row. Wrappers are broadcast up to so many characters in all, else joined by host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set[str], set[str], Wrapper]] = {}
        for batch in batches:
            out = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not page:
                    out.append("")
                    continue
                tree, text = parse(page), None
                if wrapper is not None:
                    if wrapper not in known:
                        if len(known) > 500:
                            known.clear()
                        tokens = json.loads(wrapper)
                        known[wrapper] = (*content_of(tokens), tokens)
                    text = main_text(tree, *known[wrapper])
                if text is None:
                    own = stream(tree)
                    text = main_text(tree, *content_of(own), own)
                out.append(text or "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host(F.col("url")).alias("host"))
    wrappers = cut(infer(pages))
    if (wrappers.agg(F.sum(F.length("wrapper")).alias("n")).first()["n"] or 0) <= most_broadcast:
        wrappers = F.broadcast(wrappers)
    return rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
