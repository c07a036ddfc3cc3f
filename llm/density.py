"""Main text of pages by composite text density.

Every element gets characters per tag, adjusted for how many of its characters and tags are links.  The element whose children's
densities have the largest sum holds the article; the least density on its path up to the body is the threshold that other
parts of the body must reach to count as well.  Elements that are chrome by tag, role or class are taken out before anything is counted; a form, or
an element with a telling class, stays where it holds the heart of the page, and within an article class words decide only where all of them tell.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import bounded_batches

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe object svg math xmp noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr br".split())
_CHROME = frozenset("head nav footer aside button select dialog menu script style textarea title noscript template iframe object svg".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_CHROME_TOKENS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup share sharing social related recommended comment comments commentlist disqus reply replies respond form search login "
    "widget widgets toolbar pagination pager copyright".split())
#: Words that take an element out of an article even beside others; the rest must stand alone, or beside words that say nothing, and not on prose.
_FOREIGN = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored comment comments commentlist disqus reply replies respond cookie cookies "
    "consent gdpr newsletter".split())
_NEUTRAL = frozenset("area bar block box button buttons container content group icons inner item items link links list outer post row section top bottom wrap wrapper".split())
_PROSE = frozenset("p table thead tbody tr td th caption pre blockquote figure figcaption h1 h2 h3 h4 h5 h6 dl dt dd ol li".split())
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",)),
           "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}


class _Tree:
    """Elements in page order, each with its parent and what marks it as chrome, and the pieces of text between the tags."""

    def __init__(self) -> None:
        self.tags, self.parents, self.chrome, self.suspect = ["html"], [0], [False], [False]
        self.pieces: list[tuple[int, str | None]] = []
        self.stack, self.open = [0], defaultdict(list)

    def start(self, tag: str, attributes: str) -> None:
        if tag not in _INLINE and self.open["p"]:
            self.cut(self.open["p"][-1])
        for closed in _CLOSES.get(tag, ("", ()))[0].split():
            fence = max((self.open[x][-1] for x in _CLOSES[tag][1] if self.open[x]), default=0)
            if self.open[closed] and self.open[closed][-1] > fence:
                self.cut(self.open[closed][-1])
        parent = self.stack[-1]
        inside = bool(self.open["article"] or self.open["main"])
        chrome, suspect = tag in _CHROME or tag == "header" and not inside, tag == "form"
        if attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name == "role":
                    chrome |= value in _CHROME_ROLES
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    chrome = True
                elif name in ("class", "id"):
                    tokens = set(_TOKEN.findall(value))
                    if inside:
                        known = tokens & _CHROME_TOKENS
                        suspect |= not tokens.isdisjoint(_FOREIGN) or bool(known) and tag not in _PROSE and tokens - known <= _NEUTRAL
                    else:
                        suspect |= not tokens.isdisjoint(_CHROME_TOKENS) or "header" in tokens
        self.tags.append(tag)
        self.parents.append(parent)
        self.chrome.append(chrome)
        self.suspect.append(suspect and tag not in ("body", "article", "main"))
        if tag not in _INLINE:
            self.pieces.append((parent, None))
        if tag == "br":
            self.pieces.append((parent, " "))
        if tag not in _VOID:
            self.open[tag].append(len(self.stack))
            self.stack.append(len(self.tags) - 1)

    def cut(self, depth: int) -> None:
        """Close every open element from that depth of the stack on."""
        while len(self.stack) > max(1, depth):
            tag = self.tags[self.stack.pop()]
            self.open[tag].pop()
            if tag not in _INLINE:
                self.pieces.append((self.stack[-1], None))

    def end(self, tag: str) -> None:
        if self.open[tag]:
            self.cut(self.open[tag][-1])


def _parsed(html: str) -> _Tree:
    tree, at, size, last = _Tree(), 0, len(html), html.rfind(">")
    while at < size:
        begin = html.find("<", at)
        if begin < 0 or begin > last:
            unfinished = begin >= 0 and re.match(r"</?[a-zA-Z!?]", html[begin:begin + 3])
            tree.pieces.append((tree.stack[-1], html[at:begin] if unfinished else html[at:]))
            break
        if begin > at:
            tree.pieces.append((tree.stack[-1], html[at:begin]))
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        named = _NAME.match(html, begin + 1)
        if not named:
            if html[begin + 1:begin + 2] in ("!", "?", "/"):
                at = html.find(">", begin) + 1
            else:
                tree.pieces.append((tree.stack[-1], "<"))
                at = begin + 1
            continue
        end = html.find(">", named.end())
        for quote in "\"'":
            if html.count(quote, named.end(), end) % 2:
                closing = html.find(quote, end)
                further = html.find(">", closing) if closing > 0 else -1
                if 0 < further and html.count("<", end, closing) == 0:
                    end = further
                break
        closes, tag = named[1], named[2].lower()
        attributes, at = html[named.end():end], end + 1
        if closes:
            tree.end(tag)
            continue
        tree.start(tag, attributes)
        if tag in _RAW and not attributes.endswith("/"):
            ending = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(html, at)
            tree.end(tag)
            at = ending.end() if ending else size
    return tree


def _totals(tree: _Tree, sizes: list[int], off: list[bool]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Characters, tags, linked characters and link tags of each subtree, without what is off."""
    n = len(tree.tags)
    chars, tags, linked, links = list(sizes), [1] * n, [0] * n, [0] * n
    for node in range(n - 1, -1, -1):
        if off[node]:
            chars[node] = tags[node] = linked[node] = links[node] = 0
            continue
        if tree.tags[node] == "a":
            linked[node], links[node] = chars[node], links[node] + 1
        if node:
            up = tree.parents[node]
            chars[up] += chars[node]
            tags[up] += tags[node]
            linked[up] += linked[node]
            links[up] += links[node]
    return chars, tags, linked, links


def main_text(html: str | None) -> str:
    """The article of one page; blocks are joined by line feeds; empty if there is none."""
    if not html:
        return ""
    tree = _parsed(html)
    n, parents = len(tree.tags), tree.parents
    sizes = [0] * n
    pieces = [(node, entities.unescape(text) if text and "&" in text else text) for node, text in tree.pieces]
    for node, text in pieces:
        if text:
            sizes[node] += len("".join(text.split()))
    bare = _totals(tree, sizes, tree.chrome)[0]
    ends = list(range(1, n + 1))
    for i in range(n - 1, 0, -1):
        ends[parents[i]] = max(ends[parents[i]], ends[i])
    heart = next((i for tags in (("article", "main"), ("h1",)) for i in range(n) if tree.tags[i] in tags and bare[i]), None)

    def spared(i: int) -> bool:
        """Neither a form nor a class name takes out what holds the article, or most of a page that marks none."""
        return i <= heart < ends[i] if heart is not None else 2 * bare[i] > bare[0]

    off = [tree.chrome[i] or tree.suspect[i] and not spared(i) for i in range(n)]
    chars, tags, linked, links = _totals(tree, sizes, off)
    root = next((i for i in range(n) if tree.tags[i] == "body" and not off[i]), 0)
    share = linked[root] / max(1, chars[root])

    def density(i: int) -> float:
        if not chars[i]:
            return 0.0
        base = math.log(chars[i] / max(1, chars[i] - linked[i]) * linked[i] + share * chars[i] + math.e)
        ratio = chars[i] / max(1, linked[i]) * tags[i] / max(1, links[i])
        return chars[i] / tags[i] * math.log(ratio) / math.log(base) if base > 1 else chars[i] / tags[i] * math.log(ratio)

    hidden = [False] * n
    inner = [False] * n
    for i in range(n):
        hidden[i] = off[i] or i > 0 and hidden[parents[i]]
        inner[i] = not hidden[i] and (i == root or i > root and inner[parents[i]])
    values = [density(i) if inner[i] else 0.0 for i in range(n)]
    sums, has_child = [0.0] * n, [False] * n
    for i in range(n - 1, 0, -1):
        if inner[i] and i != root:
            sums[parents[i]] += values[i]
            has_child[parents[i]] = True
    best_below = list(range(n))
    for i in range(n):
        if inner[i] and not has_child[i]:
            sums[i] = values[i]
    for i in range(n - 1, 0, -1):
        if inner[i] and i != root and sums[best_below[i]] >= sums[best_below[parents[i]]] and sums[best_below[i]] > sums[parents[i]]:
            best_below[parents[i]] = best_below[i]
    best = best_below[root]
    path, up = [best], best
    while up != root:
        up = parents[up]
        path.append(up)
    threshold = min(values[i] for i in path)
    chosen, on_path = [False] * n, set(path)
    # The nearest article around a part, if it has one: its heading belongs to it.
    article = list(range(n))
    for i in range(root + 1, n):
        up = article[parents[i]]
        article[i] = i if tree.tags[i] == "article" or parents[i] == root or tree.tags[up] != "article" else up
    chosen[article[best]] = True
    for i in range(n):
        if inner[i] and i != root and i not in on_path and values[i] >= threshold > 0 and parents[i] in on_path and parents[i] != best:
            chosen[article[best_below[i]]] = True
    for i in range(n):
        chosen[i] = chosen[i] or inner[i] and tree.tags[i] == "h1"
    for i in range(1, n):
        chosen[i] = chosen[i] or inner[i] and chosen[parents[i]] and i != root
    blocks, words = [], []
    for node, text in pieces:
        if text is None:
            if words:
                blocks.append("".join(words))
                words = []
        elif chosen[node] and not hidden[node]:
            words.append(text)
    blocks.append("".join(words))
    return "\n".join(filter(None, (" ".join(block.split()) for block in blocks)))


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`page_id`, `url`, `text`, `n_chars` of each page; null or empty html has the empty text; repeated rows stay."""

    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    found = bounded_batches(pages).select(page_id, url, F.pandas_udf(extracted, T.StringType())(html).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
