"""Main text of web pages by composite text density.

For every element of the document tree the characters per tag, adjusted by the share of links, give its density. The
element whose children's densities have the largest sum holds the article; the least density on the path from it to the
body is the threshold that other parts must reach. Text that stands in an element beside other blocks is a child of its own. What names itself as a menu, header, footer, sidebar, notice,
advert, form or reader comment is taken out of the tree before, as are scripts and styles. A name counts as a whole
(`no-sidebar` names no sidebar), and what is named stays if it holds the article: see `taken_out`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element and attribute names of HTML, and the words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template iframe object svg canvas head title nav footer aside button select textarea input dialog audio video menu".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu sidebar aside footer "
    "comment comments commentlist respond disqus cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal "
    "overlay share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar masthead".split()
)
READERS = frozenset("comment comments commentlist respond disqus related recommended".split())  # what is text, but never around the article beside it
NEUTRAL = frozenset(
    "area articles author bar block body bottom box button buttons container form icons info inner item items left links list main media outer page "
    "post posts right section site slot stories the title top unit widgets wrap wrapper".split()
)  # what may stand beside them in one name, as in site-footer
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
LISTS = frozenset("ul ol dl table div section".split())

WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Tree(HTMLParser):
    """Elements in page order, each after its parent, and blocks of text with the element they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.dropped = ["#root"], [-1], [False]
        self.named: list[str] = [""]  # by what an element may have to go: "" by nothing
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.blocks: list[tuple[int, list[tuple[int, str, bool]]]] = []  # owner, and text with its element and whether it is linked
        self.stack, self.open, self.owner = [0], [], 0
        self.links = 0

    def flush(self) -> None:
        if self.open:
            self.blocks.append((self.owner, self.open))
            self.open = []

    def block(self) -> None:
        """What follows belongs to another block."""
        self.flush()
        self.owner = next(n for n in reversed(self.stack) if self.tag[n] not in INLINE)

    def pop(self) -> None:
        self.links -= self.tag[self.stack.pop()] == "a"

    def close_to(self, names: set[str], scope: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[k]]
            if name in names:
                while len(self.stack) > k:
                    self.pop()
                return
            if name in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self.close_to({"p"}, CLOSES_P - {"p"})
        elif tag in SAME:
            self.close_to(SAME[tag], SCOPE[tag])
        above = self.stack[-1]
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(above)
        self.dropped.append(self.dropped[above] or tag in DROPPED or self.hidden(tag, attrs := dict(attrs)))
        self.named.append("" if self.dropped[node] else self.noise(tag, attrs))
        for counts in (self.chars, self.tags, self.link_chars, self.link_tags):
            counts.append(0)
        self.tags[above] += 1
        self.link_tags[above] += tag == "a"
        if tag == "br":
            self.open.append((0, " ", False))
        if tag not in VOID:
            self.stack.append(node)
            self.links += tag == "a"
        if tag not in INLINE:
            self.block()

    def hidden(self, tag: str, attrs: dict[str, str | None]) -> bool:
        return not self.sound(tag) and (attrs.get("hidden", "no") != "no" or attrs.get("aria-hidden") == "true")

    def sound(self, tag: str) -> bool:
        return tag in ("html", "body", "article", "main") and not any(self.tag[n] == "article" for n in self.stack)

    def noise(self, tag: str, attrs: dict[str, str | None]) -> str:
        """What an element says it is: "readers" (what READERS name), "header" (the tag), "noise", or "" for nothing of these."""
        found = set()
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():
            words = {w for w in WORDS.findall(name) if len(w) > 1}
            if words & (NOISE | {"header"}) and words <= NOISE | NEUTRAL | {"header"}:
                found |= words - NEUTRAL
        if self.sound(tag):
            return "own" if found & NOISE else ""
        if found & READERS:
            return "readers"
        if found & NOISE or attrs.get("role") in ROLES or tag == "form" or tag in ("label", "legend") and any(self.tag[n] == "form" for n in self.stack):
            return "noise"
        if (tag == "header" or "header" in found) and not any(self.tag[n] in ("article", "main") for n in self.stack):
            return "header" if tag == "header" else "noise"
        return ""

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if any(self.tag[n] == tag for n in self.stack[1:]):
            while self.tag[self.stack[-1]] != tag:
                self.pop()
            self.pop()
            if tag not in INLINE:
                self.block()

    def handle_data(self, data: str) -> None:
        node = self.stack[-1]
        if self.dropped[node]:
            return
        self.open.append((node, data, self.links > 0))
        size = len(data.strip())
        self.chars[node] += size
        if self.links:
            self.link_chars[node] += size


def taken_out(t: Tree) -> list[bool]:
    """Of each element whether it goes: scripts, styles and the like, and what is named as noise and does not hold the article.

    The article's marks are a main, an article (of half the longest one's text at least) and the first h1. A named element stays if one of
    them is in it, or most of the page's text that is not linked. Comments and related pages are often longer than the
    article and made of articles: they stay only if no mark is elsewhere, and inside a mark only if they are all its text.
    Names take nothing out if nothing else is left.
    """
    n = len(t.tag)
    plain = [c - lc for c, lc in zip(t.chars, t.link_chars)]
    below = [False] * n  # a header
    for k in range(n - 1, 0, -1):
        plain[t.parent[k]] += plain[k]
    for k in range(1, n):
        below[k] = below[t.parent[k]] or t.named[k] == "header"
    articles = [k for k in range(n) if t.tag[k] == "article" and not t.dropped[k] and not t.named[k]]
    most = max((plain[k] for k in articles), default=0)
    marked = {k for k in articles if 2 * plain[k] >= most} | {k for k in range(n) if t.tag[k] == "main" and not t.dropped[k]}
    marked |= set([k for k in range(n) if t.tag[k] == "h1" and not t.dropped[k] and not below[k]][:1])
    marks = [int(k in marked) for k in range(n)]
    for k in range(n - 1, 0, -1):
        marks[t.parent[k]] += marks[k]
    out, around = t.dropped[:], [(0, 0)] * n  # how many marks an element is in, and the text of the last
    for k in range(1, n):
        up = t.parent[k]
        around[k] = (around[up][0] + 1, plain[up]) if up in marked else around[up]
        if t.named[k] in ("noise", "header", "readers") and not out[k]:
            holds = marks[k] > 0 or 2 * plain[k] > plain[0]
            if t.named[k] == "readers":
                holds = holds and marks[k] + around[k][0] == marks[0] and plain[k] >= around[k][1]
            out[k] = not holds
        out[k] = out[k] or out[up]
    if any(text.strip() and not out[k] for _, run in t.blocks for k, text, _ in run):
        return out
    return t.dropped


def joined(run: list[tuple[int, str, bool]], dropped: list[bool]) -> str:
    return SPACE.sub(" ", "".join(text for k, text, _ in run if not dropped[k])).strip()


def density_of(c: int, n: int, lc: int, ln: int, share: float) -> float:
    """Composite density of a part by its characters, tags, linked characters and links; `share` is the body's of linked ones."""
    base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
    inside = c / max(1, lc) * max(1, n) / max(1, ln)
    return c / max(1, n) * math.log(max(inside, 1.0)) / max(base, 1e-9)


def densities(t: Tree) -> tuple[list[float], list[float], list[bool], list[tuple[int, float, str]]]:
    """Of each element: its composite density, the sum of its children's, and whether it holds blocks (if none does: is one).

    And the blocks: the element each stands in, its density and text. A block beside other blocks is a child of its element; its line
    breaks are no tags, as a paragraph's ends are none.
    """
    live = [not d for d in t.dropped]
    c, n, lc, ln = t.chars[:], t.tags[:], t.link_chars[:], t.link_tags[:]
    block = [tag not in INLINE for tag in t.tag]  # or an inline element around blocks
    mixed = [False] * len(live)  # has blocks among its children
    for k in range(len(live) - 1, 0, -1):
        if live[k]:
            for counts in (c, n, lc, ln):
                counts[t.parent[k]] += counts[k]
            if block[k] and c[k]:
                block[t.parent[k]] = mixed[t.parent[k]] = True
        elif live[t.parent[k]]:
            n[t.parent[k]] -= 1  # what was taken out is no tag of the page either
    body = next((k for k, tag in enumerate(t.tag) if tag == "body"), 0)
    share = lc[body] / max(1, c[body])
    density, total = [0.0] * len(live), [0.0] * len(live)
    for k in range(len(live) - 1, -1, -1):
        if live[k] and c[k]:
            density[k] = density_of(c[k], n[k], lc[k], ln[k], share)
        if k and (block[k] or not mixed[t.parent[k]]):  # else it is part of a block, which counts
            total[t.parent[k]] += density[k]
    blocks = []
    for home, run in t.blocks:
        run = [x for x in run if live[x[0]]]
        text = joined(run, t.dropped)
        if not text:
            continue
        home = next((k for k, s, _ in run if s.strip()), home)
        while not block[home]:
            home = t.parent[home]
        own = 0.0
        if mixed[home]:
            size, linked = (sum(len(s.strip()) for _, s, a in run if a >= least) for least in (False, True))
            inside = {k for k, s, _ in run if s.strip()} - {home}
            own = density_of(size, len(inside), linked, sum(t.tag[k] == "a" for k in inside) or int(linked > 0), share)
            total[home] += own
        blocks.append((home, own, text))
    t.chars, t.tags, t.link_chars, t.link_tags = c, n, lc, ln
    return density, total, mixed if any(mixed) else block, blocks


def extract(html: str) -> str:
    """The main text: its blocks in page order, one on a line, white space inside a block turned into one space.

    Only sums of densities choose, among the elements that hold blocks; an article or main goes before others of an equal sum, and when the
    choice is made what surrounds the chosen element in its own article belongs to it. Other parts
    that reach the threshold give their element of largest sum, and every block standing in them that reaches it. Nothing goes from the chosen element;
    outside of it lists, tables and sections of three links or more with over 60 % linked characters are menus and go.
    """
    t = Tree()
    t.feed(html)
    t.close()
    t.flush()
    t.dropped = taken_out(t)
    for k in range(len(t.tag)):
        if t.dropped[k]:
            t.chars[k] = t.tags[k] = t.link_chars[k] = t.link_tags[k] = 0
    density, total, holds, blocks = densities(t)
    if not any(total):
        return "\n".join(text for *_, text in blocks)
    best = max((k for k in range(len(total)) if holds[k]), key=lambda k: (total[k], t.tag[k] in ("article", "main"), -k))
    path = [best]
    while t.parent[path[-1]] >= 0 and t.tag[path[-1]] != "body":
        path.append(t.parent[path[-1]])
    kept, reached = [False] * len(total), [False] * len(total)
    least = min(density[k] for k in path)
    top = [k if holds[k] else -1 for k in range(len(total))]  # in each subtree, the element of largest sum that holds blocks
    for k in range(len(total) - 1, 0, -1):
        up = t.parent[k]
        if top[k] >= 0 and (top[up] < 0 or total[top[k]] > total[top[up]]):
            top[up] = top[k]
    for k in range(path[-1], len(total)):
        if density[k] and density[k] >= least and (k == path[-1] or reached[t.parent[k]]):
            reached[k] = True
            kept[top[k] if top[k] >= 0 and total[top[k]] > 0 else k] = True
    above, inside = set(path), [k == best for k in range(len(total))]
    listing = [k not in above and t.tag[k] in LISTS and t.link_tags[k] >= 3 and t.link_chars[k] > 0.6 * t.chars[k] for k in range(len(total))]
    for k in range(1, len(kept)):
        kept[k] = kept[k] or kept[t.parent[k]]
        inside[k] = inside[k] or inside[t.parent[k]]
        listing[k] = not inside[k] and (listing[k] or listing[t.parent[k]])
    chosen = [(kept[home] or reached[home] and bool(own) and own >= least) and not listing[home] for home, own, _ in blocks]
    return "\n".join(text for (*_, text), keep in zip(blocks, completed(t, blocks, chosen, reached, listing, path)) if keep)


def completed(t: Tree, blocks: list[tuple[int, float, str]], chosen: list[bool], reached: list[bool], listing: list[bool], path: list[int]) -> list[bool]:
    """Also the blocks too short for a density of their own: those between chosen ones in a part that reaches the threshold, headings
    right before chosen ones, and what else stands in the article or main around the best element (`path`, from it to the body)."""
    around = next((k for k in path if t.tag[k] in ("article", "main")), None)
    part = [-1] * len(t.tag)  # the nearest element around that reaches the threshold
    marked = [k == around for k in range(len(t.tag))]
    for k in range(len(t.tag)):
        up = t.parent[k]
        part[k] = k if reached[k] else part[up] if up >= 0 else -1
        marked[k] = marked[k] or up >= 0 and marked[up]
    there = [k for k, keep in enumerate(chosen) if keep]
    out = chosen[:]
    for k in range(len(blocks) - 1, -1, -1):
        home = blocks[k][0]
        between = bool(there) and there[0] < k < there[-1] and part[home] >= 0 and (part[home] != path[-1] or path[0] == path[-1])
        heads = t.tag[home] in HEADINGS and k + 1 < len(blocks) and out[k + 1]
        out[k] = out[k] or not listing[home] and (between or heads or marked[home])
    return out


def main_text(html: Column) -> Column:
    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((extract(page.as_py()) for page in batch), pa.string())

    return texts(F.coalesce(html.cast("string"), F.lit("")))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of `pages`: id, url, text (empty if there is none), n_chars.

    Null html is empty. Null ids and urls stay null, repeated rows are extracted each, whole pages are read whatever
    their length, no rows give no rows. Markup that ends early or nests wrongly is read as far as it goes. Further columns
    are not read.
    """
    found = pages.select(pages[id_col].alias(id_col), pages[url_col].alias(url_col), main_text(pages[html_col]).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
