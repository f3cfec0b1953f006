"""The main text of web pages by tree scoring.

A page is parsed into a tree of elements whose blocks of text hold their length, commas and linked part. Elements
that are never text of an article (by tag, role or the words of their class and id) go first. Each paragraph then has points
for its length and commas, less its share of links; they pass to the element that holds it, by half to the next above
and so on, in one pass from the leaves up, and an element's sum is discounted by its own link density. The
best container is kept, or the article around it, with those siblings that have a fifth of its score or are
unlinked sentences, and its blocks are written in page order.

Each page is one row's own work: no shuffle, and a task holds a batch of pages.

Defined results: a null or empty page has an empty text, as has one of which nothing is left; white space is what
Unicode calls so, a line break element counts as white space; unclosed, stray and cut off tags are read as browsers do in
the main (a block closes an open paragraph, an end tag without a start is ignored); a page in one form is read as if the
form weren't there; repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never shown as text, and those that are never part of an article.
SILENT = frozenset("audio button canvas datalist head iframe math meter noembed noframes noscript object optgroup option progress script select style svg template textarea title video".split())
APART = frozenset("aside dialog footer menu nav".split())
APART_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or an id that mark what isn't the article, and those that mark where it may be.
NOISE = frozenset(
    "ad ads adbox adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs combx comment comments consent cookie cookies disqus dropdown footer gdpr login masthead menu modal nav navbar navigation newsletter notice"
    " pager pagination popup promo promoted promotion recommended related reply respond share sharing shoutbox sidebar signup skyscraper social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
#: Those of them that are noise even where they hold an element of an article's kind.
REMARKS = frozenset("comment comments combx disqus reply respond related recommended promoted promotion shoutbox cookie cookies consent newsletter".split())
CONTENT = frozenset("article body column content entry main page post story text wrapper".split())
#: An element of this tag is closed by a further one of the group, up to the enclosing list or table.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
COMMAS = re.compile("[,،、，]")
SENTENCE_END = re.compile(r"[.!?。！？…][\"'”’»)\]]*$")

SIBLING_SHARE = 0.2
SIBLING_LENGTH = 80
SIBLING_LINKS = 0.25
MENU_LINKS = 0.75
CHARS_OF_A_POINT = 100


def marks(at: dict[str, str | None]) -> set[str]:
    return {w.lower() for k in ("class", "id") for w in WORD.findall(at.get(k) or "")}


class Tree(HTMLParser):
    """Elements in order of their start: tag, parent, whether they are noise (firm: even around an article), an article, silent or named like content; and blocks (element, text, linked characters)."""

    def __init__(self, forms: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.forms = forms
        self.tags, self.parents, self.noise, self.firm, self.article, self.silent, self.content = ["html"], [0], [False], [False], [False], [False], [False]
        self.stack, self.open = [0], {"html": 1}
        self.block_places, self.owners = [0], [0]  # places of open blocks in the stack, open blocks and noise
        self.blocks: list[tuple[int, str, int]] = []
        self.pieces: list[str] = []
        self.linked = 0
        self.wrapped = False

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self.owners[-1], text, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def pop(self, place: int) -> None:
        """Close the elements of the stack from place on."""
        gone = self.stack[place:]
        if self.owners[-1] >= gone[0]:  # elements are numbered as they open
            self.flush()
        for e in gone:
            self.open[self.tags[e]] -= 1
        del self.stack[place:]
        while self.block_places[-1] >= place:
            self.block_places.pop()
        while self.owners[-1] >= gone[0]:
            self.owners.pop()

    def above(self, stops) -> int:
        """Place of the nearest open element for whose tag stops holds; -1 if there is none."""
        return next((k for k in range(len(self.stack) - 1, 0, -1) if stops(self.tags[self.stack[k]])), -1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.pieces.append(" ")
        if tag in ("html", "br"):
            return
        if tag in BLOCKS:
            self.flush()
            near = self.block_places[-1]
            if near > 0 and (self.tags[self.stack[near]] == "p" or tag in HEADINGS and self.tags[self.stack[near]] in HEADINGS):
                self.pop(near)
            if tag in SIBLINGS:
                own, within = SIBLINGS[tag]
                place, first = len(self.stack) - 1, -1
                while place > 0 and (t := self.tags[self.stack[place]]) not in within:
                    first = place if t in own else first
                    place -= 1
                if first > 0:
                    self.pop(first)
            if tag == "body" and self.open.get("head"):
                self.pop(self.above("head".__eq__))
        if tag in VOID:
            return
        at = dict(attrs)
        words = marks(at)
        role, style = (at.get("role") or "").lower(), (at.get("style") or "").replace(" ", "").lower()
        within = bool(self.open.get("article"))
        lead = tag in ("article", "main") or role in ("main", "article") or (at.get("itemprop") or "").lower() == "articlebody"
        noise = tag in APART or role in APART_ROLES or (tag == "form" and not self.forms) or (tag == "header" and not within) or "header" in words and not within and not lead
        noise = noise or (bool(words & NOISE) and tag not in ("html", "body", "article", "main"))
        hidden = "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        self.wrapped |= bool((lead or tag == "h1") and self.open.get("form"))
        if noise or hidden:
            self.flush()
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.noise.append(noise or hidden)
        self.firm.append(hidden or bool(words & REMARKS) or tag in APART or within)
        self.article.append(lead)
        self.content.append(bool(words & CONTENT))
        self.silent.append(tag in SILENT or self.silent[self.stack[-1]])
        if tag in BLOCKS:
            self.block_places.append(len(self.stack))
        if tag in BLOCKS or self.noise[-1]:
            self.owners.append(len(self.tags) - 1)
        self.stack.append(len(self.tags) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or not self.open.get(tag):
            if tag == "br":
                self.pieces.append(" ")
            return
        if tag in BLOCKS or tag in SILENT:
            self.pop(self.above(tag.__eq__))
        else:
            place = len(self.stack) - 1
            while place > self.block_places[-1] and self.tags[self.stack[place]] != tag:
                place -= 1
            if place > self.block_places[-1]:
                self.pop(place)

    def handle_data(self, data: str) -> None:
        if not self.silent[self.stack[-1]]:
            self.pieces.append(data)
            if self.open.get("a"):
                self.linked += sum(map(len, data.split()))

    def end(self) -> None:
        self.close()
        self.flush()


def parsed(html: str, forms: bool = False) -> Tree:
    tree = Tree(forms)
    tree.feed(html)
    tree.end()
    return parsed(html, True) if tree.wrapped and not forms else tree


def points(text: str, linked: int) -> float:
    """Points of a paragraph: its length and commas, less its share of links."""
    return (len(text) / CHARS_OF_A_POINT + len(COMMAS.findall(text))) * (1 - linked / len(text))


def dropped(tree: Tree) -> list[bool]:
    """Whether each element or one around it is noise; an element that holds the article isn't."""
    n = len(tree.tags)
    leads, heads = tree.article[:], [t == "h1" for t in tree.tags]
    for e in range(n - 1, 0, -1):
        leads[tree.parents[e]] |= leads[e]
        heads[tree.parents[e]] |= heads[e]
    out = [False] * n
    for e in range(1, n):
        spared = not tree.firm[e] and (leads[e] or tree.content[e] and heads[e])
        out[e] = out[tree.parents[e]] or tree.silent[e] or (tree.noise[e] and not spared)
    return out


class Scores:
    """Each element's score, characters, linked characters and links over the blocks that are left."""

    def __init__(self, tree: Tree) -> None:
        n, parents = len(tree.tags), tree.parents
        gone = dropped(tree)
        self.tree = tree
        self.blocks = [b for b in tree.blocks if not gone[b[0]]]
        holds = [False] * n  # blocks below
        for e in range(1, n):
            if tree.tags[e] in BLOCKS and not gone[e]:
                holds[parents[e]] = True
        for e in range(n - 1, 0, -1):
            if holds[e] and tree.tags[e] not in BLOCKS:
                holds[parents[e]] = True
        self.leaf = [not h for h in holds]
        self.own, passed = [0.0] * n, [0.0] * n
        self.chars, self.linked = [0] * n, [0] * n
        for owner, text, linked in self.blocks:
            p = points(text, linked)
            self.own[owner] += p
            passed[parents[owner] if self.leaf[owner] else owner] += p
            self.chars[owner] += len(text)
            self.linked[owner] += linked
        for e in range(n - 1, 0, -1):
            passed[parents[e]] += passed[e] / 2
            self.chars[parents[e]] += self.chars[e]
            self.linked[parents[e]] += self.linked[e]
        self.score = [s * (1 - self.density(e)) for e, s in enumerate(passed)]

    def density(self, e: int) -> float:
        return self.linked[e] / self.chars[e] if self.chars[e] else 0.0

    def worth(self, e: int) -> float:
        return self.own[e] if self.leaf[e] else self.score[e]


def kept(scores: Scores) -> list[int]:
    """The elements whose text is the article: the best container or the article around it, and siblings."""
    tree = scores.tree
    best = max(range(len(tree.tags)), key=lambda e: (scores.score[e], scores.chars[e] > 0, -e))
    if not scores.chars[best]:
        return []
    around, top = best, best
    while around:
        top = around if tree.tags[around] == "article" else top
        around = tree.parents[around]
    bar = SIBLING_SHARE * max(scores.score[best], scores.score[top])
    out = []
    for e in range(1, len(tree.tags)):
        if e == top or tree.parents[e] != tree.parents[top] or not top:
            continue
        text = next((t for o, t, _ in scores.blocks if o == e), "") if scores.leaf[e] else ""
        title = tree.tags[e] == "h1" and e < top
        sentence = tree.tags[e] == "p" and scores.density(e) < SIBLING_LINKS and (len(text) >= SIBLING_LENGTH or bool(SENTENCE_END.search(text)) and not scores.linked[e])
        if scores.chars[e] and (title or sentence or (bar > 0 and scores.worth(e) >= bar)):
            out.append(e)
    return [top, *out]


def main_text(html: str | None) -> str:
    """The blocks of the page's article in page order, an empty line between them."""
    if not html:
        return ""
    scores = Scores(parsed(html))
    tree = scores.tree
    chosen = set(kept(scores))
    n = len(tree.tags)
    inside, links = [False] * n, [0] * n
    for e in range(n - 1, 0, -1):
        links[e] += tree.tags[e] == "a"
        links[tree.parents[e]] += links[e]
    for e in range(n):
        menu = e not in chosen and tree.tags[e] in ("ul", "ol", "dl", "div", "section", "table") and links[e] > 1 and scores.density(e) >= MENU_LINKS
        inside[e] = e in chosen or (e > 0 and inside[tree.parents[e]] and not menu)
    return "\n\n".join(text for owner, text, _ in scores.blocks if inside[owner])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(rows, f"page_id {kind(id_col)}, url {kind(url_col)}, text string, n_chars long")
