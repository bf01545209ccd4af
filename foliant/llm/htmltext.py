"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

A line is the text between two block tags. Its ratio is the text outside of links over the tags in it. Ratios are smoothed over
neighbouring lines; lines above the standard deviation of the smoothed ratios are content. The region of the page is what holds them: the ``article`` or ``main``
elements they lie in, else the smallest element around all of them. All of a region is the text, short lines too, but for elements that are
furniture by tag, role, visibility or name, and for parts without any content line that consist of links.

A name, a role or a tag may also be that of a wrapper around the page, or of an element that is never closed. So an element that is furniture by its name, or a form, stays if it holds an article or
main, or most of the text of the content lines; where the name says nothing else, or says remarks or advertisements, nine tenths of that text; and one that is furniture by its tag or role if
it holds nine tenths of that text in several blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul""".split())
ENDS_PARAGRAPH = BLOCKS - {"br", "option", "legend", "caption", "td", "th", "tr"}
DROPPED = frozenset("head script style noscript template svg math canvas iframe object embed audio video select textarea input datalist".split())
AROUND = frozenset("nav aside footer button dialog menu fieldset label".split())
WHOLE = frozenset(("html", "body", "article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies
 dialog discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager
 paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription
 tags toc toolbar topbar widget widgets""".split())
OWN = frozenset("article entry post story content page body main title".split())
REMARKS = frozenset("comment comments reply replies ad ads advert promo sponsored related".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: What an element is: part of the page, no text, furniture if the lines agree, the same by nothing but its name, remarks or advertisements, furniture by its tag or role.
PART, NO_TEXT, NAMED, ONLY_NAMED, REMARK, TAGGED = range(6)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Lines(HTMLParser):
    """Collects lines from a stream of tags and texts; elements are numbered, each with the number of the element around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.above, self.tag = [-1], [""]
        self.stack = [0]
        self.dropped = 0  # depth of the outermost dropped element, 0 if none
        self.content = 0  # open article or main elements
        self.named: dict[int, tuple[int, int]] = {}  # elements that are furniture if the lines agree: what they are, the next such element around them or 0
        self.open_named: list[tuple[int, int]] = []  # depth, element
        self.holding: set[int] = set()  # those with an article or main in them
        self.lines: list[tuple[list[tuple[str, int, bool]], int, int]] = []  # texts with named element and whether in a link; element, tags
        self.parts: list[tuple[str, int, bool]] = []
        self.tags = self.links = 0

    def flush(self) -> None:
        if self.parts:
            self.lines.append((self.parts, self.stack[-1], self.tags))
        self.parts, self.tags = [], 0

    def without(self, gone: set[int]) -> list[tuple[str, int, int, int]]:
        """Lines without the text of some named elements: text, element, tags, characters in links."""
        out = []
        for parts, element, tags in self.lines:
            text = " ".join("".join(data for data, named, _ in parts if named not in gone).split())
            if text:
                out.append((text, element, tags, sum(len(data) for data, named, linked in parts if linked and named not in gone)))
        return out

    def furniture(self, tag: str, attrs: list) -> int:
        if tag in DROPPED:
            return NO_TEXT
        tagged = tag in AROUND or tag == "header" and not self.content
        if tag in WHOLE and tag != "article":
            return PART
        is_form, named = tag == "form", []
        for name, value in attrs:
            if name == "role" and (value or "").lower() == "form":
                is_form = tag not in WHOLE
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return PART if tag in WHOLE else NO_TEXT
            elif name == "role" and (value or "").lower() in ROLES:
                tagged = tag not in WHOLE
            if name == "style" and value and UNSEEN.search(value):
                return PART if tag in WHOLE else NO_TEXT
            if name in ("class", "id") and value:
                named += value.split()
        if tagged:
            return TAGGED
        found = NAMED if is_form else PART
        for name in named:
            words = {w.lower() for w in WORDS.findall(name) if not w.isdigit()}
            hit = words & NAMES
            if hit and not (hit == {"header"} and words & OWN):  # the head of the article itself
                found = max(found, REMARK if hit & REMARKS else PART if tag == "article" else ONLY_NAMED if words == hit else NAMED)
                if tag == "article":
                    return found
        return found

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.tag[self.stack.pop()]
            self.content -= tag in ("article", "main")
            self.links -= tag == "a"
        while self.open_named and len(self.stack) <= self.open_named[-1][0]:
            self.open_named.pop()
        if self.dropped and len(self.stack) <= self.dropped:
            self.dropped = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in ENDS_PARAGRAPH or tag == "li":
            for depth in range(len(self.stack) - 1, 0, -1):
                open_tag = self.tag[self.stack[depth]]
                if open_tag == "p" and tag in ENDS_PARAGRAPH or open_tag == "li" and tag == "li":
                    self.pop_to(depth)
                    break
                if open_tag in BLOCKS:
                    break
        if tag in VOID:
            return
        self.above.append(self.stack[-1])
        self.tag.append(tag)
        if not self.dropped:
            what = self.furniture(tag, attrs)
            around = [e for _, e in self.open_named]
            if tag == "main" or tag == "article" and what == PART and all(self.named[e][0] not in (REMARK, TAGGED) for e in around):
                self.holding.update(around)
            if what == NO_TEXT:
                self.dropped = len(self.stack)
            elif what:
                self.named[len(self.tag) - 1] = what, self.open_named[-1][1] if self.open_named else 0
                self.open_named.append((len(self.stack), len(self.tag) - 1))
        self.stack.append(len(self.tag) - 1)
        self.content += tag in ("article", "main")
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[depth]] == tag:
                self.pop_to(depth)
                break

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """In HTML ``<![`` starts a comment that ends at the next ``>``, whatever follows it."""
        return self.parse_bogus_comment(i, report)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append((data, self.open_named[-1][1] if self.open_named else 0, self.links > 0))


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; at the borders the kernel is cut and weighs anew."""
    reach = np.arange(-3, 4)
    kernel = np.exp(-reach ** 2 / (2 * sigma ** 2))
    return np.convolve(values, kernel)[3:-3] / np.convolve(np.ones(len(values)), kernel)[3:-3]


def content_lines(lines: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Which lines are content: those with a smoothed ratio above its standard deviation."""
    ratio = smoothed(np.array([max(0, len(text) - linked) / max(1, tags) for text, _, tags, linked in lines]))
    return ratio >= min(float(ratio.std()), float(ratio.max()))


def furniture_of(parser: Lines) -> set[int]:
    """The named elements that hold neither an article nor most of the content."""
    lines = parser.without(set())
    if not parser.named or not lines:
        return set()
    held, blocks, whole = dict.fromkeys(parser.named, 0), dict.fromkeys(parser.named, 0), 0
    kept = (parts for parts, _, _ in parser.lines if any(data.strip() for data, _, _ in parts))
    for parts, content in zip(kept, content_lines(lines)):
        inside = set()
        for data, named, linked in parts if content else ():
            size = 0 if linked else len(" ".join(data.split()))
            whole += size
            while named:
                held[named] += size
                inside |= {named} if size else set()
                named = parser.named[named][1]
        for named in inside:
            blocks[named] += 1
    gone: set[int] = set()
    for element, (what, around) in parser.named.items():  # from the outside to the inside
        most = 2 * held[element] > whole if what == NAMED else 10 * held[element] > 9 * whole
        if what == TAGGED:  # a menu or button that was never closed, a fieldset or dialog around the page: all of the content, and more than one block of it
            most = most and blocks[element] > 1
        if around in gone or not most and (element not in parser.holding or what == TAGGED):
            gone.add(element)
    return gone


def main_text(html: str) -> str:
    """The main text of one whole page; empty if there is none. Broken markup is read as far as it makes sense."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, above, tag = parser.without(furniture_of(parser)), parser.above, parser.tag
    if not lines:
        return ""
    content = content_lines(lines)

    def path(element: int) -> list[int]:
        out = [element]
        while out[-1]:
            out.append(above[out[-1]])
        return out[::-1]

    paths = [path(line[1]) for line in lines]
    marked = {next(e for e in p if tag[e] in ("article", "main")) for p, c in zip(paths, content) if c and any(tag[e] in ("article", "main") for e in p)}
    inner = {e for p in paths for e in p if tag[e] == "article" and any(tag[x] == "main" for x in p)}
    if marked:
        # main with articles in it: the articles, if they hold content
        holding = {e for e in inner if any(c and e in p for p, c in zip(paths, content))}
        region = [bool(marked & set(p)) and (not holding or bool(holding & set(p)) or tag[p[-1]] in ("h1", "h2")) for p in paths]
        return " ".join(line[0] for line, kept in zip(lines, region) if kept)
    chosen = [p for p, c in zip(paths, content) if c]
    depth = 0
    while all(len(p) > depth + 1 and p[depth + 1] == chosen[0][depth + 1] for p in chosen):
        depth += 1
    while depth and tag[chosen[0][depth]] not in ("div", "section", "body", "html", "td", "table", "center", "blockquote", ""):
        depth -= 1
    root = chosen[0][depth]
    parts: dict[int, list[int]] = {}
    for i, p in enumerate(paths):
        if len(p) > depth and p[depth] == root:
            parts.setdefault(p[depth + 1] if len(p) > depth + 1 else -1 - i, []).append(i)
    out = []
    for own in parts.values():
        links = sum(lines[i][3] for i in own)
        if any(content[i] for i in own) or 2 * links <= sum(len(lines[i][0]) for i in own):
            out += own
    return " ".join(lines[i][0] for i in sorted(out))


def extracted(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All rows and columns but the markup, with the main ``text`` and its length in code points; columns of these names are replaced.

    A null page is an empty one, and gives an empty text. Character references are decoded, white space within a block is one space, blocks are joined by
    one space. Repeated rows give equal texts; an empty table gives no row.
    """
    kept = [c for c in pages.columns if c not in (html, text, n_chars)]
    fields = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in pieces(batches, "__content"):
            texts = [main_text(x.decode("utf-8", "replace")) for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*kept, text, n_chars])

    return pages.select(*[F.col(f"`{c}`") for c in kept], as_bytes(html).alias("__content")).mapInArrow(run, f"{fields}`{text}` string, `{n_chars}` long")
