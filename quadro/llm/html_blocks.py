"""Leaf blocks of a page's DOM: their texts, ancestors and a few counts.

Left out are scripts, styles, titles and templates, nothing else. Text of an embedded
element (JUDGED) is a block of its own with that ancestor; formulas stay in their
sentence. A title ends at the next block at the latest. An embedded element or template
without its end tag ends with the block that encloses it, and its blocks don't count it
as an ancestor. As browsers have it, a script or style without its end tag is the rest
of the page, and a head ends at the first text. A start tag that never ends is markup to the
end of the page, one whose quotes don't close ends at its next >, and so does a comment that
isn't closed. A page takes time in proportion to its size: of a deeper path the outer DEPTH
ancestors count.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

# HTML elements by how they lay out.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title".split())
JUDGED = frozenset("noscript template iframe object svg textarea".split())
#: An element of the left kind ends open ones of the right kinds, up to a container.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DEPTH = 256
CONTAINERS = frozenset("ul ol menu dl table select body html div section article main aside nav header footer form td th li template object".split())


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # ancestors from the outermost, each "tag" or "tag.name.name"
    linked: int  # characters inside links


class _Embedded(str):
    """The step of a path that an element of JUDGED is."""

    closed = False  # whether its end tag came


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.path: list[str] = []
        self.tags: list[str] = []
        self.open: Counter[str] = Counter()  # how many of each of tags
        self.texts: list[str] = []
        self.linked = self.links = 0
        self.silent = ""  # the open element of SILENT
        self.embedded: list[_Embedded] = []  # the open ones
        self.at: _Embedded | None = None  # the innermost one around the current texts
        self.place: tuple[str, ...] | None = None  # the path where the current texts began
        self.any = False  # whether there was an embedded element
        self.comments: int | None = None  # how far from the end the last end of a comment is

    def end_block(self) -> None:
        if self.texts:
            text = " ".join("".join(self.texts).split())
            if text:
                self.blocks.append(Block(text, self.place, self.linked))
            self.texts, self.linked = [], 0
        self.place = self.at = None

    def pop_to(self, at: int) -> None:
        self.end_block()
        self.leave(at)

    def leave(self, at: int) -> None:
        if self.embedded:
            gone = sum(isinstance(p, _Embedded) for p in self.path[at:])
            del self.embedded[len(self.embedded) - gone :]
        self.open.subtract(self.tags[at:])
        del self.path[at:], self.tags[at:]

    def enter(self, tag: str, step: str) -> None:
        self.tags.append(tag)
        self.path.append(step)
        self.open[tag] += 1

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a kind; there is one."""
        return next(at for at in range(len(self.tags) - 1, -1, -1) if self.tags[at] == tag)

    def end_head(self) -> None:
        """What a head leaves open ends with it."""
        self.silent = ""
        if not self.open["body"]:
            at = len(self.tags)
            while at and self.tags[at - 1] in JUDGED:
                at -= 1
            self.pop_to(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent = tag
            return
        if tag == "body":
            self.end_head()
        elif tag in BLOCKS or tag in JUDGED:
            self.silent = ""
        if self.silent:
            return
        if tag in JUDGED:
            self.embedded.append(_Embedded(tag))
            self.enter(tag, self.embedded[-1])
            self.any = True
        elif tag == "a":
            self.links = 1
        elif tag == "br":
            self.texts.append(" ")
        elif tag in BLOCKS:
            self.end_block()
            if self.open["p"] and tag != "option":
                at = self.last("p")
                if not CONTAINERS.intersection(self.tags[at + 1 :]):
                    self.pop_to(at)
            ends = IMPLIED.get(tag, ())
            for at in range(len(self.tags) - 1, -1, -1):
                if self.tags[at] in ends:
                    self.pop_to(at)
                    break
                if self.tags[at] in CONTAINERS:
                    break
            if tag not in VOID:
                names = [n for k, v in attrs if k in ("class", "id", "role") and v for n in re.findall("[a-z]+", v.lower())]
                self.enter(tag, ".".join([tag, *names]))

    def handle_endtag(self, tag: str) -> None:
        if tag == self.silent or tag in BLOCKS or tag in JUDGED:
            self.silent = ""
        if tag in SILENT or self.silent:
            pass
        elif tag == "head":
            self.end_head()
        elif tag in JUDGED:
            if self.open[tag]:
                at = self.last(tag)
                self.path[at].closed = True
                self.leave(at)
        elif tag == "a":
            self.links = 0
        elif tag in BLOCKS:
            self.links = 0
            if self.open[tag]:
                self.pop_to(self.last(tag))
            else:
                self.end_block()

    def parse_starttag(self, i: int) -> int:
        end = self.rawdata.find(">", i)
        if end < 0:
            return len(self.rawdata)
        k = super().parse_starttag(i)
        if k < 0:
            self.handle_starttag(re.compile(r"[^\s/>]+").match(self.rawdata, i + 1)[0].lower(), [])
        return k if k >= 0 else end + 1

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def parse_comment(self, i: int, report: bool = True) -> int:
        if self.comments is None:  # counted from the end, since what is read leaves rawdata
            self.comments = len(self.rawdata) - max(self.rawdata.rfind("-->"), self.rawdata.rfind("--!>"))
        k = super().parse_comment(i, report) if len(self.rawdata) - i >= self.comments else -1
        end = self.rawdata.find(">", i)
        return k if k >= 0 else end + 1 if end >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        """A marked section of an unknown kind is markup that nobody reads: it ends at its >."""
        if self.rawdata.find(">", i) < 0:
            return -1
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else -1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID or tag in BLOCKS:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            if not data.isspace():
                if self.any:
                    at = self.embedded[-1] if self.embedded else None
                    if at is not self.at:
                        self.end_block()
                        self.at = at
                if self.place is None:
                    self.place = tuple(self.path[:DEPTH])
            self.texts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks_of(html: str | None) -> list[Block]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.end_block()
    if reader.any:
        return _outside_templates(reader.blocks)
    return reader.blocks


def _outside_templates(blocks: list[Block]) -> list[Block]:
    """Blocks without those of templates; elements without an end tag leave the paths."""
    kept = []
    for b in blocks:
        inside = [p for p in b.path if isinstance(p, _Embedded)]
        if not any(p == "template" and p.closed for p in inside):
            if inside:
                b.path = tuple(str(p) for p in b.path if not isinstance(p, _Embedded) or p.closed)
            kept.append(b)
    return kept
