"""Labelled pages to train on: layouts of common kinds with invented words.

The tables hold no labelled pages, so pages are laid out by rule, each block with its
label (1: main text). Their texts vary in length and punctuation; names of classes are
those that such parts usually carry, or say nothing.
"""

from __future__ import annotations

import random

# Names that parts of pages usually carry.
NAMES = {
    "header": "header masthead top site-header branding hero-bar logo",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc tabs links",
    "notice": "notice cookie cookies consent alert banner warning message gdpr popup newsletter subscribe",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adbox teaser",
    "sidebar": "sidebar side aside widget rail related recommended popular trending secondary complementary",
    "comments": "comment comments commentlist discussion responses replies reader-comments respond thread",
    "footer": "footer foot site-footer copyright legal bottom colophon credits",
    "form": "form search login signup contact feedback",
    "main": "content main article post entry story body text page article-body post-content entry-content",
    "plain": "row col wrap inner box block container section item x1 unit",
}
SYLLABLES = "ba re ti on al en ou is st er and the in lo ma pre vi ko du sha ent ing tra".split()


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.rare = random.Random(f"embedded {seed}")  # embedded elements: apart, the rest of a page stays as it is
        self.out: list[tuple[str, int | None]] = []  # markup, or a block's text and label

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def prose(self, words: int) -> str:
        out = []
        for k in range(words):
            w = self.word()
            out.append((w.capitalize() if not k or out[-1].endswith(".") else w) + (self.r.choice([".", ",", ".", ","]) if self.r.random() < 0.12 else ""))
        return " ".join(out) + "."

    def named(self, kind: str) -> str:
        if self.r.random() < 0.15:
            kind = "plain"
        name = self.r.choice(NAMES[kind].split())
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def tag(self, text: str) -> None:
        self.out.append((text, None))

    def block(self, tag: str, text: str, label: int, link: bool = False) -> None:
        self.tag(f"<{tag}>" + ("<a href='/x'>" if link else ""))
        self.out.append((text, label))
        self.tag(("</a>" if link else "") + f"</{tag}>")

    def embedded(self, often: float, tags: list[str], label: int) -> None:
        if self.rare.random() < often:
            kept, self.r = self.r, self.rare
            self.block(self.r.choice(tags), self.prose(self.r.choice([1, 2, 4, 10, 20])).rstrip("."), label)
            self.r = kept

    def links(self) -> None:
        self.tag("<ul>")
        for _ in range(self.r.randint(3, 8)):
            self.block("li", self.prose(self.r.randint(1, 3)).rstrip("."), 0, link=True)
        self.tag("</ul>")

    def part(self, kind: str, tags: list[str]) -> None:
        tag = self.r.choice(tags)
        bare = tag != "div" and self.r.random() < 0.7
        self.tag(f"<{tag}{'' if bare else self.named(kind)}>")
        if kind == "menu" or kind in ("header", "sidebar", "footer") and self.r.random() < 0.5:
            self.links()
        if kind == "header":
            self.block(self.r.choice(["h1", "h2", "p", "div"]), self.prose(self.r.randint(1, 5)).rstrip("."), 0, link=self.r.random() < 0.5)
        if kind in ("notice", "advert", "footer"):
            text = self.prose(self.r.randint(3, 25))
            if tag == "div" and self.r.random() < 0.5 or tag == "footer":
                self.out.append((("© 2020 " if kind == "footer" else "") + text, 0))
            else:
                self.block("p", text, 0, link=self.r.random() < 0.3)
        if kind in ("header", "menu", "advert", "sidebar"):
            self.embedded(0.1, ["svg", "noscript", "iframe"], 0)
        if kind == "sidebar":
            self.block(self.r.choice(["h2", "h3", "h4"]), self.prose(2), 0)
            self.block("p", self.prose(self.r.randint(4, 40)), 0, link=self.r.random() < 0.3)
        if kind == "comments":
            self.block(self.r.choice(["h2", "h3"]), self.prose(2), 0)
            for _ in range(self.r.randint(1, 5)):
                self.tag(f"<{self.r.choice(['div', 'li', 'article'])}{self.named('comments')}>")
                self.block("p", self.prose(self.r.randint(3, 60)), 0)
                self.tag("</div>")
        if kind == "form":
            for _ in range(self.r.randint(1, 4)):
                self.block(self.r.choice(["p", "div", "fieldset"]), self.prose(self.r.randint(1, 4)).rstrip("."), 0)
            self.embedded(0.3, ["textarea"], 0)
        self.tag(f"</{tag}>")

    def aside_of_body(self) -> None:
        kind = self.r.choice(["advert", "notice", "sidebar", "form", "menu"])
        self.part(kind, {"advert": ["div"], "notice": ["div"], "sidebar": ["aside", "div"], "form": ["form"], "menu": ["nav", "div"]}[kind])

    def body(self) -> None:
        tag = self.r.choice(["article", "article", "main", "div", "section"])
        self.tag(f"<{tag}{self.named('main') if tag in ('div', 'section') or self.r.random() < 0.3 else ''}>")
        wrapped = self.r.random() < 0.3
        if wrapped:
            self.tag(f"<div{self.named('main')}>")
        if self.r.random() < 0.85:
            self.block(self.r.choice(["h1", "h1", "h2"]), self.prose(self.r.randint(1, 14)).rstrip("."), 1)
        for _ in range(self.r.randint(1, 12)):
            shape = self.r.random()
            if shape < 0.7:
                self.block("p", self.prose(self.r.choice([1, 2, 4, 10, 20, 40, 80, 200])), 1)
            elif shape < 0.76:
                self.block(self.r.choice(["h2", "h3"]), self.prose(self.r.randint(1, 6)).rstrip("."), 1)
            elif shape < 0.84:
                self.tag("<ul>")
                for _ in range(self.r.randint(2, 5)):
                    self.block("li", self.prose(self.r.randint(1, 20)), 1)
                self.tag("</ul>")
            elif shape < 0.9:
                self.block(self.r.choice(["blockquote", "pre", "td", "div", "figcaption"]), self.prose(self.r.randint(2, 40)), 1)
            elif self.r.random() < 0.6:
                self.aside_of_body()
            self.embedded(0.05, ["object", "object", "svg", "noscript", "iframe"], 1)
        if wrapped:
            self.tag("</div>")
        if self.r.random() < 0.2:
            self.part("comments", ["section", "div"])
        self.tag(f"</{tag}>")

    def unheard(self) -> str:
        """A name that says nothing, or none."""
        return "" if self.r.random() < 0.5 else f' {self.r.choice(["class", "id"])}="{self.word()}"'

    def plain(self) -> list[tuple[str, int | None]]:
        """A page of little but its text, or one whose parts have names that nobody knows."""
        r = self.r
        self.tag(r.choice(["", "<html><head><title>x</title></head>"]) + "<body>")
        wrap = r.choice(["article", "article", "main", "div", "section", "section", ""])
        boxes = r.random() < 0.5
        if boxes and r.random() < 0.5:
            self.box()
        if wrap:
            self.tag(f"<{wrap}{self.unheard()}>")
        if r.random() < 0.3:
            self.block(r.choice(["h1", "h2"]), self.prose(r.randint(1, 8)).rstrip("."), 1)
        for _ in range(r.choice([1, 1, 1, 2, 2, 3, 5])):
            self.block("p", self.prose(r.choice([4, 10, 20, 40, 80, 200])), 1)
        if wrap:
            self.tag(f"</{wrap}>")
        if boxes:
            self.box()
        self.tag("</body>")
        return self.out

    def box(self) -> None:
        """Something beside the text, in an element that says nothing: short, or links."""
        self.tag(f"<div{self.unheard()}>")
        if self.r.random() < 0.6:
            self.links()
        else:
            self.block(self.r.choice(["h3", "h4", "p"]), self.prose(self.r.randint(1, 3)).rstrip("."), 0, link=self.r.random() < 0.5)
            self.block("p", self.prose(self.r.randint(2, 6)).rstrip("."), 0, link=True)
        self.tag("</div>")

    def page(self) -> list[tuple[str, int | None]]:
        r = self.r
        self.tag("<html><head><title>x</title></head><body>")
        if r.random() < 0.5:
            self.tag(f"<div{self.named('plain')}>")
        before = [("header", ["header", "div"]), ("menu", ["nav", "div", "ul"]), ("notice", ["div", "section"]), ("advert", ["div", "section"]), ("form", ["form"]), ("sidebar", ["aside", "div"])]
        for kind, tags in before:
            if r.random() < 0.5:
                self.part(kind, tags)
        self.body()
        after = [("advert", ["div"]), ("sidebar", ["aside", "div", "section"]), ("comments", ["section", "div", "ol"]), ("form", ["form"]), ("menu", ["nav", "div"]), ("notice", ["div"])]
        r.shuffle(after)
        for kind, tags in after:
            if r.random() < 0.45:
                self.part(kind, tags)
        if r.random() < 0.8:
            self.part("footer", ["footer", "div"])
        self.tag("</body></html>")
        return self.out


def labelled_pages(count: int, seed: int = 1, plain: int = 0) -> list[tuple[str, dict[str, int]]]:
    """Pages, and the label of each of their blocks by its text; so many plain ones follow."""
    pages = []
    for k in range(count + plain):
        maker = _Maker(seed * 100_003 + k)
        parts = maker.page() if k < count else maker.plain()
        pages.append(("".join(t for t, _ in parts), {" ".join(t.split()): label for t, label in parts if label is not None}))
    return pages
