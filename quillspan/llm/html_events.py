"""A small HTML walker shared by text extraction and interleaved sequences: blocks of text and media references in order."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

# Element names and words in class, id or role attributes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "iframe", "noscript"}  # only their own end tag ends them
OPAQUE = {"template", "object", "svg", "math", "canvas"}  # their own end tag ends them, or that of an element around them
CONTROLS = {"select", "datalist", "optgroup", "option", "button"}  # a block's tag ends them too; option's end tag may be left out
APART = {"nav", "footer", "aside", "form", "menu", "dialog"}
CONTAINERS = {"article", "main", "section", "div", "header", "ul", "ol", "dl", "table", "figure", "blockquote", "details", "body", "html"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "pre", "figcaption", "caption", "address", "hr", "summary", "center", "legend", "fieldset"}
HINTS = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "menu", "navbar", "nav",
    "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "commentlist", "disqus", "respond", "replies", "cookie", "cookies", "consent",
    "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
    "recommended", "widget", "toolbar", "pagination", "pager", "copyright", "disclaimer", "skip", "search", "contentinfo", "complementary", "banner",
}
STRUCTURE = APART | CONTAINERS | BLOCKS
MAIN_HINTS = {"main", "articlebody"}


def words_of(value: str) -> set[str]:
    """Lower-case words of an attribute such as 'siteHeader top-nav'."""
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", value)}


class Walker(HTMLParser):
    """Calls on_block(text, tag, link_chars, apart, region) at each block's end and on_media(tag, attrs) at each reference.

    A region is an article or main element, numbered from 1 in the order of their starts; 0 is outside of all. `above`
    names each region's enclosing one.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # element, set apart, region
        self.above = [0]
        self.parts: list[str] = []
        self.link = 0
        self.in_link = False
        self.silent: list[tuple[str, Counter]] = []  # element, elements open inside it
        self.tag, self.block_apart = "", False

    def on_block(self, text: str, tag: str, link: int, apart: bool, region: int) -> None: ...

    def on_media(self, tag: str, attrs: dict[str, str]) -> None: ...

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                apart = self.block_apart or any(x[1] for x in self.stack)
                self.on_block(text, self.tag, min(self.link, len(text)), apart, self.region())
        self.parts, self.link = [], 0

    def region(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def _hushed_start(self, tag: str) -> bool:
        """Whether a start tag stands inside a silent element; ends those that it ends."""
        if tag in STRUCTURE:
            while self.silent and self.silent[-1][0] in CONTROLS:
                self.silent.pop()
        elif tag in ("option", "optgroup"):
            while self.silent and self.silent[-1][0] in ("option", tag):
                self.silent.pop()
        elif tag in ("select", "button") and self.silent and self.silent[-1][0] == tag:
            self.silent.pop()
        if not self.silent:
            return False
        around, inner = self.silent[-1]
        if around not in RAW and tag not in VOID:
            if tag in RAW or tag in OPAQUE or tag in CONTROLS:
                self.silent.append((tag, Counter()))
            else:
                inner[tag] += 1
        return True

    def _hushed_end(self, tag: str) -> bool:
        """Whether an end tag is used up inside or by a silent element."""
        while self.silent:
            around, inner = self.silent[-1]
            if around in RAW:
                if tag == around:
                    self.silent.pop()
                return True
            if inner[tag] > 0:
                inner[tag] -= 1
                return True
            if any(x[0] == tag for x in self.silent):
                while self.silent.pop()[0] != tag:
                    pass
                return True
            closes = any(x[0] == tag for x in self.stack) or (around in CONTROLS and tag in STRUCTURE)
            if not closes:
                return True
            self.silent.pop()
        return False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent and self._hushed_start(tag):
            return
        if tag in RAW or tag in OPAQUE or tag in CONTROLS:
            self.silent.append((tag, Counter()))
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        elif tag == "a":
            self.in_link = True
        elif tag in STRUCTURE:
            self.flush()
            named = dict(attrs)
            hints = words_of(" ".join(named.get(k) or "" for k in ("class", "id", "role")))
            hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (named.get("style") or "").replace(" ", "").lower()
            inside = self.region()
            opens = tag in ("article", "main") or named.get("role") == "main" or (named.get("itemprop") or "").lower() in MAIN_HINTS
            apart = tag in APART or hidden or (bool(hints & HINTS) and tag not in ("html", "body", "main")) or (tag == "header" and not inside)
            self.tag = tag
            if tag in BLOCKS:
                self.block_apart = apart
            else:
                self.block_apart = False
                if opens and not apart:
                    self.above.append(inside)
                    inside = len(self.above) - 1
                self.stack.append((tag, apart, inside))
        elif tag in ("img", "video", "audio", "source", "embed"):
            self.on_media(tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag: str) -> None:
        if self.silent and self._hushed_end(tag):
            return
        if tag == "a":
            self.in_link = False
        elif tag in BLOCKS:
            self.flush()
            self.block_apart = False
        elif any(x[0] == tag for x in self.stack):
            self.flush()
            self.block_apart = self.in_link = False
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.in_link:
                self.link += len(" ".join(data.split()))

    def walk(self, html: str):
        self.feed(html)
        self.close()
        self.flush()
        return self
