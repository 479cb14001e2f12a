"""From HTML to a page's tokens: elements by their path, and blocks of text.

A small tag-soup reader: comments and declarations go, raw text elements end at
their own end tag only, paragraphs, list items and cells are closed where HTML
closes them, a stray end tag closes nothing. An element's *role* is a hash of
its path: the names, classes and ids of the elements around it.
A text's role is a hash of its element's role and the text. Inline elements
neither break a block nor count in a path. White space and breaks inside a block
are one space; character references are decoded before.

Noise is what tag names, ARIA roles, or words of class and id call menus,
headers, footers, sidebars, notices, adverts, forms or comments.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import xxhash

# Every part takes each character once, and a tag left open ends with the page: no input is read twice.
_MARK = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>"']++)))?""")
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
ROOT = 0
OPEN, CLOSE, TEXT = 0, 1, 2

# The elements of HTML by how they behave.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr picture q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = set("title meta link style script base noscript template".split())
#: Opening one closes the nearest of the first, unless one of the second lies between.
CLOSES = {
    "li": ({"li"}, set("ul ol menu dl table td th article section aside nav main form blockquote figure".split())),
    "dt": ({"dt", "dd"}, set("dl ul ol table td th article section".split())),
    "dd": ({"dt", "dd"}, set("dl ul ol table td th article section".split())),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
CELLS = {"table", "td", "th", "caption"}
NOISE_TAGS = set("head nav footer aside form script style noscript template iframe object applet svg math canvas audio video map select datalist button textarea input dialog menu search title xmp noembed noframes".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
#: Words of class and id: whole, by their beginning, outside an article only, and those that say the next one is about something else.
NOISE_WORDS = set("ad ads adv nav menu menus footer share sharing social login signup search widget widgets toolbar notice notices banner banners replies respond masthead topbar alert alerts gdpr skip".split())
NOISE_BEGINNINGS = ("comment", "advert", "adsense", "sponsor", "promo", "cookie", "consent", "newsletter", "subscri", "sidebar", "breadcrumb", "navbar", "navigation", "disqus", "popup", "modal", "related", "recommend", "paginat")
NOISE_OUTSIDE = {"header"}
NOT_MEANT = set("has with no without is".split())
#: What makes an article element no article: comments, adverts and teasers are marked up as articles too.
NO_ARTICLE = ("comment", "advert", "sponsor", "promo", "related", "recommend")


def hashed(parent: int, text: str) -> int:
    """A signed 64-bit hash of a text below a role."""
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass"), parent & 0xFFFFFFFFFFFFFFFF), "big", signed=True)


@lru_cache(maxsize=8192)
def _element(name: str, attributes: str) -> tuple[str, bool, bool, int, bool]:
    """Signature, noise, noise outside an article, level (2 article, 1 main part, 0 neither), link."""
    given: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        given.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    marks = [" ".join(sorted(given.get("class", "").split())), given.get("id", "")]
    signature = f"{name}.{re.sub('[0-9]{2,}', '0', marks[0])}#{re.sub('[0-9]+', '0', marks[1])}"
    role = given.get("role", "").lower()
    level = 2 if name == "article" or given.get("itemprop", "").lower() == "articlebody" else 1 if name == "main" or role == "main" else 0
    words = []
    for mark in (*given.get("class", "").split(), marks[1]):
        parts = [w.lower() for w in _WORD.findall(mark)]
        words += [w for before, w in zip(["", *parts], parts) if before not in NOT_MEANT]
    if name in ("html", "body"):
        return signature, False, False, level, False
    if level:
        noise = any(w.startswith(NO_ARTICLE) or w in ("ad", "ads") for w in words)
        return signature, noise, False, 0 if noise else level, False
    noise = name in NOISE_TAGS or role in NOISE_ROLES or any(w in NOISE_WORDS or w.startswith(NOISE_BEGINNINGS) for w in words)
    outside = name == "header" or any(w in NOISE_OUTSIDE for w in words)
    return signature, noise, outside, 0, name == "a" and "href" in given


class Page:
    """Tokens of a page as parallel lists: kind, role, role of the element (of a text), text, characters inside links, level."""

    def __init__(self, html: str, mains: frozenset[int] = frozenset()):
        self.kinds: list[int] = []
        self.roles: list[int] = []
        self.ups: list[int] = []
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.levels: list[int] = []
        self.mains = mains
        self.names, self.paths, self.noisy, self.at_level = [""], [ROOT], [False], [0]
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.in_links: list[str] = []
        self._read(html)
        self._flush()
        self._pop(1)

    def _read(self, html: str) -> None:
        at, link = 0, False
        while at < len(html):
            m = _MARK.search(html, at)
            self._text(html[at : m.start() if m else len(html)], link)
            if not m:
                return
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                if name == "a":
                    link = False
                self._end(name)
                continue
            signature, noise, outside, level, is_link = _element(name, m[3])
            if name == "a":
                link = is_link
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else len(html)
                if name not in ("script", "style"):
                    self._flush()
                if end:
                    closing = html.find(">", at)
                    at = closing + 1 if closing >= 0 else len(html)
                continue
            if name in VOID:
                if name == "br":
                    self.parts.append(" ")
                elif name == "hr":
                    self._flush()
                    self._close_p()
                continue
            self._start(name, signature, noise, outside, level)

    def _text(self, text: str, link: bool) -> None:
        if text and not self.noisy[-1]:
            self.parts.append(text)
            if link:
                self.in_links.append(text)
        elif text and self.names[-1] == "head" and not text.isspace():
            self._pop(len(self.names) - 1)
            self._text(text, link)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text:
                linked = len(" ".join(unescape("".join(self.in_links)).split()))
                self._token(TEXT, hashed(self.paths[-1], "t" + text), self.paths[-1], text, linked)
            self.parts, self.in_links = [], []

    def _token(self, kind: int, role: int, up: int, text: str = "", linked: int = 0) -> None:
        self.kinds.append(kind)
        self.roles.append(role)
        self.ups.append(up)
        self.texts.append(text)
        self.linked.append(linked)
        self.levels.append(self.at_level[-1])

    def _start(self, name: str, signature: str, noise: bool, outside: bool, level: int) -> None:
        if name in INLINE:
            if noise and not self.noisy[-1]:
                self._push(name, self.paths[-1], True, self.at_level[-1])
            elif noise or self.noisy[-1] and self.names[-1] in INLINE:
                self._push(name, self.paths[-1], True, self.at_level[-1])  # so that end tags pair
            return
        self._flush()
        if self.names[-1] == "head" and name not in IN_HEAD:
            self._pop(len(self.names) - 1)
        if name in ("html", "body") and self.open[name]:
            return
        if name in ENDS_P:
            self._close_p()
        if name in HEADINGS and self.names[-1] in HEADINGS:
            self._pop(len(self.names) - 1)
        if name in CLOSES:
            self._close_nearest(*CLOSES[name])
        level = max(level, self.at_level[-1])
        path = hashed(self.paths[-1], signature)
        if path in self.mains:
            level = max(level, 2)
        self._push(name, path, self.noisy[-1] or noise or outside and not level, level)

    def _push(self, name: str, path: int, noise: bool, level: int) -> None:
        self.names.append(name)
        self.paths.append(path)
        self.noisy.append(noise)
        self.at_level.append(level)
        self.open[name] += 1
        if not noise:
            self._token(OPEN, path, path)

    def _pop(self, to: int) -> None:
        """Close all elements from ``to`` on."""
        while len(self.names) > to:
            if not self.noisy[-1]:
                self._token(CLOSE, ~self.paths[-1], self.paths[-1])
            self.open[self.names.pop()] -= 1
            self.paths.pop()
            self.noisy.pop()
            self.at_level.pop()

    def _close_p(self) -> None:
        if self.open["p"]:
            self._close_nearest({"p"}, CELLS)

    def _close_nearest(self, targets: set[str], barriers: set[str]) -> None:
        if not any(self.open[t] for t in targets):
            return
        for i in range(len(self.names) - 1, 0, -1):
            if self.names[i] in targets:
                self._pop(i)
                return
            if self.names[i] in barriers:
                return

    def _end(self, name: str) -> None:
        if name in INLINE:
            if self.names[-1] == name:
                self._pop(len(self.names) - 1)
            return
        if name in ("p", "br"):
            self._flush()
        if not self.open[name] or name in ("html", "body"):
            return
        self._flush()
        for i in range(len(self.names) - 1, 0, -1):
            if self.names[i] == name:
                self._pop(i)
                return
            if self.names[i] in CELLS and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                return


def main_blocks(html: str, noise: frozenset[int] = frozenset(), mains: frozenset[int] = frozenset()) -> list[str]:
    """Blocks of the article, in page order: of articles where a page has one, of its main part where it has
    one, else of all that is left; but for texts of the template (``noise``). ``mains``: roles taken as articles."""
    page = Page(html, mains)
    texts = [i for i, kind in enumerate(page.kinds) if kind == TEXT]
    level = max((page.levels[i] for i in texts), default=0)
    return [page.texts[i] for i in texts if page.levels[i] == level and page.roles[i] not in noise]
