"""Reading of one HTML page: its elements, the part that may hold the article, and the blocks of text in it.

A small tolerant reader for text extraction: unclosed, misnested and cut off markup is read as browsers do as far as it moves text, and
time is linear in the page, however deep it nests.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import xxhash

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"']+)")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p li dd dt blockquote pre figcaption caption tr summary address".split())
BLOCKS = PROSE | frozenset(
    "html body main article section div header footer nav aside form fieldset dl ol ul menu table thead tbody tfoot figure details dialog center hr hgroup dir".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in "script style xmp iframe noembed noframes textarea title".split()}
_TELLING = re.compile("class|id|role|hidden|style|itemprop", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
#: Elements that never hold article text, and roles of those that don't unless the article is inside.
NEVER = frozenset("head title script style template noscript svg canvas audio video object iframe xmp noembed noframes map button select textarea datalist option label legend dialog nav footer menu aside".split())
#: Inside prose, class names of these say nothing about the words that they hold.
INLINE = frozenset("a abbr b cite code del em font i ins kbd mark q s samp small span strong sub sup time tt u var".split())
#: A list or box of at least so many links and no other words is a menu, outside article elements.
MENU_LINKS = 3
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
#: Words in class and id names of boilerplate; those that also condemn an article or main element; prefixes that undo a word.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promos promotion promoted banner banners cookie cookies consent gdpr notice notices "
    "disclaimer newsletter subscribe subscription signup paywall nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination header masthead topbar footer colophon "
    "sidebar sidebars aside comment comments commentlist commentform disqus respond replies reply share sharing social related recommended recommendations popup modal "
    "copyright hidden".split()
)
FOREIGN = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promoted comment comments reply replies related recommended teaser".split())
_UNDONE = frozenset("no not has with without hide hides show shows".split())
_PLAIN = {"form": 2, "header": 3}
#: What an end tag or an implied end never reaches across, and which open element a start tag ends.
_SCOPE = ("table", "td", "th", "caption", "button", "object", "template")
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", *_SCOPE)), "dd": (("dd", "dt"), ("dl", *_SCOPE)), "dt": (("dd", "dt"), ("dl", *_SCOPE)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot"), ("table",))),
}


def _names(value: str) -> set[str]:
    """Words of class and id names, without those that a word before them undoes (``no-sidebar``)."""
    out = set()
    for name in value.split():
        parts = [p.lower() for p in _NAME_PARTS.findall(name)]
        out.update(p for before, p in zip(["", *parts], parts, strict=False) if before not in _UNDONE)
    return out


class Page:
    """The elements of a page in document order: tag, parent, and children (an element's number or a text)."""

    def __init__(self, html: str):
        self.tags, self.parents, self.children, self.marks = ["html"], [-1], [[]], [""]
        # Open elements, and their places by tag, of blocks, and of scopes.
        self._stack, self._at, self._blocks, self._scopes = [0], defaultdict(list), [0], [0]
        self._read(html)

    def _push(self, tag: str, attributes: str) -> None:
        n, parent = len(self.tags), self._stack[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        self.children.append([])
        self.marks.append(attributes)
        self.children[parent].append(n)
        if tag not in _VOID:
            place = len(self._stack)
            self._at[tag].append(place)
            if tag in BLOCKS:
                self._blocks.append(place)
            if tag in _SCOPE:
                self._scopes.append(place)
            self._stack.append(n)

    def _cut(self, size: int) -> None:
        while len(self._stack) > size:
            self._at[self.tags[self._stack.pop()]].pop()
        for places in (self._blocks, self._scopes):
            while places[-1] >= size:
                places.pop()

    def _end(self, tags, bounds) -> None:
        """End the innermost open element of ``tags``, unless one of ``bounds`` is open inside it."""
        at = max((self._at[t][-1] for t in tags if self._at[t]), default=0)
        if at and all(not self._at[b] or self._at[b][-1] <= at for b in bounds):
            self._cut(at)

    def _end_one(self, tag: str, bound: list[int]) -> None:
        """End the innermost open ``tag``, unless a place in ``bound`` lies inside it."""
        places = self._at[tag]
        if places and bound[-1] <= places[-1]:
            self._cut(places[-1])

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            lt = html.find("<", at)
            if lt < 0 or lt + 1 == end:
                self.children[self._stack[-1]].append(unescape(html[at : lt if lt >= 0 else end]))
                return
            following = html[lt + 1]
            markup = following in "!?/" or following.isascii() and following.isalpha()
            if lt > at or not markup:
                self.children[self._stack[-1]].append(unescape(html[at : lt + (not markup)]))
            if not markup:
                at = lt + 1
                continue
            if html.startswith("<!--", lt):
                # The shortest comments close themselves.
                close = html.find("-->", lt + 2)
                at = close + 3 if close >= 0 else end
                continue
            if following in "!?" or following == "/" and not html[lt + 2 : lt + 3].isalpha():
                close = html.find(">", lt)
                at = close + 1 if close >= 0 else end
                continue
            tag = _TAG.match(html, lt)
            if tag is None:
                return
            at, name = tag.end(), tag[1].lower()
            if following == "/":
                self._end_one(name, self._scopes if name in BLOCKS else self._blocks)
                continue
            if name in BLOCKS:
                if name in HEADINGS and self.tags[self._stack[-1]] in HEADINGS:
                    self._cut(len(self._stack) - 1)
                self._end_one("p", self._scopes)
            if name in _ENDS:
                self._end(*_ENDS[name])
            self._push(name, tag[2])
            if name in _RAW:
                close = _RAW[name].search(html, at)
                self._cut(len(self._stack) - 1)
                if close is None:
                    return
                at = close.start()

    def _judge(self) -> tuple[list[int], list[bool]]:
        """(for each element: 0 stays, 1 goes, 2 goes unless the article is inside, 3 so, but inside an article its headings stay; whether it starts an article region)."""
        verdict, region = [0] * len(self.tags), [False] * len(self.tags)
        for n, (tag, mark) in enumerate(zip(self.tags, self.marks, strict=True)):
            if not mark or not _TELLING.search(mark):
                verdict[n] = 1 if tag in NEVER else _PLAIN.get(tag, 0)
                region[n] = tag in ("article", "main")
                continue
            given = {}
            for a in _ATTRIBUTE.finditer(mark):
                given.setdefault((a[1] or a[5]).lower(), unescape(a[2] or a[3] or a[4] or ""))
            role, names = given.get("role", "").lower(), _names(f"{given.get('class', '')} {given.get('id', '')}")
            foreign = bool(names & FOREIGN)
            if tag in NEVER or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(given.get("style", "")):
                verdict[n] = 1
            elif tag in ("article", "main") or role in ("main", "article") or given.get("itemprop", "").lower() == "articlebody":
                verdict[n], region[n] = int(foreign), not foreign
            elif tag in ("html", "body") or tag in INLINE and self.tags[self.parents[n]] in PROSE:
                continue
            elif tag == "form" or role in ROLES or names & BOILERPLATE - {"header"}:
                verdict[n] = 2
            elif tag == "header" or "header" in names and tag not in HEADINGS:
                verdict[n] = 3
        return verdict, region

    def _menus(self) -> list[bool]:
        """Whether an element is a list or box whose words are all links."""
        links, words, linked = ([0] * len(self.tags) for _ in range(3))
        for n in range(len(self.tags) - 1, 0, -1):
            words[n] += sum(len(kid.strip()) for kid in self.children[n] if kid.__class__ is str)
            if self.tags[n] == "a":
                links[n], linked[n] = 1, words[n]
            for total in (links, words, linked):
                total[self.parents[n]] += total[n]
        return [t in ("ul", "ol", "div", "p", "section") and k >= MENU_LINKS and 0 < w == v for t, k, w, v in zip(self.tags, links, words, linked, strict=True)]

    def blocks(self) -> tuple[list[str], list[tuple[int, int, int, bool]], str]:
        """(texts of the blocks; (hash, first block, end block, strict) of the element subtrees; text of all blocks).

        ``strict`` subtrees are those that are likely to be the article's own: prose, parts of an article element, and what holds over half of the text.
        """
        verdict, region = self._judge()
        size, tags, parents = len(self.tags), self.tags, self.parents
        around = list(region)
        for n in range(size - 1, 0, -1):
            if around[n]:
                around[parents[n]] = True
        menu = self._menus()
        gone, inside, article, heading = [False] * size, [False] * size, [False] * size, [False] * size
        header = [False] * size
        for n in range(size):
            p = parents[n]
            if p >= 0:
                gone[n], inside[n], article[n], header[n], heading[n] = gone[p], inside[p], article[p], header[p], heading[p]
            if verdict[n] == 1:
                gone[n] = True
            elif verdict[n] == 3 and inside[n] and not around[n]:
                header[n] = True
            elif verdict[n] and not around[n] or menu[n] and not article[n]:
                gone[n] = True
            if region[n] and not gone[n]:
                inside[n] = True
                article[n] = article[n] or tags[n] != "main"
            heading[n] = heading[n] or tags[n] in HEADINGS
        mains = {n for n in range(size) if region[n] and not gone[n] and tags[n] == "main"}
        under = [False] * size
        for n in range(size):
            under[n] = n in mains or parents[n] >= 0 and under[parents[n]]
        wanted = under if mains else inside if any(i and not g for i, g in zip(inside, gone, strict=True)) else [True] * size

        texts: list[str] = []
        held: list[str] = []
        spans: list[tuple[int, int, int, int]] = []

        def flush() -> None:
            if not held:
                return
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                texts.append(text)

        hashes: list[list[bytes]] = [[] for _ in range(size)]
        firsts = [0] * size
        todo: list[tuple[int, int]] = [(0, 0)]
        while todo:
            n, k = todo.pop()
            if k == 0:
                if tags[n] in BLOCKS:
                    flush()
                firsts[n] = len(texts)
            kids = self.children[n]
            while k < len(kids):
                kid = kids[k]
                k += 1
                if isinstance(kid, str):
                    if wanted[n] and (not header[n] or heading[n]):
                        held.append(kid)
                        if text := kid.strip():
                            hashes[n].append(text.encode("utf-8", "surrogatepass"))
                elif tags[kid] in ("br", "td", "th", "hr") or tags[kid] in BLOCKS or not gone[kid]:
                    if tags[kid] in ("br", "td", "th"):
                        held.append(" ")
                    if tags[kid] in BLOCKS and gone[kid]:
                        flush()
                    if not gone[kid]:
                        todo.append((n, k))
                        todo.append((kid, 0))
                        break
            else:
                if tags[n] in BLOCKS:
                    flush()
                    if hashes[n] and len(texts) > firsts[n] and parents[n] >= 0 and tags[n] != "body":
                        spans.append((n, 0, firsts[n], len(texts)))
                if hashes[n] and parents[n] >= 0:
                    digest = xxhash.xxh3_64_intdigest(tags[n].encode("utf-8", "surrogatepass") + b"\0" + b"\0".join(hashes[n]))
                    hashes[parents[n]].append(digest.to_bytes(8, "little"))
                    if spans and spans[-1][0] == n:
                        spans[-1] = (n, digest, *spans[-1][2:])
                hashes[n] = []
        flush()
        letters = [0]
        for t in texts:
            letters.append(letters[-1] + len(t))
        subtrees = [
            (digest - (1 << 64) if digest >> 63 else digest, first, end, article[n] or tags[n] in PROSE or 2 * (letters[end] - letters[first]) > letters[-1])
            for n, digest, first, end in spans
        ]
        return texts, subtrees, "\n".join(texts)
