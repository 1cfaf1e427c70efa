"""HTML extraction by a tree-structured graphical model over DOM blocks.

A page becomes a tree of block elements (inline elements only mark links). Every block has two states, content and other;
its own features give a potential, and each parent-child pair has another by kind of child. Sum-product messages go up and
down the tree once and give each block's marginal; the text of blocks with a marginal of 0.5 at least is the main text.
The weights are fitted by gradient steps on the exact likelihood of labelled pages: made by labelled_pages() here, in many
layouts, each element marked as content or not. Training is deterministic and takes a few seconds on the driver; the fitted
weights are a few hundred numbers. Trees of a batch are stacked and passed level by level, so messages are array steps.

Defined results: null and empty pages give an empty text; very long pages are read whole, in time in proportion to their
length, whatever is broken in them; a tag that never ends gives nothing, nor does what follows it; head, scripts, styles, templates and form controls never give
text; a page without content gives an empty text; blocks nested deeper than DEEPEST hang on the block at that depth; broken markup is closed as browsers close it, roughly; repeated rows are
treated alike."""

from __future__ import annotations

import functools
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.common import table

# Element kinds and the words in class, id and role that features look for.
INLINE = set("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style template noscript head title textarea select option button iframe object svg canvas audio video datalist".split())
RAW = set("script style textarea title iframe noscript".split())
TAGS = "html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form fieldset address details summary dialog hr".split()
WORDS = {
    "content": "content article post entry story main body text maincontent bodytext",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topnav sitenav pagination pager tabs toc skip",
    "header": "header masthead banner topbar sitehead logo branding hero",
    "footer": "footer foot copyright colophon legal bottom sitefoot",
    "side": "sidebar side aside widget related recommended recommendations more trending popular rail complementary archive tags tagcloud",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter subscribe subscription paywall message announcement privacy warning signup",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted adsbygoogle banner-ad",
    "comment": "comment comments reply replies discussion respond disqus feedback thread reader",
    "share": "share sharing social follow author-bio byline meta tools",
    "form": "form search login subscribe-form contact poll survey",
}
WORD_OF = {w: k for k, names in enumerate(WORDS.values()) for w in names.split()}
KIND = {t: k for k, t in enumerate(TAGS)}
CLOSES_P = {t for t in TAGS if t not in ("html", "body")}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Browsers stop nesting there; deeper blocks become children of the block at this depth.
DEEPEST = 512
PLAIN = re.compile(r"(/?)([a-zA-Z][^\s/>]*)>")
START = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
NAME = re.compile(r"[\s/]*+([^\s/>=]*+)\s*+(=?)\s*+")
BARE = re.compile(r"[^\s>]*+")
LOOKED_AT = {"class", "id", "role", "data-y", "aria-label", "href"}
SPLIT = re.compile(r"[^a-z0-9]+")
#: The end of raw text; of a head that is left open, the body.
COMMENT_END = re.compile("--!?>")
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW} | {"head": re.compile(r"(?<=</head>)|<body(?=[\s/>])", re.I)}
STOPS = re.compile(r"[.,;:!?]")


class Scanner:
    """Tags of a page in one pass from left to right, by the rules of HTML: a value may be bare, up to white space or >, or
    quoted, up to the same quote. A quote that is never closed ends with its tag, at the next >. What is looked for and not
    found is remembered, so that broken markup takes time in proportion to its length."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in "\"'>"}
        self.missing: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        """Of the literal what from at on, or the end."""
        found = -1 if what in self.missing or at > self.last.get(what, at) else self.html.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found if found >= 0 else len(self.html)

    def comment(self, at: int) -> int:
        """Behind the end of the comment that begins at `at`: --> or --!>, of which only the former may end it at once."""
        if "<!--" in self.missing:
            return len(self.html)
        m = COMMENT_END.search(self.html, at + 2)
        if m and m[0] == "--!>" and m.start() == at + 2:
            m = COMMENT_END.search(self.html, at + 3)
        if not m:
            self.missing["<!--"] = at
        return m.end() if m else len(self.html)

    def close(self, name: str, at: int) -> int:
        """Where the raw text of the element name ends: before its end tag, or at the end of the page."""
        if name in self.missing:
            return len(self.html)
        m = RAW_END[name].search(self.html, at)
        if not m:
            self.missing[name] = at
        return m.start() if m else len(self.html)

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """Attributes that are looked at, from behind a tag's name on, and the place behind the tag; -1 if it never ends."""
        html, got = self.html, {}
        while at <= self.last[">"]:
            m = NAME.match(html, at)
            at = m.end()
            if at >= len(html):
                break
            name, value = m[1].lower(), ""
            if m[2] and html[at] != ">":
                if html[at] in "\"'":
                    end = self.find(html[at], at + 1)
                    if end == len(html):  # never closed
                        end = self.find(">", at)
                        value, at = html[at + 1 : end], end
                    else:
                        value, at = html[at + 1 : end], end + 1
                else:
                    bare = BARE.match(html, at)
                    value, at = bare[0], bare.end()
            if name in LOOKED_AT:
                got.setdefault(name, value.lower())
            if at < len(html) and html[at] == ">":
                return got, at + 1
        return got, -1


class Open:
    """A stack of open elements that knows where each name was opened last."""

    __slots__ = ("items", "at")

    def __init__(self):
        self.items: list[tuple[str, int]] = []
        self.at: dict[str, list[int]] = {}

    def push(self, name: str, value: int) -> None:
        self.at.setdefault(name, []).append(len(self.items))
        self.items.append((name, value))

    def last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def cut(self, k: int) -> None:
        while len(self.items) > k:
            self.at[self.items.pop()[0]].pop()


class Page:
    """Blocks in page order: parent, tag, words found in attributes, own text, text in links; pieces are (block, text)."""

    __slots__ = ("parent", "tag", "mask", "chars", "linked", "stops", "rights", "label", "pieces")

    def __init__(self, html: str):
        self.parent, self.tag, self.mask, self.label = [-1], [KIND["html"]], [0], [None]
        self.chars, self.linked, self.stops, self.rights = [0], [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []
        open_, silent = Open(), Open()  # silent: open elements that give no text, with the number of blocks around each
        open_.push("html", 0)
        scan, in_link = Scanner(html), False
        at = pos = 0  # text not yet taken begins at at
        while True:
            lt = scan.find("<", pos)
            if lt < len(html) and not (html[lt + 1 : lt + 2].isalpha() and html[lt + 1].isascii()) and html[lt + 1 : lt + 2] not in ("/", "!", "?"):
                pos = lt + 1  # a sign like any other
                continue
            if lt > at and not silent.items:
                self._text(html[at:lt], open_.items[-1][1], in_link)
            if lt >= len(html):
                break
            m, attrs = PLAIN.match(html, lt + 1), {}
            if m:
                at = pos = m.end()
            else:
                m = START.match(html, lt + 1)
                if not m:  # a comment or the like
                    at = pos = scan.comment(lt) if html.startswith("<!--", lt) else scan.find(">", lt) + 1
                    continue
                attrs, pos = scan.attributes(m.end())
                if pos < 0:
                    break
                at = pos
            name = m[2].lower()
            if m[1]:
                if name == "a":
                    in_link = False
                elif name in SILENT:
                    if (k := silent.last(name)) >= 0:
                        silent.cut(k)
                elif name not in INLINE and name not in ("html", "body"):
                    if (k := open_.last(name)) > 0:
                        open_.cut(k)
                        in_link = False
                        while silent.items and silent.items[-1][1] > k:  # left open inside what ends here
                            silent.cut(len(silent.items) - 1)
                continue
            empty = html[at - 2] == "/"
            if name in SILENT:
                if name in RAW:
                    at = pos = scan.close(name, at)
                    if at < len(html):
                        at = pos = scan.find(">", at) + 1
                elif name == "head":
                    at = pos = at if (k := scan.close(name, at)) == len(html) else k
                elif not empty:
                    if name == "option" and silent.items and silent.items[-1][0] == "option":
                        silent.cut(len(silent.items) - 1)  # an option ends where the next begins
                    silent.push(name, len(open_.items))
                continue
            if name == "a":
                in_link = "href" in attrs
            if name in ("br", "hr"):
                self.pieces.append((open_.items[-1][1], " "))
            if name in INLINE or name in VOID or name in ("html",):
                continue
            if name in CLOSES_P and open_.items[-1][0] == "p":
                open_.cut(len(open_.items) - 1)
            if name in CLOSES and (k := open_.last(*CLOSES[name])) > open_.last(*SCOPE[name]) and k > 0:
                open_.cut(k)
            in_link = in_link and name not in ("p", "li", "div")
            mask = 0
            for key in ("class", "id", "role", "aria-label"):
                for w in SPLIT.split(attrs[key]) if key in attrs else ():
                    if w in WORD_OF:
                        mask |= 1 << WORD_OF[w]
            self.parent.append(open_.items[min(len(open_.items), DEEPEST) - 1][1])
            self.tag.append(KIND.get(name, KIND["div"]))
            self.mask.append(mask)
            self.label.append(int(attrs["data-y"]) if attrs.get("data-y") in ("0", "1") else None)
            self.chars.append(0)
            self.linked.append(0)
            self.stops.append(0)
            self.rights.append(0)
            open_.push(name, len(self.parent) - 1)

    def _text(self, raw: str, block: int, in_link: bool) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.pieces.append((block, text))
        n = len(text.strip())
        self.chars[block] += n
        if in_link:
            self.linked[block] += n
        self.stops[block] += len(STOPS.findall(text))
        if "\xa9" in text or "ll rights reserved" in text:
            self.rights[block] = 1

    def text(self, keep) -> str:
        """The kept blocks' text; pieces of a block that no other block parts belong together."""
        out, last, run = [], -1, []
        for block, piece in self.pieces:
            if block != last:
                if run and (t := " ".join("".join(run).split())):
                    out.append(t)
                run, last = [], block
            if keep[block]:
                run.append(piece)
        if run and (t := " ".join("".join(run).split())):
            out.append(t)
        return " ".join(out)


N_WORDS = len(WORDS)
REGIONS = ("article", "main", "nav", "header", "footer", "aside", "form")
N_TAGS = len(TAGS)
_SIZES = np.array([1, 25, 60, 120, 250])


def _by(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by key."""
    return np.stack([np.bincount(key, values[:, k], n) for k in range(values.shape[1])], 1)


class Forest:
    """Pages stacked: features of all blocks, parents, and the blocks of each level."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages])
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        base = np.repeat(self.start[:-1], sizes)
        parent = np.concatenate([p.parent for p in pages]).astype(np.int64)
        self.root = parent < 0
        self.parent = np.where(self.root, -1, parent + base)
        tag = np.concatenate([p.tag for p in pages])
        mask = np.concatenate([p.mask for p in pages]).astype(np.int64)
        chars, linked, stops, rights = (np.concatenate([getattr(p, n) for p in pages]).astype(float) for n in ("chars", "linked", "stops", "rights"))
        depth = np.zeros(len(parent), np.int64)
        for p, s in zip(pages, self.start):
            d = [0] * len(p.parent)
            for i in range(1, len(d)):
                d[i] = d[p.parent[i]] + 1
            depth[s : s + len(d)] = d
        self.levels = [np.flatnonzero(depth == k) for k in range(int(depth.max()) + 1)]
        below, links = chars.copy(), linked.copy()
        for at in self.levels[:0:-1]:
            np.add.at(below, self.parent[at], below[at])
            np.add.at(links, self.parent[at], links[at])
        # words of attributes also hold for what lies inside
        inside = mask.copy()
        for at in self.levels[1:]:
            inside[at] |= inside[self.parent[at]]
        bits = (mask[:, None] >> np.arange(N_WORDS)) & 1
        # and so do sectioning elements
        region = np.zeros(len(parent), np.int64)
        for k, t in enumerate(REGIONS):
            region[tag == KIND[t]] = 1 << k
        for at in self.levels[1:]:
            region[at] |= region[self.parent[at]]
        frame = ((region & 0b1111100) > 0) & ((region & 0b11) == 0)  # in a header, menu or the like, but not in an article
        own = np.zeros((len(parent), N_TAGS))
        own[np.arange(len(parent)), tag] = 1
        density = linked / np.maximum(chars, 1)
        under = links / np.maximum(below, 1)
        size = (chars[:, None] >= _SIZES).astype(float)
        self.x = np.column_stack([own, bits, (inside[:, None] >> np.arange(N_WORDS)) & 1, (region[:, None] >> np.arange(len(REGIONS))) & 1, frame, frame & (below < 60), size, density, under, density > 0.5, under > 0.5, np.minimum(stops, 6) / 6, rights, below > 0, below > 400, np.log1p(below) / 8, np.minimum(depth, 8) / 8, np.ones(len(parent))])
        self.kind = tag

    def marginals(self, w: np.ndarray, pair: np.ndarray):
        """Marginals of content, and of (parent state, state) for each block but roots. pair: by kind of child, 2 x 2."""
        score = np.zeros((len(self.parent), 2))
        score[:, 1] = self.x @ w
        link = pair[self.kind]
        up = np.zeros_like(score)
        total = score.copy()
        for at in self.levels[:0:-1]:
            m = link[at] + total[at][:, None, :]
            up[at] = np.logaddexp(m[:, :, 0], m[:, :, 1])
            np.add.at(total, self.parent[at], up[at])
        joint = np.zeros((len(self.parent), 2, 2))
        for at in self.levels[1:]:
            away = total[self.parent[at]] - up[at]
            m = away[:, :, None] + link[at] + total[at][:, None, :]
            m -= m.max((1, 2), keepdims=True)
            m = np.exp(m)
            joint[at] = m / m.sum((1, 2), keepdims=True)
            down = np.logaddexp(away[:, 0, None] + link[at][:, 0], away[:, 1, None] + link[at][:, 1])
            total[at] += down
        z = total[:, 1] - total[:, 0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), joint


SYLLABLES = "an the er in re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()


def _sentence(rng, lo: int = 5, hi: int = 18) -> str:
    picked = rng.integers(0, len(SYLLABLES), (int(rng.integers(lo, hi)), 3)).tolist()
    return " ".join("".join(SYLLABLES[i] for i in word[: 1 + word[0] % 3]) for word in picked).capitalize() + "."


def _paragraph(rng) -> str:
    return " ".join(_sentence(rng) for _ in range(rng.integers(1, 7)))


def labelled_pages(n: int, seed: int = 5) -> list[str]:
    """n pages in mixed layouts; data-y tells of each element whether it is content (or holds some)."""
    rng = np.random.default_rng(seed)

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def el(tag: str, y: int, inner: str, attrs: str = "") -> str:
        return f'<{tag} data-y="{y}"{" " + attrs if attrs else ""}>{inner}</{tag}>'

    def named(kind: str) -> str:
        word = pick(*WORDS[kind].split())
        return pick(f'class="{word}"', f'id="{word}"', f'class="{word}-box"', f'class="site-{word} box"', f'class="page {word}"', "")

    def sure(kind: str) -> str:
        return named(kind) or f'class="{WORDS[kind].split()[0]}"'

    def links(y: int = 0) -> str:
        items = "".join(el("li", y, f'<a href="/{k}">{_sentence(rng, 1, 4)}</a>') for k in range(rng.integers(2, 8)))
        return el(pick("ul", "ol"), y, items)

    def menu() -> str:
        inner = pick(links(), " | ".join(f'<a href="#">{_sentence(rng, 1, 3)}</a>' for _ in range(4)), el("p", 0, f'<a href="/">{_sentence(rng, 1, 3)}</a> &gt; <a href="/x">{_sentence(rng, 1, 3)}</a>', 'class="breadcrumb"'))
        return pick(el("nav", 0, inner, named("menu")), el("div", 0, inner, sure("menu")), el("div", 0, inner, 'role="navigation"'))

    def head() -> str:
        inner = pick(el("h1", 0, f'<a href="/">{_sentence(rng, 1, 4)}</a>'), el("h1", 0, _sentence(rng, 1, 5)), el("p", 0, _sentence(rng, 2, 8)), el("h1", 0, _sentence(rng, 1, 4)) + el("p", 0, _sentence(rng, 3, 10)), el("p", 0, _paragraph(rng)), el("div", 0, _sentence(rng, 1, 5), 'class="logo"')) + (menu() if rng.random() < 0.5 else "")
        return pick(el("header", 0, inner, named("header")), el("div", 0, inner, sure("header")))

    def foot() -> str:
        inner = pick(f"&copy; {_sentence(rng, 2, 12)}", el("p", 0, f"&copy; 2020 {_sentence(rng)} All rights reserved."), el("p", 0, _paragraph(rng)) + links(), el("p", 0, _sentence(rng, 3, 14)))
        return pick(el("footer", 0, inner, named("footer")), el("div", 0, inner, sure("footer")))

    def side() -> str:
        inner = el(pick("h2", "h3", "h4"), 0, _sentence(rng, 1, 4)) + pick(links(), el("p", 0, _paragraph(rng)), el("p", 0, _sentence(rng)) + links())
        return pick(el("aside", 0, inner, named("side")), el("div", 0, inner, sure("side")), el("section", 0, inner, sure("side")))

    def advert() -> str:
        inner = pick(_sentence(rng), el("p", 0, _paragraph(rng)), el("p", 0, _sentence(rng)) + f'<a href="http://x">{_sentence(rng, 1, 4)}</a>', _paragraph(rng))
        return el(pick("div", "section", "aside", "p"), 0, inner, sure("advert")) if "<p" not in inner else el("div", 0, inner, sure("advert"))

    def notice() -> str:
        inner = pick(el("p", 0, _paragraph(rng)), _paragraph(rng), el("p", 0, _sentence(rng)) + "<button>ok</button>", el("p", 0, _sentence(rng) + ' <a href="/privacy">more</a>'))
        return el(pick("div", "section", "aside", "dialog"), 0, inner, pick(sure("notice"), sure("notice"), 'role="dialog"', 'role="alert"'))

    def form() -> str:
        inner = pick(f"<label>{_sentence(rng, 1, 4)}</label><input name=q>", el("p", 0, _paragraph(rng)) + "<input>", el("p", 0, f"<label>{_sentence(rng, 1, 3)}</label> <input> <button>{_sentence(rng, 1, 3)}</button>"), _sentence(rng) + "<select><option>a</select>", el("fieldset", 0, el("div", 0, _sentence(rng, 2, 9)) + "<textarea>x</textarea>"))
        return el("form", 0, inner, named("form"))

    def remarks() -> str:
        def one():
            by = el(pick("p", "div", "h4"), 0, _sentence(rng, 1, 3), pick('class="author"', ""))
            return by + el(pick("p", "div"), 0, _paragraph(rng))

        inner = (el(pick("h2", "h3"), 0, _sentence(rng, 1, 3)) if rng.random() < 0.6 else "") + "".join(pick(el("li", 0, one()), el("div", 0, one(), sure("comment")), el("p", 0, _paragraph(rng)), el("article", 0, one(), 'class="comment"')) for _ in range(rng.integers(1, 5)))
        return el(pick("div", "section", "ul", "ol", "aside"), 0, inner, sure("comment"))

    def share() -> str:
        return el(pick("div", "ul"), 0, f'<a href="#">{_sentence(rng, 1, 2)}</a> <a href="#">{_sentence(rng, 1, 2)}</a>', sure("share"))

    def story() -> str:
        parts = [el(pick("h1", "h1", "h2"), 1, _sentence(rng, 2, 12))]
        if rng.random() < 0.15:
            parts = [el("header", 1, parts[0] + (el("p", 1, _sentence(rng)) if rng.random() < 0.5 else ""))]
        for _ in range(rng.integers(1, 9)):
            r = rng.random()
            if r < 0.66:
                text = _paragraph(rng)
                if rng.random() < 0.25:
                    text += f' <a href="/in">{_sentence(rng, 1, 5)}</a> ' + _sentence(rng)
                parts.append(el("p", 1, pick(text, text, f"<b>{text}</b>", f"{_sentence(rng)}<br>{text}", _sentence(rng, 1, 3))))
            elif r < 0.74:
                parts.append(el(pick("h2", "h3"), 1, _sentence(rng, 1, 8)))
            elif r < 0.82:
                linked = rng.random() < 0.35

                def item() -> str:
                    text = pick(_sentence(rng), _sentence(rng, 1, 4), _paragraph(rng))
                    return f'<a href="/{int(rng.integers(99))}">{_sentence(rng, 2, 7)}</a>' + pick("", "", " " + text) if linked else text

                parts.append(el(pick("ul", "ol"), 1, "".join(el("li", 1, item()) for _ in range(rng.integers(2, 6)))))
            elif r < 0.86:
                parts.append(el("blockquote", 1, pick(_paragraph(rng), el("p", 1, _paragraph(rng)))))
            elif r < 0.89:
                parts.append(el("pre", 1, _sentence(rng)))
            elif r < 0.92:
                rows = "".join(el("tr", 1, "".join(el("td", 1, _sentence(rng, 1, 4)) for _ in range(3))) for _ in range(rng.integers(1, 4)))
                parts.append(el("table", 1, rows))
            elif r < 0.94:
                parts.append(el("figure", 1, "<img src=x>" + el("figcaption", 1, _sentence(rng, 2, 9))))
            elif r < 0.97:
                parts.append(el("div", 1, pick(_paragraph(rng), el("p", 1, _paragraph(rng))), pick("", 'class="section"')))
            else:
                parts.append(pick(advert, side, share, notice, form)())
        inner = "".join(parts)
        if rng.random() < 0.12:
            inner += remarks()
        plain = pick("", "", 'class="col"', 'class="x1"')
        return pick(el("article", 1, inner, pick(plain, sure("content"))), el("article", 1, inner), el("main", 1, inner), el("main", 1, el("article", 1, inner)), el("div", 1, inner, sure("content")), el("section", 1, inner, sure("content")), el("div", 1, el("div", 1, inner), sure("content")), el("div", 1, inner, plain))

    out = []
    for _ in range(n):
        before = [f() for f in (menu, head, notice, advert, form) if rng.random() < 0.4]
        after = [f() for f in (side, remarks, foot, advert, notice, form, share) if rng.random() < 0.4]
        rng.shuffle(before)
        body = story() if rng.random() < 0.97 else ""
        if rng.random() < 0.4 and after:
            body = el("div", 1 if body else 0, body + after.pop(0), pick("", 'class="wrap"', 'id="page"', 'class="container"'))
        out.append(f'<!DOCTYPE html><html data-y="1"><head><title>{_sentence(rng)}</title></head><body data-y="1">' + "".join(before) + body + "".join(after) + "</body></html>")
    return out


TRAINING_PAGES = 300
STEPS = 400


@functools.lru_cache(1)
def fitted() -> tuple[np.ndarray, np.ndarray]:
    pages = [Page(h) for h in labelled_pages(TRAINING_PAGES)]
    forest = Forest(pages)
    y = np.concatenate([[1 if v is None else v for v in p.label] for p in pages])
    inner = np.flatnonzero(~forest.root)
    seen = np.zeros((N_TAGS, 2, 2))
    np.add.at(seen, (forest.kind[inner], y[forest.parent[inner]], y[inner]), 1)
    w, pair = np.zeros(forest.x.shape[1]), np.zeros((N_TAGS, 2, 2))
    n = len(y)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    for step in range(1, STEPS + 1):  # Adam on the log-likelihood with a small Gaussian prior
        p, joint = forest.marginals(w, pair)
        expected = _by(forest.kind[inner], joint[inner].reshape(-1, 4), N_TAGS).reshape(N_TAGS, 2, 2)
        for k, (v, g) in enumerate(((w, forest.x.T @ (y - p) / n - 2e-4 * w), (pair, (seen - expected) / n - 2e-4 * pair))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * g * g
            v += 0.1 * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return w, pair


PAGES_AT_ONCE = 100


def _extract(w: np.ndarray, pair: np.ndarray):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, PAGES_AT_ONCE):
                part = b.slice(lo, PAGES_AT_ONCE)
                pages = [Page(h or "") for h in part.column(part.schema.get_field_index("html")).to_pylist()]
                forest = Forest(pages)
                keep = forest.marginals(w, pair)[0] >= 0.5
                texts = [p.text(keep[s:]) for p, s in zip(pages, forest.start)]
                columns = [part.column(part.schema.get_field_index(c)) for c in ("page_id", "url")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = rows.mapInArrow(_extract(*fitted()), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
