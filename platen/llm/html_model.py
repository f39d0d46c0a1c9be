"""The HTML classifier: logistic regression on blocks and parts of seeded, labelled pages.

Pages are drawn from a grammar of layouts: an article of headings, prose,
lists, tables, quotes and figures, and around and inside it menus, headers,
footers, sidebars, notices, adverts, forms and reader comments, with or without
telling tags and names. Comments and teasers are prose too, so text alone
decides little and the part of the page it lies in has to speak.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np

from .html import Model, block_features, blocks_of, part_features, parts_of

#: Pages to learn from, and the seed they are drawn from.
PAGES, SEED = 2000, 20240817

#: Names that parts of pages go by.
CONTENT = "article|content|post|entry|entry-content|post-body|article-body|story|story-body|main|main-content|body|text|page-content|articleBody|markdown-body|prose|blog-post|single|hentry".split("|")
MENU = "nav|menu|navbar|navigation|main-menu|breadcrumb|breadcrumbs|toc|topnav|nav-links|pagination|pager|skip-links|tabs|languages".split("|")
HEADER = "header|site-header|masthead|topbar|top|banner|brand|logo-bar|page-header".split("|")
FOOTER = "footer|site-footer|foot|copyright|legal|footer-links|bottom|colophon|page-footer".split("|")
SIDE = "sidebar|side|aside|widget|widgets|related|recommended|more-stories|popular|trending|rail|secondary|tag-cloud|tags|share|social|sharing|see-also|teaser".split("|")
NOTICE = "notice|cookie|cookies|cookie-banner|consent|gdpr|alert|popup|modal|overlay|message|announcement|warning-bar|subscribe|newsletter|paywall|toast".split("|")
ADVERT = "ad|ads|advert|advertisement|adsense|ad-slot|sponsor|sponsored|promo|promotion|ad-banner|ad-container".split("|")
FORM = "form|search|search-form|login|signup|login-form|contact-form|feedback|rating|poll|comment-form|respond".split("|")
COMMENTS = "comments|comment|comment-list|comments-area|replies|reply|responses|disqus|discussion|reader-comments|user-comments".split("|")
WRAPPER = "container|wrapper|layout|page|site|row|col|grid|outer|inner|page-with-sidebar|has-sidebar|with-comments|no-ads|content-wrapper|root|app|has-ad|main-wrapper".split("|")
SYLLABLES = "ta re mi no lo ka er in st ra de vo la pe su ti on an el or".split()


class _Page:
    """One page in the making: text marked as content carries the mark."""

    MARK = "⁣"

    def __init__(self, r: random.Random):
        self.r = r
        self.plain = r.random()  # how often names are left out
        self.bare = r.random() < 0.3  # no telling tags
        self.out: list[str] = []

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize()

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.phrase(3, 18) + self.r.choice("....?!") for _ in range(self.r.randint(low, high)))

    def names(self, words: list[str], often: float = 1.0) -> str:
        r = self.r
        if r.random() < self.plain * often:
            return ""
        name = r.choice(words)
        if r.random() < 0.2:
            name += r.choice((" row", " box", " clearfix", f" x{r.randint(1, 99)}", "-1", " block", "__inner"))
        quote = r.choice(('"', '"', "'", ""))
        if " " in name:
            quote = quote or '"'
        return f" {r.choice(('class', 'class', 'class', 'id'))}={quote}{name}{quote}"

    def open(self, tag: str, words: list[str], often: float = 1.0) -> Callable[[], None]:
        tag = "div" if self.bare and self.r.random() < 0.9 else tag
        self.out.append(f"<{tag}{self.names(words, often)}>")
        return lambda: self.out.append(f"</{tag}>")

    def put(self, text: str, content: bool) -> None:
        self.out.append((self.MARK if content else "") + text)

    def links(self, n: int, tag: str = "ul") -> None:
        r = self.r
        self.out.append(f"<{tag}>")
        for _ in range(n):
            self.out.append("<li>" if tag == "ul" else "<span>" if r.random() < 0.5 else "")
            self.out.append(f'<a href="/{self.word()}">{self.phrase(1, 4)}</a> ')
            self.out.append("</li>" if tag == "ul" and r.random() < 0.9 else "")
        self.out.append(f"</{tag}>")

    def paragraph(self, content: bool) -> None:
        r = self.r
        text = self.prose(1, 7) if r.random() < 0.75 else self.phrase(1, 12) + r.choice((".", ".", ":", "", ",", " |"))
        if r.random() < 0.15:
            cut = r.randint(0, len(text))
            text = text[:cut] + f"<a href='#'>{self.phrase(1, 3)}</a>" + text[cut:]
        self.out.append("<p>")
        self.put(text, content)
        self.out.append("</p>" if r.random() < 0.9 else "")

    def body(self) -> None:
        """The article."""
        r = self.r
        end = self.open(r.choice(("article", "article", "main", "div", "section")), CONTENT, 0.7)
        if r.random() < 0.8:
            top = self.open("header", ["entry-header", "post-header", "title"], 1.2) if r.random() < 0.2 else None
            self.out.append("<h1>")
            self.put(self.phrase(2, 14), True)
            self.out.append("</h1>")
            if top:
                top()
        inner = self.open("div", CONTENT) if r.random() < 0.3 else None
        if r.random() < 0.3:
            self.junk()
        if r.random() < 0.06:  # hardly any
            self.out.append("<p>")
            self.put(self.phrase(1, 3) + ".", True)
            if inner:
                inner()
            return end()
        for _ in range(r.choice((0, 1, 1, 2, 4, 8, 16, 30))):
            k = r.random()
            if k < 0.66:
                self.paragraph(True)
            elif k < 0.74:
                self.out.append(f"<h{(h := r.randint(2, 4))}>")
                self.put(self.phrase(1, 8), True)
                self.out.append(f"</h{h}>")
            elif k < 0.82:
                self.out.append(f"<{(kind := r.choice(('ul', 'ol')))}>")
                for _ in range(r.randint(1, 6)):
                    self.out.append("<li>")
                    self.put(self.phrase(1, 14) + r.choice(("", ".")), True)
                self.out.append(f"</{kind}>")
            elif k < 0.87:
                self.out.append("<blockquote>")
                self.paragraph(True)
                self.out.append("</blockquote>")
            elif k < 0.91:
                self.out.append("<table>")
                for _ in range(r.randint(1, 4)):
                    self.out.append("<tr>")
                    for _ in range(r.randint(2, 4)):
                        self.out.append("<td>")
                        self.put(r.choice((self.phrase(1, 4), str(r.randint(0, 9999)))), True)
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif k < 0.94:
                self.out.append("<figure><img src=x><figcaption>")
                self.put(self.phrase(2, 12), True)
                self.out.append("</figcaption></figure>")
            elif k < 0.96:
                self.out.append("<pre>")
                self.put(f"{self.word()}({self.word()}) = {r.randint(0, 9)};", True)
                self.out.append("</pre>")
            elif k < 0.98:
                end2 = self.open("section", CONTENT, 1.5)
                for _ in range(r.randint(1, 4)):
                    self.paragraph(True)
                end2()
            else:
                r.choice((self.advert, self.side, self.notice))()
        if inner:
            inner()
        if r.random() < 0.2:
            self.comments()
        if r.random() < 0.1:
            self.side()
        end()

    def junk(self) -> None:
        """Content that does not read like prose: it is the article's all the same."""
        r = self.r
        kind, line = r.randint(0, 4), self.phrase(1, 4)
        for _ in range(r.randint(1, 20)):
            if kind == 0:
                text = line + "."
            elif kind == 1:
                text = " | ".join(self.word() for _ in range(r.randint(1, 12)))
            elif kind == 2:
                text = self.phrase(1, 12).upper() + r.choice(("!!", "!", " ***"))
            elif kind == 3:
                text = " ".join(r.choice(("###", "%%", "&&", self.word(), str(r.randint(0, 999)))) for _ in range(r.randint(1, 9)))
            else:
                text = self.phrase(1, 3) + r.choice((".", "", ","))
            self.out.append("<p>")
            self.put(text, True)
        if r.random() < 0.5:
            self.out.append("<p>")
            self.put(r.choice(("All rights reserved.", "&copy; 2021 " + self.phrase(1, 4), f"(c) 2020 {self.word()}", "Licensed under CC BY 4.0.")), True)

    def advert(self) -> None:
        end = self.open(self.r.choice(("div", "div", "aside", "section")), ADVERT, 0.4)
        for _ in range(self.r.choice((1, 1, 1, 2))):
            self.out.append(self.r.choice(("<p>", "", "")))
            self.put(self.phrase(1, 16) + self.r.choice(("", ".", "!")), False)
        end()

    def notice(self) -> None:
        end = self.open(self.r.choice(("div", "dialog", "section", "noscript")), NOTICE, 0.4)
        self.out.append(self.r.choice(("<p>", "")))
        self.put(self.prose(1, 2), False)
        if self.r.random() < 0.5:
            self.out.append(f"<a href='#'>{self.phrase(1, 2)}</a>")
        end()

    def menu(self) -> None:
        end = self.open(self.r.choice(("nav", "nav", "div", "menu")), MENU, 0.7)
        self.links(self.r.randint(2, 12), self.r.choice(("ul", "ul", "ul", "div")))
        end()

    def header(self) -> None:
        end = self.open("header", HEADER, 0.7)
        if self.r.random() < 0.7:
            self.out.append("<div>")
            self.put(self.phrase(1, 5), False)
            self.out.append("</div>")
        if self.r.random() < 0.5:
            self.menu()
        if self.r.random() < 0.2:
            self.form()
        end()

    def footer(self) -> None:
        end = self.open("footer", FOOTER, 0.7)
        if self.r.random() < 0.5:
            self.links(self.r.randint(1, 8))
        for _ in range(self.r.randint(1, 2)):
            self.out.append(self.r.choice(("<p>", "<div>", "")))
            self.put(self.r.choice(("&copy; ", "&copy; 2023 ", "", "")) + self.r.choice((self.phrase(1, 6), self.prose(1, 2), "All rights reserved.")), False)
        end()

    def side(self) -> None:
        end = self.open(self.r.choice(("aside", "aside", "div")), SIDE, 0.4)
        if self.r.random() < 0.6:
            self.out.append(f"<h3>{self.phrase(1, 4)}</h3>")
        for _ in range(self.r.randint(1, 3)):
            k = self.r.random()
            if k < 0.5:
                self.links(self.r.randint(1, 8))
            else:
                self.paragraph(False)
        end()

    def form(self) -> None:
        end = self.open("form", FORM, 0.5)
        for _ in range(self.r.randint(1, 4)):
            self.out.append(self.r.choice(("<label>", "<p>", "<div>")))
            self.put(self.phrase(1, 4), False)
            self.out.append("<input name=q><br>")
        self.out.append("<button>Go</button>")
        end()

    def comments(self) -> None:
        r = self.r
        kind = r.choice(("div", "article", "article", "li"))
        end = self.open(r.choice(("section", "section", "div")), COMMENTS, 0.0 if kind == "article" else 0.2)
        if r.random() < 0.5:
            self.out.append(f"<h2>{self.phrase(1, 3)}</h2>")
        for _ in range(r.randint(1, 6)):
            one = self.open(kind, COMMENTS, 1.2)
            if r.random() < 0.5:
                self.out.append(f"<b>{self.word().capitalize()}</b> ")
            for _ in range(r.choice((1, 1, 2))):
                self.paragraph(False)
            one()
        if r.random() < 0.3:
            self.form()
        end()

    def page(self) -> str:
        r = self.r
        if r.random() < 0.15:  # a bare text
            if (k := r.random()) < 0.4:
                self.put(r.choice((self.prose(1, 4), self.phrase(1, 8))), True)
            elif k < 0.6:
                self.junk()
            else:
                for _ in range(r.randint(1, 6)):
                    self.paragraph(True)
            for x in (self.form, self.menu, self.footer, self.advert):
                if r.random() < 0.2:
                    x()
            return "".join(self.out)
        self.out.append("<!DOCTYPE html><html><head><title>t</title></head><body>")
        wraps = [self.open(r.choice(("div", "div", "main", "form")) if r.random() < 0.2 else "div", WRAPPER, 0.6) for _ in range(r.choice((0, 0, 1, 2)))]
        before = [x for x, p in ((self.header, 0.5), (self.menu, 0.6), (self.notice, 0.2), (self.advert, 0.4), (self.form, 0.1), (self.side, 0.1)) if r.random() < p]
        r.shuffle(before)
        for x in before:
            x()
        inside = self.open("main", WRAPPER + CONTENT[:8]) if r.random() < 0.3 else None
        self.body()
        if inside and r.random() < 0.3:
            r.choice((self.side, self.comments, self.advert))()
        if inside:
            inside()
        after = [x for x, p in ((self.side, 0.35), (self.comments, 0.3), (self.advert, 0.25), (self.notice, 0.1), (self.menu, 0.1), (self.form, 0.1)) if r.random() < p]
        r.shuffle(after)
        for x in after:
            x()
        if r.random() < 0.7:
            self.footer()
        for end in reversed(wraps):
            end()
        text = "".join(self.out) + "</body></html>"
        return text[: r.randint(len(text) // 2, len(text))] if r.random() < 0.05 else text


def pages(n: int, seed: int) -> list[tuple[str, list[bool]]]:
    """n pages, each with the label of every block: content or not."""
    out = []
    for i in range(n):
        marked = _Page(random.Random(seed * 1_000_003 + i)).page()
        out.append((marked.replace(_Page.MARK, ""), [_Page.MARK in b.text for b in blocks_of(marked) if b.text.strip(_Page.MARK)]))
    return out


def _fit(rows: list[list[str]], y: list[bool], l2: float, rounds: int) -> dict[str, float]:
    """Logistic regression by gradient descent with momentum, steps scaled by how often a feature occurs."""
    number: dict[str, int] = {}
    flat = np.array([number.setdefault(f, len(number)) for fs in rows for f in fs])
    row = np.repeat(np.arange(len(rows)), [len(fs) for fs in rows])
    target, w, speed = np.array(y, float), np.zeros(len(number)), np.zeros(len(number))
    seen = np.bincount(flat, minlength=len(w))
    most = 0.25 * np.bincount(flat, weights=np.bincount(row)[row], minlength=len(w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(row, w[flat], minlength=len(rows))))
        g = np.bincount(flat, (p - target)[row], minlength=len(w)) + l2 * w
        speed = 0.9 * speed - g / (most + l2)
        w = w + speed
    return {f: float(w[i]) for f, i in number.items() if seen[i] > 1}


_TRAINED: dict[tuple[int, int], Model] = {}


def train(n: int = PAGES, seed: int = SEED) -> Model:
    """The model of ``n`` pages of a seed; the same for the same arguments."""
    if (n, seed) not in _TRAINED:
        blocks, parts, yb, yp = [], [], [], []
        for html, labels in pages(n, seed):
            found = blocks_of(html)
            tree, place = parts_of(found)
            good = np.zeros(len(tree))
            for b, k, y in zip(found, place, labels):
                blocks.append(block_features(b))
                yb.append(y)
                good[k] += y * (b.text.count(" ") + 1)
            for k in range(len(tree) - 1, 0, -1):
                good[tree[k].parent] += good[k]
            for k, p in enumerate(tree):
                parts.append(part_features(tree, k))
                yp.append(2 * good[k] > p.words)
        _TRAINED[n, seed] = Model(_fit(blocks, yb, 2.0, 150), _fit(parts, yp, 0.3, 300))
    return _TRAINED[n, seed]
