"""Made-up pages for training the block labeller: many layouts, names and kinds of block, with
the truth for each block. Words are random syllables, so layout and context must be learned; the
few boilerplate words are what sites say in menus, notices, forms and footers."""

from __future__ import annotations

import random

SYLLABLES = "ba be bi bo da de di do en er es fa fi ga ge ha he in ion ka ke la le li lo ma me mi na ne ni no or pa pe ra re ri sa se si ta te ti to un va ve é ü ß ñ ción".split()
#: Container names that sites use, by role.
NAMES = {
    "nav": "nav menu navbar navigation main-menu topnav breadcrumbs tabs".split(),
    "header": "header masthead site-header top-bar branding page-header".split(),
    "footer": "footer site-footer page-footer colophon copyright bottom".split(),
    "aside": "sidebar side right-col widget widgets related rail recommended trending popular tags".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad adsense ad-slot sponsor".split(),
    "notice": "notice cookie cookies consent gdpr alert banner popup modal overlay newsletter disclaimer message".split(),
    "form": "form search search-form login signup subscribe contact".split(),
    "comments": "comments comment comment-list replies discussion respond disqus reviews thread responses".split(),
    "share": "share social sharing follow author-box pagination pager toolbar".split(),
    "main": "content main article post entry story post-body entry-content article-body text body page wrapper container".split(),
}
SAYS = {
    "nav": "Home About Contact News Products Menu Login Start Impressum Blog Shop Help".split(),
    "ad": ["Advertisement", "Sponsored", "Buy now", "Anzeige", "Offer of the day"],
    "notice": ["We use cookies to improve this site.", "Accept all", "Reject", "Privacy settings", "Please enable JavaScript."],
    "form": ["Search", "Your email", "Subscribe", "Name", "Message", "Send", "Sign in"],
    "comments": ["Reply", "Leave a comment", "3 comments", "says:", "Report"],
    "footer": ["© 2021", "All rights reserved", "Terms", "Privacy", "&copy; 2024 site"],
    "share": ["Share", "Tweet", "Print", "Next page", "Follow us"],
}
TAGS = {
    "nav": ["nav", "div", "ul", "table"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"],
    "ad": ["div", "aside", "ins", "section", "p"], "notice": ["div", "section", "aside", "dialog"], "form": ["form"],
    "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul", "footer"], "main": ["article", "main", "div", "section"],
}
SEMANTIC = frozenset("nav header footer aside form article main ins dialog".split())


class Maker:
    """One page from a seed: html, and for each leaf block whether it is main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.html: list[str] = []
        #: A page's own habit: a run of one sign behind most words, or capitals.
        self.habit = self.r.choice(["", "", "", "", "", "", self.signs(), self.signs(), self.signs(), self.signs(), "A"])
        self.words = ["".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(60)]

    def signs(self) -> str:
        """One to three of any sign that means nothing in markup, at times set off by a blank."""
        return self.r.choice(["", " "]) + self.r.choice("!#$%*+-/:;=?@\\^_|~") * self.r.randint(1, 3)

    def text(self, low: int, high: int) -> str:
        n = int(low + (high - low) * self.r.random() ** 2)
        words = [self.r.choice(self.words) + self.r.choices(["", ",", ".", self.signs()], [14, 1, 2, 0.4])[0] for _ in range(n)]
        if self.habit and self.r.random() < 0.8:
            words = [w.upper() if self.habit == "A" else w + self.habit for w in words]
        said = " ".join(words) or "ba"
        return (said if self.habit == "A" else said.capitalize()) + self.r.choice([".", "", "!", "?"])

    def mark(self, main: bool) -> str:
        """A sign at the start of a block that tells its label; it is taken off before training."""
        return "\ue001" if main else "\ue000"

    def put(self, tag: str, text: str, main: bool, close: bool = True) -> None:
        body = self.mark(main) + text
        if self.r.random() < 0.12:
            body = f"<{(t := self.r.choice(['b', 'em', 'span', 'i', 'strong']))}>{body}" + f"</{t}>" * (self.r.random() < 0.8)
        if self.r.random() < 0.1:
            body += " <a href='/x'>" + self.text(1, 4) + "</a> " + self.text(1, 5)
        self.html.append(f"<{tag}>{body}" + f"</{tag}>" * close + self.r.choice(["", "", "\n"]))

    def links(self, kind: str, n: int) -> None:
        lists = self.r.random() < 0.7
        self.html.append("<ul>" * lists)
        for _ in range(n):
            said = self.r.choice(SAYS["nav"]) if self.r.random() < 0.4 else self.text(1, 7)
            link = f'<a href="/{self.r.choice(self.words)}">{self.mark(False)}{said}</a>'
            self.html.append(f"<li>{link}</li>" if lists else f"<div>{link}</div>")
        self.html.append("</ul>" * lists)

    def open(self, kind: str) -> str:
        tag = self.r.choice(TAGS[kind])
        named = self.r.random() < (0.5 if tag in SEMANTIC else 1.0)
        name = self.r.choice(NAMES[kind]) + self.r.choice(["", "", "", "-1", " x" + self.r.choice(self.words)])
        self.html.append(f'<{tag} {self.r.choice(["class", "id", "class"])}="{name}">' if named else f"<{tag}>")
        return tag

    def other(self, kind: str) -> None:
        """A part that is not main text."""
        tag = self.open(kind)
        r = self.r
        if kind in ("nav", "share"):
            self.links(kind, r.randint(2, 9))
        elif kind == "comments":
            for _ in range(r.randint(1, 5)):
                item = "li" if tag in ("ol", "ul") else r.choice(["div", "article", "div class='comment'", "p"])
                self.html.append(f"<{item}>")
                if item != "p":
                    self.put(r.choice(["span", "h4", "b", "div"]), self.text(1, 3) + " " + r.choice(SAYS[kind]), False)
                    self.put("p", self.text(3, 60), False)
                else:
                    self.html.append(self.mark(False) + self.text(3, 60))
                self.html.append(f"</{item.split()[0]}>")
        elif kind == "form":
            for _ in range(r.randint(1, 4)):
                self.put(r.choice(["label", "p", "div"]), r.choice(SAYS[kind]) if r.random() < 0.7 else self.text(1, 8), False)
                self.html.append("<input type=text>")
        else:
            said = SAYS.get(kind, SAYS["nav"])
            for _ in range(r.randint(1, 3)):
                body = r.choice(said) if r.random() < 0.4 else self.text(1, 30)
                if r.random() < 0.4 or tag in ("p", "ins"):
                    self.html.append(self.mark(False) + body + ("<hr>" if tag not in ("p", "ins") else " "))
                    if tag in ("p", "ins"):
                        break
                else:
                    self.put(r.choice(["p", "h3", "div", "span"]), body, False)
            if kind in ("aside", "footer", "header") and r.random() < 0.5 and tag != "p":
                self.links(kind, r.randint(1, 6))
        self.html.append(f"</{tag}>")

    def article(self) -> None:
        r = self.r
        outer = self.open("main") if r.random() < 0.35 else ""
        tag = self.open("main") if r.random() < 0.92 else ""
        if r.random() < 0.8:
            self.put(r.choice(["h1", "h1", "h2"]), self.text(2, 14), True)
        for _ in range(r.choice([0, 1, 2, 4, 8, 16, 24])):
            kind = r.random()
            if kind < 0.72:
                if r.random() < 0.2:
                    self.html.append(f"<p><{r.choice(['b', 'b', 'strong', 'i'])}>{self.mark(True)}{self.text(1, 80)}<br>")
                else:
                    self.put("p", self.text(1, 120), True, close=r.random() < 0.9)
            elif kind < 0.79:
                self.put(r.choice(["h2", "h3"]), self.text(1, 8), True)
            elif kind < 0.85:
                self.html.append("<ul>")
                for _ in range(r.randint(1, 5)):
                    self.put("li", self.text(1, 20), True)
                self.html.append("</ul>")
            elif kind < 0.92:
                self.put(r.choice(["blockquote", "pre", "figcaption", "td", "div"]), self.text(2, 40), True)
            else:
                self.other(r.choice(["ad", "share", "notice", "aside", "form"]))
        if r.random() < 0.12:
            self.other("comments")
        self.html += [f"</{t}>" for t in (tag, outer) if t and r.random() < 0.95]

    def page(self) -> str:
        r = self.r
        self.html.append(f"<!DOCTYPE html><html><head><title>{self.text(2, 9)}</title><style>p{{}}</style></head><body>")
        for kind, chance in (("notice", 0.25), ("header", 0.5), ("nav", 0.75), ("form", 0.2), ("ad", 0.5), ("aside", 0.25)):
            for _ in range((r.random() < chance) + (r.random() < chance / 4)):
                self.other(kind)
        self.article()
        for kind, chance in (("share", 0.2), ("comments", 0.4), ("aside", 0.35), ("ad", 0.3), ("form", 0.2), ("nav", 0.1), ("notice", 0.15), ("footer", 0.85)):
            if r.random() < chance:
                self.other(kind)
        self.html.append("</body></html>")
        return "".join(self.html)
