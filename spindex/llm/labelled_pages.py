"""Labelled pages made by rule, on which the extraction model is trained."""

from __future__ import annotations

import random

# Names that pages give to their parts.
MAIN_NAMES = "content post entry article-body story main-content post-content entry-content text body-text page-content".split()
AD_NAMES = "ad ads advert advertisement sponsored promo banner-ad ad-slot adsense sponsor promotion".split()
MENU_NAMES = "nav menu navbar navigation top-nav main-menu site-nav breadcrumb breadcrumbs pagination pager tabs toc".split()
HEADER_NAMES = "header site-header masthead top-bar branding page-header".split()
FOOTER_NAMES = "footer site-footer copyright colophon bottom legal footer-links".split()
SIDE_NAMES = "sidebar side widget related recommended popular trending more-stories side-column rail tags".split()
NOTICE_NAMES = "cookie cookie-notice consent notice gdpr banner alert popup modal privacy-notice subscribe overlay message".split()
FORM_NAMES = "newsletter signup login search contact-form subscribe-form form search-box".split()
COMMENT_NAMES = "comment comments comment-list comment-body replies reply discussion respond reader-comments".split()
SHARE_NAMES = "share social social-links share-buttons follow".split()
META_NAMES = "byline meta author date post-meta timestamp".split()

OTHER, MAIN = 0, 1


# Frequent words of four languages, by which the second maker writes.
PLAIN_WORDS = (
    "the of and to in a is that it was for on are as with they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split(),
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hier unter wenn können schon seit jahr zeit gegen vom".split(),
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou leur ses mais comme elle on nous tout aux fait été aussi bien cette entre deux ces sans ont peut même temps après très autres jours ville année".split(),
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos".split(),
)


class Maker:
    """One page after another; `page` gives its HTML and the blocks' labels."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        r = self.r
        made = ["".join(r.choice(("an", "the", "ion", "er", "st", "re", "é", "que", "ch", "ein", "ung", "os", "ado", "ción", "in", "ly", "o", "ta")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
        return " ".join(made)

    def sentences(self, least: int, most: int) -> str:
        noise = self.r.choice(["", "", "", "", "###", "%%%", "!!", "&amp;&amp;&amp;"])
        text = " ".join(s[:1].upper() + s[1:] + self.r.choice("...?!") for s in (self.words(1, 18) for _ in range(self.r.randint(least, most))))
        return text.replace(" ", noise + " ") if noise else text

    def put(self, text: str, label: int, tag: str, attrs: str = "", closed: bool = True) -> None:
        self.html.append(f"<{tag}{attrs}>{text}" + f"</{tag}>" * closed)
        self.labels.append(label)

    def named(self, names: list[str]) -> str:
        return f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(names)}"'

    def links(self, n: int) -> None:
        listed = self.r.random() < 0.7
        self.html.append("<ul>" if listed else "")
        for _ in range(n):
            self.put(f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>', OTHER, "li" if listed else self.r.choice(("div", "p")))
        self.html.append("</ul>" if listed else "")

    def box(self, tags: str, names: list[str], inner) -> None:
        tag = self.r.choice(tags.split())
        plain = tag not in ("div", "section", "ul", "p")
        self.html.append(f"<{tag}{'' if plain and self.r.random() < 0.6 else self.named(names)}>")
        inner()
        self.html.append(f"</{tag}>")

    def ad(self) -> None:
        tag = self.r.choice(("div", "div", "aside", "section", "p"))
        self.put(self.sentences(1, 3), OTHER, tag, self.named(AD_NAMES))

    def menu(self) -> None:
        self.box("nav nav div ul", MENU_NAMES, lambda: self.links(self.r.randint(2, 9)))

    def header(self) -> None:
        def inner() -> None:
            self.put(self.words(1, 4), OTHER, self.r.choice(("h1", "div", "p", "h2")))
            if self.r.random() < 0.5:
                self.put(self.sentences(1, 1), OTHER, "p")
            if self.r.random() < 0.5:
                self.menu()

        self.box("header header div", HEADER_NAMES, inner)

    def side(self) -> None:
        def inner() -> None:
            if self.r.random() < 0.7:
                self.put(self.words(1, 4), OTHER, self.r.choice(("h2", "h3", "h4")))
            if self.r.random() < 0.6:
                self.links(self.r.randint(2, 7))
            for _ in range(self.r.randint(0, 2)):
                self.put(self.sentences(1, 3), OTHER, "p")
            if self.r.random() < 0.2:
                self.ad()
            if not self.labels or self.html[-1].startswith("<"):
                self.put(self.words(1, 4), OTHER, "p")

        self.box("aside aside div section", SIDE_NAMES, inner)

    def notice(self) -> None:
        def inner() -> None:
            self.put(self.sentences(1, 3), OTHER, self.r.choice(("p", "div", "p")))
            if self.r.random() < 0.6:
                self.put(self.words(1, 2), OTHER, "button")

        self.box("div div section dialog", NOTICE_NAMES, inner)

    def form(self) -> None:
        def inner() -> None:
            for _ in range(self.r.randint(0, 3)):
                self.put(f"<label>{self.words(1, 3)}</label> <input name=x>", OTHER, self.r.choice(("p", "div", "fieldset")))
            if self.r.random() < 0.4:
                self.put(self.sentences(1, 2), OTHER, "p")
            self.put(self.words(1, 2), OTHER, "button")

        self.box("form form form div", FORM_NAMES, inner)

    def comments(self) -> None:
        def inner() -> None:
            self.put(self.words(1, 2), OTHER, self.r.choice(("h2", "h3")))
            for _ in range(self.r.randint(1, 5)):
                tag = self.r.choice(("div", "li", "article", "section"))
                self.html.append(f"<{tag}{self.named(COMMENT_NAMES)}>")
                if self.r.random() < 0.6:
                    self.put(self.words(1, 2), OTHER, self.r.choice(("h4", "p", "div")), self.named(META_NAMES))
                for _ in range(self.r.randint(1, 2)):
                    self.put(self.sentences(1, 4), OTHER, "p")
                self.html.append(f"</{tag}>")
            if self.r.random() < 0.3:
                self.form()

        self.box("section div div ol", COMMENT_NAMES, inner)

    def footer(self) -> None:
        def inner() -> None:
            for _ in range(self.r.randint(0, 2)):
                self.links(self.r.randint(1, 5))
            self.put(self.r.choice(("&copy; ", "&copy; 2020 ", "", "")) + self.r.choice((self.words(1, 5), self.sentences(1, 2))) + self.r.choice(("", " &middot; " + self.words(1, 5))), OTHER, self.r.choice(("p", "div", "p")))

        if self.r.random() < 0.4:
            self.put(f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", OTHER, "footer")
        else:
            self.box("footer footer div", FOOTER_NAMES, inner)

    def story(self) -> None:
        r = self.r
        if r.random() < 0.9:
            self.put(r.choice((self.words(2, 12), self.sentences(1, 1))), MAIN, r.choice(("h1", "h1", "h2")))
        for _ in range(r.choice((1, 2, 3, 4, 6, 9, 14))):
            x = r.random()
            if x < 0.72:
                bold = r.random() < 0.15
                self.put(("<b>" if bold else "") + self.sentences(1, r.choice((1, 3, 8, 20))) + ("<br>" if bold else ""), MAIN, "p", closed=not bold and r.random() < 0.9)
            elif x < 0.77:
                self.put(self.words(1, 6), MAIN, r.choice(("h2", "h3")))
            elif x < 0.82:
                self.html.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.put(self.sentences(1, 1), MAIN, "li")
                self.html.append("</ul>")
            elif x < 0.86:
                self.html.append("<blockquote>")
                self.put(self.sentences(1, 3), MAIN, "p")
                self.html.append("</blockquote>")
            elif x < 0.89:
                self.put(f'{self.words(2, 9)} <a href="/x">{self.words(1, 6)}</a> {self.words(1, 9)}.', MAIN, "p")
            elif x < 0.91:
                self.put(self.words(1, 30), MAIN, "pre")
            elif x < 0.93:
                self.html.append("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    self.put(self.words(1, 3), MAIN, "td")
                self.html.append("</tr></table>")
            elif x < 0.96:
                self.ad()
            elif x < 0.98:
                self.box("div div ul", SHARE_NAMES, lambda: self.links(r.randint(2, 4)))
            else:
                r.choice((self.notice, self.form, self.side))()

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.html, self.labels = [], []
        self.html.append(f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
        before = [x for x, p in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.7), (self.ad, 0.5), (self.side, 0.15), (self.form, 0.1)) if r.random() < p]
        after = [x for x, p in ((self.ad, 0.2), (self.side, 0.4), (self.comments, 0.4), (self.form, 0.2), (self.menu, 0.15), (self.footer, 0.85), (self.notice, 0.15)) if r.random() < p]
        for part in before:
            part()
        x = r.random()
        if x < 0.6:
            self.html.append("<article>")
            self.story()
            if r.random() < 0.12:
                self.comments()
            self.html.append("</article>")
        elif x < 0.75:
            self.html.append("<main>")
            self.story()
            self.html.append("</main>")
        elif x < 0.93:
            self.html.append(f"<div{self.named(MAIN_NAMES)}>")
            self.story()
            self.html.append("</div>")
        else:
            self.story()
        for part in after:
            part()
        self.html.append("</body></html>" if r.random() < 0.9 else "")
        return "".join(self.html), self.labels


class Portal(Maker):
    """Pages of another make: plain words, deep and nested layout, layout tables, names in
    compound or meaningless form, teasers of whole sentences, long menus and short stories."""

    def words(self, least: int, most: int) -> str:
        return " ".join(self.r.choice(self.tongue) for _ in range(self.r.randint(least, most)))

    def sentences(self, least: int, most: int) -> str:
        r, out = self.r, []
        for _ in range(r.randint(least, most)):
            s = self.words(4, 26)
            out.append(s[:1].upper() + (s[1:].replace(" ", ", ", 1) if r.random() < 0.5 else s[1:]) + r.choice((".", ".", ".", "?", ":")))
        return " ".join(out)

    def name(self, names: list[str]) -> str:
        r = self.r
        own = r.choice(names)
        kind = r.random()
        if kind < 0.3:
            own = f"{r.choice(('c', 'site', 'page', 'l', 'wp'))}-{own}__{r.choice(('inner', 'wrap', 'item', 'box', 'main'))}"
        elif kind < 0.45:
            own = f"{own} {r.choice(('clearfix', 'row', 'col', 'grid', 'mt'))}-{r.randint(1, 12)}"
        elif kind < 0.6:
            own = "".join(p.capitalize() for p in own.split("-"))
        return f' {r.choice(("class", "class", "id"))}="{own}"'

    def hashed(self) -> str:
        return f' class="{self.r.choice(("sc", "css", "x", "jsx"))}-{self.r.randrange(16**6):06x}"'

    def within(self, inner, depth: int) -> None:
        tags = [self.r.choice(("div", "div", "div", "section")) for _ in range(depth)]
        for t in tags:
            self.html.append(f"<{t}{self.hashed() if self.r.random() < 0.6 else ''}>")
        inner()
        for t in reversed(tags):
            self.html.append(f"</{t}>")

    def region(self, tag: str, names: list[str], inner) -> None:
        plain = tag not in ("div", "section", "td", "ul")
        self.html.append(f"<{tag}{'' if plain and self.r.random() < 0.5 else self.name(names)}>")
        self.within(inner, self.r.randint(0, 3))
        self.html.append(f"</{tag}>")

    def menu_of(self, names: list[str], tag: str) -> None:
        def inner() -> None:
            r = self.r
            lone = r.random() < 0.3
            if not lone:
                self.html.append("<ul>")
            for _ in range(r.randint(3, 14)):
                text = f'<a href="#">{self.words(1, 5)}</a>'
                if lone:
                    self.put(text, OTHER, "div", self.hashed())
                elif r.random() < 0.2:
                    self.html.append("<li>")
                    self.put(text, OTHER, "div")
                    self.html.append("</li>")
                else:
                    self.put(text, OTHER, "li")
            if not lone:
                self.html.append("</ul>")

        self.region(tag, names, inner)

    def top(self) -> None:
        def inner() -> None:
            self.put(f'<a href="/">{self.words(1, 3)}</a>', OTHER, self.r.choice(("div", "h1", "p")))
            if self.r.random() < 0.5:
                self.put(self.words(3, 9), OTHER, "p", self.hashed())
            if self.r.random() < 0.6:
                self.menu_of(MENU_NAMES, self.r.choice(("nav", "div")))
            if self.r.random() < 0.3:
                self.html.append("<form>")
                self.put(self.words(1, 3), OTHER, "button")
                self.html.append("</form>")

        self.region(self.r.choice(("header", "header", "div")), HEADER_NAMES, inner)

    def teasers(self) -> None:
        def inner() -> None:
            if self.r.random() < 0.8:
                self.put(self.words(1, 5), OTHER, self.r.choice(("h2", "h3", "h4", "div")))
            for _ in range(self.r.randint(1, 5)):
                tag = self.r.choice(("div", "li", "article"))
                self.html.append(f"<{tag}{self.hashed()}>")
                self.put(f'<a href="#">{self.words(3, 12)}</a>', OTHER, self.r.choice(("h3", "h4", "div", "p")))
                if self.r.random() < 0.5:
                    self.put(self.sentences(1, 2), OTHER, "p")
                self.html.append(f"</{tag}>")

        self.region(self.r.choice(("aside", "aside", "div", "section")), SIDE_NAMES, inner)

    def talk(self) -> None:
        def inner() -> None:
            self.put(f"{self.r.randint(1, 40)} {self.words(1, 2)}", OTHER, self.r.choice(("h2", "h3", "h4")))
            for _ in range(self.r.randint(1, 6)):
                tag = self.r.choice(("li", "div", "article"))
                self.html.append(f"<{tag}{self.name(COMMENT_NAMES)}>")
                self.put(self.words(1, 3), OTHER, self.r.choice(("div", "div", "h5")), self.name(META_NAMES))
                self.within(lambda: [self.put(self.sentences(1, 5), OTHER, "p") for _ in range(self.r.randint(1, 3))], self.r.randint(0, 1))
                if self.r.random() < 0.4:
                    self.put(f'<a href="#">{self.words(1, 1)}</a>', OTHER, "div")
                self.html.append(f"</{tag}>")

        self.region(self.r.choice(("section", "div", "ol")), COMMENT_NAMES, inner)

    def bottom(self) -> None:
        def inner() -> None:
            for _ in range(self.r.randint(0, 3)):
                self.menu_of(FOOTER_NAMES, "div")
            for _ in range(self.r.randint(1, 3)):
                self.put(self.r.choice(("&copy; 2024 ", "", "", "&#169; ")) + self.r.choice((self.words(2, 8), self.sentences(1, 3))), OTHER, self.r.choice(("p", "div", "div")))

        self.region(self.r.choice(("footer", "footer", "div")), FOOTER_NAMES, inner)

    def bar(self) -> None:
        def inner() -> None:
            self.put(self.sentences(1, 3), OTHER, self.r.choice(("p", "div")))
            for _ in range(self.r.randint(0, 2)):
                self.put(self.words(1, 2), OTHER, "button")

        self.region(self.r.choice(("div", "div", "dialog", "aside")), NOTICE_NAMES, inner)

    def paragraph(self) -> None:
        r = self.r
        text = self.sentences(1, r.choice((1, 2, 4, 9)))
        if r.random() < 0.35:
            words = text.split(" ")
            at = r.randrange(len(words))
            tag, attrs = r.choice((("a", ' href="/x"'), ("em", ""), ("strong", ""), ("code", ""), ("span", self.hashed())))
            words[at] = f"<{tag}{attrs}>{words[at]}</{tag}>"
            text = " ".join(words)
        self.put(text, MAIN, r.choice(("p", "p", "p", "p", "div")), closed=True)

    def story(self) -> None:
        r = self.r
        if r.random() < 0.8:
            self.put(self.words(3, 14), MAIN, r.choice(("h1", "h1", "h2")))
        for _ in range(r.choice((1, 2, 4, 7, 12))):
            x = r.random()
            if x < 0.60:
                self.paragraph()
            elif x < 0.68:
                self.put(self.words(1, 8), MAIN, r.choice(("h2", "h3", "h4")))
            elif x < 0.74:
                tag = r.choice(("ul", "ol"))
                self.html.append(f"<{tag}>")
                for _ in range(r.randint(2, 7)):
                    self.put(r.choice((self.words(2, 9), self.sentences(1, 2))), MAIN, "li")
                self.html.append(f"</{tag}>")
            elif x < 0.77:
                self.html.append("<dl>")
                for _ in range(r.randint(1, 4)):
                    self.put(self.words(1, 3), MAIN, "dt")
                    self.put(self.sentences(1, 1), MAIN, "dd")
                self.html.append("</dl>")
            elif x < 0.80:
                self.html.append("<figure><img src=x>")
                self.put(self.words(4, 16) + ".", MAIN, "figcaption")
                self.html.append("</figure>")
            elif x < 0.83:
                self.html.append("<table><tbody>")
                for _ in range(r.randint(1, 4)):
                    self.html.append("<tr>")
                    for _ in range(r.randint(2, 4)):
                        self.put(self.words(1, 4), MAIN, r.choice(("td", "td", "th")))
                    self.html.append("</tr>")
                self.html.append("</tbody></table>")
            elif x < 0.86:
                self.put(self.sentences(1, 3), MAIN, "blockquote")
            elif x < 0.95:
                self.region("div", AD_NAMES, lambda: self.put(self.sentences(1, 2), OTHER, "p"))
            elif x < 0.98:
                self.menu_of(SHARE_NAMES, "div")
            else:
                self.teasers()

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.tongue = r.choice(PLAIN_WORDS)
        self.html, self.labels = [], []
        self.html.append(f"<!doctype html><html><head><title>{self.words(2, 9)}</title></head><body{self.hashed() if r.random() < 0.5 else ''}>")
        tables = r.random() < 0.12

        def cell(inner, names: list[str]) -> None:
            self.html.append(f"<td{self.name(names)}>")
            inner()
            self.html.append("</td>")

        def body() -> None:
            for part, p in ((self.bar, 0.2), (self.top, 0.8), (lambda: self.menu_of(MENU_NAMES, r.choice(("nav", "div", "div"))), 0.4), (self.teasers, 0.1)):
                if r.random() < p:
                    part()
            if tables:
                self.html.append("<table><tr>")
                cell(lambda: self.menu_of(MENU_NAMES, "div"), SIDE_NAMES)
                cell(self.story, MAIN_NAMES)
                self.html.append("</tr></table>")
            else:
                tag = r.choice(("article", "main", "div", "div", "section"))
                self.html.append(f"<{tag}{self.name(MAIN_NAMES) if tag in ('div', 'section') or r.random() < 0.4 else ''}>")
                self.within(self.story, r.randint(0, 3))
                if r.random() < 0.1:
                    self.talk()
                self.html.append(f"</{tag}>")
            for part, p in ((self.teasers, 0.5), (self.talk, 0.3), (self.form, 0.15), (self.bottom, 0.9), (self.bar, 0.15)):
                if r.random() < p:
                    part()

        self.within(body, r.randint(0, 4))
        self.html.append("</body></html>")
        return "".join(self.html), self.labels


def labelled_pages(n: int, seed: int = 8, makers: tuple[type[Maker], ...] = (Maker, Portal)) -> list[tuple[str, list[int]]]:
    """Pages of the makers in turn."""
    made = [m(seed) for m in makers]
    return [made[i % len(made)].page() for i in range(n)]
