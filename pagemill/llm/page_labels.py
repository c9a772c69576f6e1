"""Labelled web pages to train the page model on: layouts seen on the web, filled with filler words.

Each page is HTML whose ``data-label`` attributes say which elements hold the main text.
"""

from __future__ import annotations

import random

WORDS = (
    "river stone paper window garden letter market silver winter summer morning engine teacher doctor bridge island forest"
    " village station harbour mountain kitchen machine picture number answer question reason moment season"
).split()

#: Class or id values of what is not main text.
OTHER_NAMES = {
    "menu": "menu navbar main-nav site-navigation top-menu breadcrumb breadcrumbs pagination skip-links toolbar tabs".split(),
    "header": "header site-header masthead topbar page-header banner logo branding".split(),
    "footer": "footer site-footer page-footer bottom copyright colophon legal credits".split(),
    "side": "sidebar side widget widget-area rail related recommended more-stories popular trending tags archive left-column".split(),
    "notice": "notice cookie-banner cookie-notice consent gdpr alert message popup modal overlay paywall disclaimer announcement".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion adsbygoogle ad-slot banner-ad".split(),
    "form": "form newsletter subscribe signup search search-form login contact-form".split(),
    "comment": "comments comment comment-list reader-comments responses discussion disqus replies reply feedback".split(),
    "social": "share social sharing social-links follow byline meta author-box print-only toolbar-share".split(),
}
#: Class or id values of what holds the main text.
MAIN_NAMES = (
    "content main main-content post post-content entry entry-content article article-body article-content story story-body"
    " text body-text page-content prose markdown blog-post"
).split()


class _Writer:
    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        text = " ".join(r.choice(WORDS) for _ in range(r.randint(low, high))).capitalize()
        return text + r.choice((".", ".", ".", "", "?"))

    def attribute(self, names) -> str:
        r = self.rng
        if not names or r.random() < 0.1:
            return ""
        return f' {r.choice(("class", "class", "id"))}="{r.choice(names)}"'

    def links(self) -> str:
        r = self.rng
        items = [f'<a href="/{k}">{self.words(1, 2)}</a>' for k in range(r.randint(2, 7))]
        return r.choice(
            (
                "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>",
                "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>",
                " | ".join(items),
                "".join(f"<div>{x}</div>" for x in items),
            )
        )

    def paragraph(self, low: int = 1, high: int = 80) -> str:
        r = self.rng
        text = self.words(low, high)
        if r.random() < 0.2:
            text = r.choice(("<b>{}</b>", "<b>{}<br>", "<em>{}</em>", '<a href="/x">{}</a> ' + self.words(5, 20))).format(text)
        return text

    def body(self) -> str:
        r = self.rng
        parts = [r.choice(("<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "")).format(self.words(2, 10))]
        for _ in range(r.randint(1, 9)):
            parts.append(
                r.choice(
                    (
                        "<p>{}</p>",
                        "<p>{}</p>",
                        "<p>{}</p>",
                        "<p>{}",
                        "<p><b>{}<br>",
                        "<h2>{}</h2>",
                        "<h3>{}</h3>",
                        "<blockquote><p>{}</p></blockquote>",
                        "<ul><li>{}</li><li>{}</li></ul>",
                        "<ol><li>{}<li>{}</ol>",
                        "<pre>{}</pre>",
                        "<table><tr><td>{}</td><td>{}</td></tr></table>",
                        "<figure><img src=x><figcaption>{}</figcaption></figure>",
                        "<div>{}</div>",
                        "<section><h2>{}</h2><p>{}</p></section>",
                        "{}",
                        "<dl><dt>{}</dt><dd>{}</dd></dl>",
                    )
                ).replace("{}", "\x00")
            )
            while "\x00" in parts[-1]:
                parts[-1] = parts[-1].replace("\x00", self.paragraph(1, 12) if r.random() < 0.25 else self.paragraph(), 1)
            if r.random() < 0.12:
                parts.append(self.other(r.choice(("advert", "side", "form", "social", "notice"))))
        if r.random() < 0.25:
            parts.append(self.other("comment"))
        return "".join(parts)

    def other(self, kind: str) -> str:
        r = self.rng
        name = self.attribute(OTHER_NAMES[kind])
        if kind == "menu":
            tag, inner = r.choice((("nav", self.links()), ("nav", self.links()), ("div", self.links()), ("menu", self.links())))
        elif kind == "header":
            tag = r.choice(("header", "header", "div"))
            inner = r.choice(("<h1>{}</h1>", "<div>{}</div>", "<p>{}</p>", "{}")).format(self.words(1, 6))
            inner += self.links() if r.random() < 0.5 else ""
        elif kind == "footer":
            tag = r.choice(("footer", "footer", "div"))
            inner = r.choice(("&copy; {}", "<p>&copy; {}</p>", "<div>{}</div>")).format(self.words(2, 25))
            inner += self.links() if r.random() < 0.4 else ""
        elif kind == "side":
            tag = r.choice(("aside", "aside", "div", "section"))
            inner = r.choice(("<h3>{}</h3>", "<h2>{}</h2>", "")).format(self.words(1, 4))
            inner += self.links() if r.random() < 0.6 else f"<p>{self.words(4, 40)}</p>"
        elif kind == "form":
            tag = r.choice(("form", "form", "div"))
            inner = f"<label>{self.words(1, 4)}</label><input><select><option>{self.words(1, 1)}<option>{self.words(1, 1)}</select>"
            inner += f"<p>{self.words(3, 20)}</p><textarea>{self.words(1, 4)}</textarea><button>{self.words(1, 2)}</button>"
            if tag == "div":
                inner = f"<form>{inner}</form>"
        elif kind == "comment":
            tag = r.choice(("section", "div", "ol", "ul"))
            each = {"ol": "li", "ul": "li"}.get(tag) or r.choice(("div", "article", "p"))
            own = r.choice(("comment", "reply", "comment-body", "response"))
            inner = r.choice(("<h2>{}</h2>", "<h3>{}</h3>", "")).format(self.words(1, 3)) if each != "li" else ""
            for _ in range(r.randint(1, 4)):
                text = self.words(3, 60)
                inner += f'<{each} class="{own}">' + (text if each == "p" or r.random() < 0.4 else f"<p>{text}</p>") + f"</{each}>"
            name = name or f' class="{r.choice(OTHER_NAMES["comment"])}"'
        else:
            tag = r.choice(("div", "div", "p", "aside", "section"))
            inner = self.words(2, 30)
            if tag != "p" and r.random() < 0.4:
                inner = f"<p>{inner}</p>"
            name = name or f' class="{r.choice(OTHER_NAMES[kind])}"'
        return f'<{tag}{name} data-label="0">{inner}</{tag}>'

    def page(self) -> str:
        r = self.rng
        tag, named = r.choice((("article", 0.3), ("article", 0.3), ("article", 0.3), ("main", 0.3), ("div", 1.0), ("section", 1.0), ("td", 1.0)))
        name = self.attribute(MAIN_NAMES) if r.random() < named else ""
        if tag in ("div", "section", "td") and not name:
            name = f' class="{r.choice(MAIN_NAMES)}"'
        main = f'<{tag}{name} data-label="1">{self.body()}</{tag}>'
        if r.random() < 0.3:
            main = f"<main>{main}</main>"
        before = [k for k in ("notice", "header", "menu", "menu", "form", "advert", "side") if r.random() < 0.45]
        after = [k for k in ("side", "advert", "social", "comment", "form", "menu") if r.random() < 0.35] + ["footer"] * (r.random() < 0.85)
        middle = "".join(self.other(k) for k in before[2:]) + main + "".join(self.other(k) for k in after[:-1])
        if tag == "td":
            middle = f"<table><tr><td>{self.other('menu')}</td>{main}</tr></table>"
        elif r.random() < 0.4:
            middle = f"<div{self.attribute(('wrapper', 'container', 'page', 'row', 'layout'))}>{middle}</div>"
        lead, end = "".join(self.other(k) for k in before[:2]), "".join(self.other(k) for k in after[-1:])
        head = f"<head><title>{self.words(2, 8)}</title><script>x</script></head>" if r.random() < 0.9 else ""
        extra = f"<noscript>{self.words(3, 8)}</noscript>" if r.random() < 0.15 else ""
        return f'<html data-label="0">{head}<body>{extra}{lead}{middle}{end}</body></html>'


def labelled_pages(count: int = 260, seed: int = 1) -> list[str]:
    """So many labelled pages; the same for the same seed."""
    writer = _Writer(seed)
    return [writer.page() for _ in range(count)]
