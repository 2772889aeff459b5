"""Labelled pages for the extraction model: small layouts, drawn from a seed, with every block's label known.

Each page is a list of ``(html, label)`` parts in page order; label 1 marks a
part whose blocks are main text, 0 one whose blocks are not, None markup without text.
"""

from __future__ import annotations

import random

SYLLABLES = ("an", "be", "co", "dar", "el", "fi", "gor", "hu", "in", "ja", "kel", "lo", "mi", "nen", "or", "pa", "que", "ri", "so", "tu")
#: Class or id names of page parts.
MENUS = ("nav", "menu", "navbar", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "navigation", "site-nav", "pagination", "pager", "tabs")
HEADERS = ("header", "site-header", "masthead", "top-bar", "banner", "branding", "logo")
FOOTERS = ("footer", "site-footer", "foot", "copyright", "bottom", "legal", "credits", "colophon")
SIDES = ("sidebar", "side", "aside", "widget", "related", "related-posts", "recommended", "more-stories", "trending", "tags", "tag-list", "author-box")
NOTICES = ("cookie", "cookie-banner", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "disclaimer", "paywall", "message-bar")
ADVERTS = ("ad", "ads", "advert", "advertisement", "adsbox", "sponsored", "sponsor", "promo", "promotion", "banner-ad", "ad-slot", "commercial")
FORMS = ("form", "search", "search-box", "login", "signup", "newsletter", "subscribe", "subscription", "contact-form")
COMMENTS = ("comments", "comment", "comment-list", "disqus", "replies", "responses", "discussion", "user-comments", "comment-body")
SHARING = ("share", "social", "sharing", "social-links", "share-buttons", "print", "toolbar", "follow")
BODIES = ("content", "article", "post", "entry", "entry-content", "article-body", "post-content", "story", "main", "text", "body-text", "page-content", "main-content")


def _words(dice: random.Random, least: int, most: int) -> str:
    words = ["".join(dice.choices(SYLLABLES, k=dice.randint(1, 3))) for _ in range(dice.randint(least, most))]
    words[0] = words[0].capitalize()
    for at in range(8, len(words), 9):
        words[at] += dice.choice([",", ".", ";", ""])
    return " ".join(words)


def _name(dice: random.Random, names: tuple[str, ...]) -> str:
    return f' {dice.choice(["class", "class", "id"])}="{dice.choice(names)}"'


def _chrome(dice: random.Random, tag: str, names: tuple[str, ...]) -> str:
    """A part that is not main text, by its tag, its name, or both."""
    own = tag if dice.random() < 0.5 else dice.choice(["div", "section", "div"])
    named = _name(dice, names) if own != tag or tag in ("div", "section") or dice.random() < 0.5 else ""
    inner = dice.choice(("links", "links", "text", "text", "mixed", "long"))
    links = "".join(f'<li><a href="/{n}">{_words(dice, 1, 3)}</a></li>' for n in range(dice.randint(2, 7)))
    text = f"<p>{_words(dice, 2, 20)}</p>" if dice.random() < 0.5 else _words(dice, 3, 25)
    body = {"links": f"<ul>{links}</ul>", "text": text, "mixed": f"<h3>{_words(dice, 1, 3)}</h3>{text}<ul>{links}</ul>",
            "long": "".join(f"<p>{_words(dice, 20, 70)}</p>" for _ in range(dice.randint(1, 4)))}[inner]
    return f"<{own}{named}>{body}</{own}>"


def _main(dice: random.Random) -> str:
    """Main text: mostly paragraphs, also headings, lists, tables, quotes, short or linked lines."""
    def one() -> str:
        kind = dice.random()
        if kind < 0.6:
            text = _words(dice, 1, 120)
            if dice.random() < 0.2:
                text += f' <a href="/x">{_words(dice, 1, 3)}</a> ' + _words(dice, 2, 20)
            if dice.random() < 0.15:
                text = text.replace(" ", dice.choice([" | ", "&&& ", " # "]))
            text += dice.choice([".", ".", "!", "", ""])
            return dice.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>"])
        if kind < 0.75:
            return f"<h{dice.randint(1, 4)}>{_words(dice, 1, 9)}</h2>"
        if kind < 0.85:
            return "<ul>" + "".join(f"<li>{_words(dice, 1, 15)}</li>" for _ in range(dice.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{_words(dice, 5, 30)}</blockquote>"
        cells = "".join(f"<tr><td>{_words(dice, 1, 3)}</td><td>{dice.randint(1, 99)}</td></tr>" for _ in range(3))
        return dice.choice([f"<table>{cells}</table>", f"<pre>{_words(dice, 5, 20)}</pre>"])

    return "".join(one() for _ in range(dice.randint(1, 9)))


def page(dice: random.Random) -> list[tuple[str, int | None]]:
    """One page."""
    before = [("nav", MENUS), ("header", HEADERS), ("div", NOTICES), ("div", ADVERTS), ("form", FORMS), ("aside", SIDES), ("div", SHARING)]
    inside = [("div", ADVERTS), ("aside", SIDES), ("div", SHARING), ("form", FORMS), ("div", NOTICES), ("nav", MENUS)]
    after = [("section", COMMENTS), ("aside", SIDES), ("footer", FOOTERS), ("div", ADVERTS), ("form", FORMS), ("div", NOTICES), ("nav", MENUS)]
    parts: list[tuple[str, int | None]] = []
    for tag, names in dice.sample(before, dice.randint(1, 4)):
        parts.append((_chrome(dice, tag, names), 0))
    shell = dice.choice(["article", "article", "main", "div", "section", "td", ""])
    named = _name(dice, BODIES) if shell in ("div", "section", "td") or dice.random() < 0.3 else ""
    parts.append((f"<{shell}{named}>" if shell else "", None))
    parts.append((f"<h1>{_words(dice, 1, 12)}</h1>", 1))
    for _ in range(dice.randint(1, 3)):
        parts.append((_main(dice), 1))
        if dice.random() < 0.35:
            parts.append((_chrome(dice, *dice.choice(inside)), 0))
    if dice.random() < 0.25:
        parts.append((_chrome(dice, "section", COMMENTS), 0))
    parts.append((f"</{shell}>" if shell else "", None))
    for tag, names in dice.sample(after, dice.randint(1, 4)):
        parts.append((_chrome(dice, tag, names), 0))
    if dice.random() < 0.6:
        parts.append((f"<footer>&copy; {_words(dice, 1, 2)} &middot; {_words(dice, 2, 20)}</footer>", 0))
    return parts


def pages(n: int, seed: int = 5) -> list[list[tuple[str, int | None]]]:
    dice = random.Random(seed)
    return [page(dice) for _ in range(n)]
