"""Labelled pages to train the extraction model on.

Layouts written by hand, filled with invented sentences.  What is an article's
text is marked by ``data-main`` on an element around it; the mark is a label and
never a feature.
"""

from __future__ import annotations

import random

_SYLLABLES = "an ar be der en ing la lo mi no or per qu re sa sch ti tion un ver vo wh".split()


def _words(rng: random.Random, count: int) -> str:
    words = ["".join(rng.choices(_SYLLABLES, k=rng.choice((1, 1, 2, 2, 3)))) for _ in range(count)]
    return " ".join(words)


def _sentence(rng: random.Random, least: int = 3, most: int = 14) -> str:
    end = rng.choice("..... ?!").strip()
    return _words(rng, rng.randint(least, most)).capitalize() + end


def _text(rng: random.Random) -> str:
    return " ".join(_sentence(rng) for _ in range(rng.choice((1, 1, 2, 4, 8))))


def _links(rng: random.Random, tag: str = "li") -> str:
    return "".join(
        f'<{tag}><a href="/{i}">{_words(rng, rng.randint(1, 3))}</a></{tag}>' for i in range(rng.randint(3, 8))
    )


def _title(rng: random.Random) -> str:
    return _words(rng, rng.randint(2, 9)).capitalize() + rng.choice(("", "."))


# Words that pages use in class names and ids, by what the element holds.
_AD = "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion commercial".split()
_NOTICE = (
    "cookie notice consent alert gdpr popup subscribe newsletter signup announcement warning message modal banner "
    "disclaimer"
).split()
_NAV = "menu nav navbar navigation breadcrumb breadcrumbs topnav toolbar tabs pagination toc links".split()
_SIDE = "sidebar side widget related recommended more popular trending tags share social author bio profile".split()
_COMMENT = "comment comments commentlist replies reply discussion responses reviews feedback thread".split()
_FOOT = "footer bottom copyright legal colophon credits".split()
_HEAD = "header masthead top branding logo".split()
_MAIN = "content post entry story main article text body page".split()
_BEFORE = "site page reader post main top user".split()
_BEHIND = "box block wrapper area content body inner list item top section bar".split()


def _named(rng: random.Random, words: list[str]) -> str:
    """A class or id attribute with one of the words, alone or in a compound."""
    word = rng.choice(words)
    form = rng.random()
    if form < 0.2:
        word = f"{word}-{rng.choice(_BEHIND)}"
    elif form < 0.35:
        word = f"{rng.choice(_BEFORE)}-{word}"
    return f'{rng.choice(("class", "class", "id"))}="{word}"'


def _blocks(rng: random.Random, mark: str) -> list[str]:
    """Blocks of an article; ``mark`` labels them where no element around does."""
    level = rng.choice(("h1", "h1", "h2"))
    title = f"<{level}{mark}>{_title(rng)}</{level}>"
    out = [f"<header>{title}</header>" if rng.random() < 0.12 else title]
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        if kind < 0.62:
            out.append(f"<p{mark}>{_text(rng)}</p>")
        elif kind < 0.70:
            out.append(f"<p{mark}><b>{_sentence(rng)}<br><p{mark}>{_text(rng)}</p>")
        elif kind < 0.76:
            out.append(f"<h3{mark}>{_title(rng)}</h3><p{mark}>{_text(rng)}")
        elif kind < 0.82:
            items = "".join(f"<li{mark}>{_sentence(rng)}</li>" for _ in range(rng.randint(2, 5)))
            out.append(f"<{(tag := rng.choice(('ul', 'ol')))}>{items}</{tag}>")
        elif kind < 0.87:
            out.append(f"<blockquote{mark}><p{mark}>{_text(rng)}</p></blockquote>")
        elif kind < 0.91:
            row = "".join(f"<td{mark}>{_words(rng, 2)}</td>" for _ in range(3))
            out.append(f"<table><tr>{row}</tr><tr>{row}</tr></table>")
        elif kind < 0.95:
            out.append(f'<p{mark}>{_sentence(rng)} <a href="/x">{_words(rng, 3)}</a> {_sentence(rng)}</p>')
        else:
            out.append(f"<pre{mark}>{_words(rng, 12)}</pre>")
    return out


def _inside(rng: random.Random) -> str:
    """What stands within an article's element without being its text."""
    return rng.choice(
        (
            f"<div {_named(rng, _AD)}>{_sentence(rng)}</div>",
            f"<div {_named(rng, _AD)}><p>{_text(rng)}</p></div>",
            f"<aside><h4>{_title(rng)}</h4><ul>{_links(rng)}</ul></aside>",
            f"<div {_named(rng, _SIDE)}><p>{_sentence(rng)}</p></div>",
            f'<div class="share"><button>{_words(rng, 1)}</button><button>{_words(rng, 2)}</button></div>',
            f'<form><label>{_words(rng, 2)}</label><input type="text"><button>{_words(rng, 1)}</button></form>',
            f"<div {_named(rng, _NOTICE)}><p>{_sentence(rng)}</p></div>",
            f'<nav class="toc">{_links(rng, "p")}</nav>',
        )
    )


def _article(rng: random.Random) -> str:
    if rng.random() < 0.4:
        tag = rng.choice(("article", "article", "main"))
        return f"<{tag} data-main>{''.join(_blocks(rng, ''))}</{tag}>"
    blocks = _blocks(rng, " data-main")
    for _ in range(rng.choice((0, 1, 2, 3))):
        blocks.insert(rng.randint(1, len(blocks)), _inside(rng))
    end = rng.choice(
        (
            "",
            "",
            f"<footer>{_sentence(rng)}</footer>",
            f"<section {_named(rng, _COMMENT)}><h3>{_title(rng)}</h3><div><p>{_text(rng)}</p></div></section>",
        )
    )
    body = "".join(blocks) + end
    shape = rng.choice(("article", "main", "section", "div", "named", "named", "both"))
    if shape == "named":
        return f"<div {_named(rng, _MAIN)}>{body}</div>"
    if shape == "both":
        return f"<main><article><div {_named(rng, _MAIN)}>{body}</div></article></main>"
    return f"<{shape}>{body}</{shape}>"


def _before(rng: random.Random) -> str:
    nav = rng.choice(
        (
            f"<nav><ul>{_links(rng)}</ul></nav>",
            f"<div {_named(rng, _NAV)}>{_links(rng, 'span')}</div>",
            f"<ul {_named(rng, _NAV)}>{_links(rng)}</ul>",
            f"<div {_named(rng, _NAV)}><ul><li>{_words(rng, 1)}</li><li>{_words(rng, 2)}</li></ul></div>",
            f'<div role="navigation"><p>{_words(rng, 2)}</p><ul>{_links(rng)}</ul></div>',
        )
    )
    head = rng.choice(
        (
            "",
            f"<header><h1>{_title(rng)}</h1><p>{_sentence(rng)}</p></header>",
            f"<div {_named(rng, _HEAD)}><h2>{_title(rng)}</h2>{_sentence(rng)}</div>",
            f'<header {_named(rng, _HEAD)}><a href="/">{_words(rng, 2)}</a><p>{_sentence(rng)}</p></header>',
        )
    )
    return rng.choice((head + nav, nav + head, nav)) + _between(rng)


def _between(rng: random.Random) -> str:
    return "".join(
        rng.sample(
            (
                f"<!-- ad --><div {_named(rng, _AD)}>{_text(rng)}</div>",
                f"<div {_named(rng, _AD)}><p>{_text(rng)}</p></div>",
                f"<div {_named(rng, _NOTICE)}><p>{_text(rng)}</p><button>{_words(rng, 1)}</button></div>",
                f"<div {_named(rng, _NOTICE)}>{_sentence(rng)}</div>",
                f'<form action="/s"><label>{_words(rng, 2)}</label><select><option>{_words(rng, 1)}<option>{_words(rng, 1)}</select><button>{_words(rng, 1)}</button></form>',
            ),
            k=rng.choice((0, 1, 1, 2)),
        )
    )


def _after(rng: random.Random) -> str:
    side = rng.choice(
        (
            "",
            f"<aside><h3>{_title(rng)}</h3><p>{_text(rng)}</p><ul>{_links(rng)}</ul></aside>",
            f"<div {_named(rng, _SIDE)}><h3>{_title(rng)}</h3><p>{_text(rng)}</p>{_links(rng, 'p')}</div>",
            f"<section {_named(rng, _SIDE)}><h3>{_title(rng)}</h3><p>{_text(rng)}</p></section>",
        )
    )
    comments = rng.choice(
        (
            "",
            f"<section {_named(rng, _COMMENT)}><h2>{_title(rng)}</h2>"
            + "".join(
                f"<div {_named(rng, _COMMENT)}><p>{_words(rng, 1)}</p><p>{_text(rng)}</p></div>"
                for _ in range(rng.randint(1, 4))
            )
            + "</section>",
            f"<div {_named(rng, _COMMENT)}><article {_named(rng, _COMMENT)}><p>{_text(rng)}</p></article><ol><li><p>{_text(rng)}</p></li></ol></div>",
            f"<ul {_named(rng, _COMMENT)}><li>{_text(rng)}</li><li><p>{_text(rng)}</p></li></ul>",
        )
    )
    foot = rng.choice(
        (
            f"<footer>&copy; {_words(rng, 2)} &middot; {_sentence(rng)}</footer>",
            f"<footer><p>{_sentence(rng)}</p><ul>{_links(rng)}</ul></footer>",
            f"<div {_named(rng, _FOOT)}><p>{_text(rng)}</p>&copy; {_words(rng, 1)}</div>",
            f"<div {_named(rng, _FOOT)}>{_sentence(rng)}</div>",
        )
    )
    return "".join(rng.sample((side, comments, _between(rng)), k=3)) + foot


def labelled_pages(count: int = 800, seed: int = 7) -> list[str]:
    """Pages in all combinations of the layouts, the same for the same seed."""
    rng = random.Random(seed)
    pages = []
    for _ in range(count):
        if rng.random() < 0.06:
            page = "".join(f"<p data-main>{_text(rng)}</p>" for _ in range(rng.randint(1, 5)))
            pages.append(rng.choice((page, f"<html><body>{page}</body></html>", f"<body data-main>{_text(rng)}</body>")))
            continue
        side_first = _after(rng) if rng.random() < 0.1 else ""
        end = rng.choice(("</body></html>", ""))
        pages.append(f"<!DOCTYPE html><html><body>{_before(rng)}{side_first}{_article(rng)}{_after(rng)}{end}")
    return pages
