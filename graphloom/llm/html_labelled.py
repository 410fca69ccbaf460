"""Labelled pages to learn content marginals from: composed by rule from page parts, with the wanted text marked.

`label="1"` on an element says that it and what it holds is content, `label="0"` that it is not; the nearest mark
counts, and without one an element is not content. The marks are taken off before features are read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

SYLLABLES = ("an", "ber", "con", "de", "er", "ful", "gen", "hol", "is", "ka", "lo", "men", "no", "or", "pre", "qui", "ra", "st", "ti", "un", "ver", "wa", "ya", "zu")


#: Words of the made-up text, from which nothing about real words is to be learned.
MADE_UP = re.compile(f"(?:{'|'.join(SYLLABLES)})+")


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def sentences(rng: random.Random, n: int) -> str:
    return " ".join(words(rng, rng.randint(4, 16)).capitalize() + rng.choice("..!?") for _ in range(n))


def links(rng: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{rng.randint(1, 99)}">{words(rng, rng.randint(1, 3))}</a></li>' for _ in range(n))


def odd_text(rng: random.Random) -> str:
    """Text that is no plain sentences: shouted, without marks, numbers, signs, one line again and again."""
    n = rng.randint(3, 90)
    return rng.choice((
        lambda: " ".join(w.upper() + "!!" for w in words(rng, n).split()), lambda: words(rng, n), lambda: " ".join(str(rng.randint(0, 99_999)) for _ in range(n)),
        lambda: " ".join(rng.choice(("#", "@@", "...", "--", "=>", words(rng, 1))) for _ in range(n)), lambda: " ".join([words(rng, rng.randint(1, 6)) + "."] * rng.randint(2, 12)), lambda: ", ".join(words(rng, n).split()),
    ))()


def paragraphs(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        kind = rng.random()
        text = words(rng, rng.randint(1, 4)) + "." if kind < 0.2 else odd_text(rng) if rng.random() < 0.12 else sentences(rng, rng.randint(1, 6))
        if kind > 0.9:
            out.append(f"<ul>{''.join(f'<li>{sentences(rng, 1)}</li>' for _ in range(rng.randint(2, 5)))}</ul>")
        elif kind > 0.85:
            out.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind > 0.8:
            out.append(f"<h2>{words(rng, 3)}</h2>")
        elif kind > 0.75:
            out.append(f"<pre>{text}</pre>")
        elif kind > 0.7:
            out.append(f"<table><tr><th>{words(rng, 1)}</th><td>{words(rng, 4)}</td></tr></table>")
        elif kind > 0.6:
            out.append(f'<p>{text} <a href="/x">{words(rng, 2)}</a> {words(rng, 3)}</p>')
        elif kind > 0.5:
            out.append(rng.choice((f"<p><b>{text}</b><br>", f"<p><b>{text}<br></b></p>", f"<p><i>{text}</i></p>", f"<p><b>{text}</b></p>")))
        else:
            out.append(f"<p>{text}</p>")
    return "".join(out)


def heading(rng: random.Random) -> str:
    tag = rng.choice(("h2", "h3", "h4"))
    return f"<{tag}>{words(rng, rng.randint(1, 3))}</{tag}>"


def comment(rng: random.Random) -> str:
    tag = rng.choice(("div", "li", "article"))
    return f'<{tag} class="comment"><p class="author">{words(rng, 1)}</p><p>{sentences(rng, rng.randint(1, 4))}</p></{tag}>'


#: Page parts that are not content.
PARTS = (
    lambda r: f"<nav><ul>{links(r, r.randint(3, 8))}</ul></nav>",
    lambda r: f'<div class="{r.choice(("menu", "navbar", "nav", "main-menu", "breadcrumb", "breadcrumbs"))}"><ul>{links(r, r.randint(2, 8))}</ul></div>',
    lambda r: f'<header><a href="/">{words(r, 2)}</a><p>{words(r, r.randint(2, 6))}</p></header>',
    lambda r: f"<header><h1>{words(r, r.randint(1, 4))}</h1>{'<p>' + sentences(r, 1) + '</p>' if r.random() < 0.5 else ''}</header>",
    lambda r: f'<div id="{r.choice(("header", "masthead", "banner", "top"))}">{heading(r)}<p>{words(r, 4)}</p></div>',
    lambda r: f"<footer>&copy; {words(r, 2)} &middot; {sentences(r, r.randint(1, 3))}</footer>",
    lambda r: f'<div class="{r.choice(("footer", "site-footer", "copyright", "legal"))}"><p>{sentences(r, r.randint(1, 3))}</p></div>',
    lambda r: f'<aside>{heading(r)}<p>{sentences(r, r.randint(1, 4))}</p><ul>{links(r, 3)}</ul></aside>',
    lambda r: f'<div class="{r.choice(("sidebar", "related", "widget", "recommended", "popular", "side", "rail"))}">{heading(r)}<ul>{links(r, 4)}</ul><p>{sentences(r, r.randint(1, 2))}</p></div>',
    lambda r: f'<div class="{r.choice(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad"))}">{sentences(r, r.randint(1, 3))}</div>',
    lambda r: f'<div class="{r.choice(("ad", "ads", "advert", "ad-slot"))}">{" ".join(words(r, 1) + "." for _ in range(r.randint(1, 5)))}</div>',
    lambda r: f'<div class="{r.choice(("ad", "promo", "sponsored", "advert"))}"><p>{sentences(r, r.randint(1, 4))}</p><a href="/buy">{words(r, 2)}</a></div>',
    lambda r: f'<ins class="ads">{words(r, 8)}</ins>',
    lambda r: f'<div class="{r.choice(("cookie", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal", "paywall"))}"><p>{sentences(r, r.randint(1, 4))}</p><button>{words(r, 1)}</button></div>',
    lambda r: f'<div role="{r.choice(("alert", "dialog", "banner", "navigation", "complementary", "search", "contentinfo"))}"><p>{sentences(r, r.randint(1, 3))}</p></div>',
    lambda r: f'<form action="/s"><label>{words(r, 2)}</label><input name="q"><select><option>{words(r, 1)}<option>{words(r, 1)}</select><textarea>{words(r, 3)}</textarea><button>{words(r, 1)}</button></form>',
    lambda r: f'<div class="{r.choice(("newsletter", "subscribe", "signup", "login"))}"><form><p>{sentences(r, 1)}</p><input></form></div>',
    lambda r: f'<div class="{r.choice(("share", "social", "tags", "meta", "byline", "pager", "pagination"))}">{"".join(f"<a href=/s>{words(r, 1)}</a> " for _ in range(4))}</div>',
    lambda r: f'<section class="{r.choice(("comments", "comment-list", "discussion", "responses", "replies", "disqus"))}">{heading(r)}{"".join(comment(r) for _ in range(r.randint(1, 5)))}</section>',
    lambda r: f'<div id="comments"><ol>{"".join(comment(r) for _ in range(r.randint(1, 4)))}</ol></div>',
    lambda r: f"<noscript><p>{sentences(r, 1)}</p></noscript>",
)
#: The same things under other names, in other languages, as tables and as bare elements.
HEADS = ("Comments", "Kommentare", "Comentarios", "Commentaires", "Leave a reply", "Responses", "Was denkst du", "Reader comments", "Discussion", "Antworten")
PARTS += (
    lambda r: f'<div id="{r.choice(("nav", "navigation", "menue", "menu", "mainnav"))}">{"".join(f"<a href=/{r.randint(1, 99)}>{words(r, r.randint(1, 2))}</a>{r.choice((' ', ' | ', '<br>'))}" for _ in range(r.randint(3, 8)))}</div>',
    lambda r: f'<div>{"".join(f"<a href=/{r.randint(1, 99)}>{words(r, r.randint(1, 2))}</a> " for _ in range(r.randint(3, 9)))}</div>',
    lambda r: f"<ul>{links(r, r.randint(1, 9))}</ul>",
    lambda r: f'<div class="{r.choice(("menu", "nav", "links"))}"><ul>{links(r, r.randint(1, 3))}</ul></div>',
    lambda r: f"<nav>{' '.join(f'<a href=/{r.randint(1, 99)}>{words(r, 1)}</a>' for _ in range(r.randint(1, 4)))}</nav>",
    lambda r: r.choice(("<br>", " ", "<br>\n")).join(f"<a href=/{r.randint(1, 99)}>{words(r, r.randint(1, 2))}</a>" for _ in range(r.randint(2, 7))),
    lambda r: f"<p>{' | '.join(f'<a href=/{r.randint(1, 99)}>{words(r, 1)}</a>' for _ in range(r.randint(3, 7)))}</p>",
    lambda r: f"<table><tr>{''.join(f'<td><a href=/{r.randint(1, 99)}>{words(r, 1)}</a></td>' for _ in range(r.randint(3, 7)))}</tr></table>",
    lambda r: f"<div>{r.choice(('Last updated', 'Copyright', '&copy;', 'Impressum', 'Stand', 'Derechos reservados', 'Mentions'))} {r.randint(1995, 2030)} {words(r, r.randint(1, 4))}</div>",
    lambda r: f"<p>{r.choice(('Last updated', 'Last modified', 'Copyright', '&copy;', 'Posted by', 'Contact', 'Seite zuletzt'))} {words(r, r.randint(1, 4))} {r.randint(1995, 2030)}</p>",
    lambda r: f"<hr><p><small>{r.choice(('Last updated', 'Copyright', '&copy;'))} {r.randint(1995, 2030)} {words(r, r.randint(1, 5))}</small></p>",
    lambda r: f'<div class="{r.choice(("werbung", "anzeige", "publicidad", "publicite", "reklame", "sponsor"))}"><p>{sentences(r, r.randint(1, 3))}</p></div>',
    lambda r: f'<div>{sentences(r, 1)} <a href="/buy">{words(r, 2)}</a></div>',
    lambda r: f'<section id="{r.choice(("respond", "kommentare", "comentarios", "commentaires", "disqus_thread", "reviews", "forum", "antworten", "avis"))}"><h3>{r.choice(HEADS)}</h3>{"".join(comment(r) for _ in range(r.randint(1, 4)))}</section>',
    lambda r: f'<div><h3>{r.choice(HEADS)}</h3>{"".join(f"<div><b>{words(r, 1)}</b><p>{sentences(r, r.randint(1, 2))}</p></div>" for _ in range(r.randint(1, 5)))}</div>',
    lambda r: f'<section><h4>{r.randint(1, 90)} {r.choice(HEADS)}</h4><ul>{"".join(f"<li><i>{words(r, 2)}</i> {sentences(r, r.randint(1, 2))}</li>" for _ in range(r.randint(1, 5)))}</ul></section>',
    lambda r: f"<div><p>{r.choice(('We use cookies.', 'Diese Seite verwendet Cookies.', 'Usamos cookies.', 'Nous utilisons des cookies.'))} {words(r, 4)}</p><button>OK</button></div>",
)
#: Those that are one element, as they may stand inside the text.
WRAPPED = tuple(p for p in PARTS if not p(random.Random(0)).startswith(("<hr", "<a ")))
#: Where content stands.
ROOTS = ("<article{m}>{t}</article>", "<main><article{m}>{t}</article></main>", "<main{m}>{t}</main>", '<div class="content"{m}>{t}</div>', '<div class="wrapper"><div class="post"{m}>{t}</div></div>', '<div id="main"><section class="story"{m}>{t}</section></div>', '<div class="article-body"{m}>{t}</div>', '<div role="main"{m}>{t}</div>', "<div{m}>{t}</div>", '<div class="page"><div class="entry-content"{m}>{t}</div></div>', "<article{m}><section>{t}</section></article>", '<article class="post"{m}><div class="body">{t}</div></article>')


ROOTS += ('<div><div class="t"{m}>{t}</div></div>', '<div class="x1"><div{m}>{t}</div></div>', "<section{m}>{t}</section>", "<center><div{m}>{t}</div></center>", '<div class="artikel"{m}>{t}</div>', '<div class="contenido"{m}>{t}</div>', '<div id="inhalt"><div{m}>{t}</div></div>', '<div class="texte"{m}>{t}</div>')
NAMES = re.compile(r"""\b(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""")


def divided(rng: random.Random, body: str) -> str:
    """Paragraphs as bare `div`s or lines, as old and machine-made pages have them."""
    way = rng.random()
    if way < 0.5:
        return body.replace("<p>", "<div>").replace("</p>", "</div>")
    return body.replace("<p>", "").replace("</p>", rng.choice(("<br><br>", "<br/><br/>", "<p>")))


def renamed(rng: random.Random, page: str) -> str:
    """The page with each name replaced by a made-up one, the same for the same, or without names."""
    if rng.random() < 0.4:
        return NAMES.sub("", page)
    known: dict[str, str] = {}
    return NAMES.sub(lambda m: f'{m[1]}="{known.setdefault(m[2], "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 6))))}"', page)


def labelled_pages(n: int = 1200, seed: int = 11) -> Iterator[str]:
    """`n` pages with marks; the same ones for the same seed. Of half of them names are made up or missing."""
    for i in range(n):
        rng = random.Random(f"{seed}-{i}")
        part = lambda: rng.choice(PARTS)(rng)  # noqa: B023, E731
        long_ = rng.random()
        text = paragraphs(rng, rng.randint(20, 70)) if long_ < 0.04 else "".join(f"<p>{sentences(rng, rng.randint(20, 90))}</p>" for _ in range(rng.randint(1, 3))) if long_ < 0.1 else paragraphs(rng, rng.randint(1, 12))
        body = f"<h1>{words(rng, rng.randint(1, 9))}</h1>" * (rng.random() < 0.8) + text
        if rng.random() < 0.25:
            body = divided(rng, body)
        if rng.random() < 0.4:
            inner = rng.choice(WRAPPED)(rng)
            tag, rest = inner[1:].split(" ", 1) if inner.split(">", 1)[0].count(" ") else inner[1:].split(">", 1)
            marked = f'<{tag} label="0"' + (" " + rest if inner.split(">", 1)[0].count(" ") else ">" + rest)
            body = body + marked if rng.random() < 0.5 else marked + body
        shape = rng.random()
        before, after = [part() for _ in range(rng.randint(0, 4))], [part() for _ in range(rng.randint(0, 5))]
        if shape < 0.1:
            # The text straight in the page, without an element of its own.
            head = rng.choice(('<h1 label="1">{}</h1>', '<center><h1 label="1">{}</h1></center>', '<h2 label="1">{}</h2><hr>', "")).format(words(rng, rng.randint(2, 7)))
            main = head + "".join(rng.choice(('<p label="1">{}</p>', '<p label="1">{}</p>', '<ul label="1"><li>{}</li></ul>', '<div label="1">{}</div>')).format(sentences(rng, rng.randint(1, 6))) for _ in range(rng.randint(1, 6)))
            if rng.random() < 0.25:
                main = head + f'<ul label="1">{"".join(f"<li>{sentences(rng, rng.randint(1, 3))}</li>" for _ in range(rng.randint(2, 6)))}</ul>'
        elif shape < 0.2:
            # A layout by tables: parts and the text in cells.
            cells = [f"<td>{x}</td>" for x in before] + [f'<td label="1">{body}</td>'] + [f"<td>{x}</td>" for x in after]
            main = "<table>" + "".join(c if rng.random() < 0.6 else f"</tr><tr>{c}" for c in ["<tr>", *cells]) + "</tr></table>"
            before, after = [part()] if rng.random() < 0.5 else [], [part()] if rng.random() < 0.5 else []
        elif shape < 0.22:
            yield f'<html><body label="1">{sentences(rng, rng.randint(1, 4))}{"".join(f"<p>{sentences(rng, rng.randint(1, 4))}" for _ in range(rng.randint(0, 4)))}</body></html>'
            continue
        elif shape < 0.26:
            yield "".join(f'<{t} label="1">{sentences(rng, rng.randint(1, 5))}</{t}>' for t in (rng.choice(("p", "div")) for _ in range(rng.randint(1, 6))))
            continue
        else:
            main = rng.choice(ROOTS).replace("{m}", ' label="1"').replace("{t}", body)
        wrap = ("<div class='container'>", "</div>") if rng.random() < 0.3 else ("", "")
        page = f"{wrap[0]}{''.join(before)}{main}{''.join(after)}{wrap[1]}"
        if rng.random() < 0.5:
            page = renamed(rng, page)
        yield f"<!DOCTYPE html><html><head><title>{words(rng, 4)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{page}</body></html>"
