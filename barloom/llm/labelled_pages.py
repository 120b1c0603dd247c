"""Labelled pages that the extraction model is trained on.

Written for this purpose. ``data-main="1"`` marks an element as main text with all below it, and
``data-main="0"`` marks one inside as not; whatever is marked neither way isn't main text. An element
that holds both kinds counts as main text if it is marked so itself.
"""

from __future__ import annotations

import random
import re

_S = (
    "The river rose by two metres overnight, and the lower road was closed before dawn.",
    "Nobody had expected the old bridge to hold, but it did, and the market opened as usual.",
    "Les ouvriers ont repris le travail lundi, après trois semaines de discussions difficiles.",
    "Der Zug hielt kurz hinter der Grenze, und die meisten Reisenden stiegen dort aus.",
    "La cosecha fue buena este año, aunque las lluvias llegaron tarde y con poca fuerza.",
    "She kept the letters in a tin box, sorted by year, and read them only in winter.",
    "Two of the three laboratories repeated the measurement and found the same value.",
    "A short walk leads from the station to the harbour. There the boats are painted in spring.",
)


def _p(k: int, n: int = 1) -> str:
    return " ".join(_S[(k + i) % len(_S)] for i in range(n))


_NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
_TOP = "<!DOCTYPE html><html><head><meta charset=utf-8><title>A page</title><style>p{margin:0}</style><script>var a='</p>';</script></head><body>"
_END = "</body></html>"


def _page(k: int) -> list[str]:
    return [
        f'{_TOP}{_NAV}<div class="ad">{_p(k)}</div><article data-main="1"><h1>{_p(k + 1)[:40]}</h1><p>{_p(k + 2, 2)}</p><p>{_p(k + 3)}</p><p>Yes.</p></article><footer>&copy; 2020 Harbour News &middot; {_p(k)[:50]}</footer>{_END}',
        f'{_TOP}<header class="site-header"><a href="/">Harbour News</a><p>Daily since 1911</p></header><div class="menu"><a href="/a">World</a> <a href="/b">Sport</a></div><div id="content" data-main="1"><h2>{_p(k)[:30]}</h2><p>{_p(k + 1, 3)}</p><div class="advertisement" data-main="0"><p>{_p(k + 4)}</p></div><p>{_p(k + 2)}</p><ul><li>{_p(k + 5)}</li><li>Salt</li><li>{_p(k + 6)[:30]}</li></ul></div><div class="sidebar"><h3>Related</h3><ul><li><a href="/x">{_p(k + 6)}</a></li><li><a href="/y">{_p(k + 7)}</a></li></ul></div><div id="footer"><p>All rights reserved. <a href="/terms">Terms</a></p></div>{_END}',
        f'{_TOP}<div class="cookie-notice"><p>We use cookies to improve this site. {_p(k)}</p><button>Accept</button></div><main data-main="1"><section><h1>{_p(k + 2)[:25]}</h1><p>{_p(k + 2, 2)} <a href="/s">{_p(k)[:20]}</a> <b>{_p(k + 3)}</b></p><blockquote>{_p(k + 5)}</blockquote><p>{_p(k + 1)[:18]}</p></section><section class="comments" data-main="0"><h3>Comments</h3><div class="comment"><p>{_p(k + 3)}</p></div><div class="comment"><p>{_p(k + 6, 2)}</p></div><form action="/post"><label>Your name</label><textarea>Write here</textarea><button>Send</button></form></section></main><aside><p>{_p(k + 4)}</p></aside>{_END}',
        f'{_TOP}<div role="navigation"><a href="/">Start</a><a href="/k">Contact</a></div><div class="page"><div class="post" data-main="1"><h1>{_p(k)[:35]}</h1><div class="entry"><p>{_p(k, 2)}<p>{_p(k + 4)}<p><b>{_p(k + 1)}<br></div></div><div id="comments"><ol><li><p>{_p(k + 2)}</p></li><li><p>Thanks!</p></li></ol></div><div class="widget"><h4>Newsletter</h4><form><input name=q><p>Subscribe to our letter. {_p(k + 3)}</p></form></div></div><div class="copyright">Copyright 2021 by the editors</div>{_END}',
        f'{_TOP}<div class="banner notice"><p>{_p(k + 2)}</p></div><table><tr><td><a href="/1">One</a></td><td><a href="/2">Two</a></td></tr></table><div><div data-main="1"><h1>{_p(k + 6)[:28]}</h1><p>{_p(k + 3, 2)}</p><table><tr><th>Year</th><td>1911</td></tr><tr><th>Boats</th><td>{_p(k)[:22]}</td></tr></table><p>{_p(k + 5, 2)}</p><figure><img src=a.png><figcaption>{_p(k + 1)[:40]}</figcaption></figure><pre>one two</pre></div></div><div class="sponsored promo"><p>{_p(k + 7)}</p><a href="/buy">Buy now</a></div>{_END}',
        f'{_TOP}{_NAV}<article data-main="1"><header data-main="0"><p>By the editors</p><time>Monday</time></header><h1>{_p(k + 1)[:33]}</h1><p>{_p(k + 1)}</p><div class="share social" data-main="0"><a href="/t">Share this</a> <a href="/f">Follow</a></div><p>{_p(k + 6, 3)}</p><aside class="related" data-main="0"><h3>Read next</h3><p>{_p(k + 2)}</p></aside><h2>{_p(k + 3)[:20]}</h2><p>{_p(k + 7)}</p><footer data-main="0"><p>{_p(k + 4)}</p></footer></article><section class="reader-comments"><p>{_p(k + 5)}</p><p>{_p(k)}</p></section>{_END}',
        f'{_TOP}<div class="alert"><p>{_p(k + 1)[:45]}</p></div><div class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/n">News</a></div><div class="story-body" data-main="1"><p>{_p(k + 4, 2)}</p><p>{_p(k + 5)} <i>{_p(k + 6)}</i></p><h3>{_p(k + 7)[:24]}</h3><p>{_p(k)}</p><ol><li><p>{_p(k + 2)}</p></li></ol></div><div class="login"><form><p>Sign in to read more</p><input><button>Log in</button></form></div><div class="footer-links"><ul><li><a href="/p">Privacy</a></li><li><a href="/c">Contact</a></li></ul></div>{_END}',
        f'{_TOP}{_NAV}<!-- ad --><div class="ad">{_p(k)}</div><article data-main="1"><h1>{_p(k + 1)[:9]}</h1><p><b>{_p(k + 1)[:9]}<br></article><footer>&copy; Harbour &middot; {_p(k + 2)}</footer>{_END}',
        f'{_TOP}<header><p>{_p(k + 3)}</p></header><main data-main="1"><h1>No</h1><p>Yes.</p><p>Why?</p><p>{_p(k)[:15]}</p><p><b>{_p(k + 2)}<br></main><div class="notice"><p>No.</p></div><div class="comments"><p>Yes!</p><p>{_p(k + 1)[:12]}</p></div>{_END}',
        f'{_TOP}<p data-main="1">{_p(k, 2)}</p><p data-main="1">{_p(k + 2)}</p><h2 data-main="1">{_p(k + 4)[:20]}</h2><p data-main="1">{_p(k + 5)}</p><div><a href="/a">Back</a> <a href="/b">Next</a></div>{_END}',
    ]


#: Where main text stands, and what stands beside it or within it; ``{}`` is what it holds.
_WRAPS = (
    "<article {m}>{{}}</article>", "<main {m}>{{}}</main>", '<div class="content" {m}>{{}}</div>', '<div id="main-content" {m}>{{}}</div>', "<main><article {m}>{{}}</article></main>",
    '<div class="page"><div class="post" {m}>{{}}</div></div>', '<div id="wrap"><div {m}>{{}}</div></div>', '<section class="story" {m}>{{}}</section>', '<div class="article-body" {m}>{{}}</div>',
)
_BESIDE = (
    '<section class="comments">{}</section>', '<aside>{}</aside>', '<div class="ad">{}</div>', '<div class="cookie-notice">{}</div>', '<div id="comments">{}</div>', '<div class="sidebar">{}</div>', '<footer>{}</footer>', '<header>{}</header>',
    "<form action='/s'>{}<input></form>", '<div class="related">{}</div>', '<div class="banner">{}</div>', '<ul class="menu">{}</ul>', '<div role="alert">{}</div>', '<div class="newsletter">{}</div>', '<div class="comment-list"><div class="comment">{}</div></div>',
    '<div class="promo">{}</div>', '<div id="footer">{}</div>', '<div class="notice">{}</div>', '<nav>{}</nav>', '<div class="share">{}</div>', '<section id="reader-comments">{}</section>', '<div class="advertisement">{}</div>', '<div id="header">{}</div>',
    '<div class="sponsored">{}</div>', '<div class="popup">{}</div>', '<div class="login">{}</div>', '<ol class="replies"><li>{}</li></ol>', '<div class="breadcrumb">{}</div>', '<div role="complementary">{}</div>', '<div class="copyright">{}</div>',
)


def _mixed(k: int) -> str:
    """Main text in one of the wraps with blocks of the other kind within and around it. Both hold like
    sentences, so that only the structure tells them apart."""
    few = lambda j: "".join(f"<p>{_p(k + j + i, 1 + (k + i) % 2)}</p>" for i in range(1 + (k + j) % 3))
    link = lambda j: f'<a href="/{j}">{_p(k + j)[: 12 + 9 * (j % 3)]}</a>'
    beside = [_BESIDE[(k * 7 + j * 11) % len(_BESIDE)].format(few(j) if (k + j) % 4 else f"<p>{_p(k + j)[:30]}</p>" if j % 2 else f"<li>{link(j)}</li><li>{link(j + 1)}</li>") for j in range(6)]
    inner = [b.replace(">", ' data-main="0">', 1) for b in beside[3:]]
    text = [f"<h{1 + k % 3}>{_p(k)[: 10 + k % 30]}</h{1 + k % 3}>" if k % 3 else "", few(1), inner[0], few(2), inner[1] if k % 2 else f"<ul><li>{_p(k)}</li><li>{_p(k + 1)[:20]}</li></ul>", f"<p>{_p(k + 3)[:14]}</p>", f"<p>{_p(k + 2)} {link(2)} {_p(k + 5)}</p>", inner[2]]
    if k % 4 == 1:  # little text, and sometimes nothing around it
        text = [f"<p>{_p(k)[: 8 + k % 50]}</p>" for k in range(k, k + 1 + k % 3)] + [few(1)] * (k % 2)
        beside = [b if (k + j) % 3 else "" for j, b in enumerate(beside)]
        if k % 8 == 1:
            return _WRAPS[k % len(_WRAPS)].format(m='data-main="1"').format("".join(text))
    return _TOP + beside[0] + beside[1] + _WRAPS[k % len(_WRAPS)].format(m='data-main="1"').format("".join(text)) + beside[2] + _END



# Pages of many layouts, dealt from parts. Classes tell the truth, something else, or nothing; paragraphs may talk of
# cookies and comments; main text stands in all kinds of containers, lists and table cells.

_SYLLABLES = "ka lo mi ter an de ru sol vin par to ne ges ich ung cion ado eau ent er ly st qua or".split()
_ASIDES = ("They subscribe to a newsletter and comment on cookies.", "The copyright question was left to the court.", "Readers may sign in, read more and follow the debate.", "An advert in the paper had announced it.", "We share this view, with one comment.")
_NAMES_MAIN = ("content", "post-body", "entry-content", "article__text", "td-post-content", "story", "c-rich-text", "main-column", "blog-post", "text-block", "single-post-body", "prose", "mw-body page")
_NAMES_NONE = ("", "", "css-1x9ab", "col-8", "row", "box b2", "wrapper", "inner", "x-17", "grid__cell", "block", "container")
_NAMES_LESS = {
    "menu": ("nav-main", "menu", "site-navigation", "topbar", "breadcrumbs"), "head": ("site-header", "masthead", "branding"), "foot": ("site-footer", "footer", "bottom-bar", "copyright"), "side": ("sidebar", "widget-area", "related-posts", "most-popular"),
    "note": ("cookie-banner", "gdpr-consent", "alert alert-info", "notice-bar", "modal"), "ad": ("ad-slot", "advertisement", "sponsored", "promo-box"), "form": ("newsletter-signup", "login-box", "search-form"), "talk": ("comments", "comment-list", "disqus-thread", "responses"), "share": ("share-buttons", "social", "byline", "post-meta", "tags"),
}


class _Dealer:
    """One page after the other from a seeded generator."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(n))

    def sentence(self) -> str:
        if self.r.random() < 0.06:
            return self.r.choice(_ASIDES)
        return self.words(self.r.randint(3, 18)).capitalize() + self.r.choice("...!?")

    def text(self, least: int = 1, most: int = 4) -> str:
        return " ".join(self.r.choice(_S) if self.r.random() < 0.2 else self.sentence() for _ in range(self.r.randint(least, most)))

    def link(self, n: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 99)}">{self.words(self.r.randint(1, n)).capitalize()}</a>'

    def class_(self, kind: str) -> str:
        """Attributes that tell of the kind, or of none."""
        name = self.r.choice(_NAMES_LESS[kind]) if self.r.random() < 0.6 else self.r.choice(_NAMES_NONE)
        return f' {self.r.choice(("class", "class", "id"))}="{name}"' if name else ""

    def less(self) -> str:
        """A part that isn't main text."""
        r, w = self.r, self.words
        kind = r.choice(("menu", "menu", "head", "foot", "foot", "side", "note", "ad", "form", "talk", "share", "links"))
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "talk": "section"}.get(kind, "div")
        named = self.class_(kind) if kind != "links" else ""
        tag = tag if r.random() < 0.4 else "div"
        if tag == "div" and not named and kind in ("note", "ad", "talk", "side"):
            named = f' class="{r.choice(_NAMES_LESS[kind])}"'  # nothing else would tell it from main text
        if kind in ("menu", "links"):
            body = "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>" if r.random() < 0.6 else r.choice((" ", " | ", " &middot; ")).join(self.link() for _ in range(r.randint(2, 8)))
        elif kind == "head":
            body = f"{self.link()}<p>{w(4)}</p>" if r.random() < 0.5 else f"<h1>{self.link(2)}</h1>"
        elif kind == "foot":
            body = r.choice((f"&copy; 20{r.randint(10, 25)} {w(3)}", f"<p>Copyright {w(2)}. All rights reserved. {self.link()}</p>", f"<p>{w(5)} &middot; {self.link()} {self.link()}</p>", f"&copy; {w(1)}.example.net &middot; {self.sentence()}"))
        elif kind == "side":
            body = f"<h3>{w(2).capitalize()}</h3>" + ("<ul>" + "".join(f"<li>{self.link(8)}</li>" for _ in range(r.randint(2, 6))) + "</ul>" if r.random() < 0.6 else f"<p>{self.text(1, 2)}</p>")
        elif kind == "note":
            body = f"<p>{r.choice(('We use cookies. ', 'This site uses cookies to improve your visit. ', 'Please note: ', ''))}{self.text(1, 2)}</p>" + ("<button>OK</button>" if r.random() < 0.5 else "")
        elif kind == "ad":
            body = r.choice((f"{self.text(1, 2)}", f"<p>{self.text(1, 2)}</p>{self.link()}", f"<b>Advertisement</b> {self.sentence()}"))
        elif kind == "form":
            body = f"<p>{r.choice(('Subscribe to our newsletter', 'Log in', 'Search'))}</p><label>{w(2)}</label><input><button>Go</button>"
        elif kind == "talk":
            body = f"<h3>{r.choice(('Comments', 'Responses', w(2)))}</h3>" + "".join(f"<div class='comment'><b>{w(1)}</b><p>{self.text(1, 3)}</p></div>" if r.random() < 0.6 else f"<li><p>{self.text(1, 2)}</p></li>" for _ in range(r.randint(1, 5)))
        else:
            body = r.choice((f"{self.link(1)} {self.link(1)} {self.link(1)}", f"By {w(2)} &middot; {r.randint(1, 28)} May", f"Tags: {self.link(1)}, {self.link(1)}"))
        return f'<{tag}{named} data-main="0">{body}</{tag}>'

    def main(self) -> list[str]:
        """Blocks of main text, long or short, in one style for the page."""
        r, w = self.r, self.words
        out = [f"<h{k}>{w(r.randint(1, 8)).capitalize()}</h{k}>" for k in (r.randint(1, 2),) if r.random() < 0.75]
        short, style, most = r.random() < 0.2, r.choice(("p", "p", "p", "p", "open", "div", "div", "br")), r.choice((1, 1, 2, 4, 6))
        for _ in range(r.randint(1, 2) if short else r.randint(2, 10)):
            kind = r.random()
            if kind < 0.64:
                inner = self.text(1, 1 if short else most)
                if r.random() < 0.2:
                    inner += f" {self.link()} {self.text(1, 1)}"
                if r.random() < 0.15:
                    inner = f"<b>{inner}</b>" if r.random() < 0.5 else f"{inner} <i>{w(2)}</i>"
                out.append({"p": f"<p>{inner}</p>", "open": f"<p>{inner}", "div": f"<div>{inner}</div>", "br": f"{inner}<br><br>"}[style])
            elif kind < 0.72:
                tag = r.choice(("ul", "ol"))
                item = r.choice((lambda: w(r.randint(1, 6)), self.sentence, lambda: f"<p>{self.sentence()}</p>"))
                out.append(f"<{tag}>" + "".join(f"<li>{item()}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif kind < 0.78:
                k = r.randint(2, 4)
                out.append(f"<h{k}>{w(r.randint(1, 6)).capitalize()}</h{k}>")
            elif kind < 0.82:
                out.append(f"<blockquote>{self.text(1, 2)}</blockquote>")
            elif kind < 0.86:
                out.append("<table>" + "".join(f"<tr><th>{w(1)}</th><td>{w(r.randint(1, 5))}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif kind < 0.88:
                out.append(f"<figure><img src=a.png><figcaption>{self.sentence()}</figcaption></figure>")
            elif kind < 0.9:
                out.append(f"<pre>{w(6)}</pre>")
            elif not short:
                out.append(self.less())
        return out

    def page(self) -> str:
        r = self.r
        if r.random() < 0.12:  # little text, which what stands around it outweighs
            tag, around = r.choice(("article", "article", "main", "section", "div")), self.text(1, 2)
            foot = r.choice((f"<footer>&copy; {self.words(1)}.example.net &middot; {self.text(1, 1)}</footer>", f"<footer><p>{around}</p></footer>", self.less()))
            return f'{_TOP}{self.less() if r.random() < 0.8 else _NAV}<{tag} data-main="1"><h1>{self.sentence()}</h1><p>{self.text(1, 2)}</p></{tag}>{foot}{_END}'
        name = r.choice(_NAMES_MAIN) if r.random() < 0.4 else r.choice(_NAMES_NONE)
        named = f' {r.choice(("class", "id"))}="{name}"' if name else ""
        tag = r.choice(("article", "article", "main", "div", "div", "div", "section", "td"))
        blocks = self.main()
        body = f'<{tag}{named} data-main="1">{"".join(blocks)}</{tag}>'
        if r.random() < 0.1:  # nothing holds it together
            body = "".join(x if "data-main" in x[:80] else re.sub(r"^<(\w+)", r'<\1 data-main="1"', x) if x.startswith("<") else f'<p data-main="1">{x}</p>' for x in blocks)
        elif tag == "td":
            side = f'<td data-main="0">{"".join(self.link() + "<br>" for _ in range(4))}</td>'
            body = f"<table><tr>{r.choice((side, ''))}{body}{r.choice((side, ''))}</tr></table>"
        before, after = ("".join(self.less() for _ in range(r.randint(0, 3))) for _ in range(2))
        for _ in range(r.randint(0, 3)):
            wrap = r.choice(_NAMES_NONE + _NAMES_MAIN)
            body = f'<div{f" class={chr(34)}{wrap}{chr(34)}" if wrap else ""}>{body}{self.less() if r.random() < 0.3 else ""}</div>'
        return _TOP + before + body + after + _END


def dealt(n: int, seed: int = 11) -> list[str]:
    """Labelled pages of as many layouts."""
    dealer = _Dealer(seed)
    return [dealer.page() for _ in range(n)]


PAGES = [page for k in range(6) for page in _page(k)] + [_mixed(k) for k in range(120)] + dealt(640)
