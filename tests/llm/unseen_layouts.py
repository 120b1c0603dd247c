"""Twenty pages for development; ``[[`` and ``]]`` stand around main text. The model isn't trained on them, but its features,
labels and training pages were chosen while looking at their scores: ``fresh_layouts`` tells how it does on new ones."""

A = "The ferry was late again this morning, and by nine the queue reached the fish market."
B = "Most of the passengers took it calmly; a few had brought chairs, and one of them a small stove."
C = "According to the harbour office, a spare part has to be sent from abroad, which may take until Friday."
D = "Until then two fishing boats will carry people and post, though not cars, bicycles or large dogs."
E = "Older residents remember the winter of the long ice, when nobody crossed for six weeks."
F = "The council will discuss a second ship in autumn, but money for it hasn't been found."
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/w">Weather</a></li><li><a href="/s">Sport</a></li><li><a href="/m">More</a></li></ul>'
P = lambda *xs: "".join(f"<p>{x}</p>" for x in xs)
DOC = lambda body: f"<!doctype html><html><head><title>Ferry</title></head><body>{body}</body></html>"

LAYOUTS = {
    "plain div": f"<div>{NAV}</div><div>[[{P(A, B, C, D, E, F)}]]</div><div>Copyright 2021 The Courier</div>",
    "paragraphs in the body": f"<h3><a href='/'>The Courier</a></h3>[[{P(A, B, C, D)}]]<hr><p><a href='/p'>Back</a> <a href='/n'>Next</a></p>",
    "table": f"<table width='100%'><tr><td width=120><a href='/1'>One</a><br><a href='/2'>Two</a><br><a href='/3'>Three</a></td><td>[[{P(A, B, C, D)}]]</td></tr></table>",
    "prefixed classes": f"<div class='zz-nav'>{NAV}</div><div class='zz-ss-main'><div class='zz-post-inner'>[[{P(A, B, C, D)}]]</div></div><div class='zz-foot'>&copy; 2020</div>",
    "hashed classes": f"<div class='css-a1'>{NAV}</div><div class='css-b2'><div class='css-c3'>[[<h1>Ferry late</h1>{P(A, B, C, D, E)}]]</div></div><div class='css-d4'><a href='/t'>Terms</a> <a href='/p'>Privacy</a></div>",
    "cue words": f"<article>[[{P(A, 'Passengers who subscribe to the newsletter had been told; comments were few.', B)}]]</article>",
    "list in an article": f"<nav>{NAV}</nav><article>[[<p>{A}</p><ul><li>two boats</li><li>{C}</li><li>no dogs</li></ul><p>{D}</p>]]</article>",
    "comments by class": f"<main><div class='txt'>[[<h1>Ferry late</h1>{P(A, B, C)}]]</div><div class='comments'><h3>3 comments</h3><div class='comment'>{P(E)}</div><div class='comment'>{P(F)}</div></div></main>",
    "sidebar beside": f"<div class='wrap'><div class='left'>[[<h2>Ferry</h2>{P(A, B, C, D)}]]</div><div class='sidebar'><h4>Popular</h4><ul><li><a href='/a'>Ten harbours worth a visit this summer</a></li><li><a href='/b'>Why gulls steal</a></li></ul></div></div>",
    "cookie bar": f"<div class='cookie-consent'><p>We use cookies so that this site works. By going on you agree.</p><button>Fine</button></div><section>[[{P(A, B, C)}]]</section>",
    "blockquote": f"<header><a href='/'>Courier</a></header><div class='body'>[[{P(A)}<blockquote>{B}</blockquote>{P(C, D)}]]</div><footer><p>The Courier, 1 Quay Street</p></footer>",
    "divs for paragraphs": f"<div id='top'>{NAV}</div><div id='mid'>[[<div>{A}</div><div>{B}</div><div>{C}</div><div>{D}</div>]]</div><div id='end'>&copy; Courier</div>",
    "line breaks": f"<div class='menu'><a href='/'>Home</a> <a href='/x'>News</a></div><div class='news'>[[{A}<br><br>{B}<br><br>{C}<br><br>{D}]]</div>",
    "advert inside": f"<article>[[{P(A, B)}]]<div class='ad-box'><p>Buy two boots for the price of one, this week only.</p></div>[[{P(C, D)}]]</article>",
    "data table": f"<nav>{NAV}</nav><article>[[{P(A)}<table><tr><th>Boat</th><th>Seats</th></tr><tr><td>Anna</td><td>40</td></tr></table>{P(B, C)}]]</article><footer>&copy;</footer>",
    "deep nesting": f"<div><div><div><div>{NAV}</div><div><div><section><div>[[{P(A, B, C, D)}]]</div></section></div></div></div></div></div>",
    "unclosed": f"<nav>{NAV}</nav><div id=content>[[<p>{A}<p>{B}<p>{C}<p>{D}]]</div><div id=footer>All rights reserved",
    "header within": f"<article><header><p>By Ann Smith</p><time>3 May</time></header>[[<h1>Ferry</h1>{P(A, B, C)}]]<footer><a href='/t'>Tag</a></footer></article>",
    "newsletter form": f"<main>[[{P(A, B)}]]<form><p>Get our newsletter</p><input><button>Go</button></form>[[{P(C, D)}]]</main>",
    "links within": f"<div class='topnav'>{NAV}</div><div class='entry'>[[<p>{A} <a href='/f'>The ferry</a> is old. {B}</p><p>{C} See the <a href='/t'>timetable</a>.</p>]]</div><div class='related'><p><a href='/r'>The bridge that was never built</a></p></div>",
}


def plain() -> dict[str, str]:
    return {k: DOC(v.replace("[[", "").replace("]]", "")) for k, v in LAYOUTS.items()}
