"""Twelve more layouts, written after the model of round 3 was settled and scored once: nothing was changed for them.

The twenty of ``unseen_layouts`` weren't trained on either, but features, labels and the dealing of training pages were
chosen while looking at their scores, so these are the ones that tell how it does on new pages."""

from tests.llm.unseen_layouts import A, B, C, D, DOC, E, F, P

LAYOUTS = {
    "definition list": f"<div class='hd'><a href='/'>Gazette</a></div><div class='bd'>[[{P(A)}<dl><dt>Anna</dt><dd>{B}</dd><dt>Bodil</dt><dd>{C}</dd></dl>{P(D)}]]</div><div class='ft'>&copy; Gazette 2019</div>",
    "two columns of divs": f"<div><div style='float:left'><b>Sections</b><br><a href='/a'>Town</a><br><a href='/b'>Sea</a></div><div style='float:right'>[[<h2>Late</h2>{P(A, B, C)}]]</div></div>",
    "comments without a class": f"<article>[[{P(A, B, C, D)}]]</article><h3>What readers say</h3><ul><li><b>Per</b>: {E}</li><li><b>Liv</b>: {F}</li></ul>",
    "long link list": "<div>" + "".join(f"<p><a href='/{k}'>Story number {k} of this long week by the sea</a></p>" for k in range(12)) + f"</div><div>[[{P(A, B, C)}]]</div>",
    "interview": f"<main>[[<h1>Three questions</h1><p><b>Why was it late?</b></p><p>{A}</p><p><b>Who took it calmly?</b></p><p>{B}</p>]]</main><aside><p>Advertisement</p><p>{F}</p></aside>",
    "one short note": f"<nav><a href='/'>Home</a> <a href='/n'>News</a></nav><section>[[<p>{A}</p>]]</section><footer>Terms and privacy</footer>",
    "nested table": f"<table><tr><td colspan=2><a href='/'>Gazette</a></td></tr><tr><td><a href='/x'>X</a><br><a href='/y'>Y</a></td><td><table><tr><td>[[{P(A, B)}]]</td></tr><tr><td>[[{P(C, D)}]]</td></tr></table></td></tr></table>",
    "author box": f"<div class='single'>[[<h1>Ferry</h1>{P(A, B, C, D)}]]<div class='author-bio'><p>Ann Smith has written about boats since she was a child.</p></div></div>",
    "pull quotes": f"<article>[[{P(A)}<aside class='pullquote'><p>{B}</p></aside>{P(C, D, E)}]]</article>",
    "related in the middle": f"<div class='article'>[[{P(A, B)}]]<div class='see-also'><p>See also</p><ul><li><a href='/1'>A history of ferries</a></li><li><a href='/2'>Ice and snow</a></li></ul></div>[[{P(C, D)}]]</div>",
    "recipe": f"<div id='page'><div id='nav'><a href='/'>Home</a></div><div id='recipe'>[[<h1>Fish soup</h1><ul><li>two onions</li><li>one cod</li><li>salt</li></ul><ol><li>{A}</li><li>{B}</li></ol>]]</div><div id='subscribe'><p>Get a recipe by mail each week</p></div></div>",
    "old page": f"<center><font size=5><a href='index.html'>Gazette</a></font></center><hr><font>[[{A}<p>{B}<p>{C}<p>{D}]]</font><hr><center><a href='mailto:x@y.z'>Mail us</a></center>",
}


def plain() -> dict[str, str]:
    return {k: DOC(v.replace("[[", "").replace("]]", "")) for k, v in LAYOUTS.items()}
