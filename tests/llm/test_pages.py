"""Hand-written pages in layouts that no generator made, each with the text that has to come out."""

import pytest

from marketframe.llm import html_extract

P1 = "The harbour was quiet in the early morning, and only two fishing boats had left before the fog came in from the west."
P2 = "By noon the council had met twice, without agreeing on who should pay for the new pier, which is said to cost four million."
P3 = "Residents told the meeting that the old pier had served them well for sixty years, and that repairs would be cheaper by far."
P4 = "A decision is expected next month, when the engineers will have finished their report on the state of the foundations."
BODY = [P1, P2, P3, P4]
paragraphs = "".join(f"<p>{p}</p>" for p in BODY)

PAGES = {
    "semantic": (f"<html><head><title>Pier</title></head><body><header><a href='/'>Daily</a></header><nav><ul><li><a href='/a'>News</a></li><li><a href='/b'>Sport</a></li></ul></nav><main><article><h1>The pier dispute</h1>{paragraphs}</article></main><footer>© 2024 Daily. All rights reserved.</footer></body></html>", ["The pier dispute", *BODY]),
    "divs": (f"<body><div class='top-menu'><a href='/'>Home</a> | <a href='/n'>News</a> | <a href='/c'>Contact</a></div><div class='story'><h2>The pier dispute</h2>{paragraphs}</div><div class='sidebar'><h3>Most read</h3><ul><li><a href='/1'>Ten recipes for autumn</a></li><li><a href='/2'>Who won the cup</a></li></ul></div></body>", ["The pier dispute", *BODY]),
    "comments": (f"<body><article><h1>The pier dispute</h1>{paragraphs}</article><section id='comments'><h3>2 comments</h3><div class='comment'><p class='author'>Ann</p><p>I think the old one was fine, to be honest, and we should keep it.</p></div><div class='comment'><p class='author'>Bob</p><p>So do I. The council never listens to us anyway, does it?</p></div></section></body>", ["The pier dispute", *BODY]),
    "cookie": (f"<body><div class='cookie-notice'><p>We use cookies to improve your experience. By staying here you accept them.</p><button>Accept</button></div><article><h1>The pier dispute</h1>{paragraphs}</article></body>", ["The pier dispute", *BODY]),
    "list and quote": (f"<body><nav><a href='/'>Home</a></nav><article><h1>The pier dispute</h1><p>{P1}</p><ul><li>Two boats left before the fog came in from the west.</li><li>The council met twice and agreed on nothing at all.</li></ul><blockquote><p>{P3}</p></blockquote><p>{P4}</p></article></body>", ["The pier dispute", P1, "Two boats left before the fog came in from the west.", "The council met twice and agreed on nothing at all.", P3, P4]),
    "unclosed": (f"<body><nav><a href=/>Home</a><a href=/n>News</a></nav><article><h1>The pier dispute</h1><p>{P1}<p>{P2}<p>{P3}<p>{P4}</article><footer>Imprint</footer>", ["The pier dispute", *BODY]),
    "link blocks": (f"<body><article><h1>The pier dispute</h1>{paragraphs}</article><aside class='related'><a href='/1'><div>How the first pier was built in nineteen sixty</div></a><a href='/2'><div>Five walks along the coast for every weather</div></a></aside></body>", ["The pier dispute", *BODY]),
    "entities": (f"<body><header><a href='/'>Daily</a></header><article><h1>Pier &amp; harbour</h1><p>{P1}</p><p>It costs &euro;4&nbsp;million, &ldquo;at least&rdquo;, says the mayor of the town in an interview.</p><p>{P4}</p></article></body>", ["Pier & harbour", P1, "It costs €4 million, “at least”, says the mayor of the town in an interview.", P4]),
    "scripts": (f"<body><script>var a = '<p>not text</p>';</script><style>p {{color: red}}</style><article><h1>The pier dispute</h1>{paragraphs}<script>track()</script></article><noscript>Please enable scripts</noscript></body>", ["The pier dispute", *BODY]),
    "form": (f"<body><form class='search'><label>Search</label><input name='q'><button>Go</button></form><article><h1>The pier dispute</h1>{paragraphs}</article><form class='newsletter'><p>Sign up for our newsletter</p><input name='mail'><button>Subscribe</button></form></body>", ["The pier dispute", *BODY]),
    "inline": (f"<body><nav><a href='/'>Home</a></nav><article><h1>The <em>pier</em> dispute</h1><p>The <b>harbour</b> was quiet in the <a href='/m'>early morning</a>, and only two <i>fishing</i> boats had left before the fog came.</p><p>{P2}</p><p>{P3}</p></article></body>", ["The pier dispute", "The harbour was quiet in the early morning, and only two fishing boats had left before the fog came.", P2, P3]),
    "advert inside": (f"<body><article><h1>The pier dispute</h1><p>{P1}</p><p>{P2}</p><div class='advert'><a href='/x'>Buy two pairs of boots and save</a></div><p>{P3}</p><p>{P4}</p></article></body>", ["The pier dispute", *BODY]),
    "german": ("<body><div id='navigation'><a href='/'>Start</a> <a href='/k'>Kontakt</a></div><div id='content'><h1>Der Streit um den Steg</h1><p>Am frühen Morgen war der Hafen still, und nur zwei Boote waren vor dem Nebel hinausgefahren, sagt der Hafenmeister.</p><p>Der Rat hat zweimal getagt, ohne sich darüber zu einigen, wer den neuen Steg bezahlen soll, der vier Millionen kostet.</p></div><div id='footer'>Impressum | Datenschutz</div></body>", ["Der Streit um den Steg", "Am frühen Morgen war der Hafen still, und nur zwei Boote waren vor dem Nebel hinausgefahren, sagt der Hafenmeister.", "Der Rat hat zweimal getagt, ohne sich darüber zu einigen, wer den neuen Steg bezahlen soll, der vier Millionen kostet."]),
    "nothing": ("<body><nav><a href='/'>Home</a><a href='/n'>News</a></nav><footer>© 2024 Daily</footer></body>", []),
}


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page(model, name):
    page, want = PAGES[name]
    assert html_extract.main_text([page], model)[0].split("\n") == (want or [""])


def test_links_reach_through_blocks():
    found = html_extract.blocks("<body><a href='/1'><div>One title</div><div>Another</div></a><div>No link</div><p><a href='/2'>open<p>leaks no further</p></body>")
    assert [(b[0], b[3]) for b in found] == [("One title", 1.0), ("Another", 1.0), ("No link", 0.0), ("open", 1.0), ("leaks no further", 0.0)]
