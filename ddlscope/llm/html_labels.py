"""Labelled pages for the block classifier: the first word of a main text block starts with +, of others with -.

Invented for training; the words carry no meaning, only lengths, links and places do.
Most pages have no article, main or named parts: words, link density and the blocks around decide there.
"""

import re

PAGES = (
    """<html><head><meta charset="utf-8"><title>-x</title></head><body><header><a href="/">-Home site</a></header>
    <nav><ul><li><a href="/a">-News</a></li><li><a href="/b">-Sport</a></li><li><a href="/c">-Weather today</a></li></ul></nav>
    <article><h1>+the quick story of a river town and</h1><p>+of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea</p><p>+the</p><p>+Be.</p><p>+river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from</p><ul><li>+a river town and its bridge that people built</li><li>+story of a</li></ul><p>+see <a href="/x">this page</a></p><h2>+the quick</h2><p>+bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago</p></article>
    <aside><h3>-Most read</h3><p>-quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick</p></aside><footer>-copyright town news <a href="/t">terms</a></footer></body></html>""",
    """<body><div class="topbar">-the quick story of a river</div><main><h1>+and its bridge that people</h1><p>+story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long</p><div class="ad">-a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge</div><p>+the quick story of</p><p>+town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago</p>
    <form><p>-the quick story of a river town and its bridge that people</p><label>-Your mail</label></form><section id="comments"><h3>-Comments</h3><p>-its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea</p><p>-river town and</p></section></main><div id="sidebar"><p>-quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story</p></div><footer><p>-the quick story of a river town and its bridge that people built long ago while waiting for boats to</p></footer></body>""",
    """<body><div><a href="/">-Home</a> <a href="/n">News</a></div><div><a href="/1">-One thing</a></div><div><h1>+of a river town and its bridge</h1><p>+of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge</p><p>+of a river town and its bridge that people built long ago</p><p>+of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the</p><p>+story of a river town and</p><p>+story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river</p></div>
    <div><a href="/p">-the quick story of a river town and its</a></div><div><a href="/q">-the quick story of a river town</a></div><div>-All rights</div></body>""",
    """<body><div class="cookie-consent"><p>-the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that</p></div><ul><li><a>-the quick</a></li><li><a>-the quick story</a></li><li><a>-the quick story of</a></li></ul><article><p>+town and</p><p>+town and its bridge that people built long ago while waiting for boats to</p><blockquote>+story of a river town and its bridge that people built long ago while waiting for boats to</blockquote><p>+<a href="/k">the quick story of</a></p><footer>-the quick story of a river town and its</footer></article><div class="related"><p>-the quick story of a river town and its bridge that people built long ago while waiting for boats to come back</p></div></body>""",
    """<body><table><tr><td><a>-the quick story</a></td><td><a>-the quick</a></td></tr></table><h1>+quick story of a river town</h1><p>+quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting</p><h2>+quick story of</h2><p>+river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town</p><ul><li>+story of a river town and its bridge that people built long ago while waiting</li><li>+story of a river town and its bridge that people built</li></ul><p>+story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while</p><p><a>-the quick story of a</a> <a>the quick story of a river</a></p><p>-the quick story</p></body>""",
    """<article><header><h1>+the quick story of</h1></header><p>+of a river town and</p><p>+a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of</p><div class="share"><a>-Share</a></div><div class="newsletter-signup"><p>-the quick story of a river town and its bridge that people built long ago while</p></div><p>+river town and its bridge that people built long ago while waiting for boats to come back from sea the quick</p></article><nav><a>-the</a></nav><footer><p>-the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people</p></footer>""",
    """<body><nav><ul><li><a>-the</a></li></ul></nav><div class="login-form"><p>-the quick story of a river town and its</p></div><footer><p>-the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick story of a river town and its bridge that people built long ago while waiting for boats to</p></footer></body>""",
    """<body><div>-the quick story</div><article><h1>+of a river</h1><p>+town and its bridge that people built</p><p>+long</p>
    <p>+ago while waiting for boats to come back from sea the quick story of a river</p><p>+town</p><p>+and</p><p><a href="/z">+its bridge</a></p><p>+that</p></article>
    <p><a href="/y">-people built long</a></p><p>-ago while</p></body>""",
    """<body><ul><li><a>-the</a></li><li><a>-quick</a></li></ul><article><p>+story of a river town and its bridge</p></article><footer>-that people</footer></body>""",
    """<body><article><h1>+built long ago while waiting for boats to</h1><p>+come back from sea the quick story of</p><p>+a</p><p>+river town and its</p><p>+bridge that people built long ago while waiting for boats to come back from sea</p></article></body>""",
    """<article><p>+a</p></article>""", """<main><p>+the quick</p></main>""", """<article><h1>+story of</h1><p>+a river town</p></article>""",
    """<article><p>+and its bridge</p><p>+that people built long ago while waiting for boats</p><p>+to come back</p></article>""",
    """<article><p>+from sea the quick story of a</p></article>""", """<article><p><a>+river town</a></p><p><a>+and its bridge that</a></p></article>""",
    """<article><ul><li><a>+people built</a></li><li><a>+long</a></li></ul><p>+ago while</p></article>""",
    """<div>-waiting</div>""", """<p>-for boats</p><p><a>-to come</a></p>""", """<div><a>-back from</a></div><div>-sea the quick</div>""", """<p>-story of a</p><p>-river</p>""",
    """<body><div><a>-the quick</a></div><p>+story of a river town and its bridge that people built long ago while waiting for boats to come back from sea the quick</p>
    <p>+story of a river town and its bridge that people built long ago while waiting</p><div><a>-for boats</a> <a>to come</a></div><p>+back from sea the quick story of a river town and its bridge that people built long ago</p></body>""",
    """<body><p><a>-while waiting for boats to come back from</a></p><p>+sea the quick story of a river town and its bridge that people built long ago while waiting for boats to come back</p>
    <p><a>-from sea the quick story of a river town and</a></p><p>+its bridge that people built long ago while waiting for boats to come back from sea</p><p><a>-the quick</a></p></body>""",
    """<body><p>+the quick story of a river town and its bridge that people built long ago while waiting</p><p>+for boats to come back from sea the quick story of a river town</p>
    <div><a>-and its bridge that people built long ago while waiting for boats to come back from sea</a></div>
    <div><a>-the quick story of a river town and its bridge that people built long ago while waiting</a> <a>for boats</a></div>
    <div><a>-to come back from sea the quick story of a river town and its bridge</a></div></body>""",
    """<body><div><a>-that people built long ago while waiting for boats to come back from sea the quick story</a></div>
    <p>+of a <a>river town</a> and its bridge that people built long ago while waiting for boats to come back</p><p>+from sea the quick story of a river town and its bridge that people built</p></body>""",
    """<body><div>-posted by a town clerk at noon</div><div>-long ago</div><p>+the quick story of a river town and its bridge that people built long ago while waiting for boats</p>
    <p>+to come back from sea</p><p>+the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea</p>
    <div>-all words kept by the river town</div><div>-built long ago by quick people</div><div>-a town at sea</div></body>""",
    """<body><div>-waiting for boats to come back</div><div>-its bridge and the town clerk</div><p>+story of a river town and its bridge that people built long ago while waiting for boats to come back from sea</p>
    <p>+the quick story of a river</p><p>+town and its bridge that people built long ago while waiting for boats to come back from sea</p><div>-the town and its people</div><div>-quick boats</div></body>""",
    """<body class="single has-sidebar comments-open"><nav><a>-the quick</a></nav><div class="content with-sidebar"><article class="post category-social tag-legal">
    <h1>+story of a river</h1><p>+town and its bridge that people built long ago while waiting for boats to come back from sea</p></article></div>
    <div class="sidebar"><p>-the quick story of a river town and its bridge that people built long ago</p></div></body>""",
    """<body class="right-sidebar"><main class="main no-print"><h1>+the quick story</h1><p>+of a river town and its bridge that people built long ago while waiting</p>
    <p>+for boats</p></main></body>""",
)

#: Pages without articles and names, a block a word: + main text or - not, its tag (d for div, p, h for h2, l for li),
#: its words and, behind a slash, how many of them are linked.  [ ] stand for an article, ( ) for an aside.
SHAPES = (
    "-d1/1 -d1/1 -d2/2 +h6 +p48 +p31 +p22 -d3/3 -d2/2 -d4",
    "-l1/1 -l1/1 -l1/1 -l2/2 +h4 +p60 +p12 +p55 -l6/6 -l8/8 -l7/7 -d5/1",
    "-d3 -d2/2 +h9 +p25 +p80/4 +p33/2 +p41 -p9/9 -p11/11 -d6/2",
    "-d1/1 -d1/1 +h5 +p38 +h3 +p44 +h4 +p29 -h2 -l5/5 -l9/9 -d4/2",
    "-p4/4 -p3/3 +h7 +p90 +p15 +p70 -d8/3 -d2/2 -d2/2",
    "-l2/2 -l1/1 -l1/1 +h8 +p35 +l14 +l16 +l12 +p40 -l3/3 -l4/4 -d7",
    "-d5/5 -d6/6 +p52 +p47 +p61/3 -d12/12 -d14/14 -d10/10",
    "-d2 -d2/2 -d2/2 +h10 +p27 +p30 +p26 +p28 -d3/3 -d3/3 -d6/1",
    "-l1/1 -l1/1 -l1/1 -l1/1 -l1/1 +h3 +p110 +p95 -h2 -l7/7 -l6/6 -l8/8 -d9/2",
    "-d1/1 +h6 +p33/5 +p42/6 +p38/4 -p6/6 -p7/7 -d3",
    "-d4/4 -d3/3 -d5/5 -d6/6 -d4/4", "-h2 -l9/9 -l8/8 -l10/10 -l7/7", "-d2/2 -d8 -d2/2 -d5/5 -d3", "-p6 -p3/3 -p5",
    "-l3/3 -l4/4 -h3 -l12/12 -l11/11 -l13/13 -h2 -l9/9 -d6/1", "-d1/1 -d1/1 -d1/1 -d7 -d1/1",
    "-d2/2 +h5 +p24 +p9 +p36 +p45 -d2/2 -d3/3 -d5",
    "-l1/1 -l2/2 +h7 +p58 +p6 +p63 +p7 +p49 -l5/5 -l5/5 -d8/2",
    "-d3/3 -d2/2 +h4 +p66/9 +p71/12 +p54/8 -d9/9 -d7/7 -d4",
    "-p2/2 -p2/2 -p2/2 +h12 +p34 +p37 +p28/1 -h3 -p8/8 -p9/9 -p4",
    "-d6 -d1/1 -d1/1 +h8 +p43 +l22 +l19/2 +l25 +p39 -d2/2 -d6",
    "-d1/1 -d1/1 -d1/1 +p75 +p82 +p64 +p91 -d3/3 -d5/1",
    "-l2/2 -l2/2 -l2/2 +h6 +p29 +p32 -l2/2 -l2/2 -l2/2 -d6/2",
    "-d7/7 -d8/8 +h5 +p51 +h2 +p46 +p57 -d11/11 -d13/13 -d4",
    "-d3 -l1/1 -l1/1 +h9 +p120 +p18 +p84 -h2 -l4/4 -l6/6 -d8/1",
    "-p5/5 -p1/1 +h3 +p23 +p27/2 +p31 -p4/4 -p6/6 -p5",
    "-d2/2 -d2/2 -d2/2 -d2/2 +h11 +p69 +p44/3 +p72 -d10/10 -d9/9 -d7/2",
    "-l1/1 -l1/1 +h5 +p37 +p41 +p11 +p50 -h3 -l8/8 -l7/7 -l9/9 -d3",
    "-d4 -d3/3 +h6 +p88/7 +p93/5 -d6/6 -d6/6 -d6/6 -d2",
    "-d1/1 -d3/3 +h7 +p26 +l15 +l18 +p30 -d4/4 -d5/2",
    "-l4/4 -l3/3 -l5/5 -d6 -l10/10 -l12/12 -d4/1", "-d9/9 -h3 -d10/10 -h4 -d12/12 -d5",
    "-d1/1 -d2/2 +h8 +p53 +p59 +p62 -h2 -p7/7 -h2 -p8/8 -d6",
    "-d2/2 -d1/1 +p140 -d3/3 -d2/2", "-l1/1 -l1/1 +h4 +p100/2 -l3/3 -l3/3 -d5/1",
    "-l1/1 -l1/1 -l1/1 -d5 [+h9 +p130 +p160 +p2 +p7 +p80] -d12", "-l1/1 -l1/1 -d8 [+h6 +p9 +p55 +p1 +p140 +p3 +p20] -d15",
    "-l1/1 -d30 [+h12 +p17 +p21 +p19 +p4 +p90 +p6] -d6", "[+h7 +p5/5 +p3 +p70/20 +p2/2 +l4/4 +l3/3 +p1 +p18] -d9",
    "-d4 [+h3 +p15 +p16 +p3 +p22 +p2 +p18 +p14 +p20] -d3", "-l2/2 [+p1 +p14 +p1 +p19 +p1 +p21 +p60 +p1] -d4 -d3/3",
    "-l1/1 -l1/1 [+h5 +l2 +l1 +l3/3 +l2/2 +p12 +l30 +l6/6] (-h2 -p40 -p55) -d5", "(-p60 -p70) [+h6 +p10 +p11 +p12] (-p25) -d18",
    "[+p75 +p72/30 +p80 +p90/60 +p4/4 +p100 +p2 +p110] -d20", "-d22 [+h10 +p150 +p20/20 +p155 +p18/9 +p160 +p1/1] (-p90 -h3 -p35) -d7",
    "-d16 -d18 [+h8 +p20 +h2 +p22 +h3 +p16 +h1 +p15] -d21 -d14", "-l1/1 [+h4 +p8 (-p50 -p65 -l3/3) +p9 +p33 (-d4) +p2] -d10",
    "-d10 [+h11 +h6 +p44 +h5 +p3/1 +p6/2 +p13/5 +p28/7] -p45 -d9", "[+h2 +p300 +p2 +p250 +p9 +p5 +p400] -p30 -p28 -d11",
    "-p35 [+p6 +p23 +p24 +p7 +p26 +p2 +p70 +p71] -d25", "(-h4 -l5/5 -l6/6) [+h9 +p18 +p6/6 +p13 +p3 +p88] (-h2 -l9/9 -p20) -d4",
    "-d3 [+p1]", "[+l1/1 +l1/1 +l2/2 +l1/1] -d2", "-d40 [+h6 +p13 +p5 +p17 +p20 +p19 +p22] -d40", "[+p8/8 +p9/9 +p70 +p12/12 +p90 +p30/30] -d5/5",
)
_WORDS = "the quick story of a river town and its bridge that people built long ago while waiting for boats to come back from sea".split()
_TAGS = {"d": "div", "p": "p", "h": "h2", "l": "li"}


_PARTS = {"[": "<article>", "]": "</article>", "(": "<aside>", ")": "</aside>"}


def _page(shape: str) -> str:
    blocks = []
    for at, (part, sign, tag, n, linked) in enumerate(re.findall(r"([\[\]()])|([+-])([dphl])(\d+)(?:/(\d+))?", shape)):
        if part:
            blocks.append(_PARTS[part])
            continue
        words = [_WORDS[(7 * at + i) % len(_WORDS)] for i in range(int(n))]
        words[0] = sign + words[0]
        cut = len(words) - int(linked or 0)
        text = " ".join(words[:cut]) + (f" <a href='/'>{' '.join(words[cut:])}</a>" if linked else "")
        blocks.append(f"<{_TAGS[tag]}>{text}</{_TAGS[tag]}>")
    return "<body>" + "".join(blocks) + "</body>"


LABELLED = (*PAGES, *map(_page, SHAPES))
