"""Pages written by hand, none from the generator that the model is trained on: (name, html, blocks of the article in order)."""

LONG = "The river had been rising for three days, and on Thursday night it reached the second step of the old mill. Nobody in the village could remember anything like it. By morning, the road to the station was gone, and with it the only way to bring in flour, medicine and mail."
MORE = "Volunteers came from both valleys, some on foot, with ropes and lamps. They worked until noon, slept for two hours in the school, and then went back to the bridge."
LAST = "The council will meet on Monday to decide whether the mill is to be rebuilt."

PAGES = [
    ("plain divisions", f"<html><body><div><div>{LONG}</div><div>{MORE}</div><div>{LAST}</div></div></body></html>", [LONG, MORE, LAST]),
    ("short article in a named division", f'<body><div class="nav"><a href="/">Home</a> <a href="/a">About</a></div><div class="post-body"><h1>The flood</h1><p>{LAST}</p></div><div class="footer">Written by us.</div></body>', ["The flood", LAST]),
    ("article in a cell", f'<table width="100%"><tr><td><a href="/">Home</a><br><a href="/news">News</a></td><td><h1>The flood</h1><p>{LONG}</p><p>{MORE}</p></td></tr></table>', ["The flood", LONG, MORE]),
    ("bare text in a cell", f'<html><body><table><tr><td><a href="/home">Home</a></td><td>{LONG} {MORE}</td></tr></table></body></html>', [f"{LONG} {MORE}"]),
    ("title in the article's header", f'<body><header><a href="/">Valley Post</a><nav><a href="/n">News</a><a href="/s">Sport</a></nav></header><article><header><h1>The flood</h1></header><p>{LONG}</p><p>{MORE}</p></article><footer><p>Valley Post, 3 Mill Lane</p></footer></body>', ["The flood", LONG, MORE]),
    ("magazine", f'<div id="page"><div id="masthead"><a href="/">Valley</a></div><ul class="menu"><li><a href="/1">News</a><li><a href="/2">Culture</a><li><a href="/3">Contact</a></ul><main id="content"><h1>The flood</h1><p>{LONG}<p>{MORE}<blockquote>{LAST}</blockquote><div class="share"><a href="#t">Tweet</a><a href="#f">Like</a></div></main><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/7">A bridge for the valley</a><li><a href="/8">Bread by boat</a></ul></aside><div id="footer">&copy; 2021 Valley. All rights reserved.</div></div>', ["The flood", LONG, MORE, LAST]),
    ("comments", f'<article class="post"><h1>The flood</h1><p>{LONG}</p><p>{MORE}</p></article><section class="comments"><h2>2 comments</h2><div class="comment"><p>I was there with my brother, it was worse than they say.</p></div><div class="comment"><p>Who pays for the road now? Not the county, I am sure.</p></div><form>Your comment <textarea></textarea><button>Send</button></form></section>', ["The flood", LONG, MORE]),
    ("line breaks", f'<html><body><center><a href="a.html">Back</a> | <a href="b.html">Next</a></center><div id="text">{LONG}<br><br>{MORE}<br><br>{LAST}</div></body></html>', [f"{LONG} {MORE} {LAST}"]),
    ("notices", f'<div class="cookie-consent"><p>We use cookies to make this site better for you. <button>Accept</button></p></div><div class="alert">The archive will be closed on Sunday.</div><main><h1>The flood</h1><p>{LONG}</p><div class="advertisement">Boots for every weather, now ten off.</div><p>{MORE}</p></main><div class="newsletter"><p>Get our letter every week.</p><form><input></form></div>', ["The flood", LONG, MORE]),
    ("list article", f'<body><nav><ul><li><a href="/">Start</a></li></ul></nav><article><h1>What to bring</h1><p>{LAST}</p><ul><li>Two blankets, dry.</li><li>A lamp with oil.</li><li>Bread for a day.</li></ul><p>{MORE}</p></article><footer><ul><li><a href="/i">Imprint</a></li></ul></footer></body>', ["What to bring", LAST, "Two blankets, dry.", "A lamp with oil.", "Bread for a day.", MORE]),
    ("one paragraph", f"<html><body><p>{LAST}</p></body></html>", [LAST]),
    ("sections", f'<div class="wrapper"><div class="header"><div class="logo">Valley</div><div class="menu"><a href="/1">One</a><a href="/2">Two</a></div></div><section><h2>The flood</h2><p>{LONG}</p></section><section><h2>The bridge</h2><p>{MORE}</p><figure><img src="b.png"><figcaption>The bridge on Friday.</figcaption></figure></section><div class="bottom"><a href="/p">Privacy</a> <a href="/t">Terms</a></div></div>', ["The flood", LONG, "The bridge", MORE, "The bridge on Friday."]),
    ("links in prose", f'<body><div class="topbar"><a href="/">V</a></div><div class="entry-content"><h1>The flood</h1><p>As <a href="/x">we wrote on Tuesday</a>, the <a href="/y">old mill</a> stands in water. {MORE}</p><p>{LONG}</p></div><div class="related"><h3>Related</h3><a href="/q">Bread by boat</a></div></body>', ["The flood", f"As we wrote on Tuesday , the old mill stands in water. {MORE}".replace(" ,", ","), LONG]),
    ("no article", '<body><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><footer>&copy; 2020 Valley</footer></body>', []),
]

NEW = "The ferry runs again from Friday. Tickets are sold on board."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
TALK = "".join(f'<div class="comment"><b>Reader {k}</b> I crossed it myself last week. It was colder than in any year I can remember.</div>' for k in range(5))

#: Pages whose articles were once lost, or that kept what is no article; every one exact.
EXACT = [
    ("links after a sentence", f'<body>{NAV}<main><h1>The flood</h1><p>{LAST}</p><ul><li><a href="/a">Map of the valley</a></li><li><a href="/b">Bread by boat</a></li></ul></main></body>', ["The flood", LAST, "Map of the valley", "Bread by boat"]),
    ("a linked paragraph", f'<body>{NAV}<article><h1>The flood</h1><p><a href="/x">{LAST}</a></p><p>{NEW}</p></article></body>', ["The flood", LAST, NEW]),
    ("a short post", f'<body><header><a href="/">Valley Post</a></header>{NAV}<article><p>Short update.</p></article><footer><p>Valley Post, 3 Mill Lane</p></footer></body>', ["Short update."]),
    ("many comments", f'<body>{NAV}<article><h1>The flood</h1><p>{NEW}</p></article><div id="comments">{TALK}</div></body>', ["The flood", NEW]),
    ("roles", f'<body><div role="banner"><a href="/">Valley Post</a><p>News from the river since 1911.</p></div><div role="navigation"><a href="/n">News</a></div><div role="main"><h1>The flood</h1><p>{LONG}</p><p>{MORE}</p></div><div role="complementary"><p>Our book of the flood is in the shops. It has forty plates.</p></div><div role="search">Find in this paper</div><div role="contentinfo"><p>Valley Post is printed in the old mill. Letters go to the editor.</p></div></body>', ["The flood", LONG, MORE]),
    ("sources", f'<body>{NAV}<article><h1>The flood</h1><p>{LONG}</p><h2>Sources</h2><ul><li><a href="/1">County records, 1911</a></li><li><a href="/2">Letters of the miller</a></li><li><a href="/3">A map of the valley</a></li></ul></article><footer>&copy; Valley</footer></body>', ["The flood", LONG, "Sources", "County records, 1911", "Letters of the miller", "A map of the valley"]),
    ("German names", f'<body>{NAV}<div id="inhalt"><h1>Die Flut</h1><p>{LONG}</p></div><div class="seitenleiste"><p>{NEW}</p></div><div id="kommentare"><p>I was there with my brother. It was worse than they say.</p><p>Who pays for the road now? Not the county.</p></div></body>', ["Die Flut", LONG]),
    ("Spanish names", f'<body><div class="cabecera"><a href="/">Valle</a></div><div class="contenido"><h1>La crecida</h1><p>{LONG}</p><p>{LAST}</p></div><div class="barra-lateral"><p>{NEW}</p></div><div class="comentarios"><p>I was there with my brother. It was worse than they say.</p></div><div class="pie">Valle, 3 Mill Lane</div></body>', ["La crecida", LONG, LAST]),
    ("comments in the article", f'<body>{NAV}<article><h1>The flood</h1><p>{LONG}</p><section id="comments"><h2>5 comments</h2>{TALK}</section></article></body>', ["The flood", LONG]),
    ("a form around the page", f'<body><form id="aspnetForm"><div class="menu"><a href="/">Home</a></div><div id="content"><h1>The flood</h1><p>{LONG}</p><p>{MORE}</p></div><div id="footer">Valley, 3 Mill Lane</div></form></body>', ["The flood", LONG, MORE]),
    ("a wrapper named for its sidebar", f'<body><div class="layout has-sidebar"><main><h1>The flood</h1><p>{LONG}</p><p>{LAST}</p></main><aside><p>{NEW}</p></aside></div></body>', ["The flood", LONG, LAST]),
    ("definitions", f'<body>{NAV}<main><h1>Words of the river</h1><p>{LAST}</p><dl><dt>Weir</dt><dd>A low dam across a river, to raise it.</dd><dt>Ford</dt><dd>A place to walk through.</dd></dl></main></body>', ["Words of the river", LAST, "Weir", "A low dam across a river, to raise it.", "Ford", "A place to walk through."]),
    ("a table of figures", f'<body>{NAV}<article><h1>The flood</h1><p>{LONG}</p><table><tr><th>Day</th><th>Height</th></tr><tr><td>Thursday</td><td>4.1 m</td></tr></table><p>{MORE}</p></article></body>', ["The flood", LONG, "Day", "Height", "Thursday", "4.1 m", MORE]),
    ("a byline", f'<body><article><header><h1>The flood</h1><p class="byline">By A. Miller</p></header><p>{LONG}</p><p>{MORE}</p><footer class="tags"><a href="/t">river</a> <a href="/u">mill</a></footer></article></body>', ["The flood", LONG, MORE]),
    ("code in prose", f'<body>{NAV}<article><h1>Reading the gauge</h1><p>{LAST}</p><pre>read gauge 4, then wait for an hour</pre><p>{NEW}</p></article></body>', ["Reading the gauge", LAST, "read gauge 4, then wait for an hour", NEW]),
    ("misnested inline elements", f'<body>{NAV}<article><h1><b><i>The flood</b></i></h1><p><em>{LAST}</p><p>{NEW}</em></p></article></body>', ["The flood", LAST, NEW]),
    ("many inline elements", f'<body>{NAV}<article><h1>The flood</h1><p><a href="/x">As <b><i><u><s><q><em><small><sub><sup>deep</sup></sub></small></em></q></s></u></i></b></a> as that. {LONG}</p></article></body>', ["The flood", f"As deep as that. {LONG}"]),
    ("only menus", f'<body>{NAV}<div class="sidebar"><ul><li><a href="/a">One</a></li></ul></div><footer>&copy; 2020 Valley. All rights reserved.</footer></body>', []),
    ("related within the article", f'<body>{NAV}<article><h1>The flood</h1><p>{LONG}</p><div class="related"><h3>Read on</h3><ul><li><a href="/7">A bridge for the valley</a></li><li><a href="/8">Bread by boat</a></li></ul></div><p>{MORE}</p></article></body>', ["The flood", LONG, MORE]),
    ("consent before all", f'<body><div id="consent-banner"><p>We and our partners keep data on your device. You may refuse.</p><button>Refuse</button></div><div class="site-header"><a href="/">Valley</a></div><div class="story"><h1>The flood</h1><div>{LONG}</div><div>{MORE}</div></div></body>', ["The flood", LONG, MORE]),
]
