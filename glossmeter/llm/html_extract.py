"""Main text of web pages by a tree-structured graphical model.

A page's DOM becomes a tree of blocks; inline elements belong to the block around them.  Each block is content or not.
Node potentials come from its tag, names, text and links, parent-child potentials from the kind of edge.  Sum-product
messages go up to the root and down again and give every block its exact marginal; blocks above one half that own text
are the page's main text.  The weights are trained on labelled pages that this module lays out from a fixed seed.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .html_weights import PAIR, UNARY

# -- a tolerant parser -------------------------------------------------------------------------

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as page text.
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title".split())
HIDDEN = RAW | frozenset("head svg math canvas object select button option datalist label audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A new element of the key ends an open element of the value.
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {b: {"p"} for b in _BLOCKS}
_SCOPE = frozenset("table ul ol dl div section article main body html td th form nav aside header footer".split())


class Block:
    __slots__ = ("tag", "names", "parent", "text", "linked", "depth", "kids")

    def __init__(self, tag: str, names: str, parent: int, depth: int):
        self.tag, self.names, self.parent, self.text, self.linked, self.depth, self.kids = tag, names, parent, [], 0, depth, 0


def parse(page: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """Blocks, parents first, and the runs of text in page order, each with its block. A run ends where a block begins or ends."""
    blocks, runs, pending = [Block("html", "", -1, 0)], [], []
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # tag, block, hidden
    at, links, opened = 0, 0, {}  # opened: how many elements of each tag are open, so a stray end tag costs nothing
    inline: list[dict[str, int]] = [{}]  # the same for inline elements within each open block: their end tags do not reach out of it

    def flush() -> None:
        if pending:
            runs.append((stack[-1][1], "".join(pending)))
            pending.clear()

    def put(text: str) -> None:
        if text and not stack[-1][2]:
            text = html.unescape(text)
            pending.append(text)
            if links:
                blocks[stack[-1][1]].linked += len(text.strip())

    def pop() -> None:
        nonlocal links
        tag = stack[-1][0]
        if tag not in INLINE:
            flush()
            inline.pop()
        else:
            inline[-1][tag] -= 1
            links -= tag == "a"
        opened[tag] -= 1
        stack.pop()

    find = _TOKEN.search
    while m := find(page, at):
        put(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                put(" ")
            elif (inline[-1] if tag in INLINE else opened).get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if (ends := _ENDS.get(tag)) and any(opened.get(e) for e in ends):
            i = len(stack) - 1
            while i > 0 and stack[i][0] not in ends and (stack[i][0] in INLINE or tag not in _BLOCKS and stack[i][0] not in _SCOPE):
                i -= 1
            if i > 0 and stack[i][0] in ends:
                while len(stack) > i:
                    pop()
        if tag == "body" or tag == "html":
            while len(stack) > 1 and stack[-1][0] in ("head", "title"):
                pop()
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                put(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            skip = page.find(">", at)
            at = skip + 1 if end and skip >= 0 else len(page)
            if tag not in ("title",):
                put(" ")
            continue
        hidden = stack[-1][2] or tag in HIDDEN
        opened[tag] = opened.get(tag, 0) + 1
        if tag in INLINE:
            stack.append((tag, stack[-1][1], hidden))
            inline[-1][tag] = inline[-1].get(tag, 0) + 1
            links += tag == "a"
        else:
            flush()
            inline.append({})
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(m[3] or "")).lower()
            up = stack[-1][1]
            blocks[up].kids += 1
            blocks.append(Block(tag, names, up, blocks[up].depth + 1))
            stack.append((tag, len(blocks) - 1, hidden))
    put(page[at:])
    flush()
    for i, (b, text) in enumerate(runs):
        text = " ".join(text.split())
        runs[i] = (b, text)
        if text:
            blocks[b].text.append(text)
    return blocks, [r for r in runs if r[1]]


# -- the model ---------------------------------------------------------------------------------

_KINDS = {
    "tag_main": frozenset(["article", "main"]), "tag_part": frozenset(["section", "div", "td", "tr", "table", "tbody", "body", "html"]), "tag_text": frozenset(["p", "blockquote", "pre", "figcaption", "figure"]),
    "tag_title": frozenset(["h1", "h2", "h3", "h4", "h5", "h6"]), "tag_list": frozenset(["ul", "ol", "dl"]), "tag_item": frozenset(["li", "dt", "dd"]),
    "tag_nav": frozenset(["nav", "menu"]), "tag_head": frozenset(["header"]), "tag_foot": frozenset(["footer"]), "tag_side": frozenset(["aside"]), "tag_form": frozenset(["form", "fieldset", "dialog"]),
}
_WORDS = {
    "name_main": r"article|post-?(?:body|content|text)?|entry|story|main|content|body|artikel|inhalt|beitrag|contenu|contenido|articulo|artículo",
    "name_nav": r"nav\w*|menu\w*|menü|breadcrumbs?|pagination|pager|tabs?|toc|skip\w*|brotkrumen|navegaci[oó]n|menú",
    "name_head": r"header|masthead|topbar|top|logo|branding|site-?header|kopf(?:zeile)?|en-?t[eê]te|cabecera|encabezado",
    "name_foot": r"footer|foot|bottom|copyright|legal|colophon|site-?footer|contentinfo|fu(?:ss|ß)(?:zeile|bereich)?|impressum|pied(?:-de-page)?|pie(?:-de-pagina)?|mentions",
    "name_side": r"sidebar|side|aside|widgets?|related|recommended|more|trending|rail|complementary|seiten(?:leiste|spalte)|randspalte|marginalie|barre-?lat[eé]rale|barra-?lateral|lateral|verwandt\w*|relacionad\w*|connexes?",
    "name_ad": r"ads?|advert\w*|sponsor\w*|promo\w*|banner|adsense|outbrain|taboola|dfp|werbung|anzeigen?|publicidad|publicit[eé]|anuncios?|reklame",
    "name_comment": r"comments?|commentlist|disqus|replies|reply|respond|discussion|kommentare?|diskussion|leserbriefe|antworten|commentaires?|r[eé]ponses?|comentarios?|respuestas?",
    "name_note": r"cookie\w*|consent|gdpr|dsgvo|notice|alert|newsletter|subscribe|subscription|popup|modal|overlay|signup|login|paywall|disclaimer|search|suche|recherche|buscar|hinweis|abonn\w*|anmelden|aviso",
    "name_share": r"share|sharing|social|tags|tag-?list|author-?box|byline|meta|rating|toolbar|teilen|partager|compartir|autor|auteur",
}
_WORD_RE = {k: re.compile(rf"(?:^|[\s_-])(?:{v})(?=$|[\s_-])") for k, v in _WORDS.items()}
_TEXT = ("links", "text_some", "text_long", "stops", "few_words", "rights", "no_text")
_BELOW = ("below_links", "below_share", "below_long", "around_links", "around_share", "alone", "only")
#: Where a block is: in a region of its own that is no article, or in an article; and of the latter, what counts less there.
_REGION = ("off", "main", "main_links", "main_below_links", "main_few_words", "beside_links")
FEATURES = ["bias", *_KINDS, *_WORDS, *_TEXT, *_BELOW, *_REGION]
_RIGHTS = re.compile(r"©|\(c\) ?\d|copyright|all rights reserved", re.I)
#: Kinds of edges, by the child: what opens a region of its own, what names one, and all others.
EDGES = 3


@lru_cache(maxsize=4096)
def _kind(tag: str, names: str) -> tuple[int, ...]:
    """Features of a tag and its names."""
    out = [i for i, tags in enumerate(_KINDS.values(), 1) if tag in tags]
    base = 1 + len(_KINDS)
    return (0, *out, *[i for i, r in enumerate(_WORD_RE.values(), base) if names and r.search(names)])


_OFF_TAGS = frozenset("nav menu footer aside dialog".split())
_OFF_NAMES = tuple(list(FEATURES).index(k) for k in ("name_nav", "name_foot", "name_side", "name_ad", "name_comment", "name_note", "name_share"))
_MAIN = FEATURES.index("name_main")
_COMMENT = FEATURES.index("name_comment")


def regions(blocks: list[Block]) -> tuple[list[bool], list[bool]]:
    """Of each block whether it is in a region that is no article (menus, comments and so on, by tag, role or name), and whether it is in an article.

    A region by name or a form that holds a page's main element, article or first heading is a wrapper, not such a region; an article named as a comment is no article.
    """
    n = len(blocks)
    kinds = [_kind(b.tag, b.names) for b in blocks]
    holds = [b.tag in ("main", "h1") or b.tag == "article" and _COMMENT not in k for b, k in zip(blocks, kinds)]
    for i in range(n - 1, 0, -1):
        holds[blocks[i].parent] |= holds[i]
    off, main = [False] * n, [False] * n
    for i in range(1, n):
        b, k = blocks[i], kinds[i]
        named = b.tag != "body" and (b.tag == "form" or any(x in k for x in _OFF_NAMES))
        own = b.tag in _OFF_TAGS or named and not holds[i]
        off[i] = off[b.parent] or own
        main[i] = main[b.parent] or (b.tag in ("article", "main") or _MAIN in k and b.tag != "body") and not own
    return off, main


def features(blocks: list[Block]) -> list[list[tuple[int, float]]]:
    """Of each block sparse (index, value): tag and names, own text, how much text and how many links are below and around it, and the region that it is in."""
    n = len(blocks)
    own = [" ".join(b.text) for b in blocks]
    size, linked = [len(t) for t in own], [b.linked for b in blocks]
    for i in range(n - 1, 0, -1):
        size[blocks[i].parent] += size[i]
        linked[blocks[i].parent] += linked[i]
    all_of = max(1, size[0])
    base = 1 + len(_KINDS) + len(_WORDS)
    below = base + len(_TEXT)
    region = below + len(_BELOW)
    off, main = regions(blocks)
    out = []
    for i, b in enumerate(blocks):
        f = [(k, 1.0) for k in _kind(b.tag, b.names)]
        text = own[i]
        if text:
            f.append((base, min(1.0, b.linked / len(text))))
            f.append((base + 1, 1.0))
            f.append((base + 2, min(1.0, len(text) / 400)))
            f.append((base + 3, min(1.0, (text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))) / 4)))
            if len(text) < 40:
                f.append((base + 4, 1.0))
            if len(text) < 300 and _RIGHTS.search(text):
                f.append((base + 5, 1.0))
        else:
            f.append((base + 6, 1.0))
        if size[i]:
            f.append((below, min(1.0, linked[i] / size[i])))
            f.append((below + 1, size[i] / all_of))
            f.append((below + 2, min(1.0, size[i] / 800)))
            p = b.parent
            if p >= 0:
                f.append((below + 3, min(1.0, linked[p] / size[p])))
                f.append((below + 4, size[p] / all_of))
                if size[p] == size[i]:
                    f.append((below + 5, 1.0))
            if p >= 0 and size[p] > size[i]:
                f.append((region + 5, min(1.0, max(0, linked[p] - linked[i]) / (size[p] - size[i]))))
        if text and len(text) == size[0]:  # the page has no other text
            f.append((below + 6, 1.0))
        if off[i]:
            f.append((region, 1.0))
        elif main[i]:
            f.append((region + 1, 1.0))
            if text:
                f.append((region + 2, min(1.0, b.linked / len(text))))
                if len(text) < 40:
                    f.append((region + 4, 1.0))
            if size[i]:
                f.append((region + 3, min(1.0, linked[i] / size[i])))
        out.append(f)
    return out


@lru_cache(maxsize=4096)
def _edge(tag: str, names: str) -> int:
    if tag in ("nav", "menu", "header", "footer", "aside", "form", "article", "main", "dialog"):
        return 1
    return 2 if names and any(r.search(names) for r in _WORD_RE.values()) else 0


class TreeModel:
    """unary: a weight a feature for being content. pair[kind][parent][child]: log-potentials of edges."""

    def __init__(self, unary: np.ndarray | None = None, pair: np.ndarray | None = None):
        self.unary = np.zeros(len(FEATURES)) if unary is None else unary
        self.pair = np.zeros((EDGES, 2, 2)) if pair is None else pair

    def marginals(self, blocks: list[Block], feats: list | None = None) -> tuple[list[float], list[np.ndarray]]:
        """P(content) of each block by sum-product, and the pair marginals of each block with its parent (for training)."""
        u, n = self.unary.tolist(), len(blocks)
        pair = [[[math.exp(v) for v in row] for row in k] for k in self.pair.tolist()]
        feats = feats or features(blocks)
        score = [sum(u[i] * v for i, v in f) for f in feats]
        own = [(1.0 / (1.0 + math.exp(min(50.0, s))), 1.0 / (1.0 + math.exp(min(50.0, -s)))) for s in score]
        up0, up1 = [o[0] for o in own], [o[1] for o in own]  # own potential times messages from below
        to0, to1 = [1.0] * n, [1.0] * n  # message to the parent
        for i in range(n - 1, 0, -1):
            p = pair[_edge(blocks[i].tag, blocks[i].names)]
            a, b = up0[i], up1[i]
            m0, m1 = p[0][0] * a + p[0][1] * b, p[1][0] * a + p[1][1] * b
            z = m0 + m1
            m0, m1 = max(m0 / z, 1e-12), max(m1 / z, 1e-12)
            to0[i], to1[i] = m0, m1
            q = blocks[i].parent
            a, b = up0[q] * m0, up1[q] * m1
            z = a + b
            up0[q], up1[q] = max(a / z, 1e-200), max(b / z, 1e-200)
        down0, down1 = [1.0] * n, [1.0] * n
        out, pairs = [0.0] * n, [None] * n
        out[0] = up1[0] / (up0[0] + up1[0])
        for i in range(1, n):
            q = blocks[i].parent
            p = pair[_edge(blocks[i].tag, blocks[i].names)]
            a, b = down0[q] * up0[q] / to0[i], down1[q] * up1[q] / to1[i]  # the parent without this child
            z = a + b
            a, b = a / z, b / z
            d0, d1 = a * p[0][0] + b * p[1][0], a * p[0][1] + b * p[1][1]
            z = d0 + d1
            down0[i], down1[i] = d0 / z, d1 / z
            x, y = down0[i] * up0[i], down1[i] * up1[i]
            out[i] = y / (x + y)
            pairs[i] = (a, b, p, up0[i], up1[i])
        return out, pairs


def train(pages: list[tuple[str, frozenset[str]]], rounds: int = 30, rate: float = 0.5, decay: float = 0.001) -> TreeModel:
    """Maximum likelihood by Adagrad; a labelled page is (html, texts of its content blocks). Of blocks without text, the innermost around all content is content, and so are those between it and content."""
    data = []
    for page, good in pages:
        blocks, _ = parse(page)
        y = [1 if b.text and " ".join(b.text) in good else 0 for b in blocks]
        below = y[:]
        for i in range(len(blocks) - 1, 0, -1):
            below[blocks[i].parent] += below[i]
        for i, b in enumerate(blocks):  # the deepest block around all content, and what leads from there to content
            if not b.text:
                y[i] = int(0 < below[i] and (below[i] < below[0] or not any(c.parent == i and below[j] == below[i] for j, c in enumerate(blocks))))
        data.append((blocks, features(blocks), y))
    model, gu, gp = TreeModel(), np.full(len(FEATURES), 1e-6), np.full((EDGES, 2, 2), 1e-6)
    for _ in range(rounds):
        for blocks, feats, y in data:
            m, pairs = model.marginals(blocks, feats)
            du, dp = -decay * model.unary, -decay * model.pair
            for i, b in enumerate(blocks):
                for k, v in feats[i]:
                    du[k] += v * (y[i] - m[i])
                if i:
                    a, c, p, u0, u1 = pairs[i]
                    j = np.array([[a * p[0][0] * u0, a * p[0][1] * u1], [c * p[1][0] * u0, c * p[1][1] * u1]])
                    kind = _edge(b.tag, b.names)
                    dp[kind] -= j / j.sum()
                    dp[kind][y[b.parent]][y[i]] += 1
            gu, gp = gu + du * du, gp + dp * dp
            model.unary = model.unary + rate * du / np.sqrt(gu)
            model.pair = model.pair + rate * dp / np.sqrt(gp)
    return model


def labelled_pages(n: int = 600, seed: int = 7) -> list[tuple[str, frozenset[str]]]:
    """Pages laid out from a seed, with the texts of their content blocks.

    Outer shapes with and without semantic tags and names, also tables for layout; paragraphs as p, as div, or between line
    breaks; titles inside and outside of headers; long and very short articles; and everything around them that is no content.
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou") + r.choice("bdklmnrst") for _ in range(r.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + "."
    name = lambda *of: f' {r.choice(["class", "id"])}="{x}"' if (x := r.choice(of)) else ""
    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(r.choice([1, 1, 2, 3])))}</a>'
    links = lambda k: "".join(f"<li>{link()}</li>" for _ in range(k))
    out = []
    for _ in range(n):
        good: set[str] = set()

        def keep(t: str) -> str:
            good.add(t)
            return t

        style, short = r.choice(["p"] * 6 + ["div", "div", "br"]), r.random() < 0.25
        title = keep(say(1, 9)[: r.choice([-1, None, None])])
        head = r.choice([f"<h1>{title}</h1>"] * 3 + [f"<h2>{title}</h2>", f'<header><h1>{title}</h1></header>', f'<header><h1>{title}</h1><p class="{r.choice(["byline", "meta"])}">{word()} {word()}</p></header>', f'<div class="{r.choice(["title", "headline", "entry-title"])}">{title}</div>'])
        if r.random() < 0.12:
            good, head = set(), ""
        post = not head and r.random() < 0.4  # a few words and no title
        body, loose = head, []
        for _ in range(r.randint(1, 2) if short else r.randint(1, 7)):
            k = r.random()
            if k < 0.72 or style == "br":
                t = r.choice([say(1, 2)[:-1], say(1, 2), say(1, 24)]) if short else " ".join(say(3, 24) for _ in range(r.choice([1, 1, 2, 4])))
                if r.random() < 0.06:  # no sentences
                    t = " ".join([word()] * r.randint(5, 90))
                first, _, rest = t.partition(" ")
                inner = t if r.random() < 0.7 else f'<a href="/{first}">{first}</a> {rest}'
                if style == "br":
                    loose.append((t, inner))
                    continue
                keep(t)
                if r.random() < 0.06:  # a paragraph that is a link
                    inner = f'<a href="/{first}">{t}</a>'
                body += f"<{style}>{inner}</{style}>"
                if r.random() < 0.15:
                    body += f"<{style}>{keep(word())}</{style}>"
            elif k < 0.8:
                body += f"<h2>{keep(say(2, 6))}</h2>"
            elif k < 0.86:
                body += r.choice([f"<blockquote>{keep(say(6, 20))}</blockquote>", f"<pre>{keep(say(4, 12))}</pre>", f'<figure><img src="x"><figcaption>{keep(say(3, 9))}</figcaption></figure>'])
            elif k < 0.895:  # sources
                body += r.choice(["", f"<h2>{keep(say(1, 3))}</h2>"]) + r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f'<li><a href="/{word()}">{keep(say(1, 8)[: r.choice([-1, None])])}</a></li>' for _ in range(r.randint(1, 5))))
            elif k < 0.94:
                body += "<ul>" + "".join(f"<li>{keep(say(2, 12))}</li>" for _ in range(r.randint(2, 4))) + "</ul>"
            elif k < 0.96:
                body += f"<table><tr><td>{keep(say(2, 6))}</td><td>{keep(say(2, 6))}</td></tr></table>"
            else:
                body += f'<div class="{r.choice(["ad", "ads", "promo", "related", "newsletter", "share", "advert"])}">{say(4, 14)}</div>'
        if post:
            good, loose = set(), []
            body = f"<p>{keep(say(1, 6))}</p>"
        if loose:
            keep(" ".join(t for t, _ in loose))
            body += f"<div{name('', 'text', 'body')}>" + "<br><br>".join(x for _, x in loose) + "</div>"
        site = word()
        top = r.choice([f'<div role="banner"><a href="/">{site}</a><p>{say(2, 8)}</p></div>', f'<div role="navigation">{link()} {link()}</div>', f"<nav><ul>{links(6)}</ul></nav>", f"<nav>{link()} {link()} {link()}</nav>", f"<div{name('menu', 'topnav', 'navbar', '')}><ul>{links(5)}</ul></div>", f'<header><a href="/">{site}</a><p>{say(2, 5)}</p><nav><ul>{links(5)}</ul></nav></header>', f'<div id="header"><h2>{site}</h2><ul class="nav">{links(4)}</ul></div>', f'<div class="breadcrumb"><a href="/">{site}</a> / {site}</div>', f"<p>{link()} | {link()} | {link()}</p>", f"<div>{link()} {link()} {link()} {link()}</div>", f"<ul>{links(5)}</ul>", f"<div{name('masthead', 'site-header', 'top')}>{site} {word()}</div>", ""])
        notice = r.choice([f'<div class="cookie-notice"><p>{say(8, 18)}</p></div>', f'<div class="notice">{say(4, 12)}</div>', "", "", "", f'<div class="ad">{say(4, 14)} {say(3, 9)}</div>', f'<div class="ad"><p>{say(4, 14)}</p></div>', f'<div id="banner" class="advert">{say(4, 14)}</div>', f'<dialog>{say(4, 12)}<button>{site}</button></dialog>'])
        side = r.choice([f'<div role="complementary"><p>{say(6, 20)} {say(3, 9)}</p></div>', f'<div{name("seitenleiste", "barra-lateral", "sidebar")}><p>{say(6, 20)} {say(6, 20)}</p></div>', f"<aside><h3>{say(1, 3)}</h3><p>{say(5, 16)}</p><ul>{links(4)}</ul></aside>", f'<div class="sidebar"><h3>{say(1, 3)}</h3><p>{say(6, 20)}</p></div>', "", f'<div class="widget related"><ul>{links(5)}</ul></div>', f"<div><h4>{word()}</h4><ul>{links(4)}</ul></div>", f"<section{name('related', 'trending', 'recommended')}><h2>{say(1, 3)}</h2><ul>{links(4)}</ul></section>"])
        form = r.choice([f'<div role="search">{say(1, 4)}</div>', f'<form action="/s"><p>{say(3, 8)}</p><input name="q"><button>{word()}</button></form>', "", "", f'<div class="newsletter"><form>{say(3, 8)}<input></form></div>', f"<form><label>{word()}</label><input><select><option>{word()}<option>{word()}</select></form>"])
        talk = r.choice(["", "", f'<div class="comments"><h3>{say(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{say(5, 24)} {say(3, 9)}</p></div>' for _ in range(3)) + "</div>", f'<section id="comments"><ul class="commentlist"><li>{say(5, 24)}</li><li>{say(5, 24)}</li></ul></section>', f'<div{name("comments", "kommentare", "commentaires", "comentarios", "discussion")}>' + "".join(f'<div class="{r.choice(["comment", "reply", "", "kommentar"])}">{say(5, 24)} {say(4, 20)}</div>' for _ in range(r.randint(1, 6))) + "</div>", f'<div id="disqus">{say(3, 9)}<article class="comment"><p>{say(5, 24)}</p></article></div>'])
        foot = r.choice([f'<div role="contentinfo">{say(3, 12)}</div>', f'<div class="fusszeile">{say(3, 9)} {say(3, 9)}</div>', f"<footer>{say(3, 9)}</footer>", f"<footer><p>{say(4, 12)}</p><ul>{links(3)}</ul></footer>", f'<div class="footer"><p>&copy; {say(4, 10)}</p></div>', f'<div id="footer">{say(3, 10)}</div>', "", f"<p>&copy; 20{r.randint(10, 30)} {site}</p>", f"<div>Copyright {site}. All rights reserved.</div>", f"<div>{link()} {link()} {link()}</div>"])
        open_, close = r.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), (f"<div{name('content', 'main', 'story', 'entry')}>", "</div>"), ('<div id="main"><div class="post-body">', "</div></div>"), (f"<div{name('post-body', 'entry-content', 'article-body', 'post', 'page')}>", "</div>"), ('<article class="post">', "</article>"), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("<section>", "</section>"), ("", "")])
        inside = r.random() < 0.3
        main = open_ + body + (talk + form if inside and open_ else "") + close
        inside = inside and bool(open_)
        rest = "" if inside else form + talk
        if r.random() < 0.14:  # a table for layout
            cells = [f"<td{name('', '', 'left', 'nav')}>{r.choice([top, link(), link() + '<br>' + link(), f'<ul>{links(4)}</ul>'])}</td>", f"<td{name('', '', 'content')}>{main}</td>"]
            bar = f"<td>{side}</td>" if side and r.random() < 0.4 else ""
            page = f"{notice}<table><tr>{cells[0]}{cells[1]}{bar}</tr></table>{rest}{foot}"
        else:
            before = r.random() < 0.4
            page = f"{notice}{top}{side + main if before else main + rest}{rest if before else side}{foot}"
        if r.random() < 0.14:  # nothing around it
            page = main if not inside else open_ + body + close
        if r.random() < 0.3:
            page = f"<div{name('', '', 'wrapper', 'container', 'page')}>{page}</div>"
        if r.random() < 0.07:  # a paragraph's bare text in a cell
            t = keep(" ".join(say(6, 20) for _ in range(3)))
            good = {t}
            page = f"<table><tr><td>{link()}</td><td>{t}</td></tr></table>{foot}"
        elif r.random() < 0.05:  # one paragraph and nothing else
            good = {t := say(5, 30)}
            page = r.choice([f"<p>{t}</p>", f"<div>{t}</div>", f"<article><p>{t}</p></article>"])
        out.append((f"<html><body>{page}</body></html>", frozenset(good)))
    return out


def extract(page: str | None, model: TreeModel) -> str:
    """The texts of content blocks in page order, joined by a blank.

    If no block passes one half, a page with an article or main element still has its text there: the one of highest marginal gives what is in no other region.
    """
    if not page:
        return ""
    blocks, runs = parse(page)
    m, _ = model.marginals(blocks)
    found = [t for b, t in runs if m[b] > 0.5]
    if runs and not found:
        off, _ = regions(blocks)
        best = max((i for i, b in enumerate(blocks) if b.tag in ("article", "main") and not off[i]), key=lambda i: m[i], default=None)
        if best is not None:
            below = [False] * len(blocks)
            for i in range(best, len(blocks)):
                below[i] = i == best or below[blocks[i].parent]
            found = [t for b, t in runs if below[b] and not off[b]]
    return " ".join(found)


def main_text(pages: DataFrame, model: TreeModel, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns in keep, text, n_chars (code points).

    A null or empty page, and one without content blocks, has an empty text.  Markup of any kind is read whole: what never
    closes ends with the page.  Rows pass one by one; other columns are not read.
    """
    unary, pair = model.unary, model.pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TreeModel(unary, pair)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [extract(h.as_py(), own) for h in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    slim = pages.select(*[pages[k].alias(k) for k in keep], pages[html_col].cast("string").alias("__html"))
    kinds = [f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keep]
    return slim.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))


@lru_cache(maxsize=1)
def default_model() -> TreeModel:
    """The model trained on labelled_pages(), from its stored weights."""
    return TreeModel(np.array([UNARY[k] for k in FEATURES]), np.array(PAIR))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"), default_model())
