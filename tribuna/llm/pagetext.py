"""Main text of pages by a tree-structured graphical model over DOM nodes.

A tolerant parser turns a page into a tree of block elements (inline markup belongs to its block; scripts, styles, titles and
form controls are left out; a head has nothing else that is text, and what else stands in it is the body's, as in HTML).
Each node is content or not; a node's evidence is its tag, the words of its class and id, its share of link text and the length of its own text. Potentials tie each child to its parent. One sum-product pass from the
leaves to the root and one back give each node's marginal; blocks whose node is content with more than 1/2 are the text.

Evidence and tie potentials are counted on labelled pages of two generators. `labelled_sheets` draws trees of sections from a
grammar; `labelled_pages` makes layouts of many kinds with articles, menus, headers, footers, sidebars, notices, adverts, forms and comments, every node labelled, class words drawn from several
languages, from words that tell nothing, or left out, so that structure has to carry what words do not say. A class word that
was never seen is no evidence. A page of which no block reaches 1/2 gives its best-scoring container, unless that is plainly
none (LEAST). Fitting takes a second on the driver; the model is a few kilobytes. Extraction is one narrow pass over whole pages.

Defined cases: null and empty html give the empty text; html without tags is one block; unclosed and stray tags are closed or
skipped; an element with a hyphen in its name is a block where it holds blocks or stands among them, and its name's words are class
words, but inline within running text; an element that is left out and not closed before its parent ends at the next start or end of a block (an unclosed
script or style, as in HTML, at the end of the page); an attribute whose quote is never closed ends with its tag; elements nest
to any depth; ids of any type, repeated rows and other columns stay apart and do not matter.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that start a block of their own. Fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements whose text is never read.
SKIPPED = frozenset("script style noscript template title select button textarea iframe object svg math canvas audio video datalist option input".split())
RAW = frozenset("script style noscript template title textarea iframe".split())
#: Skipped elements in which another of their kind ends the open one, and those that run to the end of the page if unclosed.
ALONE, TO_END = frozenset("select button audio video datalist option".split()), frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key closes an open element of the value, within the nearest element of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SMOOTHING, PAGES, SEED = 0.5, 900, 7
#: A page without content blocks gives its best container if one of its blocks is content with this chance at least.
LEAST = 0.2

_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)|([^>]*)(?:>|$)))", re.S)
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.I)
#: Attributes in order: what stands in a quoted value is no attribute.
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
#: Elements of running text: an element of another namespace in them, or after text, is inline.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 dt figcaption caption summary pre legend".split())
_NAME = re.compile(r"[^\W\d_]+")


class Node:
    """An element with its own text in blocks: parent's index, tag, class words, [(position, text)], link characters."""

    __slots__ = ("parent", "tag", "words", "texts", "chars", "linked", "kids")

    def __init__(self, parent: int, tag: str, words: tuple[str, ...]):
        self.parent, self.tag, self.words = parent, tag, words
        self.texts, self.chars, self.linked, self.kids = [], 0, 0, 0


def boundary(page: str, at: int, tag: str, never: dict[str, int]) -> int:
    """Where the next start or end of a block begins, or the next start of `tag`."""
    while m := _TAG.search(page, at):
        at = m.end()
        if m.group(2) is None:
            continue
        name, closing = m.group(2).lower(), bool(m.group(1))
        if name in BLOCKS or name == tag and not closing:
            return m.start()
        if name in RAW and not closing and name != tag:
            at = skip_raw(page, at, name, never)
    return len(page)


def skip_raw(page: str, at: int, tag: str, never: dict[str, int]) -> int:
    """Where an element without markup ends whose start tag ends at `at`; `never` gets where a tag is not closed any more."""
    if at < never.get(tag, at + 1):
        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
        if end:
            return end.end()
        never[tag] = at
    if tag in TO_END:
        return len(page)
    block = _BLOCK.search(page, at)
    return block.start() if block else len(page)


def skip_element(page: str, start: int, tag: str, above: Counter, ends: dict[int, int | None], never: dict[str, int]) -> int:
    """Where a skipped element with markup ends whose start tag ends at `start`, in open blocks of the tags `above`.

    `ends` keeps, by where start tags end, where their elements end (None: not closed), so a part of a page is read once."""
    if start not in ends:
        own, inside, at = [start], [], start
        while own and (m := _TAG.search(page, at)):
            at = m.end()
            if m.group(2) is None:
                continue
            name, closing = m.group(2).lower(), bool(m.group(1))
            if name == tag:
                if closing:
                    ends[own.pop()] = at
                elif tag in ALONE:
                    break
                elif not m.group(0).endswith("/>"):
                    own.append(at)
            elif name in RAW and not closing:
                at = skip_raw(page, at, name, never)
            elif name in BLOCKS and name != "hr":
                if not closing:
                    inside.append(name)
                elif name in inside:
                    while inside.pop() != name:
                        pass
                elif above[name] or name in ("body", "html"):
                    break
        ends.update(dict.fromkeys(own))
    end = ends[start]
    return boundary(page, start, tag, never) if end is None else end


def attribute_words(rest: str) -> Iterator[str]:
    """Words of class, id and role, and `hidden` for elements that are not shown."""
    hidden = False
    for m in _ATTR.finditer(rest):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id", "role"):
            yield from _NAME.findall(value.lower())
        hidden = hidden or name == "hidden" or name == "style" and bool(_NONE.search(value))
    if hidden:
        yield "hidden"


def parse(page: str) -> list[Node]:
    """Nodes in document order, a parent before its children; node 0 is the root."""
    nodes, stack = [Node(-1, "#root", ())], [0]
    run: list[str] = []  # raw text of the present block
    link, run_linked, order = 0, 0, 0
    at, n = 0, len(page)
    ends: dict[int, int | None] = {}
    never: dict[str, int] = {}
    opened: Counter = Counter()  # open blocks by tag

    def shut_from(k: int) -> None:
        for i in stack[k:]:
            opened[nodes[i].tag] -= 1
        del stack[k:]

    def flush() -> None:
        nonlocal run, run_linked, order
        if run:
            text = " ".join(_html.unescape("".join(run)).split())
            if text:
                own = nodes[stack[-1]]
                own.texts.append((order, text))
                own.chars += len(text)
                own.linked += min(run_linked, len(text))
                order += 1
            run, run_linked = [], 0

    while at < n:
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            run.append(piece)
            if link:
                run_linked += len(piece)
        if not m:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if tag in SKIPPED:
            if not closing and tag not in VOID:
                if tag in RAW:
                    at = skip_raw(page, at, tag, never)
                else:
                    flush()
                    at = skip_element(page, at, tag, opened, ends, never)
            continue
        custom = "-" in tag
        if custom and not (opened[tag] if closing else nodes[stack[-1]].tag not in RUNNING and not "".join(run).strip()):
            continue
        if tag not in BLOCKS and not custom:
            if tag == "a":
                link = 0 if closing else 1
            elif tag == "br":
                run.append(" ")
            continue
        flush()
        link = 0
        if closing:
            if opened[tag]:
                shut_from(next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == tag))
            continue
        if tag == "hr":
            continue
        if nodes[stack[-1]].tag == "p":
            shut_from(len(stack) - 1)
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag][0]):
            shut, within = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[k]].tag
                if open_tag in within:
                    break
                if open_tag in shut:
                    shut_from(k)
                    break
        rest = m.group(3) or m.group(4) or ""
        words = tuple(_NAME.findall(tag)) if custom else ()
        if rest:
            words = tuple(dict.fromkeys([*words, *attribute_words(rest)]))
        nodes[stack[-1]].kids += 1
        nodes.append(Node(stack[-1], tag, words))
        stack.append(len(nodes) - 1)
        opened[tag] += 1
    flush()
    return nodes


def tie_class(tag: str) -> int:
    """Which potentials tie a child to a parent of this tag: the page's frame, generic containers, or an element of text."""
    return 0 if tag in ("#root", "html", "body") else 1 if tag in ("div", "section", "center") else 2


def evidence(nodes: list[Node]) -> list[list[str]]:
    """Names of the features of each node; text and links count with all that is below."""
    chars, linked, blocks = [x.chars for x in nodes], [x.linked for x in nodes], [len(x.texts) for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        linked[nodes[i].parent] += linked[i]
        blocks[nodes[i].parent] += blocks[i]
    within = [False] * len(nodes)  # an article or main part
    for i, x in enumerate(nodes):
        within[i] = x.tag in ("article", "main") or i > 0 and within[x.parent]
    out = []
    for i, x in enumerate(nodes):
        share = linked[i] / chars[i] if chars[i] else 0.0
        above = nodes[x.parent].tag if i else ""
        own = [f"tag={x.tag}", f"under={above}/{x.tag}", f"links={'none' if not share else 'few' if share < 0.34 else 'many' if share < 0.8 else 'all'}", f"length={min(6, int(math.log2(chars[i] + 1) / 2))}", f"part={min(4, int(5 * chars[i] / (chars[0] or 1)))}"]
        if share >= 0.34:  # menus are lists of short links, sources of long ones, and these stand in articles
            own.append(f"linked={min(7, int(math.log2(chars[i] / blocks[i])))}/{within[i]}")
        own += [f"word={w}" for w in x.words]
        out.append(own)
    return out


#: Words of class names and ids, in several languages, that training pages take for content and for the rest, and words that
#: tell nothing. Fixed values of this model.
NAMES = {
    True: "content article post entry main story body text page prose copy single blog news contenido articulo noticia cuerpo texto entrada contenu corps texte actualite inhalt artikel beitrag haupttext nachricht conteudo artigo materia corpo contenuto articolo notizia testo tekst innehall",
    False: "nav navbar navigation menu header masthead banner topbar footer foot bottom copyright sidebar side aside widget rail ad ads advert advertisement sponsor sponsored promo promoted cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe signup login search form comment comments disqus reply replies discussion responses related recommended share social breadcrumb breadcrumbs pagination pager tags hidden toolbar skip complementary contentinfo dialog cabecera pie lateral anuncio publicidad aviso comentario comentarios relacionados compartir buscar entete pied barre publicite commentaire commentaires recherche partager kopfzeile fusszeile seitenleiste werbung anzeige hinweis kommentar kommentare verwandt suche teilen cabecalho rodape publicidade comentarios intestazione piede annuncio pubblicita commenti",
    None: "wrapper container row col inner outer box block wrap grid flex item section group left right center top layout holder panel module component",
}


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> Iterator[tuple[str, list[bool]]]:
    """(html, label of each node in document order after the root): layouts of many kinds, by rules."""
    rnd = random.Random(seed)
    letters = "etaoinshrdlu"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rnd.randrange(a, b)))
    good, bad = NAMES[True].split(), NAMES[False].split()

    for _ in range(pages):
        labels: list[bool] = []
        silent = rnd.choice([0.1, 0.1, 0.5, 1.0])  # share of class words that say nothing on this page

        def tag(name: str, label: bool, inner, attrs: str = "") -> str:
            labels.append(label)
            return f"<{name}{attrs}>{inner() if callable(inner) else inner}</{name}>"

        def named(pool: list[str], p: float = 0.8) -> str:
            if rnd.random() > p:
                return ""
            if rnd.random() < silent:  # a word that is nowhere else, or one that tells nothing
                return f' class="{word() + word() if rnd.random() < 0.5 else rnd.choice(NAMES[None].split())}"'
            return f' {rnd.choice(["class", "class", "id"])}="{rnd.choice(["", "", "the-", "site-", "x "])}{rnd.choice(pool)}"'

        def links(label: bool) -> str:
            return tag("ul", label, lambda: "".join(tag("li", label, f'<a href="/{word()}">{words(1, 4)}</a>') for _ in range(rnd.randrange(2, 9))))

        def boiler() -> str:
            kind = rnd.randrange(9)
            if kind == 0:
                return tag("nav", False, lambda: links(False), named(bad, 0.4))
            if kind == 1:
                return tag("aside", False, lambda: tag(rnd.choice(["h2", "h3"]), False, words(1, 4)) + (links(False) if rnd.random() < 0.6 else tag("p", False, words(5, 40))), named(bad, 0.5))
            if kind == 2:
                return tag("form", False, lambda: tag(rnd.choice(["p", "div"]), False, words(2, 12)) + "<input><button>x</button>", named(bad, 0.3))
            if kind == 3:
                return tag(rnd.choice(["div", "section"]), False, words(3, 40), named(bad, 1))
            if kind == 4:
                return tag(rnd.choice(["div", "section", "ol"]), False, lambda: "".join(tag(rnd.choice(["div", "article", "li"]), False, lambda: tag("p", False, words(4, 50)), named(["comment", "reply", "comment-body", "comentario", "kommentar", "commentaire"], 1)) for _ in range(rnd.randrange(1, 5))), named(["comments", "comment-list", "discussion", "responses", "replies", "comentarios", "kommentare", "commentaires"], 1))
            if kind == 5:
                return tag("div", False, lambda: "".join(tag("p", False, words(3, 30)) for _ in range(rnd.randrange(1, 3))), named(bad, 1))
            if kind == 6:
                return tag("div", False, lambda: links(False), named(bad, 0.7))
            if kind == 7:
                return tag("section", False, lambda: tag("h3", False, words(1, 4)) + tag("p", False, words(3, 30)), named(bad, 1))
            return tag("div", False, lambda: tag("div", False, words(3, 30)), named(bad, 1))

        def block() -> str:
            kind = rnd.randrange(15)
            if kind == 14:  # sources: a list of links that belongs to the article
                return (tag(rnd.choice(["h2", "h3", "p"]), True, words(1, 3)) if rnd.random() < 0.5 else "") + tag(rnd.choice(["ul", "ol"]), True, lambda: "".join(tag("li", True, f'<a href="/{word()}">{words(2, 12)}</a>' + (f" {words(1, 8)}" if rnd.random() < 0.3 else "")) for _ in range(rnd.randrange(1, 7))))
            if kind == 0:
                return tag(rnd.choice(["ul", "ol"]), True, lambda: "".join(tag("li", True, words(2, 25)) for _ in range(rnd.randrange(2, 6))))
            if kind == 1:
                return tag("blockquote", True, lambda: tag("p", True, words(4, 40)))
            if kind == 2:
                return tag(rnd.choice(["h2", "h3", "h4"]), True, words(1, 8))
            if kind == 3:
                return tag("table", True, lambda: "".join(tag("tr", True, lambda: "".join(tag("td", True, words(1, 4)) for _ in range(3))) for _ in range(2)))
            if kind == 4:
                return tag("p", True, f"{words(3, 20)} <a href='/x'>{words(1, 3)}</a> {words(3, 20)}")
            if kind == 5:
                return tag(rnd.choice(["div", "section"]), True, lambda: "".join(tag("p", True, words(5, 60)) for _ in range(rnd.randrange(1, 3))), named(good, 0.3))
            if kind == 6:
                return tag("pre", True, words(3, 30))
            if kind == 7:
                return tag("figure", True, lambda: tag("figcaption", True, words(2, 12)))
            return tag("p", True, words(1, 90))

        def article() -> str:
            title = lambda: tag("h1", True, words(2, 10))
            head = lambda: (title() if rnd.random() < 0.75 else tag("header", True, lambda: title() + (tag("p", True, words(2, 12)) if rnd.random() < 0.5 else ""))) if rnd.random() < 0.8 else ""
            tail = lambda: tag("footer", False, words(2, 12), named(bad, 0.2)) if rnd.random() < 0.1 else ""
            inside = lambda: head() + "".join(boiler() if rnd.random() < 0.08 else block() for _ in range(rnd.randrange(1, 12))) + tail()
            kind = rnd.randrange(10)
            if kind < 5:
                return tag("article", True, inside, named(good, 0.3))
            if kind < 7:
                return tag("main", True, lambda: tag("article", True, inside) if rnd.random() < 0.5 else inside(), named(good, 0.3))
            return tag("div", True, lambda: tag("div", True, inside, named(good, 0.6)) if rnd.random() < 0.4 else inside(), named(good, 0.9))

        def body() -> str:
            top = "".join(boiler() for _ in range(rnd.randrange(0, 3)))
            header = tag("header", False, lambda: tag(rnd.choice(["h1", "div", "p"]), False, words(1, 5)) + (tag("nav", False, lambda: links(False)) if rnd.random() < 0.6 else ""), named(bad, 0.3)) if rnd.random() < 0.6 else ""
            middle = article() + "".join(boiler() for _ in range(rnd.randrange(0, 4)))
            foot = tag("footer", False, lambda: words(2, 25) if rnd.random() < 0.5 else tag("p", False, words(2, 20)), named(bad, 0.2)) if rnd.random() < 0.8 else ""
            return header + top + middle + foot

        if rnd.random() < 0.25:
            page = tag("body", True, lambda: tag("div", True, body, ' class="wrapper"'))
        elif rnd.random() < 0.1:
            page = tag("body", True, lambda: "".join(block() for _ in range(rnd.randrange(1, 8))))
        else:
            page = tag("body", True, body)
        yield page, labels


def labelled_sheets(pages: int = PAGES // 2, seed: int = SEED) -> Iterator[tuple[str, list[bool]]]:
    """The same from another generator: pages as trees of sections drawn from a grammar, with frames of tables or of elements of
    their own, definition lists, sources, threads of remarks, and text that stands in containers without paragraphs."""
    rnd = random.Random(seed + 1)
    text = lambda low, high: " ".join("".join(rnd.choice("aeioulnrstmpdcgbv") for _ in range(rnd.randrange(1, 11))) for _ in range(rnd.randrange(low, high)))
    frames = {"nav": ["nav", "site-nav", "app-menu", "div"], "head": ["header", "site-header", "div"], "foot": ["footer", "site-footer", "div"], "side": ["aside", "side-panel", "div"], "notice": ["div", "cookie-notice", "dialog"]}
    said = {"nav": "menu nav navigation", "head": "header masthead banner", "foot": "footer bottom copyright", "side": "sidebar related widget", "notice": "cookie notice consent alert"}

    for _ in range(pages):
        labels: list[bool] = []
        plain = rnd.random() < 0.4  # no class words at all

        def put(name: str, label: bool, parts, attrs: str = "") -> str:
            labels.append(label)
            inner = "".join(p() if callable(p) else p for p in (parts if isinstance(parts, list) else [parts]))
            return f"<{name}{attrs}>{inner}</{name}>"

        def anchors(label: bool, low: int, high: int) -> list:
            return [lambda: put("li", label, f"<a href='{text(1, 2)}'>{text(low, high)}</a>") for _ in range(rnd.randrange(2, 8))]

        def frame(kind: str) -> str:
            name = rnd.choice(frames[kind])
            own = rnd.choice(said[kind].split()) if name == "div" or not plain and rnd.random() < 0.4 else ""
            attrs = f' class="{own}"' if own else ""
            lists = lambda: put("ul", False, anchors(False, 1, 4))
            if kind == "nav":
                return put(name, False, [lists], attrs)
            if kind == "side":
                return put(name, False, [lambda: put("h4", False, text(1, 4)), lists if rnd.random() < 0.5 else lambda: put("p", False, text(4, 25))], attrs)
            return put(name, False, text(2, 20) if rnd.random() < 0.5 else [lambda: put("p", False, text(2, 20))], attrs)

        def piece(depth: int) -> str:
            kind = rnd.choice(["p"] * 6 + ["list", "terms", "table", "quote", "code", "sources", "bare", "section"])
            if kind == "section" and depth < 3:
                return put("section", True, [lambda: put(f"h{min(6, depth + 2)}", True, text(1, 7)), *[lambda: piece(depth + 1) for _ in range(rnd.randrange(1, 4))]])
            if kind == "list":
                return put(rnd.choice(["ul", "ol"]), True, [lambda: put("li", True, text(1, 20)) for _ in range(rnd.randrange(2, 6))])
            if kind == "terms":
                return put("dl", True, [lambda: put("dt", True, text(1, 4)) + put("dd", True, text(3, 25)) for _ in range(rnd.randrange(1, 4))])
            if kind == "table":
                return put("table", True, [lambda: put("tr", True, [lambda: put("td", True, text(1, 5)) for _ in range(2)]) for _ in range(rnd.randrange(2, 5))])
            if kind == "quote":
                return put("blockquote", True, text(5, 40))
            if kind == "code":
                return put("pre", True, text(4, 30))
            if kind == "sources":
                return put("h3", True, text(1, 3)) + put(rnd.choice(["ul", "ol"]), True, anchors(True, 3, 12))
            if kind == "bare":
                return put("div", True, text(8, 70))
            return put("p", True, text(2, 30) + (f" <a href='x'>{text(1, 4)}</a> {text(2, 20)}" if rnd.random() < 0.3 else ""))

        def thread() -> str:
            remark = lambda: put("li", False, [lambda: put("div", False, text(3, 40))], "" if plain and rnd.random() < 0.5 else ' class="comment"')
            return put(rnd.choice(["div", "section", "comment-thread"]), False, [lambda: put("ol", False, [remark for _ in range(rnd.randrange(1, 5))])], f' id="{rnd.choice(["comments", "replies", "discussion"])}"')

        def story() -> str:
            return put(rnd.choice(["article", "main", "article", "div"]), True, [lambda: put("h1", True, text(2, 9)), *[lambda: piece(0) for _ in range(rnd.randrange(2, 10))]], "" if plain else ' class="article"')

        if rnd.random() < 0.25:  # a frame of tables: menu, story, side
            row = [lambda: put("td", False, [lambda: frame("nav")]), lambda: put("td", True, [story])] + ([lambda: put("td", False, [lambda: frame("side")])] if rnd.random() < 0.5 else [])
            parts = [lambda: put("table", True, [lambda: put("tr", True, row)]), lambda: frame("foot")]
        else:
            parts = [lambda k=k: frame(k) for k in ("head", "nav") if rnd.random() < 0.7] + [story]
            parts += [thread] if rnd.random() < 0.4 else []
            parts += [lambda k=k: frame(k) for k in ("side", "notice", "foot") if rnd.random() < 0.5]
        yield put("body", True, parts), labels


@lru_cache(maxsize=2)
def fit(pages: int = PAGES, seed: int = SEED) -> tuple[dict[str, float], tuple[tuple[float, ...], ...]]:
    """(log-odds of each feature; for each tie class the potentials not|not, content|not, not|content, content|content)."""
    counts, pairs, totals = {True: Counter(), False: Counter()}, Counter(), Counter()
    for page, labels in chain(labelled_pages(pages, seed), labelled_sheets(pages // 2, seed)):
        nodes = parse(page)
        if len(nodes) != len(labels) + 1:
            raise ValueError("a labelled page does not parse as it was made")
        marks = [True, *labels]
        for i, features in enumerate(evidence(nodes)):
            if i:
                counts[marks[i]].update(features)
                totals[marks[i]] += 1
                pairs[tie_class(nodes[nodes[i].parent].tag), marks[nodes[i].parent], marks[i]] += 1
    known = set(counts[True]) | set(counts[False])
    names = {w for pool in NAMES.values() for w in pool.split()} | {"hidden"}
    odds = {}
    for f in known:
        if f.startswith("word=") and f[5:] not in names:
            continue
        odds[f] = math.log((counts[True][f] + SMOOTHING) / (totals[True] + 2 * SMOOTHING)) - math.log((counts[False][f] + SMOOTHING) / (totals[False] + 2 * SMOOTHING))
    ties = []
    for kind in range(3):
        own = []
        for parent in (False, True):
            both = pairs[kind, parent, False] + pairs[kind, parent, True] + 2 * SMOOTHING
            own += [(pairs[kind, parent, child] + SMOOTHING) / both for child in (False, True)]
        ties.append(tuple(own))
    return odds, tuple(ties)


def marginals(nodes: list[Node], model: tuple[dict[str, float], tuple[tuple[float, ...], ...]]) -> list[float]:
    """P(content) of each node by sum-product: messages from the leaves up, then from the root down."""
    odds, ties = model
    kinds = [ties[tie_class(x.tag)] for x in nodes]
    local = [math.exp(max(-30.0, min(30.0, sum(odds.get(f, 0.0) for f in features)))) for features in evidence(nodes)]
    local[0] = 1e6  # a page as a whole is content
    n = len(nodes)
    up = list(local)  # odds of content given what is at and below the node
    message = [1.0] * n  # odds that a node's subtree gives its parent
    for i in range(n - 1, 0, -1):
        o = up[i]
        p = nodes[i].parent
        nn, nc, cn, cc = kinds[p]
        message[i] = (cn + cc * o) / (nn + nc * o)
        up[p] = max(1e-200, min(1e200, up[p] * message[i]))
    belief = [0.0] * n
    belief[0] = up[0]
    for i in range(1, n):
        nn, nc, cn, cc = kinds[nodes[i].parent]
        rest = max(1e-200, min(1e200, belief[nodes[i].parent] / message[i]))  # the parent without this child
        down = (nc + cc * rest) / (nn + cn * rest)
        belief[i] = max(1e-200, min(1e200, up[i] * down))
    return [b / (1 + b) for b in belief]


def main_text(page: str | None, model) -> str:
    """Blocks of content nodes in page order, one a line."""
    if not page:
        return ""
    nodes = parse(page)
    chances = marginals(nodes, model)
    blocks = [b for x, p in zip(nodes, chances) if p > 0.5 for b in x.texts]
    if not blocks:
        blocks = best_container(nodes, chances)
    return "\n".join(t for _, t in sorted(blocks))


def best_container(nodes: list[Node], chances: list[float]) -> list[tuple[int, str]]:
    """Blocks of the element whose own and children's texts have the most expected content, those half as likely as its best."""
    scores: Counter = Counter()
    for i, (x, p) in enumerate(zip(nodes, chances)):
        if x.texts and p >= LEAST:
            for k in {i, x.parent} - {-1}:
                scores[k] += p * x.chars
    if not scores:
        return []
    best = min(scores, key=lambda k: (-scores[k], k))
    inside = [i for i, x in enumerate(nodes) if x.texts and (i == best or x.parent == best)]
    most = max(chances[i] for i in inside)
    return [b for i in inside if chances[i] >= most / 2 for b in nodes[i].texts]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every row."""
    model = fit()

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda h: main_text(h, model) if isinstance(h, str) else "")

    out = pages.select(pages[id_col].alias(id_col), pages[url_col].alias(url_col), text(pages[html_col]).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
