"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags.  A block
is described by the tags of its ancestors, by what their class, id and role say,
by its own tag and by its text (length, links, punctuation), and by the blocks
before and after it.  The chain labels each block main text or not; Viterbi
decoding picks the best labelling of the whole page.

The model is trained on labelled pages: HTML whose main blocks carry the
attribute ``data-main``.  ``labelled_pages`` makes such pages in many layouts
from a seed; ``train`` takes any others as well.

Text that browsers don't show (script, style, head, templates, comments of the
markup, form controls) never becomes a block.  Character references are decoded;
``br`` is white space inside its block.

Defined cases: null or empty pages and pages without main blocks give an empty
text; unclosed tags end with their parents; repeated rows are extracted alike;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.quality import fit_chain

#: Elements whose content is raw text, up to their own end tag.
RAW = "script|style|textarea|title|noscript|template|iframe|svg|select|object|noembed|xmp"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S | re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of the value, if it is nearer than a container.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ATTRS = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

TAGS = "nav header footer aside form article main section ul ol li table td th dl p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption button div body address details fieldset hidden".split()
#: What names of classes, ids and roles say.
SAYS = {
    "ad": r"\b(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner[-_]?ad|doubleclick)\b", "comment": r"comment|disqus|repl(?:y|ies)|respond|discussion|feedback",
    "nav": r"nav|menu|breadcrumb|pagination|pager|toc\b|skip", "notice": r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri|signup|paywall|banner",
    "side": r"side|widget|related|recommend|popular|trending|more[-_]|complementary", "foot": r"foot|copyright|legal|contentinfo", "head": r"header|masthead|topbar|logo|site[-_]?title",
    "content": r"content|article|post\b|post[-_]|entry|story|body|main|text|prose", "share": r"share|social|follow|like", "meta": r"byline|author|date|meta|tag|categor", "search": r"search|login|form",
}
NAMES = [*TAGS, *SAYS]
BIT = {name: 1 << i for i, name in enumerate(NAMES)}
SAID = [(BIT[k], re.compile(v)) for k, v in SAYS.items()]
N_TEXT = 12
N_OWN = 2 * len(NAMES) + N_TEXT
_said: dict[str, int] = {}


def _mask(attrs: str) -> int:
    names = " ".join(next(filter(None, m), "") for m in ATTRS.findall(attrs)).lower()
    if not names:
        return 0
    if (found := _said.get(names)) is None:
        words = names.replace("_", "-")
        found = sum(bit for bit, pattern in SAID if pattern.search(words) or pattern.search(words.replace("-", " ")))
        if len(_said) < 10_000:
            _said[names] = found
    return found


def blocks(page: str) -> list[tuple[str, int, int, float, bool]]:
    """(text, ancestors' mask, own mask, share of text in links, labelled as main) of each leaf block, in page order."""
    out, buf = [], []
    links = total = 0
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
    in_link = 0  # the depth of the element that a link has begun in, which ends it when it is left

    def flush() -> None:
        nonlocal links, total
        if buf:
            text = "".join(buf)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                _, mask, own, main = stack[-1]
                out.append((text, mask, own, links / max(total, 1), main))
            buf.clear()
            links = total = 0

    def pop(to: int) -> None:
        nonlocal in_link
        del stack[to:]
        in_link = in_link if in_link <= len(stack) else 0

    at = 0
    in_head = False
    for m in TOKEN.finditer(page):
        if m.start() > at and not in_head:
            piece = page[at : m.start()]
            buf.append(piece)
            size = len(piece.strip())
            total += size
            links += size if in_link else 0
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and in_head is False and m["raw"].lower() == "title":
                continue
            continue
        tag = tag.lower()
        end = m["end"]
        if tag == "head":
            in_head = not end
            continue
        if tag == "body":
            in_head = False
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if end else len(stack)
            elif tag in ("br", "img", "wbr") and tag == "br":
                buf.append(" ")
            continue
        in_head = in_head and tag not in ("p", "div", "article", "nav", "main", "header", "section", "h1")
        flush()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        closing = IMPLIED.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else frozenset())
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closing:
                    pop(i)
                    break
                if stack[i][0] in ("div", "article", "section", "ul", "ol", "table", "body", "main", "aside", "nav", "td", "blockquote", "form"):
                    break
        if tag in VOID:
            continue
        attrs = m["attrs"]
        own = BIT.get(tag, 0) | (_mask(attrs) if "=" in attrs else 0)
        if attrs and re.search(r"\bhidden\b|display\s*:\s*none", attrs):
            own |= BIT["hidden"]
        if not attrs.endswith("/") or tag not in ("div", "p"):
            stack.append((tag, stack[-1][1] | own, own, stack[-1][3] or "data-main" in attrs))
    if at < len(page) and not in_head:
        buf.append(page[at:])
        total += len(page) - at
    flush()
    return out


def text_features(text: str, link: float) -> list[float]:
    n = len(text)
    spaces = text.count(" ")
    return [
        1.0, min(n, 400) / 200, float(n < 25), float(25 <= n < 80), float(n >= 80), link, float(link > 0.5), float(text[-1] in ".!?…:;”\"")
        , min(text.count(".") + text.count(","), 6) / 3, float("©" in text or "·" in text), min(sum(map(text.count, "0123456789")) / n, 1.0), min(n / (spaces + 1), 20) / 10,
    ]


def features(found: list[tuple[str, int, int, float, bool]]) -> np.ndarray:
    """Own features of blocks: bits of ancestors and of the block's own element, and of the text."""
    masks = np.array([(b[1], b[2]) for b in found], np.int64).reshape(-1, 2)
    bits = (masks[:, :, None] >> np.arange(len(NAMES))) & 1
    texts = np.array([text_features(b[0], b[3]) for b in found], np.float32).reshape(-1, N_TEXT)
    return np.hstack([bits.reshape(len(found), -1).astype(np.float32), texts])


def unary_input(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, and the neighbours' text features and ancestors (zeros at the ends)."""
    near = own[:, list(range(len(NAMES))) + list(range(2 * len(NAMES), N_OWN))]
    prev, after = np.zeros_like(near), np.zeros_like(near)
    prev[1:], after[:-1] = near[:-1], near[1:]
    some = first[:-1][np.diff(first) > 0]
    prev[some] = 0
    after[first[1:][np.diff(first) > 0] - 1] = 0
    return np.hstack([own, prev, after])


def viterbi(unary: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labelling of each page, all pages at once, block by block."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    starts, sizes = first[:-1][order], counts[order]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
    e = np.stack([-unary / 2, unary / 2], 1)
    best, back = e.copy(), np.zeros((len(unary), 2), np.int8)
    for t in range(1, longest):
        i = starts[: live[t]] + t
        step = best[i - 1][:, :, None] + trans[None]
        back[i] = step.argmax(1)
        best[i] = e[i] + step.max(1)
    label = np.zeros(len(unary), np.int8)
    for t in range(longest - 1, -1, -1):
        i = starts[: live[t]] + t
        last = sizes[: live[t]] == t + 1
        label[i[last]] = best[i[last]].argmax(1)
        more = i[~last]
        label[more] = back[more + 1, label[more + 1]]
    return label


def labelled_pages(n: int = 600, seed: int = 8) -> Iterator[str]:
    """Pages in many layouts, with ``data-main`` on the blocks of the article."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)]

    def words(a: int, z: int) -> str:
        return " ".join(r.choice(vocabulary) for _ in range(r.randint(a, z)))

    def sentence(a: int = 4, z: int = 18) -> str:
        return words(a, z).capitalize() + r.choice(".....!?")

    def prose() -> str:
        text = " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 6])))
        kind = r.random()
        if kind < 0.12:
            return sentence(1, 2)
        if kind < 0.2:
            return text.upper()
        if kind < 0.27:
            return " | ".join(text.split())
        if kind < 0.34:
            return " ".join(w + r.choice(["***", "$$$", "&amp;&amp;&amp;", "###"]) for w in text.split())
        if kind < 0.42:
            return text.replace(" ", f' <a href="/x">{words(1, 2)}</a> ', 1)
        if kind < 0.5:
            return text.replace(" ", f" <em>{words(1, 2)}</em> ", 1)
        return text

    def menu(tag: str, cls: str) -> str:
        links = "".join(f'<li><a href="/{w}">{words(1, 2)}</a></li>' for w in range(r.randint(2, 8)))
        return f"<{tag}{cls}><ul>{links}</ul></{tag}>"

    def named(*names: str) -> str:
        kind = r.random()
        return "" if kind < 0.15 else f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'

    def clutter(*kinds: str) -> str:
        kind = r.choice(kinds)
        body = r.choice([sentence(), f"<p>{sentence()}</p>", f"<p>{sentence()}</p><p>{sentence()}</p>", f"<a href='/a'>{words(2, 5)}</a>", f"<ul><li>{words(1, 4)}</li><li>{words(1, 4)}</li></ul>", f"<h3>{words(1, 3)}</h3><p>{sentence()}</p>"])
        name = {
            "ad": ("ad", "ads", "advert", "ad-slot", "advertisement", "sponsored", "promo"), "comments": ("comments", "comment-list", "reader-comments", "disqus", "replies"), "notice": ("cookie-notice", "notice", "alert", "cookie-banner", "newsletter", "consent", "subscribe-box"),
            "side": ("sidebar", "widget", "related", "recommended", "side"), "share": ("share", "social", "share-buttons"),
        }
        if kind == "form":
            return f"<form action='/s'><label>{words(1, 2)}</label><input name=q><p>{sentence(2, 6)}</p><button>{words(1, 1)}</button></form>"
        if kind == "aside":
            return f"<aside{named('sidebar', 'box', 'rail')}>{body}</aside>"
        cls = f' {r.choice(["class", "class", "id"])}="{r.choice(name[kind])}"'
        if kind == "comments":
            one = "".join(f"<{t}{c}><p>{sentence()}</p></{t}>" for t, c in [r.choice([("div", ' class="comment"'), ("li", ""), ("article", ' class="comment"'), ("div", "")])] * r.randint(1, 4))
            return f"<{(t := r.choice(['section', 'div', 'ol']))}{cls}><h3>{words(1, 2)}</h3>{one}</{t}>"
        return f"<{(t := r.choice(['div', 'div', 'section', 'p', 'aside']))}{cls}>{body if t != 'p' else sentence()}</{t}>"

    def block() -> str:
        m = " data-main"
        kind = r.random()
        if kind < 0.7:
            return r.choice([f"<p{m}>{prose()}</p>", f"<p{m}>{prose()}</p>", f"<p{m}>{prose()}", f"<p{m}><b>{prose()}<br>"])
        if kind < 0.76:
            return f"<h2{m}>{words(1, 6).capitalize()}</h2>"
        if kind < 0.82:
            return f"<ul{m}>" + "".join(f"<li>{r.choice([words(1, 5), sentence()])}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.86:
            return f"<blockquote{m}>{r.choice([prose(), f'<p>{prose()}</p>'])}</blockquote>"
        if kind < 0.9:
            return f"<table{m}><tr><th>{words(1, 2)}</th><td>{words(1, 4)}</td></tr></table>"
        if kind < 0.93:
            return f"<pre{m}>{words(2, 9)}</pre>"
        if kind < 0.96:
            return f"<figure{m}><img src='i.png'><figcaption>{words(3, 8)}</figcaption></figure>"
        return f"<div{m}>{prose()}</div>"

    for _ in range(n):
        head = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head><body>"
        top, side, low = [], [], []
        if r.random() < 0.5:
            top.append(f"<header{named('site-header', 'masthead', 'top')}>{r.choice([f'<h1>{words(1, 3)}</h1>', f'<a href=/>{words(1, 2)}</a>', f'<div class=logo>{words(1, 2)}</div><p>{sentence(2, 6)}</p>'])}{menu('nav', '') if r.random() < 0.5 else ''}</header>")
        if r.random() < 0.75:
            top.append(menu(r.choice(["nav", "nav", "div"]), r.choice([' class="nav"', ' class="menu"', ' id="navigation"', ' role="navigation"', ' class="breadcrumbs"'])) if r.random() < 0.5 else menu("nav", ""))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            top.append(clutter("ad", "notice", "form", "share"))
        for _ in range(r.choice([0, 0, 1, 2])):
            (side if r.random() < 0.5 else low).append(clutter("side", "aside", "ad", "form", "notice"))
        if r.random() < 0.35:
            low.append(clutter("comments"))
        if r.random() < 0.8:
            low.append(f"<{(t := r.choice(['footer', 'footer', 'footer', 'div']))}{named('footer', 'site-footer', 'colophon') if t == 'footer' else ' class=footer'}>{r.choice([f'&copy; {words(1, 3)}', f'&copy; {words(1, 2)}.example &middot; {sentence()}', f'<p>{sentence()}</p>', f'<p>&copy; 2024 {words(1, 2)}</p><p>{sentence()}</p>'])}</{t}>")
        parts = [f"<h1 data-main>{prose() if r.random() < 0.3 else words(2, 9).capitalize()}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            parts.append(block())
        if r.random() < 0.35:
            parts.insert(r.randint(0, len(parts)), clutter("ad", "ad", "aside", "share", "notice", "form", "side"))
        if r.random() < 0.2:
            parts.append(clutter("comments"))
        tag, cls = r.choice([("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="article-body"'), ("section", ' class="story"'), ("div", ' role="main"'), ("div", "")])
        core = f"<{tag}{cls}>" + "".join(parts) + f"</{tag}>"
        if tag == "article" and r.random() < 0.3:
            core = f"<main>{core}</main>"
        yield head + "".join(top) + "".join(side) + core + "".join(low) + ("</body></html>" if r.random() < 0.8 else "")


def train(pages: Iterator[str] | None = None, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from labelled pages (``labelled_pages`` by default)."""
    found = [b for b in map(blocks, pages if pages is not None else labelled_pages()) if b]
    first = np.concatenate([[0], np.cumsum([len(b) for b in found])])
    every = [x for b in found for x in b]
    x = unary_input(features(every), first)
    y = np.array([b[4] for b in every], float)
    return fit_chain(x, first, y, np.ones(len(y)), steps)


def main_text(pages: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page."""
    weights, trans = model
    found = [blocks(p) if p else [] for p in pages]
    first = np.concatenate([[0], np.cumsum([len(b) for b in found])]).astype(np.int64)
    every = [x for b in found for x in b]
    if not every:
        return [""] * len(pages)
    label = viterbi(unary_input(features(every), first) @ weights, first, trans)
    return ["\n".join(every[k][0] for k in range(first[i], first[i + 1]) if label[k]) for i in range(len(pages))]


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray], at_once: int = 64) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``; ``at_once`` pages are held as blocks at a time."""

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        out: list[str] = []
        for i in range(0, len(column), at_once):
            out += main_text(column.slice(i, at_once).to_pylist(), model)
        return pa.array(out, pa.string())

    return pages.select("page_id", "url", text_of(F.col("html")).alias("text")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
