"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text nodes, each with the path of block tags (and first classes) from
the root to it.  For every path the characters and the punctuation of all its nodes are summed and
divided by the number of its nodes.  Both ratios are smoothed along the order in which paths first
appear, with weights that fall with the distance and grow with the share of the path two of them have
in common; own and smoothed ratios are fused by a weighted product with the share of text outside links
and a prior.  The prior lowers paths below elements that markup names as menu, header, footer, sidebar,
notice, advert, form or comment, and, where articles and mains hold most of the text, paths outside them; it raises headings.
Paths whose fused ratio reaches the threshold are content: a part of the standard deviation below the
mean, of logarithms, or ``SPREAD`` times less than the best path's, whichever is lower.  The nodes of the
chosen paths, in page order, are the text.

Null or empty html, and pages without text, give an empty string; an empty table gives no rows.  Broken
markup (unclosed or stray tags, cut pages, tags inside scripts) never fails.  Very long pages are read
whole.  Rows are independent: repeated rows need no rule; a path exactly at the threshold is content;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Tags by their role in HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"b", "i", "em", "strong", "span", "u", "s", "small", "big", "sub", "sup", "mark", "code", "kbd", "samp", "var", "cite", "q", "abbr", "time", "font", "tt", "del", "ins", "dfn", "label", "bdi", "bdo", "data", "ruby", "rt", "rp", "strike", "center"}
UNREAD = {"svg", "math", "object", "canvas", "audio", "video", "head", *RAW}
OUT = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CELLS = {"td", "th", "br", "hr", "img", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar", "note"}
# Words in a class or id that name what is not the article, unless a word of layout stands beside them; the second set yields to words that name the article.
HARD = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "sidebar", "sidenav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond", "related", "recommended", "recommendations", "trending", "popular", "share", "sharing", "social", "login", "menu", "masthead", "topbar", "toolbar", "widget", "copyright", "skip", "hidden"}
SOFT = {"nav", "header", "footer", "foot", "side", "aside", "rail", "notice", "notices", "notification", "alert", "banner", "search", "legal", "disclaimer", "warning", "tags", "follow", "links"}
LAYOUT = {"has", "with", "no", "without", "layout", "wrapper", "container", "page", "site", "grid", "columns"}
MAIN = {"article", "content", "entry", "story", "main", "text", "post", "body"}

#: Width of the smoothing and its reach in paths, weights of the fusion, and least punctuation.
SIGMA, REACH, TEXT_WEIGHT, PUNCT_WEIGHT, LEAST_PUNCT = 2.0, 4, 1.0, 1.0, 0.2
#: How far below the mean the threshold lies, and the part of the best path's ratio that is always content, on pages without and with articles and mains that hold most of the text.
LAMBDA, SPREAD = 0.05, (12.0, 1000.0)
#: Priors of paths below an element that its markup names as no part of the article, of paths outside those articles and mains, and of headings; share of linked text that counts against a path inside them.
NAMED, OUTSIDE, HEADING, LINKED = 1e-5, 1e-4, 8.0, 0.9999
RAW_END = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
PUNCT = re.compile(r"[.,;:!?…。、，؛؟।]")


def _named(tag: str, attrs: str, inside: bool) -> tuple[str, str]:
    """``hidden``, ``tag``, ``name`` or nothing: whether the element is not shown, or its tag or names speak against it; and its class for the path."""
    if tag in UNREAD:
        return "hidden", ""
    by_tag = "tag" if tag in OUT or (tag == "header" and not inside) else ""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return by_tag, ""
    words, cls = set(), ""
    for name, *value in ATTR.findall(attrs):
        name, v = name.lower(), "".join(value)
        if name in ("class", "id"):
            words |= {w.lower() for w in WORD.findall(v)}
            cls = cls or v.split(" ")[0]
        elif name == "hidden" or name == "aria-hidden" and v.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
            return "hidden", ""
        elif name == "role" and v.lower() in ROLES:
            by_tag = "tag"
    if by_tag or tag in ("body", "html", "article", "main") or words & LAYOUT and tag not in ("section", "p", "ul", "ol"):
        return by_tag, cls
    return "name" if words & HARD or words & SOFT and not words & MAIN else "", cls


class Node:
    """A block of text: its path, its text, how much of it is in links, whether it is in an article or main, and whether tags or names speak against it."""

    __slots__ = ("against", "inside", "linked", "path", "text")

    def __init__(self, path: tuple, text: str, linked: int, inside: bool, against: str):
        self.path, self.text, self.linked, self.inside, self.against = path, text, linked, inside, against


def nodes(page: str) -> list[Node]:
    """The text blocks of a page that a reader sees, in page order."""
    out: list[Node] = []
    stack: list[tuple[str, str, str]] = []  # tag, name in the path, what speaks against it or an element around it
    parts: list[str] = []
    state = {"linked": 0, "link": 0, "main": 0}
    dropped = 0  # depth of the stack at which an element is left out, 0 for none

    def end_block() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(Node(tuple(s[1] for s in stack), text, state["linked"], state["main"] > 0, stack[-1][2] if stack else ""))
        parts.clear()
        state["linked"] = 0

    def pop_to(k: int) -> None:
        nonlocal dropped
        for tag, _, _ in stack[k:]:
            state["main"] -= tag in ("article", "main")
        del stack[k:]
        if dropped > k:
            dropped = 0

    def add(raw: str) -> None:
        if not dropped and raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if state["link"]:
                state["linked"] += len(text.strip())

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        if tag == "a":
            state["link"] = 0 if closing else 1
            continue
        if tag in INLINE:
            continue
        if tag in CELLS:
            parts.append(" ")
            if tag == "hr":
                end_block()
            continue
        if closing:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if k >= 0:
                end_block()
                pop_to(k)
            continue
        if tag in VOID:
            continue
        if tag in RAW and not (m[3] or m[6] or "").endswith("/"):
            # lower-casing a page can change its length
            end = RAW_END[tag].search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = len(page) if close < 0 else close + 1
            continue
        end_block()
        if tag in CLOSES_P:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"), -1)
            if k >= 0 and not any(s[0] in ("td", "li", "article", "section", "div") for s in stack[k + 1 :]):
                pop_to(k)
        elif tag in SIBLINGS:
            same, stop = SIBLINGS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in same:
                    pop_to(k)
                    break
        if (m[3] or m[6] or "").endswith("/") and tag not in CLOSES_P:
            continue
        against, cls = ("", "") if dropped else _named(tag, m[3] or m[6] or "", state["main"] > 0)
        around = stack[-1][2] if stack else ""
        # a tag says more than a name
        stack.append((tag, f"{tag}.{cls}" if cls else tag, max(around, against)))
        state["main"] += tag in ("article", "main")
        if against == "hidden":
            dropped = len(stack)
    end_block()
    return out


def common(p: tuple, q: tuple) -> float:
    """The share of the longer path that two paths have in common from the root."""
    n = next((k for k, (a, b) in enumerate(zip(p, q)) if a != b), min(len(p), len(q)))
    return (n + 1) / (max(len(p), len(q)) + 1)


def smooth(paths: list[tuple], x: np.ndarray) -> np.ndarray:
    """Each path's ratios (columns of ``x``) as the mean over the paths near it in order, weighted by a Gaussian and the square of what they have in common."""
    near = np.exp(-(np.arange(REACH + 1) ** 2) / (2 * SIGMA**2))
    total, weight = x.copy(), np.ones(len(x))
    for d in range(1, min(REACH, len(paths) - 1) + 1):
        w = near[d] * np.array([common(p, q) for p, q in zip(paths, paths[d:])]) ** 2
        total[:-d] += w[:, None] * x[d:]
        total[d:] += w[:, None] * x[:-d]
        weight[:-d] += w
        weight[d:] += w
    return total / weight[:, None]


def ratios(found: list[Node], named: bool = True) -> tuple[list[tuple], np.ndarray, float]:
    """The paths of the nodes in order of appearance, their fused ratios, and the threshold; a path is told apart by what speaks against it, names too if ``named``."""
    speaks = (lambda n: n.against) if named else (lambda n: n.against if n.against == "tag" else "")
    sums: dict[tuple, list[float]] = {}
    for n in found:
        p = sums.setdefault((n.path, n.inside, speaks(n)), [0.0, 0.0, 0.0, 0.0])
        p[0] += 1
        p[1] += len(n.text)
        p[2] += len(PUNCT.findall(n.text))
        p[3] += min(n.linked, len(n.text))
    keys, v = list(sums), np.array(list(sums.values()))
    own = v[:, 1:3] / v[:, :1]
    # a path's own ratio counts as much as its smoothed one, so that a long node beside short ones stands out
    text, punct = ((own + smooth([k[0] for k in keys], own)) / 2).T
    inside = np.array([k[1] for k in keys])
    prior = np.array([NAMED if k[2] else 1.0 for k in keys])
    articles = 2 * (v[:, 1] * prior)[inside].sum() >= (v[:, 1] * prior).sum()
    if articles:
        prior *= np.where(inside, 1.0, OUTSIDE)
    prior *= [HEADING if k[0] and k[0][-1][:2] in HEADINGS else 1.0 for k in keys]
    free = 1 - np.where(inside, LINKED, 1.0) * v[:, 3] / v[:, 1]
    fused = text**TEXT_WEIGHT * (LEAST_PUNCT + punct) ** PUNCT_WEIGHT * free * prior
    x = np.log1p(fused)
    return keys, fused, min(float(np.expm1(x.mean() - LAMBDA * x.std())), float(fused.max()) / SPREAD[int(articles)])


def select(found: list[Node], named: bool = True) -> list[Node]:
    """The nodes whose tag paths have a fused ratio at or above the threshold, in page order."""
    keys, fused, least = ratios(found, named)
    chosen = {k for k, f in zip(keys, fused, strict=True) if f >= least and f > 0}
    return [n for n in found if (n.path, n.inside, n.against if named or n.against == "tag" else "") in chosen]


def extract(page: str | None) -> str:
    """The main text of a page: its content blocks in page order, joined by a line break."""
    found = nodes(page) if page else []
    # a page whose names rule everything out is judged by its tags, one whose tags do has no article
    named = any(not n.against for n in found)
    if not named and not any(n.against != "tag" for n in found):
        return ""
    return "\n".join(n.text for n in select(found, named))


def main_text(pages: DataFrame) -> DataFrame:
    """Columns page_id, url, text, n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
