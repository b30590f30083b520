"""Main text of web pages by tag-path ratios (operator 2).

A page is cut into blocks (runs of text between block-level tags), each with its root-to-leaf
path of tags and class words.  Subtrees whose tag or role says that they are something else
(navigation, page headers and footers, asides, forms, scripts) are left out first.

Per path the text length and the punctuation are aggregated over its blocks; both ratios are
smoothed over neighbouring paths in page order and fused to one score, together with what class and
id words and an article or main element say (factors ``WORDED`` and ``MARKED``).  Paths at or above a
threshold, a share of the scores' deviation, are content paths.  The text is the smallest element
around their blocks, or the article or main element around that, without

- blocks on paths below the threshold that a word of a class or id names (adverts, notices, comments),
- parts of it that are mostly links, and
- parts of it before the first and after the last content block that hold no content path,

so headings, short paragraphs, lists and tables of the article stay.

Defined results: a null or empty page, or one without text, gives an empty text; broken markup
(unclosed or cut-off tags) is read as far as it goes; repeated rows give equal texts; pages of
any length are read whole, in time linear in length and nesting; other columns pass through.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import table

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "button", "canvas", "audio", "video")
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
DROP_TAGS = frozenset("head nav footer aside form menu dialog fieldset".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
DROP_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adbox adslot sponsor sponsors sponsored sponsorship promo promos promotion promoted banner banners
    nav navi navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars sidenav aside rail footer foot masthead topbar toolbar
    notice notices notification notifications alert alerts cookie cookies consent gdpr privacy popup popups modal overlay disclaimer newsletter subscribe subscription signup login signin register paywall
    share sharing sharer social related recommended recommendations recommends widget widgets outbrain taboola
    comment comments commentlist commentary respond reply replies disqus discussion guestbook pagination pager skip search searchbox hidden""".split()
)
HEADER_WORDS = frozenset("header head masthead".split())
EXEMPT = frozenset(("html", "body", "main", "article"))
#: Parts of a text that are never taken for a container of something else.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header pre blockquote table figure dl".split())
#: What a path's score is multiplied by inside an element that a class or id names as something else, and inside article or main.
WORDED, MARKED = 1e-4, 4.0
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body article section div main aside nav header footer form table ul ol dl blockquote td th".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.IGNORECASE) for t in RAW}
_DIGITS = re.compile(r"[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


def _dropped(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether the element is left out, and whether only a word of its class or id says so."""
    if tag in DROP_TAGS or (tag == "header" and not in_article):
        return True, False
    if not attributes or tag in EXEMPT:
        return False, False
    worded = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            words = set(value.split())
            worded = worded or bool(words & DROP_WORDS or (not in_article and words & HEADER_WORDS))
        elif name == "role" and value in DROP_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
    return worded, worded


@dataclass
class Page:
    """Blocks in page order (text, element, characters of links) and elements, parents before children.

    An element's path is a number; equal numbers are equal paths of block tags and class words.
    """

    blocks: list[tuple[str, int, int]]
    tags: list[str]
    parents: list[int]
    paths: list[int]
    factors: list[float]


def blocks(page: str) -> Page:
    tags, parents, paths, factors = [], [], [], []
    known: dict[tuple, int] = {}
    stack: list[tuple[str, int, bool]] = []  # tag, element, dropped here or above
    open_at: dict[str, list[int]] = {}
    scopes: list[int] = []
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, stack[-1][1] if stack else -1, linked))
            parts.clear()
        linked = 0

    def pop_to(place: int):
        while len(stack) > place:
            tag = stack[-1][0]
            if tag in BLOCK:
                flush()
            stack.pop()
            open_at[tag].pop()
            if tag in SCOPE:
                scopes.pop()

    def nearest(tag: str) -> int:
        found = open_at.get(tag)
        return found[-1] if found else -1

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not (stack and stack[-1][2]):
            text = unescape(page[at:stop])
            parts.append(text)
            if open_at.get("a"):
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] if m[2] else m[6]
        if closing:
            place = nearest(tag)
            if place >= 0 and (tag in BLOCK or not scopes or scopes[-1] <= place):
                pop_to(place)
            continue
        if tag in _RAW_END:
            end = None if attributes.rstrip().endswith("/") and tag in ("svg", "math") else _RAW_END[tag].search(page, at)
            at = end.end() if end else n if tag in ("script", "style") else at
            continue
        if tag == "br" or tag in VOID:
            if tag in BLOCK:
                flush()
            elif not (stack and stack[-1][2]):
                parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
            paragraph = nearest("p")
            if paragraph > (scopes[-1] if scopes else -1):
                pop_to(paragraph)
            same = max((nearest(t) for t in CLOSES.get(tag, ())), default=-1)
            if same >= 0 and same >= (scopes[-1] if scopes else -1):
                pop_to(same)
        marked = bool(open_at.get("article") or open_at.get("main"))
        dropped, by_word = _dropped(tag, attributes, marked)
        by_word = by_word and tag in BLOCK  # others are parts of a block
        parent = stack[-1][1] if stack else -1
        factor, path = (factors[parent], paths[parent]) if parent >= 0 else (1.0, -1)
        if tag in BLOCK:
            factor = min(factor, WORDED) if by_word else factor * MARKED if tag in ("article", "main") and not marked else factor
            path = known.setdefault((path, tag, _class_words(attributes), by_word), len(known))
        tags.append(tag)
        parents.append(parent)
        paths.append(path)
        factors.append(factor)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append((tag, len(tags) - 1, bool(stack and stack[-1][2]) or dropped and not by_word))
    pop_to(0)
    flush()
    return Page(out, tags, parents, paths, factors)


def path_scores(lengths: list[int], marks: list[int], paths: list, factors: list[float] | None = None, radius: int = 1, width: float = 0.5) -> dict:
    """Fused score of each path: smoothed text ratio times smoothed punctuation ratio times its factor."""
    order = list(dict.fromkeys(paths))
    total = {p: [0, 0, 0] for p in order}
    for p, n, k in zip(paths, lengths, marks, strict=True):
        total[p][0] += n
        total[p][1] += k
        total[p][2] += 1
    ratios = [[total[p][j] / total[p][2] for p in order] for j in (0, 1)]
    kernel = [math.exp(-((d / width) ** 2) / 2) for d in range(-radius, radius + 1)]

    def smooth(values):
        out = []
        for i in range(len(values)):
            near = [(kernel[d + radius], values[i + d]) for d in range(-radius, radius + 1) if 0 <= i + d < len(values)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    text, punctuation = (smooth(r) for r in ratios)
    factor = dict(zip(paths, factors, strict=True)) if factors else {}
    return {p: t * (1 + k) * factor.get(p, 1.0) for p, t, k in zip(order, text, punctuation, strict=True)}


def _inside(page: Page, blocks: list[int], weights: list[float]) -> list[float]:
    """Sum of the weights of blocks in each element; children add to their parents once."""
    held = [0.0] * len(page.tags)
    for i, w in zip(blocks, weights, strict=True):
        if page.blocks[i][1] >= 0:
            held[page.blocks[i][1]] += w
    for e in range(len(held) - 1, -1, -1):
        if page.parents[e] >= 0:
            held[page.parents[e]] += held[e]
    return held


def _root(page: Page, paths: list[int], scores: dict, chosen: list[int]) -> int:
    """The article or main element around the lowest element that holds all chosen blocks and more than
    one block of the page, or else that element.

    A path that a single block holds, with less than half the best score, has no say.
    """
    count: dict[int, int] = {}
    for i in chosen:
        count[paths[i]] = count.get(paths[i], 0) + 1
    best = max(scores[paths[i]] for i in chosen)
    said = [i for i in chosen if count[paths[i]] > 1 or 2 * scores[paths[i]] >= best]
    of_said = _inside(page, said, [1] * len(said))
    of_all = _inside(page, list(range(len(page.blocks))), [1] * len(page.blocks))
    enough = min(2, len(page.blocks))
    # elements are numbered in page order, so of those around all said blocks the last is the deepest
    root = max((e for e, k in enumerate(of_said) if k == len(said) and of_all[e] >= enough), default=-1)
    e, around = root, -1
    while e >= 0:
        if page.tags[e] == "article" or page.tags[e] == "main" and around < 0:
            around = e
        e = page.parents[e]
    return around if around >= 0 else root


def main_text(html: str | None, strictness: float = 0.5) -> str:
    page = blocks(html or "")
    found = page.blocks
    if not found:
        return ""
    paths = [page.paths[e] if e >= 0 else -1 for _, e, _ in found]
    factors = [page.factors[e] if e >= 0 else 1.0 for _, e, _ in found]
    scores = path_scores([len(t) for t, _, _ in found], [len(_PUNCTUATION.findall(t)) for t, _, _ in found], paths, factors)
    mean = sum(scores.values()) / len(scores)
    deviation = (sum((s - mean) ** 2 for s in scores.values()) / len(scores)) ** 0.5
    threshold = min(max(scores.values()), strictness * deviation)
    content = [scores[p] >= threshold for p in paths]
    root = _root(page, paths, scores, [i for i, c in enumerate(content) if c])

    # the part of the root (its child) that each element is in: parents come first
    part = [-1] * len(page.tags)
    for e, parent in enumerate(page.parents):
        part[e] = e if parent == root else part[parent] if parent >= 0 else -1
    inside = [i for i, (_, e, _) in enumerate(found) if root < 0 or e == root or e >= 0 and part[e] >= 0]
    # below: -1 for blocks that are no part's, which stay
    below = {i: part[found[i][1]] if found[i][1] >= 0 and found[i][1] != root else -1 for i in inside}
    letters: dict[int, list[float]] = {}
    for i in inside:
        held = letters.setdefault(below[i], [0, 0, 0])
        held[0] += len(found[i][0])
        held[1] += found[i][2]
        held[2] += content[i]
    main = [i for i in inside if content[i]]
    first, last = main[0], main[-1]
    named = 0.01 * max(factors[i] for i in main)

    def stays(i: int) -> bool:
        if not content[i] and factors[i] < named:
            return False
        p = below[i]
        if p < 0 or page.tags[p] in FLOW:
            return True
        text, links, own = letters[p]
        return bool(own) if not first < i < last else own > 0 or 2 * links < text

    return "\n".join(found[i][0] for i in inside if stays(i))


def _class_words(attributes: str) -> tuple[str, ...]:
    """The words of an element's class, without digits."""
    if "class" not in attributes.lower():
        return ()
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() == "class":
            return tuple(sorted({_DIGITS.sub("", w) for w in "".join(values).lower().split()}))
    return ()


def extract_main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with ``out``: the main text of the page in ``html``, blocks joined by newlines."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.StringType())])

    def extract(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(html).to_pylist()]
            keep = [i for i, name in enumerate(batch.schema.names) if name != out]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(texts, pa.string())], names=[batch.schema.names[i] for i in keep] + [out])

    return df.mapInArrow(extract, schema)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
