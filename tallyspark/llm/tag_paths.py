"""Operator 6, HTML extraction by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf path: the block
elements around it with their class and id (digits made alike, so that
numbered elements share a path).  Three ratios are taken of the blocks under a
path, headings left out: characters per block, punctuation marks per block,
and characters per holder (the element that holds the block; a comment list
has many holders of little text, an article few of much).  Their fused score
is the cube root of characters * (1 + marks) * characters per holder.

* The *content root* is the longest path prefix that holds ``ROOT_SHARE`` of
  the page's text, each path's text weighed by its score and prior.
* Under the root all blocks stay but those under a named container, or a
  distrusted element, whose score, smoothed with the ratios of the heaviest
  path, is below ``INSIDE`` of that path's.
* Elsewhere a path stays if its score, from where it leaves the root's own
  path, is at least ``OUTSIDE`` of the heaviest path's; a main heading beside
  the root stays too.
* Paths of mostly links are no content.

Priors only weigh the scores: an element that is named as no content (a whole
class or id: ``WHOLE``; a part of one: ``PART``; a role: ``WHOLE``) counts
less, ``main`` and ``article`` more.  Elements that HTML itself defines as no
running text of the page (scripts, forms, nav, aside, footer, the page's
header, hidden ones) are left out.  Single short blocks of a neutral name
inside the article stay.

Character references are decoded, white space within a block becomes one
blank, blocks are trimmed and joined by an empty line in page order.  Broken
markup is read as browsers do as far as it concerns blocks: a block start
ends an open paragraph, unknown end tags are ignored, open elements end with
the page.  A null or empty page has the empty text, and an empty table gives
an empty one.  Pages are read whole, one by one, so repeated rows give
repeated results; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROOT_SHARE = 0.6
INSIDE, OUTSIDE = 0.35, 0.4
SMOOTH = 0.2       # share of the heaviest path's ratios in those of a path under the root
LINK_SHARE = 0.6
HOLDERS = 3        # from so many holders on their number counts
WHOLE, PART, TRUSTED = 0.1, 0.6, 3.0

# Elements by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span
strike strong sub sup time tt u var""".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
NEVER = set("""aside button canvas datalist dialog footer form head iframe math menu nav noembed noframes noscript object
optgroup option script select style svg template textarea title video audio xmp""".split())
BREAKS_P = set("""address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul""".split())
NOT_CONTENT = set("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie
cookies consent disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination pager
popup promo promotion recommended register related respond share sharing sidebar signup skyscraper social sponsor sponsored
subscribe subscription toolbar widget widgets""".split())
ROLES = set("banner navigation complementary contentinfo search form dialog alert menu menubar".split())
SAME_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table article section div body main td th".split())

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = set("div section article main".split())
HOLDING = CONTAINERS | {"body", "li", "td", "dd", "blockquote"}

_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？]")


@dataclass(frozen=True)
class Step:
    """An element of a path: its tag, its names, and how far to trust it."""

    tag: str
    names: str
    prior: float


@dataclass
class Block:
    path: tuple[Step, ...]
    text: str
    links: int   # characters in links
    holder: int  # number of the element around the block's own


def _open(tag: str, attrs: str, inside: bool) -> tuple[Step, bool]:
    """(path step, whether the element and all in it is no content)."""
    names, out, prior = [], tag in NEVER or tag == "header" and not inside, 1.0
    trusted = tag in ("html", "body", "article", "main")
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "role":
            prior *= WHOLE if value in ROLES else 1
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            out = True
        elif name in ("class", "id"):
            names.append(re.sub("[0-9]+", "0", value))
            if not trusted:
                words = value.split()
                part = not NOT_CONTENT.isdisjoint(_SPLIT.split(value))
                prior *= WHOLE if not NOT_CONTENT.isdisjoint(words) else PART if part else 1
    return Step(tag, " ".join(names), TRUSTED if tag in ("article", "main") else prior), out


def blocks(page: str) -> list[Block]:
    """The blocks that may be content, in page order."""
    out, stack, parts, linked = [], [], [], 0  # stack: (tag, step, no content, number)
    in_link = opened = 0

    def flush():
        nonlocal linked
        if parts:
            if not (stack and stack[-1][2]):
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    holder = next((x[3] for x in reversed(stack) if x[0] in HOLDING), 0)
                    out.append(Block(tuple(x[1] for x in stack), text, min(linked, len(text)), holder))
            parts.clear()
        linked = 0

    def close(i):
        flush()
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        upto = m.start() if m else end
        if upto > at:
            parts.append(page[at:upto])
            linked += upto - at if in_link else 0
        if not m:
            break
        at = m.end()
        slash, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if slash else 1
            continue
        if tag in ("br", "wbr", "img"):
            parts.append(" " if tag != "wbr" else "")
            continue
        if slash:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                flush()
            in_link = 0
            continue
        flush()
        if tag in BREAKS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in SAME_END.get(tag, ()):
                close(i)
                break
            if stack[i][0] in SCOPE:
                break
        if tag in VOID:
            continue
        if tag == "body":  # whatever was open belongs to the head
            close(next((i for i, x in enumerate(stack) if x[0] == "head"), len(stack)))
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        inside = any(x[0] in ("article", "main") for x in stack)
        step, never = _open(tag, attrs, inside)
        opened += 1
        stack.append((tag, step, never or bool(stack and stack[-1][2]), opened))
    flush()
    return out


class _Sums:
    """Ratios of the blocks under a path."""

    def __init__(self) -> None:
        self.chars = self.marks = self.blocks = self.links = 0
        self.holders: set[int] = set()

    def add(self, block: Block, marks: int) -> None:
        self.chars += len(block.text)
        self.marks += marks
        self.blocks += 1
        self.links += block.links
        self.holders.add(block.holder)

    def score(self, root: _Sums | None = None, smooth: float = 0.0) -> float:
        """Fused ratios; beside a path few holders count as that path's."""
        chars, marks, held = self.chars / self.blocks, self.marks / self.blocks, self.chars / len(self.holders)
        if root is not None:
            chars = (1 - smooth) * chars + smooth * root.chars / root.blocks
            marks = (1 - smooth) * marks + smooth * root.marks / root.blocks
            held = held if len(self.holders) >= HOLDERS else root.chars / len(root.holders)
        return (chars * (1 + marks) * held) ** (1 / 3)


def _prior(steps: tuple[Step, ...]) -> float:
    out = 1.0
    for s in steps:
        out *= s.prior
    return out


def select(found: list[Block]) -> list[str]:
    """The texts of the blocks whose paths are content."""
    marks = [len(_PUNCT.findall(b.text)) for b in found]
    own = defaultdict(_Sums)
    for b, m in zip(found, marks):
        own[b.path].add(b, m)
    linked = {p for p, s in own.items() if s.links > LINK_SHARE * s.chars}
    live = [(b, m) for b, m in zip(found, marks) if b.path not in linked]
    if not live:
        return []
    under, weights, each = defaultdict(_Sums), defaultdict(float), {}
    plain = [(b, m) for b, m in live if not b.path or b.path[-1].tag not in HEADINGS]
    for b, m in plain or live:
        for d in range(len(b.path) + 1):
            under[b.path[:d]].add(b, m)
    for p, s in own.items():
        if p in linked or plain and p and p[-1].tag in HEADINGS:
            continue
        each[p] = s.chars * s.score() * _prior(p)
        for d in range(max(1, len(p))):  # proper prefixes: a root holds blocks or elements
            weights[p[:d]] += each[p]
    root = max((p for p, w in weights.items() if w >= ROOT_SHARE * weights[()]), key=len, default=())
    best, n = own[max((p for p in each if p[:len(root)] == root), key=each.get)], len(root)
    least = best.score(best)

    def stays(path: tuple[Step, ...]) -> bool:
        same = 0
        while same < min(n, len(path)) and path[same] == root[same]:
            same += 1
        if same < n:  # beside the root
            if same == len(path):
                return own[path].score() >= OUTSIDE * least
            prior = _prior(path[same:])
            if path[same].tag == "h1" and len(path) == same + 1:
                return prior >= 1
            return path[:same + 1] in under and under[path[:same + 1]].score() * prior >= OUTSIDE * least
        for d in range(n + 1, len(path) + 1):
            step, prior = path[d - 1], _prior(tuple(s for s in path[n:d] if s.tag not in ("article", "main")))
            if step.prior < 1 or step.tag in CONTAINERS and step.names:
                sums = under.get(path[:d])
                if (sums.score(best, SMOOTH) if sums else least) * prior < INSIDE * least:
                    return False
        return True

    kept = {p for p in own if p not in linked and stays(p)}
    return [b.text for b in found if b.path in kept]


def extract(page: str | None) -> str:
    """The main text of a page."""
    return "\n\n".join(select(blocks(page))) if page else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
