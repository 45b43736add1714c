"""Main text of HTML pages by two passes of block rules.

Pass one gives every block a label from its stop-word density, length and link density, from
the container it stands in (navigation, footers, forms, asides, or what a class, id or role
names) and from whether it is part of an article. A name counts if it is a whole class or id made
of such words alone (``comment-list``, not ``comments-open`` or ``has-sidebar``); it never condemns
``article`` or ``main``, nor, on a page without these, the container of the prose if nothing
else of the page would be kept. In an article neither densities nor a notice of rights condemn a
block: it may be a list, a licence or in a language without known stop words. Short and middling blocks stay undecided;
in pass two they inherit the label of the nearest decided neighbour, one of the same
container kind before others. Stop words are known for a few languages only: on a page without
an article and with too few of them, and for blocks in other scripts, length and links decide.

A page is worked on alone, so pages need no shuffle and a task holds one batch of them.

Cases: null or empty html gives an empty text; so does a page in which no block is kept. Text
without any markup is one block and is kept. Cut-off tags, comments, quotes and character
references end with the page. Without an article, the only block outside boilerplate is kept
unless it is mostly links. Null urls and ids are passed on, repeated rows are each
returned, extra columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tripletide.llm.tables import runs

SHORT = 70  # characters of a block below which only its neighbours decide
LONG = 200
LINKED = 0.5  # share of characters in links
STOP_HIGH, STOP_LOW = 0.30, 0.15
COVERED = 0.22  # share of stop words from which a page's language is one of theirs

STOP_WORDS = frozenset(
    """
    the of and to in is that for it as was with on be by from or an are this a at not have has had but they his her
    which you we he she will would there their been were if can all one
    de la le et les des en un du une que est pour qui dans par plus au avec sur pas ce elle il se ne sont aux mais ou
    der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    el y los del las por con no su para al lo como más pero sus le ya o este sí porque esta entre cuando muy sin
    """.split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg math".split())
BLOCKS = frozenset(
    """
    address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search
    section select summary table tbody td tfoot th thead tr ul button noscript
    """.split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head nav footer aside form button select menu noscript dialog fieldset search option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Names in class or id: those of the first list hold inside an article too, and hold what they enclose.
FIRM = frozenset(
    """
    comment comments reply replies respond discussion disqus nav navbar navigation menu breadcrumb breadcrumbs footer
    related recommended recommendations share sharing social newsletter subscribe login signup pagination pager
    advert adverts advertisement advertising ad ads adsense sponsor sponsored promo promotion cookie cookies consent gdpr
    popup modal copyright legal disclaimer
    """.split()
)
LOOSE = frozenset("sidebar banner header masthead notice notices alert widget widgets toolbar topbar skip hidden teaser".split())
# Words that may stand beside those in a name without changing what it means.
BESIDE = frozenset(
    """
    site page main global primary secondary top bottom left right upper lower inner outer post posts article articles entry list lists
    item items area areas section box boxes block blocks bar bars panel wrapper wrap container content body inside group row col column
    columns links link buttons button icons form forms thread section slot unit inline sticky fixed mobile desktop small large rail
    policy message text title heading overlay dialog us with and js the
    """.split()
)
RIGHTS = re.compile(r"©|\(c\) ?\d{4}|\bcopyright\b.{0,40}\d{4}|\ball rights reserved\b", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|[^<]++|<",
    re.S,
)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_EDGE = ".,;:!?()[]\"'«»„“”‘’…"

GOOD, BAD, OPEN = 1, -1, 0


@dataclass
class Block:
    text: str
    linked: int
    boiler: bool
    article: bool
    tag: str = ""
    label: int = OPEN
    named: int = 0  # the outermost container that only its name condemns, 0 if none


def _named(attrs: str) -> tuple[bool, bool]:
    """Whether class, id or role mark a container as boilerplate: firmly, loosely."""
    firm = loose = False
    for name, value in _NAMES.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            firm |= value.lower() in ROLES
        elif name == "hidden":
            firm |= value.lower() != "until-found"
        elif name == "aria-hidden":
            firm |= value.lower() == "true"
        elif name == "style":
            firm |= re.search(r"display\s*:\s*none", value, re.I) is not None
        else:
            for token in value.split():
                words = {w.lower() for w in _WORD.findall(token)}
                if words <= FIRM | LOOSE | BESIDE:
                    firm |= not words.isdisjoint(FIRM)
                    loose |= not words.isdisjoint(LOOSE)
    return firm, loose


def blocks_of(html: str) -> list[Block]:
    """The non-empty blocks of a page in order."""
    out: list[Block] = []
    # tag, boilerplate (0 no, 1 loosely, 2 firmly), in an article, number of the container whose name alone condemns
    stack: list[tuple[str, int, bool, int]] = []
    pieces: list[str] = []
    linked: list[str] = []
    links = 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tag, boiler, article, named = stack[-1] if stack else ("", 0, False, 0)
                out.append(Block(text, len(" ".join("".join(linked).split())), boiler > 0, article, tag, named=named))
            pieces.clear()
            linked.clear()

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                text = unescape(text) if "&" in text else text
                pieces.append(text)
                if links:
                    linked.append(text)
            continue
        tag, ended = tag.lower(), bool(m["end"] or m["end2"])
        if tag in RAW:
            if not ended:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
                at = close.end() if close else size
            pieces.append(" ")
            continue
        if tag == "a":
            links = max(0, links - 1) if ended else 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in BLOCKS:
            attrs = m["attrs"] or m["attrs2"] or ""
            if tag in VOID or not (ended or "class" in attrs or "id" in attrs or "role" in attrs or "hidden" in attrs):
                continue
        if tag in BLOCKS:
            flush()
            links = 0
        if ended:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCKS and stack[i][1] != (stack[i - 1][1] if i else 0):
                        flush()
                    del stack[i:]
                    break
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        if tag in BLOCKS and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in ("li", "option", "dt", "dd", "td", "th", "tr") and stack and stack[-1][0] == tag:
            stack.pop()
        _, boiler, article, named = stack[-1] if stack else ("", 0, False, 0)
        firm, loose = _named(attrs) if "=" in attrs or "hidden" in attrs else (False, False)
        if tag in ("html", "body"):
            firm = loose = False
        mine = 2 if tag in NEVER or firm else 1 if loose and not article or tag == "header" and not article else 0
        if tag in ("article", "main"):
            if boiler < 2:
                boiler, article, mine, named = 0, True, 0, 0
        level = max(boiler, mine)
        if level > 0:
            # a tag that condemns by itself is not excused with the name around it
            named = 0 if tag in NEVER or boiler and not named else named or at
        if tag not in BLOCKS:
            if level == boiler:
                continue
            flush()
        stack.append((tag, level, article, named))
    flush()
    return out


def _latin(text: str) -> bool:
    """Whether most letters of a text are Latin ones."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c < "\u0250" or "\u1e00" <= c < "\u1f00" for c in letters) >= len(letters)


def _excused(blocks: list[Block]) -> None:
    """Frees the named container with most prose if its page holds no article and no other plain block."""
    if any(b.article or not b.boiler and b.linked <= LINKED * len(b.text) for b in blocks):
        return
    prose: dict[int, int] = {}
    for b in blocks:
        if b.named and len(b.text) >= SHORT and b.linked <= LINKED * len(b.text):
            prose[b.named] = prose.get(b.named, 0) + len(b.text)
    best = max(prose, key=prose.__getitem__, default=0)
    for b in blocks:
        b.boiler &= not best or b.named != best


def label(blocks: list[Block]) -> list[Block]:
    """Both passes; afterwards every block is GOOD or BAD."""
    _excused(blocks)
    some_article = any(b.article and not b.boiler for b in blocks)
    counts = [(sum(w.strip(_EDGE) in STOP_WORDS for w in words), len(words)) for words in (b.text.lower().split() for b in blocks)]
    plain = [not b.boiler and b.linked <= LINKED * len(b.text) for b in blocks]
    stop_words, all_words = (sum(c[i] for c, p in zip(counts, plain) if p) for i in (0, 1))
    covered = some_article or stop_words >= COVERED * all_words
    only = not some_article and sum(not b.boiler for b in blocks) == 1
    for b, (n, of) in zip(blocks, counts):
        stops = n / of
        heading = b.article and len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit()
        if b.boiler or not b.article and len(b.text) <= LONG and b.tag != "pre" and RIGHTS.match(b.text):
            b.label = BAD
        elif heading and b.linked > LINKED * len(b.text):
            b.label = GOOD
        elif b.linked > LINKED * len(b.text) and not (b.article and len(b.text) >= LONG and stops >= STOP_HIGH):
            b.label = BAD
        elif only:
            b.label = GOOD
        elif len(b.text) < SHORT:
            b.label = OPEN
        elif b.article:
            b.label = GOOD
        elif stops >= STOP_HIGH:
            b.label = OPEN if some_article else GOOD
        elif not some_article and not (covered and _latin(b.text)):
            b.label = GOOD
        elif stops < STOP_LOW:
            b.label = OPEN if b.tag == "pre" and not some_article else BAD
    decided = [i for i, b in enumerate(blocks) if b.label]
    inherited = {}
    before, after = _nearest(blocks, decided), _nearest(blocks, decided, backwards=True)
    for i, b in enumerate(blocks):
        if b.label:
            continue
        near = [(j, abs(i - j)) for j in (before[i], after[i]) if j is not None]
        alike = [x for x in near if blocks[x[0]].article == b.article and not (b.article and blocks[x[0]].boiler)]
        if b.article and not alike:
            inherited[i] = GOOD
        elif not near:
            inherited[i] = BAD if some_article else GOOD
        else:
            best = min(d for _, d in alike or near)
            votes = [blocks[j].label for j, d in alike or near if d == best]
            inherited[i] = max(votes) if b.article else min(votes)
    for i, v in inherited.items():
        blocks[i].label = v
    return blocks


def _nearest(blocks: list[Block], decided: list[int], backwards: bool = False) -> list[int | None]:
    """The nearest decided block before each (or after it), of its own kind where there is one."""
    out: list[int | None] = [None] * len(blocks)
    last: dict[bool, int] = {}
    order = range(len(blocks) - 1, -1, -1) if backwards else range(len(blocks))
    known = set(decided)
    for i in order:
        own = last.get(blocks[i].article)
        out[i] = own if own is not None else last.get(not blocks[i].article)
        if i in known:
            last[blocks[i].article and not blocks[i].boiler] = i
    return out


def main_text(html: str | None) -> str:
    return "\n".join(b.text for b in label(blocks_of(html or "")) if b.label == GOOD)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch, "html"):
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
