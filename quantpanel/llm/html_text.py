"""HTML extraction by two-pass block rules.

Pass 1 decides blocks by themselves: by link density, length and stop-word density, with where they stand as one more sign (menus,
headers, footers, sidebars, notices, adverts, forms, comments). Stop words are known for a few languages; on a page whose long blocks
have hardly any of them they are learned from the page (its words that most blocks share), and where that is not possible length and
links decide alone. A class or id that names something other than the article counts against a container, not for certain: a container
that holds nearly all prose of the page is the article whatever its name, and under a name that articles use too (`related-work`) a
block that reads as text stays. Pass 2 lets the short blocks that remain inherit the label of the nearest decided neighbours. Each page
is judged alone, in time linear in its length, so partitions need no exchange.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantpanel.llm.common import give_back
from quantpanel.session import ship_package

# Frequent words of the languages served.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by can for from had has have he her his i if in into is it its more not of on or our she so than
    that the their them then there these they this to was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im in
    ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wenn wie wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour que qui sa
    se ses son sont sur un une vous
    al como con de del el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se ser si sin
    sobre son su sus también un una y ya yo
    """.split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())  # their content is no markup
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
AWAY = frozenset("aside button canvas datalist dialog footer form head label map menu nav noscript object search select svg template audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words of class, id or role that name something other than the article; the second list, those that articles use too.
AWAY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner billboard breadcrumb breadcrumbs byline complementary consent contentinfo cookie "
    "cookies comment comments commentlist disclaimer disqus footer footnav gdpr hidden login masthead menu menubar modal nav navbar navigation "
    "newsletter notification notifications pager pagination paywall popup privacy promo promoted recommend recommendations recommended "
    "replies reply responses rss sharing shares sidebar sidenav signup skip sponsor sponsored subscribe subscription tagcloud "
    "taboola teaser toolbar topbar trending widget widgets outbrain".split()
)
UNSURE_WORDS = frozenset("alert announcement discussion legal notice overlay promotion related respond search share social warning".split())
KEPT_IN_ARTICLE = frozenset({"header", "label"})  # words and tags that are harmless inside an article

# an attribute's quotes may hold < and >; outside of them a < ends a broken tag, so that no text is looked through twice
TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"]*+"|'[^']*+'|[^<>"'])*+)>|(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>)""", re.S
)
HINT = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
UNSEEN = re.compile(r"""(?:\s|^)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
# a run of letters; letters of scripts without spaces stand alone
WORD = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]|[^\W\d_]+")
SPACE = re.compile(r"\s+")

LINKS_BAD, LINKS_BAD_HOME, STOP_LOW, STOP_HIGH, SHORT, LONG = 0.35, 0.66, 0.12, 0.25, 70, 140
KNOWN_LANGUAGE = 0.05  # share of known stop words in the long blocks of a page, below which they are learned
LEARNED = 40  # stop words learned, from LEARN_FROM blocks or more
LEARN_FROM = 4
ALL_PROSE = 0.9  # a container with this share of a page's prose is no menu, whatever its name
RULES = frozenset({"stop words", "links", "length", "neighbours"})


@dataclass
class Block:
    tag: str
    away: bool  # by its tags
    named: int  # innermost container whose name speaks against it, -1 if none
    home: bool  # inside an article or main element
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    text: str = ""
    links: int = 0
    words: list[str] = field(default_factory=list)


def _away(tag: str, attributes: str, in_home: bool) -> tuple[bool, str]:
    """Whether the tag or a hiding attribute excludes, and what the names say: "", "unsure" or "away"."""
    if tag in AWAY and not (in_home and tag in KEPT_IN_ARTICLE):
        return True, ""
    if tag == "header" and not in_home:
        return True, ""
    if not attributes or tag in ("html", "body", "main"):
        return False, ""
    if UNSEEN.search(attributes):
        return True, ""
    says = ""
    for value in HINT.findall(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value)
        words = set(re.split(r"[^a-z0-9]+", value.lower()))
        if tag == "article":
            words &= {"comment", "comments", "reply", "ad", "ads", "sponsored", "promoted", "related", "teaser"}
        if words & AWAY_WORDS or (not in_home and "header" in words):
            return False, "away"
        if words & UNSURE_WORDS:
            says = "unsure"
    return False, says


def blocks_of(page: str) -> tuple[list[Block], list[tuple[int, bool]]]:
    """The page's text blocks in order, with where they stand, and the named containers (the one around it, whether its name is sure).
    Unclosed and stray tags are tolerated."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, away, named container and home from here on
    opened: Counter[str] = Counter()
    containers: list[tuple[int, bool]] = []
    links = 0
    block = Block("body", False, -1, False)

    def leave(to: int) -> None:
        for tag, *_ in stack[to:]:
            opened[tag] -= 1
        del stack[to:]

    def fresh(tag: str) -> None:
        nonlocal block
        if block.parts:
            out.append(block)
        block = Block(tag, *(stack[-1][1:] if stack else (False, -1, False)))

    def add(text: str) -> None:
        if text:
            block.parts.append(text)
            if links:
                block.linked.append(text)

    at, end = 0, len(page)
    while True:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^<>]*+>?", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            add(" ")
            continue
        structural = tag in BLOCK or tag in AWAY
        if not structural:
            if tag in ("span", "b", "i", "em", "strong", "font", "u", "small", "big", "sub", "sup", "code", "abbr", "mark") and not attributes:
                continue
            if tag in VOID or not (attributes or closing):
                continue
        if closing:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                leave(i)
            elif not structural:
                continue
            fresh(tag if structural else block.tag)
            links = 0 if structural else links
            continue
        if tag in VOID:
            fresh(tag)
            continue
        if tag in BLOCK and stack and stack[-1][0] == "p":
            leave(-1)  # a paragraph ends where a block begins
        if tag in CLOSES and stack and stack[-1][0] in CLOSES[tag]:
            leave(-1)
        if tag == "body":
            while stack and stack[-1][0] == "head":
                leave(-1)
        away, named, home = stack[-1][1:] if stack else (False, -1, False)
        own, says = _away(tag, attributes, home)
        if not structural and not own and not says:
            continue
        if says:
            containers.append((named, says == "away"))
            named = len(containers) - 1
        stack.append((tag, away or own, named, home or tag in ("article", "main") or "articlebody" in attributes.lower()))
        opened[tag] += 1
        fresh(tag)
        if structural:
            links = 0
    if block.parts:
        out.append(block)
    kept = []
    for b in out:
        b.text = SPACE.sub(" ", entities.unescape("".join(b.parts))).strip()
        if b.text:
            b.links = sum(map(len, b.linked))
            b.words = WORD.findall(b.text.lower())
            kept.append(b)
    return kept, containers


def stop_words_of(blocks: list[Block]) -> frozenset[str] | None:
    """The known stop words; those learned from the page where its long blocks hardly hold any; None if there are too few of them."""
    long = [b.words for b in blocks if not b.away and len(b.text) >= LONG and b.links <= LINKS_BAD * len(b.text)]
    total = sum(map(len, long))
    if sum(w in STOP_WORDS for words in long for w in words) >= KNOWN_LANGUAGE * total and total:
        return STOP_WORDS
    if len(long) < LEARN_FROM:
        return None
    often = Counter(w for words in long for w in set(words))
    return frozenset(w for w, n in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:LEARNED] if 2 * n >= len(long))


def _reads_as_text(block: Block, stops: frozenset[str] | None, rules: frozenset[str]) -> str:
    """good, bad, or short where length leaves it open."""
    n = len(block.text)
    if "links" in rules and block.links > (LINKS_BAD_HOME if block.home else LINKS_BAD) * n:
        return "bad"
    short = n < SHORT if "length" in rules else False
    if short:
        return "short"
    if block.home:
        return "good"  # an article's tables, lists and figures are its own
    if not block.words:
        return "bad"
    if stops is None or "stop words" not in rules:
        return "good" if n >= LONG else "short"
    density = sum(w in stops for w in block.words) / len(block.words)
    if density >= STOP_HIGH or (density >= STOP_LOW and n >= LONG):
        return "good"
    return "short" if n < LONG and density >= STOP_LOW / 4 else "bad" if density < STOP_LOW / 4 and n < 4 * LONG else "good"


def _stays_away(blocks: list[Block], labels: list[str], containers: list[tuple[int, bool]]) -> list[bool]:
    """Of each named container, whether it or one around it excludes what it holds; an unsure name alone does not."""
    prose, total = [0] * len(containers), 0
    for b, label in zip(blocks, labels, strict=True):
        if label == "good" and not b.away:
            total += len(b.text)
            if b.named >= 0:
                prose[b.named] += len(b.text)
    for i in range(len(containers) - 1, -1, -1):
        if containers[i][0] >= 0:
            prose[containers[i][0]] += prose[i]
    out: list[bool] = []
    for i, (around, sure) in enumerate(containers):
        out.append((around >= 0 and out[around]) or (sure and prose[i] < ALL_PROSE * max(total, 1)))
    return out


def _nearest(labels: list[str], blocks: list[Block]) -> list[tuple[str, int]]:
    """Of each block, the label of the nearest decided one before it on its side of the article's border, and the text between them. Inside
    an article a bad block decides nothing: it is a box in the text."""
    out, label, far = [], "", 0
    for i, b in enumerate(blocks):
        if i and b.home != blocks[i - 1].home:
            label, far = "", 0
        out.append((label, far))
        if labels[i] != "short" and not (b.home and labels[i] == "bad"):
            label, far = labels[i], 0
        else:
            far += len(b.text)
    return out


def main_text(page: str | None, rules: frozenset[str] = RULES) -> str:
    """The article's blocks, joined by two line feeds. Null or empty: empty. rules: those that are in force (all but in tests)."""
    if not page:
        return ""
    blocks, containers = blocks_of(page)
    stops = stop_words_of(blocks)
    reads = [_reads_as_text(b, stops, rules) for b in blocks]
    away = _stays_away(blocks, reads, containers)
    outside = [b.away or (b.named >= 0 and (away[b.named] or (not containers[b.named][1] and label != "good"))) for b, label in zip(blocks, reads, strict=True)]
    only_home = any(b.home and not out for b, out in zip(blocks, outside, strict=True))
    outside = [out or (only_home and not b.home) for b, out in zip(blocks, outside, strict=True)]
    labels = ["bad" if out else label for label, out in zip(reads, outside, strict=True)]
    if "neighbours" in rules:
        before, after = _nearest(labels, blocks), _nearest(labels[::-1], blocks[::-1])[::-1]
    else:
        before = after = [("", 0)] * len(blocks)
    final = []
    for i, b in enumerate(blocks):
        (left, near_left), (right, near_right) = before[i], after[i]
        if labels[i] != "short":
            final.append(labels[i])
        elif not left and not right:
            final.append("good" if b.home else "bad")
        elif b.tag in HEADINGS and right:
            final.append(right)
        elif left == right or not right:
            final.append(left)
        elif not left:
            final.append(right)
        else:
            final.append("good" if near_left == near_right else left if near_left < near_right else right)
    if "good" not in final and "neighbours" in rules:  # a page of short blocks alone: there is no text that they could stand beside
        final = ["good" if label == "short" and b.words else "bad" for label, b in zip(labels, blocks, strict=True)]
    return "\n\n".join(b.text for b, label in zip(blocks, final, strict=True) if label == "good")


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars (code points); columns of these names are replaced.

    Null or empty html, and pages without an article, give an empty text and 0. Broken markup is read as far as it goes; repeated
    rows get the same answer; very long pages are read whole.
    """
    ship_package(pages.sparkSession)

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = pd.Series([main_text(p) for p in batch], dtype=object)
            del batch
            give_back()
            yield out

    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    out = pages.select(*rest, read(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
