"""Operator 5: the main text of a web page, by two-pass block rules.

The page is cut into blocks at block-level tags; what navigation, headers, footers, sidebars, notices, adverts, forms and
comments hold is left out by its markup. The first pass classifies every other block by length, stop-word density and link
density alone, as good, bad, near good or short. Then the region is found: the article, if there is one (or what a class or
id calls so), unless the rules are certain of more text outside it than it holds; else the whole page. In the second pass
the ambiguous blocks take the label of their nearest decided neighbours in the region, and headings that of what follows.
The borders of an article count as good neighbours and its blocks that the first pass calls bad as ambiguous, since all of
an article is asked for: its short lines, link lists, tables and formulas stand between good blocks. The borders of a page
count as bad.

Defined results: null and empty pages, and pages without main text, give ''; white space within a block becomes one
space; unclosed tags end with what holds them; text after an unclosed comment, script or style is lost with it, as in
a browser; repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bounded_batches, fresh, per_slice, table

GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"
#: Says of a block that a class or id calls what holds it an article or its content.
NAMED = "named"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
    "template tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags whose content is not main text.
LEFT_OUT = frozenset("head nav footer aside form button select option datalist script style noscript iframe svg canvas object applet template dialog menu textarea audio video map search".split())
ARTICLE = frozenset("article main".split())
ROLES_LEFT_OUT = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Classes and ids that tell what is no main text: one of these names, whole, perhaps with a word of place before it and one of
#: form after it, as in site-nav, comment-list or cookie_notice_2.
NAMES_LEFT_OUT = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|post|article|entry|content|primary|secondary|mobile|reader|user|wp-block|js|gdpr|email)[-_]*)?"
    r"(?:ads?|advs?|adverts?|advertisements?|advertising|aside|skip|teasers?|pager|tools|signup|login|search|alerts?|repl(?:y|ies)|respond|banners?|breadcrumbs?|comments?|"
    r"consent|cookies?|disqus|footers?|gdpr|masthead|menus?|modal|nav|navbar|navigation|newsletters?|notices?|notifications?|outbrain|overlay|pagination|popups?|promos?|promotions?|"
    r"recommend(?:ed|ations)|related|shar(?:e|ing)|sidebars?|social|sponsor(?:ed|s)?|subscri(?:be|ption)|taboola|toolbar|widgets?)"
    r"(?:[-_]*(?:bar|box|list|links?|items?|wrapper|wrap|container|area|section|block|inner|outer|menu|buttons?|icons?|media|notices?|banner|popup|form|posts?|articles?|stories|content|text|"
    r"threads?|body|left|right|top|bottom|slot|unit|card|panel|message|overlay|modal|signup|alert|law|[0-9]+))*"
).fullmatch
NAMES_HEADER = re.compile(r"(?:(?:site|page|main|global|top)[-_]*)?(?:header|topbar)(?:[-_]*(?:bar|wrapper|container|inner|section))*").fullmatch
NAMES_ARTICLE = frozenset("article post entry story content main body text maincontent articlebody postcontent entrycontent".split())
#: Frequent words of four languages.
STOP_WORDS = frozenset(
    "the of and a to in is was for on that with by are this be at from it as an or not but his her they which have had were "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les de des un une et en est que qui dans pour sur pas au par avec ce il plus ne se du sont mais ou leur "
    "el los las del y una por con para como más pero sus este ha si sobre entre cuando muy sin ser también lo al".split()
)
SHORT_CHARS, LONG_CHARS = 70, 200
MAX_LINKS = 0.33
STOP_LOW, STOP_HIGH = 0.1, 0.2

TOKEN = re.compile(r"""<!--(?P<comment>.*?)(?:--!?>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_WORDS = re.compile(r"[a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    link_chars: int
    tag: str
    label: str  # what the markup says, or ''

    def links(self) -> float:
        return self.link_chars / len(self.text)

    def stop_density(self) -> float:
        words = WORDS.findall(self.text.lower())
        return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _says(name: str, rest: str, in_article: bool) -> str:
    """What a start tag says of what it holds: GOOD, NAMED, BAD or ''."""
    if name in LEFT_OUT:
        return BAD
    if name == "header" and not in_article:
        return BAD
    if not rest or "=" not in rest and "hidden" not in rest:
        return GOOD if name in ARTICLE else ""
    attributes = {}
    for key, value in ATTRIBUTE.findall(rest):
        attributes.setdefault(key.lower(), unescape(value.strip("\"'")).lower())
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN.search(attributes.get("style", "")):
        return BAD
    if name in ("html", "body"):
        return ""
    if name in ARTICLE or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articlebody":
        return BAD if any(map(NAMES_LEFT_OUT, _names(attributes))) else GOOD
    if attributes.get("role") in ROLES_LEFT_OUT:
        return BAD
    names = _names(attributes)
    if any(map(NAMES_LEFT_OUT, names)) or not in_article and any(map(NAMES_HEADER, names)):
        return BAD
    return NAMED if name in BLOCK and any(NAMES_ARTICLE & set(NAME_WORDS.findall(x)) for x in names) else ""


def _names(attributes: dict[str, str]) -> list[str]:
    return (attributes.get("class", "") + " " + attributes.get("id", "")).split()


def blocks(html: str) -> list[Block]:
    """The blocks of a page with text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # open tags, and what holds for their content
    parts: list[str] = []
    link_chars, links, breaks, says, tag = 0, 0, 0, "", ""

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(link_chars, len(text)), tag, says))
            parts, link_chars = [], 0

    def write(text: str) -> None:
        nonlocal link_chars, breaks
        if text and says != BAD:
            decoded = unescape(text) if "&" in text else text
            parts.append(decoded)
            if links:
                link_chars += len(" ".join(decoded.split()))
            if not decoded.isspace():
                breaks = 0

    def close(i: int) -> None:
        nonlocal says, tag, links
        links = max(0, links - sum(x == "a" for x, _ in stack[i:]))
        del stack[i:]
        says = stack[-1][1] if stack else ""
        tag = next((x for x, _ in reversed(stack) if x in BLOCK), "")

    at, size = 0, len(html)
    while at < size:
        found = TOKEN.search(html, at)
        if not found:
            write(html[at:])
            break
        write(html[at : found.start()])
        at = found.end()
        name = found["name"]
        if not name:
            continue
        name = name.lower()
        if found["end"]:
            if name in BLOCK:
                flush()
            if name == "br":
                parts.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name == "br":
            parts.append(" ")
            breaks += 1
            if breaks == 2:
                flush()
            continue
        if name in BLOCK:
            flush()
            breaks = 0
            ends = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}.get(name, ())
            holds = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(name, ("body",))
            first = -1
            for i in range(len(stack) - 1, -1, -1):
                x = stack[i][0]
                if x == "p" or x in ends:
                    first = i
                elif x in holds or x in BLOCK and not ends:
                    break
            if first >= 0:
                close(first)
            if stack and stack[-1][0] == "head" or name == "body" and any(x == "head" for x, _ in stack):
                if name not in ("head", "html"):
                    close(next(i for i, (x, _) in enumerate(stack) if x == "head"))
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            at = end.start() if end else size
            continue
        if found["rest"].endswith("/") and name in ("svg", "math", "path"):
            continue
        if name == "a":
            links += 1
        said = BAD if says == BAD else _says(name, found["rest"], says in (GOOD, NAMED)) or says
        if said == NAMED and says == GOOD:
            said = GOOD
        stack.append((name, said))
        says = said
        if name in BLOCK:
            tag = name
    flush()
    return out


def first_pass(block: Block) -> str:
    """What length, stop words and links tell of a block."""
    if block.links() > MAX_LINKS:
        return BAD
    if len(block.text) < SHORT_CHARS:
        return BAD if block.link_chars else SHORT
    density = block.stop_density()
    if density >= STOP_HIGH:
        return GOOD if len(block.text) > LONG_CHARS else NEAR
    if density >= STOP_LOW or len(block.text) > LONG_CHARS:
        return NEAR
    return BAD


def region_of(found: list[Block], labels: list[str]) -> str:
    """Where the text is: in what the markup calls so (GOOD or NAMED), or '' for the whole page, where the rules are
    certain of more text outside that than it holds: a teaser or one line of the page was marked."""
    said = next((x for x in (GOOD, NAMED) if any(b.label == x for b in found)), "")
    certain = sum(len(b.text) for b, x in zip(found, labels, strict=True) if b.label != said and x == GOOD)
    return said if certain <= sum(len(b.text) for b in found if b.label == said) else ""


def second_pass(found: list[Block], labels: list[str], border: str) -> list[str]:
    """Labels in which the ambiguous blocks have taken those of their neighbours, border being that of what is beyond."""
    n = len(labels)
    before, after = [border] * n, [border] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last, near = border, False
        for i in order:
            side[i] = NEAR if near and last == BAD else last
            if labels[i] in (GOOD, BAD):
                last, near = labels[i], False
            elif labels[i] == NEAR:
                near = True
    out = list(labels)
    for i, label in enumerate(labels):
        if label == SHORT:
            sides = (before[i], after[i])
            heading = found[i].tag in HEADINGS and after[i] in (GOOD, NEAR)
            out[i] = GOOD if sides == (GOOD, GOOD) or heading or GOOD in sides and NEAR in sides else BAD
        elif label == NEAR:
            out[i] = BAD if (before[i], after[i]) == (BAD, BAD) else GOOD
    return out


def classified(html: str | None) -> list[tuple[Block, str, str]]:
    """Each block with its label after the first pass (where a doubtful BAD is SHORT) and after the second; blocks beyond the
    region are BAD in both."""
    found = blocks(html or "")
    labels = [first_pass(b) for b in found]
    region = region_of(found, labels)
    if region:
        labels = [SHORT if x == BAD else x for x in labels]
    elif GOOD not in labels:  # nothing is certain: the long blocks are, or else those with enough stop words
        labels = [GOOD if x == NEAR and len(b.text) > LONG_CHARS else x for x, b in zip(labels, found, strict=True)]
        if GOOD not in labels:
            labels = [GOOD if x == NEAR else x for x in labels]
    inside = [i for i, b in enumerate(found) if not region or b.label == region]
    last = second_pass([found[i] for i in inside], [labels[i] for i in inside], GOOD if region else BAD)
    out = [(b, BAD, BAD) for b in found]
    for i, x in zip(inside, last, strict=True):
        out[i] = (found[i], labels[i], x)
    return out


def main_text(html: str | None) -> str:
    return "\n\n".join(b.text for b, _, x in classified(html) if x == GOOD)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """The columns of pages but html, and the main text, which replaces a column of its name."""
    bounded_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html, text)]
    (source,) = fresh(pages, "html")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([main_text(x) for x in batch.column(source).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], texts], [*kept, text])

    schema = pages.select(*kept, F.lit("").alias(text)).schema
    return pages.select(*kept, F.col(html).cast("string").alias(source)).mapInArrow(per_slice(run, source), schema)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
