"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks of text at block-level tags; unclosed and misnested tags are put right as browsers roughly do.
Blocks inside navigation, forms, adverts, notices, comments and the like never count; no container makes a block count. Of the
other blocks the first pass decides: those of links don't count; long and middling ones with many stop words do; lists with
hardly any don't, nor does what stands in a container that often holds no text (related links, widgets) unless it is long and
dense. The second pass gives each ambiguous block, short or with an unclear share of stop words, the label of its nearest decided
neighbour: distance is the text between, and more if they aren't siblings, or parent and child; a heading looks ahead only. If
no block of the page is decided to count, all ambiguous ones do.

Defined results: a null or empty page has an empty text, as has one without a main text; markup cut off at the end of a page
is dropped; a very long page is handled as a whole, in memory and time in proportion to it; repeated rows give equal results; a
null page_id or url is kept; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import map_arrow, text_or_empty

# Tags and words of HTML pages, frequent words of four languages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody "
    "td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"br", "body", "html", "head", "button", "option", "optgroup", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "legend"}
RAW = frozenset("script style noscript template iframe noembed noframes xmp svg math canvas object audio video title textarea".split())
NEVER = frozenset("nav footer aside form menu dialog button select option optgroup datalist fieldset head search".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments disqus replies respond "
    "newsletter subscribe subscription signup login pagination pager hidden".split()
)
WEAK_HINTS = frozenset("banner overlay aside share sharing social related recommended recommendations teaser widget toolbar skip".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
STOP_WORDS = frozenset(
    "the of and to in a is that it was for on are with as be by at from this have or had not but which he you were they an we all "
    "der die und das von zu den mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur se ne ce il sont avec son ou "
    "el y los se las por una con para su al lo como más o pero sus le ha me si sin sobre este ya".split()
)
LINK_SHARE = 0.5
LONG_CHARS = 80
SHORT_WORDS = 10
DENSE, SPARSE = 0.20, 0.08
APART = 200  # characters that blocks without a common element count as further apart
LISTED = frozenset("li td th dd dt".split())
REPEATED = frozenset("li dd dt option tr td th".split())

TOKEN = re.compile(r"<!--|<[!?]|</?[a-zA-Z]")
TAG_REST = re.compile(r"""[^\s/>]*((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
TAG_PLAIN = re.compile(r"[^\s/>]*([^>]*)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[a-z0-9]+")
TEXT_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    never: bool  # inside a container that never counts
    weak: bool  # inside a container that often holds no text
    listed: bool  # a list item or table cell
    prose: bool  # a paragraph or heading
    heading: bool
    near: tuple[int, int]  # numbers of its element and of the one around it


def unwanted(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element's tag or attributes say that it holds no main text, and whether they say so weakly.

    inside: of an article or main element, whose header is a part of it.
    """
    never, weak = tag in NEVER or (tag == "header" and not inside), False
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if tag not in ("body", "html", "main", "article"):
                found = WORDS.findall(value)
                never |= not HINTS.isdisjoint(found)
                weak |= not WEAK_HINTS.isdisjoint(found)
        elif name == "role":
            never |= value in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            never = True
    return never, weak


def tags(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before, tag name with / if it ends, attributes); comments and raw elements are skipped; the name is empty at the end."""
    at, closed_quotes, text = 0, True, []
    n = len(page)
    while m := TOKEN.search(page, at):
        text.append(page[at : m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if m[0] in ("<!", "<?"):
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        rest = TAG_REST.match(page, m.end() - 1) if closed_quotes else None
        if not rest:
            closed_quotes = False
            rest = TAG_PLAIN.match(page, m.end() - 1)
        if not rest:
            at = n
            break
        name = page[m.end() - 1 : rest.start(1)].lower()
        at = rest.end()
        if m[0][1] == "/":
            yield "".join(text), "/" + name, ""
        else:
            yield "".join(text), name, rest[1]
            if name in RAW and not rest[1].endswith("/"):
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
                at = end.start() if end else n
        text = []
    text.append(page[at:])
    yield "".join(text), "", ""


@dataclass
class Element:
    tag: str
    number: int
    never: bool
    weak: bool
    inside: bool  # an article or main element


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[Element] = []  # open block elements
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, link_at, number = 0, -1, 0  # link_at: depth of the stack where a link began

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                last = [e.tag for e in stack[-3:]]
                own = last[-1] if last else ""
                heading = own[:1] == "h" and own[1:].isdigit()
                near = (stack[-1].number if stack else 0, stack[-2].number if len(stack) > 1 else 0)
                never, weak = (stack[-1].never, stack[-1].weak) if stack else (False, False)
                out.append(Block(text, linked, never, weak, not LISTED.isdisjoint(last), heading or own == "p", heading, near))
            parts.clear()
        linked = 0

    def close() -> str:
        tag = stack.pop().tag
        opened[tag] -= 1
        return tag

    for text, name, attributes in tags(page):
        if text:
            parts.append(text)
            if link_at >= 0:
                linked += len(text.strip())
        if name == "a":
            link_at = len(stack)
        elif name == "/a":
            link_at = -1
        elif name.lstrip("/") in BLOCK:
            flush()
            if name[0] == "/":
                if opened[name[1:]]:
                    while close() != name[1:]:
                        pass
            elif name not in VOID:
                if stack and ((stack[-1].tag == "p" and name in ENDS_P) or (stack[-1].tag == name and name in REPEATED)):
                    close()
                around = stack[-1] if stack else Element("", 0, False, False, False)
                never, weak = unwanted(name, attributes, around.inside)
                number += 1
                stack.append(Element(name, number, never or around.never, weak or around.weak, around.inside or name in ("article", "main")))
                opened[name] += 1
            if link_at > len(stack):
                link_at = -1
    flush()
    return out


GOOD, BAD, UNSURE = 1, 0, -1


def first_pass(found: list[Block]) -> list[int]:
    def label(b: Block) -> int:
        if b.never:
            return BAD
        if b.linked > LINK_SHARE * len(b.text):
            return UNSURE if b.prose and not b.weak else BAD
        words = TEXT_WORD.findall(b.text.lower())
        dense = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        long = len(b.text) >= LONG_CHARS
        if b.weak:
            return GOOD if long and dense >= DENSE else BAD
        if dense >= DENSE and (long or len(words) > SHORT_WORDS):
            return GOOD
        return BAD if long and b.listed and dense < SPARSE else UNSURE

    return [label(b) for b in found]


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    """Ambiguous blocks take the label of the nearest decided block, on a tie that of the one before."""
    if GOOD not in labels:
        return [GOOD if x == UNSURE else x for x in labels]
    at = [i for i, b in enumerate(found) if not b.never]  # other blocks aren't neighbours of any

    def nearest(order: list[int]) -> dict[int, tuple[int, int]]:
        """(distance, label) of the decided block before, in this order."""
        out: dict[int, tuple[int, int]] = {}
        last, between = -1, 0
        for i in order:
            if labels[i] != UNSURE:
                last, between = i, 0
                continue
            if last >= 0:
                out[i] = between + (0 if not set(found[i].near).isdisjoint(found[last].near) else APART), labels[last]
            between += len(found[i].text)
        return out

    before, after = nearest(at), nearest(at[::-1])
    out = list(labels)
    for i in at:
        if labels[i] == UNSURE:
            ahead = [after[i]] if i in after else []
            back = [before[i]] if i in before else []
            known = ahead if found[i].heading and ahead else back + ahead
            out[i] = min(known, key=lambda k: k[0])[1]
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, x in zip(found, second_pass(found, first_pass(found)), strict=True) if x == GOOD)


def extract(pages: DataFrame, *, page: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The key columns, text (empty if there is none) and n_chars, its code points."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(len(keys)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*keys, "text", "n_chars"])

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return map_arrow(pages.select(*keys, text_or_empty(page).alias("page")), run, f"{kinds}, text string, n_chars long")
