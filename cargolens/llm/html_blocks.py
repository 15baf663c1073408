"""HTML extraction: two-pass block rules.

A page is cut into blocks at its block elements. The first pass classifies each block without its neighbours: by
the element that holds it (menus, forms and containers whose class or role names them as such are out), by link density, by
length and by the density of stop words. Short blocks and blocks with few stop words stay ambiguous. In the second
pass an ambiguous block takes the label of the nearest decided block.

An article container (article, main, or a class or id like content) is a prior and decides no block alone: in it,
fewer stop words are enough, few of them leave a long block ambiguous instead of out, and ambiguous blocks look at
decided blocks of the containers first, as the menus around say nothing about them. Text outside goes by the same
rules as on a page without a container, except that at equal distance from text and boilerplate it goes.

Scale: a map over rows without a shuffle; whole pages, batch by batch.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.shared import with_package

SHORT, LONG, LINKS, FEW, MANY = 70, 200, 0.4, 0.15, 0.28
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
LOOSE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# Elements and stop words.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW = set("script style noscript template iframe textarea svg math object noembed noframes title head".split())
OUT = set("nav footer aside form menu select button dialog fieldset option label datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Elements that a class, a role or an id may mark, and the words that mark.
CONTAINER = set("div section aside ul ol dl table tbody header footer nav form details figure center menu dir main article".split())
MARKS = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion promotions banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer foot "
    "comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations trending widget widgets toolbar pagination pager skip search legal copyright disclaimer complementary contentinfo dialog".split()
)
#: These mark what is outside of an article only.
OUTER = set("header masthead topbar".split())
#: What may stand beside a marking word in a name, so that other words make it the name of a subject.
BESIDE = set(
    "site page main top bottom left right global primary secondary user users reader readers post posts article articles story stories container wrapper wrap box list section area block bar link links "
    "button buttons inner outer unit slot form item items text content body panel row col column group in up side sign to more header footer".split()
)
ARTICLE = set("article post content main story article-body article-content article-text post-body post-content entry-content main-content story-body body-text".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
STOP = frozenset(
    "the of and to a in that is was for on with as are this be at or by from it an not have has had his her they we you i he she which will their its but were been one all would there what when who if more no so out up can do into "
    "le la les de des du un une et à est en que qui dans pour par sur au aux avec ne pas plus ce il elle se sont son sa ses ou mais nous vous ils cette ces "
    "der die das und ist nicht ein eine einen mit den dem des von zu im in auf für als auch sich es er sie wir ihr bei aus nach wie wird sind war oder um an am "
    "el los las y es por con para una del al lo como más su sus se no pero o este esta ha fue son muy ya entre sin sobre".split()
)
WORDS = re.compile(r"[^\W\d_]+")


def _marked(names: list[str], marks: set[str]) -> bool:
    """Whether a name is made of a marking word and at most words that go with it: cookie-notice, but not legal-history."""
    for name in names:
        parts = [p for p in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower().replace("_", "-").split("-") if p and not p.isdigit()]
        if any(p in marks for p in parts) and all(p in marks or p in BESIDE for p in parts):
            return True
    return False


def _role(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """(out, inside) that an element's own name and attributes say; ``inside``: it stands in an article.

    Classes and roles mark containers only, and by whole names; an id only if it is a marking word as it stands.
    """
    said = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
    hidden = "hidden" in said or bool(HIDDEN.search(said.get("style", "").lower()))
    if name not in CONTAINER:
        return hidden or name in OUT, False
    names = [*said.get("class", "").split(), *said.get("role", "").split()]
    whole = said.get("id", "").lower()
    if name in ("article", "main"):
        return hidden or _marked(names, {"comment", "comments", "reply", "replies", "ad", "ads", "advert"}), True
    marks = MARKS if inside else MARKS | OUTER
    out = hidden or name in OUT or (name == "header" and not inside) or whole in marks or _marked(names, marks)
    return out, not out and any(n.lower().replace("_", "-") in ARTICLE for n in [*names, whole])


class _Block:
    __slots__ = ("heading", "inside", "links", "out", "parts")

    def __init__(self, out: bool, inside: bool, heading: bool):
        self.parts, self.links, self.out, self.inside, self.heading = [], 0, out, inside, heading


def blocks(page: str) -> list[tuple[str, float, bool, bool, bool]]:
    """(text, link density, in an element that is out, in an article, heading) of each block with text, in order."""
    found: list[_Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, out, inside, heading
    opened: dict[str, int] = {}  # how many of an element are on the stack, so that stray ends need no search
    now: _Block | None = None
    in_link, at, skip, breaks = 0, 0, "", 0

    def add(piece: str) -> None:
        nonlocal now, breaks
        if not piece:
            return
        if now is None:
            top = stack[-1] if stack else ("", False, False, False)
            now = _Block(top[1], top[2], top[3])
            found.append(now)
        if not piece.isspace():
            breaks = 0
        piece = html.unescape(piece)
        now.parts.append(piece)
        if in_link:
            now.links += len("".join(piece.split()))

    while at < len(page):
        if skip:
            end = re.compile(rf"</{skip}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at, skip = (end.end() if end else len(page)), ""
            continue
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        m = TAG.match(page, start) or LOOSE.match(page, start)
        if not m:
            add("<")
            at = start + 1
            continue
        at = m.end()
        if not m.group(2):
            continue
        closing, name, attributes = m.group(1), m.group(2).lower(), m.group(3) or ""
        if name in RAW:
            now = now if name in ("object", "svg", "math") else None
            if not closing and not attributes.rstrip().endswith("/") and name != "head":
                skip = name
            elif not closing and name == "head":
                skip = "head" if re.compile(r"</head\s*>", re.I).search(page, at) else ""
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                now = None
            else:
                add(" ")
            continue
        if name not in BLOCK and name not in OUT:
            # inline elements count only where they hide or mark their content
            continue
        now, breaks, in_link = None, 0, (in_link if name in ("div", "p", "span") or name.startswith("h") else 0)
        if name in VOID:
            continue
        if closing:
            while opened.get(name):
                top = stack.pop()[0]
                opened[top] -= 1
                if top == name:
                    break
            continue
        while stack and stack[-1][0] in SELF_CLOSING.get(name, ()):
            opened[stack.pop()[0]] -= 1
        top = stack[-1] if stack else ("", False, False, False)
        marked, article = _role(name, attributes, top[2])
        out = top[1] or marked
        stack.append((name, out, (top[2] or article) and not out, name[0] == "h" and name[1:].isdigit()))
        opened[name] = opened.get(name, 0) + 1
    result = []
    for b in found:
        text = " ".join("".join(b.parts).split())
        if text:
            result.append((text, min(1.0, b.links / max(1, len(text.replace(" ", "")))), b.out, b.inside, b.heading))
    return result


def first_pass(text: str, links: float, out: bool, inside: bool, heading: bool) -> bool | None:
    """True and False are decided, None is ambiguous."""
    if out or links > LINKS and not (inside and len(text) > SHORT and links < 0.8):
        return False
    words = WORDS.findall(text.lower())
    stop = sum(w in STOP for w in words) / max(1, len(words))
    if heading or len(text) < SHORT:
        return None
    if stop >= (FEW if inside else MANY) or len(text) > LONG and stop >= FEW:
        return True
    return None if inside or stop >= FEW or len(text) <= LONG else False


def second_pass(labels: list[bool | None], headings: list[bool], tie: bool) -> list[bool]:
    """Ambiguous blocks get the label of the nearest decided one; ``tie``: theirs at equal distance of different labels."""
    before: list[tuple[int, bool | None]] = []
    last: tuple[int, bool | None] = (-1, None)
    for i, x in enumerate(labels):
        last = (i, x) if x is not None else last
        before.append(last)
    result, nxt = [], (-1, None)
    for i in range(len(labels) - 1, -1, -1):
        nxt = (i, labels[i]) if labels[i] is not None else nxt
        label = labels[i]
        if label is None:
            (a, left), (b, right) = before[i], nxt
            if left is None or right is None:
                label = left if right is None else right
                # ambiguous blocks only: text without links and menus is all that there is
                label = True if left is None and right is None else label
            elif left == right:
                label = left
            else:
                # a heading goes with what follows
                label = right if headings[i] else left if i - a < b - i else right if b - i < i - a else tie
        result.append(label)
    return result[::-1]


def extract(page: str | None) -> str:
    found = blocks(page or "")
    labels, headings = [first_pass(*b) for b in found], [b[4] for b in found]
    inside = [i for i, b in enumerate(found) if b[3]]
    for i, label in zip(inside, second_pass([labels[i] for i in inside], [headings[i] for i in inside], True)):
        labels[i] = label
    return "\n".join(b[0] for b, kept in zip(found, second_pass(labels, headings, not inside)) if kept)


def extract_main_text(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the columns ``keep``, text (main text, blocks joined by a line feed) and n_chars (code points).

    A null or an empty page gives an empty text, an empty table no rows. Equal rows stay as many rows; broken markup is
    read as far as it goes (unclosed elements end with the page). Columns of the input other than ``keep`` are not read;
    columns in ``keep`` that are named text or n_chars give way to the results. Long pages are read whole, in time
    linear in their length.
    """
    read = pages.select(*[F.col(f"`{c}`") for c in keep if c not in ("text", "n_chars")], F.col(f"`{page}`").alias("__page"))
    kept = [f.name for f in read.schema if f.name != "__page"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [extract(p.as_py()) for p in part.column("__page")]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"])

    return with_package(read).mapInArrow(batches, read.drop("__page").schema.add("text", "string").add("n_chars", "long"))
