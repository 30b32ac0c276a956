"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Elements that never hold an article (menus, forms, scripts and the like) are
left out, as are parts whose whole class, id or role name says so. The first pass then decides a block by its link density,
its length and its share of stop words; where the page marks an article, that only shifts the thresholds. The second pass
gives blocks that stay undecided, most of them short, the label of the nearest decided neighbours.

All work on a page is linear in its length.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_report
from .quality import FUNCTION_WORDS

#: Elements that hold no article text, and those whose content is not even markup.
OUT = frozenset("nav header footer aside form menu dialog button select option fieldset noscript template iframe svg canvas object embed video audio map".split())
RAW = frozenset("script style textarea title noscript iframe template svg canvas select".split())
#: Elements that begin and end a block; others run on within the line.
BLOCK = frozenset(
    "address article aside blockquote body caption center col dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where the next one of their kind, or their parent, does: end tags may lack.
LOOSE = frozenset("p li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
#: Names that mark what surrounds an article, and words that may stand beside them in a compound such as "ad-box".
SIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts adbox advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead header cookie cookies consent "
    "notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus replies reply respond pagination pager toolbar search "
    "copyright legal disclaimer skip contentinfo complementary alert outbrain taboola responses feedback".split()
)
#: Words that set an element apart wherever they stand in a name, unless a word says that it is about something's presence or
#: state ("has-comments", "comments-open"); and a name that does so as a class, while an id of it may be a chapter's.
STRONG_WORDS = frozenset("comment comments cookie cookies gdpr consent sponsored promo".split())
STATE_WORDS = frozenset("no has with without not open closed on off enabled disabled accepted".split())
CLASS_WORDS = frozenset(("discussion",))
NEUTRAL_WORDS = frozenset("box block bar area list wrap wrapper container section slot unit item items links link buttons button form top bottom left right side site page global main primary inner outer row col post posts article articles".split())
#: Thresholds of the first pass: characters of a short and of a long text, shares of characters in links, of stop words.
SHORT, LONG, MAX_LINKS, FULL_LINKS, LOW_STOPS, HIGH_STOPS = 70, 200, 0.33, 0.8, 0.12, 0.22
#: Words of a block that is all link, up to which it is no sentence; within an article such blocks go only as a menu: so many of
#: them in a row, none a heading, of so few words each.
LINK_WORDS, MENU_RUN, MENU_WORDS = 12, 3, 2

_TAG = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: What follows a tag's name: signs, and values, which may hold ">" if they are quoted.
_REST = re.compile(r"(?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


def tags(html: str):
    """(start, end, name, rest) of each piece of markup in order; ``name`` is lower-case and empty for comments and the like.

    The content of elements that hold no markup goes with their tag. A "<" that starts no tag is text.
    """
    at, size, quotes, closed = 0, len(html), True, True
    while closed and (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", ""
            continue
        if html.startswith("<![CDATA[", start):
            end = html.find("]]>", start)
            at = size if end < 0 else end + 3
            yield start, at, "cdata", html[start + 9 : at if end < 0 else end]
            continue
        found = _TAG.match(html, start + 1)
        if not found and not html.startswith(("<!", "<?", "</"), start):
            at = start + 1
            continue
        after = found.end() if found else start + 1
        match = _REST.match(html, after) if found and quotes else None
        if found and quotes and not match:
            quotes = False  # a quote that is never closed: from here on they count for nothing
        end = match.end() if match else html.find(">", after) + 1
        closed = end > 0
        if not closed:
            return
        name = found[0].lower() if found else ""
        rest = html[after : end - 1]
        if name in RAW and not rest.endswith("/"):
            last = _ENDS[name].search(html, end)
            end = last.end() if last else size
            name = ""
        at = end
        yield start, at, name, rest


def set_apart(rest: str) -> tuple[bool, bool, bool]:
    """(hidden, apart, named): whether attributes hide an element, whether a name of class, id or role sets it apart, and whether
    it has a name at all.

    A name sets apart if all its words do or are neutral, or if one of them is strong and none says that it is a state.
    """
    apart = named = False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "style" and _UNSEEN.search(value):
            return True, apart, named
        if key in ("class", "id", "role"):
            for name in value.split():
                named = True
                words = [w for w in re.split(r"[-_]+", _HUMP.sub("-", name).lower()) if w]
                if words and not SIDE_WORDS.isdisjoint(words) and all(w in SIDE_WORDS or w in NEUTRAL_WORDS for w in words):
                    apart = True
                elif not STRONG_WORDS.isdisjoint(words) and STATE_WORDS.isdisjoint(words):
                    apart = True
                elif key != "id" and len(words) == 1 and words[0] in CLASS_WORDS:
                    apart = True
    return False, apart, named


class Block:
    """A run of text: characters within links, whether an excluded element holds it, the innermost element around it that has
    a name (an index, or -1), whether an article element holds it, whether it is a heading, and whether an element with a
    name that does not hold the article is around it."""

    __slots__ = ("text", "links", "out", "named", "main", "heading", "labelled")

    def __init__(self, text: str, links: int = 0, out: bool = False, named: int = -1, main: bool = False, heading: bool = False, labelled: bool = False):
        self.text, self.links, self.out, self.named, self.main, self.heading, self.labelled = text, links, out, named, main, heading, labelled


def blocks_of(html: str) -> tuple[list[Block], list[int], list[bool], set[int]]:
    """The page's blocks; of each element with a name the next one around it, and whether its name sets it apart; those that
    hold an article."""
    done: list[Block] = []
    stack: list[tuple[str, str, int]] = []  # open elements that matter: name, kind, index if named
    open_, outs, mains, headings = Counter(), 0, 0, 0
    around: list[int] = []
    apart: list[bool] = []
    named, holders = -1, set()
    parts: list[str] = []
    in_link, link_chars, at = False, 0, 0

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                # A heading in an article's own header is the article's.
                own = headings > 0 and 0 <= first_main < first_out and outs == open_["header"]
                done.append(Block(text, min(link_chars, len(text)), outs > 0 and not own, named, mains > 0, headings > 0))
        parts, link_chars = [], 0

    first_main = first_out = -1  # depths of the outermost ones

    def push(name: str, kind: str, index: int = -1) -> None:
        nonlocal outs, mains, headings, named, first_main, first_out
        stack.append((name, kind, index))
        open_[name] += 1
        if kind == "out":
            first_out = len(stack) if not outs else first_out
            outs += 1
        if kind == "main":
            first_main = len(stack) if not mains else first_main
            mains += 1
        headings += name in HEADINGS
        if index >= 0:
            named = index

    def pop() -> str:
        nonlocal outs, mains, headings, named, first_main, first_out
        name, kind, index = stack.pop()
        open_[name] -= 1
        outs -= kind == "out"
        mains -= kind == "main"
        if not mains:
            first_main = -1
        headings -= name in HEADINGS
        if index >= 0:
            named = around[index]
        return name

    def said(text: str) -> None:
        nonlocal link_chars
        if text:
            parts.append(text)
            if in_link:
                link_chars += len(" ".join(text.split()))

    for start, end, name, rest in tags(html):
        said(html[at:start])
        at = end
        if not name:
            continue
        if name == "cdata":
            said(rest.replace("&", "&amp;"))
            continue
        closing, name = name[0] == "/", name.lstrip("/")
        if name == "a":
            in_link = not closing
            continue
        inline = name not in BLOCK and name not in OUT
        if closing:
            if not inline:
                flush()
            if open_[name]:
                flush()
                while pop() != name:
                    pass
            if name in LOOSE:
                in_link = False  # a link that was never closed
            continue
        hidden, by_name, has_name = set_apart(rest) if rest and name not in VOID else (False, False, False)
        if inline and not hidden and not by_name:
            continue
        flush()
        if name in VOID or rest.endswith("/"):
            continue
        if name in LOOSE:
            while stack and stack[-1][0] in LOOSE and (stack[-1][0] == name or stack[-1][0] == "p" or name == "tr"):
                pop()
        elif not inline and stack and stack[-1][0] == "p":
            pop()  # no block stands inside a paragraph
        if name in MAIN:
            k = named
            while k >= 0 and k not in holders:
                holders.add(k)
                k = around[k]
        index = -1
        if has_name and name not in MAIN and name not in ("body", "html"):
            index = len(around)
            around.append(named)
            apart.append(by_name)
        push(name, "out" if name in OUT or hidden else "main" if name in MAIN else "", index)
    said(html[at:])
    flush()
    return done, around, apart, holders


def stop_share(text: str) -> tuple[float, int]:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in FUNCTION_WORDS for w in words) / len(words), len(words)


def bare_link(block: Block, most: int = LINK_WORDS) -> bool:
    """Whether a block is all link and no sentence."""
    return block.links / len(block.text) > FULL_LINKS and len(block.text.split()) <= most


def menus(blocks: list[Block]) -> list[bool]:
    """Of an article's blocks those that stand in a run of short links like a menu's."""
    short = [bare_link(b, MENU_WORDS) and not b.heading for b in blocks]
    found, start = [False] * len(blocks), 0
    for i in range(len(blocks) + 1):
        if i == len(blocks) or not short[i]:
            if i - start >= MENU_RUN:
                found[start:i] = [True] * (i - start)
            start = i + 1
    return found


def first_pass(block: Block, marked: bool, menu: bool = False) -> bool | None:
    """Whether a block is article text by density, or None if that is open.

    ``marked``: the page marks an article; ``menu``: the block is one of a menu's inside it. A heading that is all link is
    open, and so is any other such block of a marked article.
    """
    density = block.links / len(block.text)
    stops, words = stop_share(block.text)
    inside = marked and block.main
    if menu:
        return False
    if density > FULL_LINKS and words <= LINK_WORDS:
        return None if inside or block.heading and not marked else False
    if density > MAX_LINKS and not inside:
        return False
    if marked and not inside:  # beside the marked article only what reads like one and has no name of its own
        return len(block.text) >= LONG and stops >= HIGH_STOPS and not block.links and not block.labelled
    if len(block.text) < SHORT:
        return None
    if stops >= HIGH_STOPS or stops >= LOW_STOPS and len(block.text) >= LONG:
        return True
    return None


def second_pass(labels: list[bool | None], inside: bool = False) -> list[bool]:
    """Open blocks get the label of the nearest decided neighbour; of two at one distance either may say yes.

    Within a marked article (``inside``) the nearest ones on both sides, however far, have to say no. If nothing is
    decided, nothing speaks against the text there is.
    """
    far = len(labels) + 1
    left, right = [(far, True)] * len(labels), [(far, True)] * len(labels)
    for out, order in ((left, range(len(labels))), (right, range(len(labels) - 1, -1, -1))):
        seen = (far, True)
        for i in order:
            seen = (0, labels[i]) if labels[i] is not None else (min(seen[0] + 1, far), seen[1])
            out[i] = seen
    return [a[1] or b[1] if inside or a[0] == b[0] else a[1] if a[0] < b[0] else b[1] for a, b in zip(left, right)]


def classify(blocks: list[Block]) -> list[bool]:
    """Whether each of the blocks, none of which stands in an excluded element, belongs to the article."""
    marked = any(b.main for b in blocks)
    if not marked:
        return second_pass([first_pass(b, False) for b in blocks])
    article = [b for b in blocks if b.main]
    own = iter(second_pass([first_pass(b, True, m) for b, m in zip(article, menus(article))], inside=True))  # an article's blocks are each other's neighbours
    return [next(own) if b.main else bool(first_pass(b, True)) for b in blocks]


def main_text(html: str) -> str:
    found, around, apart, holders = blocks_of(html)
    drop = [a and k not in holders for k, a in enumerate(apart)]
    labelled = [k not in holders for k in range(len(around))]
    for k, outer in enumerate(around):  # an element stands after the one around it
        if outer >= 0:
            drop[k] |= drop[outer]
            labelled[k] |= labelled[outer]
    for b in found:
        b.labelled = b.named >= 0 and labelled[b.named]
    blocks = [b for b in found if not b.out and not (b.named >= 0 and drop[b.named])]
    keep = classify(blocks)
    if not any(b.main for b in found) and not any(k and len(b.text) >= SHORT for b, k in zip(blocks, keep)):
        every = [b for b in found if not b.out]
        again = classify(every)
        if any(k and len(b.text) >= LONG for b, k in zip(every, again)):
            blocks, keep = every, again  # a name has set the article itself apart
    return " ".join(b.text for b, k in zip(blocks, keep) if k)


def html_extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """A struct ``page`` of the columns ``keep``, and the main text.

    Character references are decoded, white space within a block becomes one space, blocks are joined by one space in
    page order. A null or empty page, or one without text, gives an empty text; very long pages are read whole. Blocks as
    far from a kept as from a dropped neighbour are kept. Rows, repeated ones too, stay; a table without rows gives none.
    Other columns are ignored; ``keep`` may name columns called text or page.
    """

    def make():
        return lambda pages: [pa.array([main_text(p.decode("utf-8", "replace")) if p else "" for p in pages], pa.string())]

    return with_report(pages, html_col, keep, make, "text string").withColumnRenamed("doc", "page")
