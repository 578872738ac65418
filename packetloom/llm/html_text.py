"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. Pass one decides each block from stop-word density, length and link
density (and from where it stands: menus, footers, forms and the like are out whatever they say). Pass two gives the
blocks that were too short to decide the label of the nearest decided neighbour.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the four languages of the corpus; callers may give others.
STOP_WORDS = frozenset(
    "the of and to a in is it that was for on with as be by this at from are or an not but have has they you he she we "
    "der die das und ist von mit den dem des ein eine zu auf für nicht auch im sich als aus bei nach "
    "le la les de des et un une est que qui dans en du pour pas sur avec au par il elle ce ne plus son sa "
    "el los las y es una por con para del se no lo al como más su sus pero ".split()
)
# Tags that hold no text of the page, tags of page furniture, tags that part blocks, tags without an end.
SILENT = frozenset("script style noscript template svg iframe object canvas textarea select datalist math audio video head".split())
FURNITURE = frozenset("nav footer aside form button dialog menu header".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that mark page furniture.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|"
    r"signup|sidebars?|side|menus?|nav(?:bar|igation)?|breadcrumbs?|footers?|header|masthead|comments?|commentlist|disqus|respond|replies|reply|share|sharing|social|related|"
    r"recommended|widgets?|toolbar|pagination|pager|search|login|hidden)(?:$|[\s_-])",
    re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = re.compile(r"<(script|style|noscript|template|svg|iframe|textarea|canvas|head)\b([^>]*+)>", re.I)
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
REST = re.compile(r"(?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+>")
SPACES = re.compile(r"\s+")
LINK_DENSITY = 0.4
STOP_LOW, STOP_HIGH = 0.12, 0.25
SHORT, LONG = 40, 140
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: int
    heading: bool
    out: bool
    article: bool
    label: str = ""


@dataclass
class _Cutter:
    """Walks over the tokens of one page and collects its blocks."""

    blocks: list[Block] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    links: int = 0
    stack: list[tuple[str, bool]] = field(default_factory=list)
    #: by tag, and of blocks: their depths in the stack
    places: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))
    block_depths: list[int] = field(default_factory=list)
    out: int = 0
    article: int = 0
    heading: int = 0
    anchor: int = 0

    def text(self, raw: str) -> None:
        if raw:
            self.words.append(raw)
            if self.anchor:
                self.links += len(raw.strip())

    def flush(self) -> None:
        if self.words:
            text = SPACES.sub(" ", html.unescape("".join(self.words))).strip()
            if text:
                self.blocks.append(Block(text, self.links, self.heading > 0, self.out > 0, self.article > 0))
            self.words.clear()
        self.links = 0

    def open(self, tag: str, rest: str) -> None:
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.words.append(" ")
        if tag in VOID or rest.endswith("/"):
            return
        if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and self.places[tag]:
            # the same element that only inline ones separate ends here, as browsers have it
            depth = self.block_depths[-1]
            if self.stack[depth][0] == tag:
                while len(self.stack) > depth:
                    self.pop()
        out = tag in FURNITURE and not (tag == "header" and self.article)
        if not out and rest and tag in BLOCK | {"span"} and tag not in ("html", "body", "article", "main"):
            for name, a, b, c in ATTRIBUTE.findall(rest):
                name, value = name.lower(), a or b or c
                out = out or (name == "hidden") or (name == "aria-hidden" and value == "true") or (name in ("class", "id", "role") and bool(MARKED.search(value)))
        self.places[tag].append(len(self.stack))
        if tag in BLOCK:
            self.block_depths.append(len(self.stack))
        self.stack.append((tag, out))
        self.count(tag, out, 1)

    def count(self, tag: str, out: bool, by: int) -> None:
        self.out += by * out
        self.article += by * (tag in ("article", "main"))
        self.heading += by * (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
        self.anchor += by * (tag == "a")

    def pop(self) -> None:
        tag, out = self.stack.pop()
        self.places[tag].pop()
        if tag in BLOCK:
            self.block_depths.pop()
        self.count(tag, out, -1)

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if not self.places[tag]:
            return
        depth = self.places[tag][-1]
        if tag not in BLOCK and self.block_depths and self.block_depths[-1] > depth:
            return  # an inline end tag doesn't end the block around it
        while len(self.stack) > depth:
            self.pop()


class _Ends:
    """Where things end from a place on; what was once looked for in vain isn't looked for again, so any page takes linear time."""

    def __init__(self, page: str):
        self.page, self.missing, self.next = page, set(), {}
        self.marks: list[int] | None = None

    def find(self, what: str, at: int) -> int:
        """The first place of a string from at on (which never goes back), or -1."""
        found = self.next.get(what, 0)
        if 0 <= found < at or what not in self.next:
            found = self.next[what] = self.page.find(what, at)
        return found

    def end_tag(self, name: str, at: int) -> int:
        """The end of the end tag of name (for head, the start of body will do), or -1."""
        if name in self.missing:
            return -1
        found = re.compile(rf"</{name}\s*+>" + (r"|(?=<body\b)" if name == "head" else ""), re.I).search(self.page, at)
        if found is None:
            self.missing.add(name)
            return -1
        return found.end()

    def tag(self, at: int) -> int:
        """The place after the > that ends a tag whose name ends at `at` (none inside quotes counts), or -1."""
        if self.marks is None:
            if found := REST.match(self.page, at):
                return found.end()
            # a tag that never ends: from here on, the ends are told from the last mark backwards
            marks = [(m.start(), m[0]) for m in re.finditer("[\"'>]", self.page)]
            self.marks, self.after, following = [m[0] for m in marks], [-1] * (len(marks) + 1), {}
            for i in range(len(marks) - 1, -1, -1):
                place, mark = marks[i]
                if mark == ">":
                    self.after[i] = place + 1
                else:
                    self.after[i] = self.after[following[mark] + 1] if mark in following else -1
                    following[mark] = i
        return self.after[bisect_left(self.marks, at)]


def cut(page: str) -> list[Block]:
    """The non-empty blocks of a page in order."""
    c, ends, at, begun = _Cutter(), _Ends(page), 0, 0
    while (at := page.find("<", at)) >= 0:
        mark = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            over = ends.find("-->", at + 4)
            after = over + 3 if over >= 0 else len(page)
        elif mark in ("!", "?"):
            after = ends.find(">", at + 2) + 1
        elif (raw := RAW.match(page, at) if ends.find(">", at) >= 0 else None) or (m := TAG.match(page, at)):
            after = raw.end() if raw else ends.tag(m.end())
        else:
            after = 0
        if after <= 0:
            at += 1
            continue
        c.text(page[begun:at])
        if raw if mark not in ("!", "?") else None:
            name = raw[1].lower()
            if name in BLOCK:
                c.flush()
            if not raw[2].endswith("/"):
                over = ends.end_tag(name, after)
                after = over if over >= 0 else (after if name in ("noscript", "template", "svg", "head") else len(page))
        elif mark not in ("!", "?"):
            tag = m[2].lower()
            if m[1]:
                c.close(tag)
            elif tag in SILENT:
                over = ends.end_tag(tag, after)
                after = over if over >= 0 else after
            else:
                c.open(tag, page[m.end() : after - 1])
        at = begun = after
    tail = page[begun:]
    cut_off = re.search(r"<[/A-Za-z!][^<]*\Z", tail)  # a tag that the page's end cut short
    c.text(tail[: cut_off.start()] if cut_off else tail)
    c.flush()
    return c.blocks


def first_pass(blocks: list[Block], stop_words: frozenset = STOP_WORDS) -> None:
    """good or bad by what a block says, out by where it stands, or an open label (short, near) for the second pass."""
    inside = any(b.article and not b.out for b in blocks)
    for b in blocks:
        n = len(b.text)
        words = WORD.findall(b.text.lower())
        density = sum(w in stop_words for w in words) / len(words) if words else 0.0
        if b.out or (inside and not b.article):
            b.label = "out"
        elif b.links > LINK_DENSITY * n or (b.text[0] == "©" and n < LONG):
            b.label = "bad"
        elif b.heading:
            b.label = "near" if b.article else "short"
        elif n < SHORT:
            b.label = "short"
        elif density >= STOP_HIGH:
            b.label = "good" if n > LONG else "near"
        elif (density >= STOP_LOW or b.article) and not b.links:
            b.label = "near"
        else:
            b.label = "short" if density >= STOP_LOW else "bad"


def second_pass(blocks: list[Block]) -> None:
    """Open blocks take the label of the nearest decided one.

    At equal distance from two that differ, or with none decided, near ones and those of the article proper are good,
    the others bad. Blocks that are out decide nothing.
    """
    decided = [i for i, b in enumerate(blocks) if b.label in ("good", "bad")]
    labels = [b.label for b in blocks]
    after = 0
    for i, b in enumerate(blocks):
        while after < len(decided) and decided[after] <= i:
            after += 1
        if labels[i] not in ("short", "near"):
            continue
        fallback = "good" if labels[i] == "near" or b.article else "bad"
        left = decided[after - 1] if after else None
        right = decided[after] if after < len(decided) else None
        if left is None or right is None:
            b.label = fallback if left is right else labels[right if left is None else left]
        elif i - left == right - i:
            b.label = labels[left] if labels[left] == labels[right] else fallback
        else:
            b.label = labels[left if i - left < right - i else right]


def main_text(page: str | None, stop_words: frozenset = STOP_WORDS) -> str:
    """The main text of a page: its good blocks in order, parted by an empty line; empty if there are none."""
    if not page:
        return ""
    blocks = cut(page)
    first_pass(blocks, stop_words)
    second_pass(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points of text).

    Null html counts as empty and gives empty text; null ids and urls are kept; whole pages of any length are read,
    broken markup included; repeated rows are worked on each; other columns aren't read; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
