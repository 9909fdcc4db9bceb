"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import small_batches, utf8

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the key ends these elements where they are still open and no element of FENCES lies between.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table select article section main aside div body".split())
#: Elements that make up a list or table; their items belong to what holds it.
LISTS = frozenset("ul ol dl li dt dd p table caption thead tbody tfoot tr td th pre blockquote h1 h2 h3 h4 h5 h6 summary figcaption".split())
ITEMS = frozenset("li dt dd".split())
#: Elements and roles that hold no article, and the words of classes and ids that say the same.
APART = frozenset("nav footer aside form button select menu dialog fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset(
    "ad ads advert advertisement advertising adbox adsense banner sponsor sponsored promo promotion nav navigation navbar menu submenu topbar breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget related recommended share sharing social cookie cookies consent gdpr notice notification alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist disqus respond replies reply pagination pager toolbar copyright".split()
)
#: A class that begins so tells what a part has or lacks, not what it is.
MODIFIERS = frozenset({"no", "not", "has", "with", "without"})
#: Of these, the names that an article's own head has too.
HEADS = frozenset({"header", "masthead"})
LANDMARKS = frozenset({"article", "main"})
#: A path in a landmark counts so many times.
RAISE = 2.0
KEPT_SHARE, WINDOW = 0.1, 1
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>\"'=<]*)", re.S)
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I | re.S)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


@dataclass
class Block:
    """A run of text between block borders: number and last element of its path, its text, and what is around it.

    ``container`` numbers the element that holds it, lists and tables not counted. ``apart`` tells whether
    something around it sets it apart.
    """

    path: int
    kind: str = ""
    container: int = 0
    parts: list[str] = field(default_factory=list)
    apart: bool = False
    landmark: bool = False
    linked: int = 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def _apart(tag: str, attributes: str, in_landmark: bool) -> bool:
    if tag in APART or tag == "header" and not in_landmark:
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if kind == "role" and value.strip().lower() in ROLES:
            return True
        if kind == "hidden" and tag not in ("html", "body") or kind == "aria-hidden" and value.lower() == "true":
            return True
        if kind in ("class", "id") and tag not in ("html", "body", "article", "main"):
            tokens = ([x.lower() for x in _NAME.findall(token)] for token in value.split())
            names = {x for token in tokens if token and token[0] not in MODIFIERS for x in token} & NAMES
            if names - HEADS if in_landmark else names:
                return True
    return False


class _Tags:
    """Where tags end, in time linear in the page. A ``>`` inside quotes does not end a tag.

    From the first tag whose quotes leave no end up to the end of the page, quotes are ordinary characters.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quoted = page, page.rfind(">"), True

    def end(self, at: int) -> int:
        """Position of the ``>`` of a tag whose name ends at ``at``; -1 if the page holds no more."""
        if at > self.last:
            return -1
        place = at
        while self.quoted:
            m = _MARK.search(self.page, place)
            if m and m.group() == ">":
                return m.start()
            place = self.page.find(m.group(), m.end()) + 1 if m else 0
            self.quoted = place > 0
        return self.page.find(">", at)


@dataclass
class _Open:
    tag: str
    path: int
    container: int
    apart: bool = False
    landmark: bool = False
    form: bool = False  # only a form sets it apart


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order. Unclosed elements end with what holds them, end tags without an element are skipped."""
    found: list[Block] = []
    root = _Open("", 0, 0)
    stack: list[_Open] = []
    numbers: dict[tuple[int, str], int] = {}
    open_at: dict[str, int] = defaultdict(int)
    current: Block | None = None
    depth_of_links = containers = 0
    at, end, tags = 0, len(page), _Tags(page)

    def add(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            top = stack[-1] if stack else root
            kind = next((x.tag for x in reversed(stack) if x.tag in BLOCKS), "")
            current = Block(top.path, kind, top.container, apart=top.apart, landmark=top.landmark)
            found.append(current)
        current.parts.append(text)
        if depth_of_links:
            current.linked += len(text)

    def close(count: int) -> None:
        nonlocal current, depth_of_links
        for _ in range(count):
            tag = stack.pop().tag
            open_at[tag] -= 1
            depth_of_links -= tag == "a"
            if tag in BLOCKS:
                current = None

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        stop = tags.end(at)
        if stop < 0:
            break  # the end of the page cuts the tag off
        attributes, at = page[at:stop], stop + 1
        if m.group(1):
            if open_at[name]:
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == name)
                # An inline end tag doesn't close blocks around it.
                if name in BLOCKS or not any(x.tag in BLOCKS for x in stack[depth + 1 :]):
                    close(len(stack) - depth)
            elif name in BLOCKS:
                current = None
            continue
        if name in RAW:
            if not attributes.endswith("/") or name not in ("svg", "math"):
                closing = _RAW_END[name].search(page, at)
                at = page.find(">", closing.end()) + 1 or end if closing else end
            continue
        if name == "br":
            add(" ")
            continue
        if name in VOID:
            current = None if name in BLOCKS else current
            continue
        if name in BLOCKS:
            if open_at["p"] and name not in ENDS:
                # A block ends an open paragraph with what is open inside it.
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == "p" or stack[i].tag in FENCES), -1)
                if depth >= 0 and stack[depth].tag == "p":
                    close(len(stack) - depth)
            if name in ENDS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in FENCES:
                        break
                    if stack[i].tag in ENDS[name]:
                        close(len(stack) - i)
            current = None
        if attributes.endswith("/") and name not in BLOCKS:
            continue
        top = stack[-1] if stack else root
        path, container = top.path, top.container
        if name in BLOCKS:
            path = numbers.setdefault((top.path, name), len(numbers) + 1)
            if name not in LISTS:
                containers += 1
                container = containers
        # A form around an article or main element is one around the page.
        around = top.apart and not (top.form and name in LANDMARKS)
        own = _apart(name, attributes, top.landmark)
        only_form = top.form if around else name == "form" and not _apart("div", attributes, top.landmark)
        stack.append(_Open(name, path, container, around or own, top.landmark or name in LANDMARKS, only_form and not (around and own and name != "form")))
        open_at[name] += 1
        depth_of_links += name == "a"
    return found


def _joined(held: list[tuple[Block, str]], kept: list[bool]) -> list[bool]:
    """Blocks kept, and with them what belongs to their container.

    Dropped blocks between two kept ones of one container stay if they are in that container too, lists and tables
    in it included, and so do list items that follow or precede a kept block there. A run most of whose text is
    links, such as a menu, stays dropped.
    """
    out, at = list(kept), 0
    while at < len(held):
        if kept[at]:
            at += 1
            continue
        stop = at
        while stop < len(held) and not kept[stop] and held[stop][0].container == held[at][0].container:
            stop += 1
        run, container = range(at, stop), held[at][0].container
        before = at > 0 and kept[at - 1] and held[at - 1][0].container == container
        after = stop < len(held) and kept[stop] and held[stop][0].container == container
        linked, size = (sum(x) for x in zip(*((min(held[i][0].linked, len(held[i][1])), len(held[i][1])) for i in run), strict=True))
        if 2 * linked < size:
            for i in run:
                out[i] = before and after or (before or after) and held[i][0].kind in ITEMS
        at = stop
    return out


def content(page: str) -> str:
    """Main text: blocks of the paths whose fused ratio reaches the threshold.

    Per path, the text ratio is the length of the text per block, the punctuation ratio the number of
    marks per block; link text doesn't count. Both are smoothed over neighbouring blocks in page order
    and multiplied. Paths reach a share of the page's best path, or are dropped, in an article or main
    element as elsewhere; there a path's ratio is raised by a fixed factor before it is compared. Lists and what else
    lies between kept blocks of one container stay with them (see ``_joined``).
    """
    held = [(b, t) for b, t in ((b, b.text()) for b in blocks(page) if not b.apart) if t]
    if not held:
        return ""
    paths: dict[int, list[int]] = defaultdict(list)
    for i, (b, _) in enumerate(held):
        paths[b.path].append(i)
    length = np.array([max(len(t) - b.linked, 0) for b, t in held], float)
    marks = np.array([1 + len(PUNCTUATION.findall(t)) if len(t) > b.linked else 0 for b, t in held], float)
    fused = np.zeros(len(held))
    for members in paths.values():
        fused[members] = length[members].mean() * marks[members].mean()
    kernel = np.exp(-0.5 * np.arange(-WINDOW, WINDOW + 1) ** 2.0)
    smooth = np.convolve(np.pad(fused, WINDOW, mode="edge"), kernel / kernel.sum(), mode="valid")
    score = {path: float(smooth[members].mean()) for path, members in paths.items()}
    best = max(score.values())
    fair = {path for path, members in paths.items() if score[path] * (RAISE if held[members[0]][0].landmark else 1) >= KEPT_SHARE * best}
    kept = _joined(held, [b.path in fair for b, _ in held])
    return "\n".join(t for (_, t), keep in zip(held, kept, strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: (page_id, url, text, n_chars).

    A block is the text between two borders of block elements, with character references decoded, white
    space turned into single spaces and trimmed; blocks are joined by a line feed in page order. What
    lies in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
    comments (by element, role, class or id) is left out before paths are rated.

    Null and empty pages and pages without text have an empty text. Tags that the end of a page cuts off
    are dropped. Whole pages are read, whatever their length. Rows that repeat each get a row; a null
    page_id or url stays null. Other columns are ignored. Nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            texts = [content((page or b"").decode()) for page in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    held = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = held.mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
