"""Element outline of a page: the one place where a tag tree is needed.

Rules such as "the price inside this product card" depend on which closing tag
belongs to which opening tag, which no regular expression can tell.  A small
Arrow UDF pairs the tags of one page and returns the wanted elements as a flat
array; every rule on top of it is a Column expression.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Executors need not have this package installed: the helper travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The HTML tags without content, the tags whose end may be left out, and what bounds them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OPTIONAL_END = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BOUNDS = set("article body div dl footer form header main nav ol section select table td ul".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

# A ">" in quotes doesn't end a tag, unless the quote has no end.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^'">]++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*+)>""")
CLASS = re.compile(r"(?:^|[\s\"'/])class\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)

SCHEMA = (
    "struct<pieces:array<string>,elements:array<struct<seq:int,last:int,parent:int,depth:int,tag:string,cls:string,opener:string,"
    "start:int,stop:int,around:array<struct<tag:string,start:int,stop:int>>>>>"
)
SPAN = [("start", pa.int32()), ("stop", pa.int32())]
ELEMENT = pa.struct(
    [("seq", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("cls", pa.string()),
     ("opener", pa.string()), *SPAN, ("around", pa.list_(pa.struct([("tag", pa.string()), *SPAN])))]
)
ARROW = pa.struct([("pieces", pa.list_(pa.string())), ("elements", pa.list_(ELEMENT))])


class Node:
    __slots__ = ("tag", "attrs", "start", "inner", "inner_stop", "stop", "parent")

    def __init__(self, tag, match, parent):
        self.tag, self.attrs, self.parent = tag, match.group(3), parent
        self.start, self.inner = match.start(), match.end()
        self.inner_stop = self.stop = match.end()


def pair_tags(page: str) -> list[Node]:
    """Nodes of a page in document order, each with its extent and parent."""
    nodes, stack, still_open = [], [], Counter()

    def close_to(tag, at, end):
        while True:
            node = nodes[stack.pop()]
            still_open[node.tag] -= 1
            node.inner_stop = node.stop = at
            if node.tag == tag:
                node.stop = end
                return

    # Nothing after the last ">" is a tag; to look for one from every "<" there would take the square of its length.
    for match in TAG.finditer(page, 0, page.rfind(">") + 1):
        tag = match.group(2).lower()
        if match.group(1):
            if still_open[tag]:
                close_to(tag, match.start(), match.end())
            continue
        for i in reversed(stack) if any(still_open[t] for t in OPTIONAL_END.get(tag, ())) else ():
            if nodes[i].tag in BOUNDS:
                break
            if nodes[i].tag in OPTIONAL_END[tag]:
                close_to(nodes[i].tag, match.start(), match.start())
                break
        nodes.append(Node(tag, match, stack[-1] if stack else -1))
        if tag not in VOID and not match.group(3).endswith("/"):
            stack.append(len(nodes) - 1)
            still_open[tag] += 1
    for i in stack:
        nodes[i].inner_stop = nodes[i].stop = len(page)
    return nodes


def parts_between(page, nodes, members, start, stop):
    """Tag and extent of the elements and loose texts of a sibling run, in order."""
    for i in members:
        if page[start : nodes[i].start].strip():
            yield "", start, nodes[i].start
        yield nodes[i].tag, nodes[i].inner, nodes[i].inner_stop
        start = nodes[i].stop
    if page[start:stop].strip():
        yield "", start, stop


def outline_page(page, wanted, within, heading_words, with_parts):
    """The page's wanted elements as intervals over pieces of its text, which are cut where an interval begins or ends."""
    nodes = pair_tags(page)
    children, place = {}, {}
    for i, node in enumerate(nodes):
        place[i] = len(children.setdefault(node.parent, []))
        children[node.parent].append(i)
    out, spans = [], []
    around_of = {-1: 0}  # the wanted element around each node
    for i, node in enumerate(nodes):
        owner, opener = around_of[node.parent], f"<{node.tag}{node.attrs}>"
        heading = node.tag in HEADINGS
        take = wanted.search(opener) or (owner and (node.tag in within or CLASS.search(node.attrs)))
        if heading and not take:
            take = owner or heading_words.search(page, node.inner, node.inner_stop)
        if not take:
            around_of[i] = owner
            continue
        around = None
        if heading:
            siblings, first = children[node.parent], place[i] + 1
            after = first
            while after < len(siblings) and nodes[siblings[after]].tag not in HEADINGS:
                after += 1
            end = nodes[node.parent].inner_stop if node.parent >= 0 else len(page)
            end = nodes[siblings[after]].start if after < len(siblings) else end
            around = list(parts_between(page, nodes, siblings[first:after], node.stop, end))
        elif with_parts and with_parts.search(opener):
            around = list(parts_between(page, nodes, children.get(i, []), node.inner, node.inner_stop))
        seq = around_of[i] = len(out) + 1
        found = CLASS.search(node.attrs)
        cls = " ".join(found.group(1).strip("\"'").split()) if found else ""
        depth = out[owner - 1]["depth"] + 1 if owner else 0
        out.append(dict(seq=seq, last=seq, parent=owner, depth=depth, tag=node.tag, cls=f" {cls} " if cls else "", opener=opener))
        spans.append((node.inner, node.inner_stop, around))
    for row in reversed(out):  # elements inside come later, so their last is known
        if row["parent"]:
            owner = out[row["parent"] - 1]
            owner["last"] = max(owner["last"], row["last"])
    cuts = {at for start, stop, around in spans for at in (start, stop, *(x for part in around or () for x in part[1:]))}
    cuts = sorted(cuts)
    at = {cut: k for k, cut in enumerate(cuts)}
    for row, (start, stop, around) in zip(out, spans):
        row["start"], row["stop"] = at[start], at[stop]
        row["around"] = None if around is None else [dict(tag=t, start=at[a], stop=at[b]) for t, a, b in around]
    return {"pieces": [page[a:b] for a, b in zip(cuts, cuts[1:])], "elements": out}


class Remembered:
    """Pattern that keeps what it said of the last short texts: pages of one shop repeat their opening tags."""

    def __init__(self, pattern: re.Pattern, longest: int = 200):
        self._find, self._longest = pattern.search, longest
        self._known = lru_cache(maxsize=4096)(lambda text: self._find(text) is not None)

    def search(self, text: str) -> bool:
        return self._known(text) if len(text) <= self._longest else self._find(text) is not None


def as_arrow(outlines: list) -> pa.StructArray:
    """Outlines, or None, as one array that is built column by column."""

    def lists(sizes, values, mask=None):
        return pa.ListArray.from_arrays(pa.array(list(accumulate(sizes, initial=0)), pa.int32()), values, mask=mask)

    def fields(rows, kind):
        return [pa.array([row[name] for row in rows], kind.field(name).type) for name in (f.name for f in kind)]

    held = [o or {"pieces": (), "elements": ()} for o in outlines]
    elements = [e for o in held for e in o["elements"]]
    parts = [p for e in elements for p in e["around"] or ()]
    part = ELEMENT.field("around").type.value_type
    around = lists(
        (len(e["around"] or ()) for e in elements), pa.StructArray.from_arrays(fields(parts, part), fields=list(part)),
        pa.array([e["around"] is None for e in elements], pa.bool_()),
    )
    columns = [*fields(elements, pa.struct(list(ELEMENT)[:-1])), around]
    return pa.StructArray.from_arrays(
        [
            lists((len(o["pieces"]) for o in held), pa.array([p for o in held for p in o["pieces"]], pa.string())),
            lists((len(o["elements"]) for o in held), pa.StructArray.from_arrays(columns, fields=list(ELEMENT))),
        ],
        fields=list(ARROW), mask=pa.array([o is None for o in outlines], pa.bool_()),
    )


def outline(
    markup: Column, wanted: str, *, within=(), heading_words: str = "(?!)", with_parts: str | None = None
) -> Column:
    """The elements whose opening tag matches ``wanted``, ``within`` tags and elements
    with a class inside those, and headings that are inside those or match ``heading_words``.

    ``elements`` are intervals in page order: ``seq`` numbers them from 1, ``last`` is the last element inside,
    so an element is around another if it comes earlier and its last does not; ``parent`` is the one directly
    around (0: none), ``depth`` how many there are. Markup is in ``pieces``, once, in page order: what
    stands in an element is the pieces from ``start`` to before ``stop``. ``around`` are such spans of what follows a heading up
    to the next one (or of the children of an element matching ``with_parts``). So the outline is not larger than
    a small multiple of the page, however its elements are nested.
    """
    wanted_re, words_re = re.compile(wanted, re.I), re.compile(heading_words, re.I)
    parts_re = re.compile(with_parts, re.I) if with_parts else None
    inner_tags = frozenset(within)

    @F.arrow_udf(SCHEMA)
    def page_outline(pages: pa.Array) -> pa.Array:
        rows = (p.as_py() for p in pages)
        wanted_tag, parts_tag = Remembered(wanted_re), Remembered(parts_re) if parts_re else None
        return as_arrow([None if p is None else outline_page(p, wanted_tag, inner_tags, words_re, parts_tag) for p in rows])

    # Keeps the optimizer from moving or repeating the call: each page is outlined once.
    return page_outline.asNondeterministic()(markup)
