"""Attribute, class and selector tests on page elements."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from storelens.functions.text import STRIP_TAGS, apply, blank_to_null, contains_any, found, let, strip_tags, unescape_html

# Quotes are written \\x22 and \\x27 so that the patterns fit into SQL text as they are.
TRIM_QUOTES = r"^[\x22\x27]|[\x22\x27]$"
ATTR = r"(?is)(?:^|[\s\x22\x27/]){}\s*=\s*(\x22[^\x22]+\x22|\x27[^\x27]+\x27|[^\s\x22\x27>]+)"
BARE_ATTR = (
    r"(?is)(?:^|[\s\x22\x27/]){}\s*=\s*[\x22\x27]?((?<=\x22)[^\x22]++(?=\x22)|(?<=\x27)[^\x27]++(?=\x27)|(?<![\x22\x27])[^\s\x22\x27>]+)"
)
HAS_ATTR = r"(?is)[\s\x22\x27/]{}(?:[\s=/>]|$)"


def attr(opener: Column, name: str) -> Column:
    """Value of an attribute in an opening tag, NULL when absent or empty."""
    return F.trim(unescape_html(raw_attr(opener, name)))


def raw_attr(opener: Column, name: str) -> Column:
    """Attribute value with character references as written."""
    return F.regexp_replace(found(opener, ATTR.format(name), 1), TRIM_QUOTES, "")


def bare_attr(opener: Column, name: str) -> Column:
    """Like ``raw_attr``, but empty without the attribute; one regex finds the value and leaves its quotes out."""
    return F.regexp_extract(opener, BARE_ATTR.format(name), 1)


def has_attr(opener: Column, name: str) -> Column:
    return opener.rlike(HAS_ATTR.format(name))


def first_attr(opener: Column, *names: str) -> Column:
    return let(opener, lambda o: F.coalesce(*[attr(o, n) for n in names]))


def _value(name: str) -> str:
    return f"regexp_replace(get(regexp_extract_all({{e}}.opener, r'{ATTR.format(name)}', 1), 0), r'{TRIM_QUOTES}', '')"


def selector_test(selector: str) -> str:
    """SQL test, with ``{e}`` for the element, of a simple selector: ``.class``, ``#id``, ``tag``, ``[attr]``,
    ``[attr="v"]``, ``[attr*="v"]`` (``i`` for any case), or a tag with one of the last three."""
    tag, name, operator, value, flag = re.fullmatch(
        r"([.#]?[\w-]*)(?:\[([\w-]+)(?:(\*?=)\"([^\"]*)\"( i)?)?\])?", selector
    ).groups()
    tests = []
    if tag.startswith("."):
        tests.append(f"contains({{e}}.cls, ' {tag[1:]} ')")
    elif tag.startswith("#"):
        tests.append(f"{_value('id')} = '{tag[1:]}'")
    elif tag:
        tests.append(f"{{e}}.tag = '{tag}'")
    if name == "class":
        tests.append(f"contains({{e}}.cls, '{value}')")
    elif name and value is None:
        tests.append(f"{{e}}.opener rlike r'{HAS_ATTR.format(name)}'")
    elif name:
        held = f"lower({_value(name)})" if flag else _value(name)
        tests.append(f"contains({held}, '{value}')" if operator == "*=" else f"{held} = '{value}'")
    return f"coalesce({' and '.join(tests)}, false)"


def _named(test: str, name: str) -> str:
    return test.replace("{e}", name)


def matches(element: Column, selector: str) -> Column:
    """True when the element matches the selector."""
    return apply(f"x -> {_named(selector_test(selector), 'x')}", element)


def matches_path(element: Column, owners: Column, selector: str) -> Column:
    """``a b``: the element matches ``b`` and one of its owners matches ``a``."""
    return apply(f"p -> {path_test(selector, 'p.element', 'p.owners')}", _pair(element, owners))


def _pair(element: Column, owners: Column) -> Column:
    return F.struct(element.alias("element"), owners.alias("owners"))


def path_test(selector: str, element: str, owners: str) -> str:
    """SQL test of a selector with at most one outer part; a space inside brackets belongs to the selector."""
    parts = re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", selector)
    tests = [_named(selector_test(parts[-1]), element)]
    tests += [f"exists({owners}, o -> {_named(selector_test(part), 'o')})" for part in parts[:-1]]
    return " and ".join(tests)


def selector_rank(selectors, element: Column, owners: Column) -> Column:
    """Index of the first selector the element matches."""
    cases = " ".join(f"when {path_test(s, 'p.element', 'p.owners')} then {i}" for i, s in enumerate(selectors))
    return apply(f"p -> case {cases} end", _pair(element, owners))


def class_has(element: Column, words) -> Column:
    """Class text holds any of the words, in any case."""
    return contains_any(F.lower(element["cls"]), words)


def _first(selector: str, elements: str) -> str:
    return f"get(filter({elements}, e -> {_named(selector_test(selector), 'e')}), 0)"


def first_match(elements: Column, selector: str) -> Column:
    """First element, in page order, that matches the selector."""
    return apply(f"es -> {_first(selector, 'es')}", elements)


def inner_html(span: Column, pieces: Column | str = "pieces") -> Column:
    """Markup of an element, or of a part around it, from the pieces of its page."""
    held = F.col(pieces) if isinstance(pieces, str) else pieces
    return F.when(span.isNotNull(), F.array_join(F.slice(held, span["start"] + 1, span["stop"] - span["start"]), ""))


def element_text(element: Column) -> Column:
    return blank_to_null(strip_tags(inner_html(element)))


def first_texts(elements: Column, selectors) -> Column:
    """Text of each selector's first element, in selector order."""
    spans = ", ".join(_first(s, "es") for s in selectors)
    html = F.transform(apply(f"es -> array({spans})", elements), lambda e: inner_html(e))
    return F.call_function("transform", html, F.expr(STRIP_TAGS))


def inside(page: Column, element: Column) -> Column:
    """Elements within ``element``: they follow it directly in the page outline."""
    return F.slice(page, element["seq"] + 1, element["last"] - element["seq"])


CLIMBED = 32


def owners_sql(page: str, e: str) -> str:
    """SQL for the elements around ``e``, outermost first: up from parent to parent, or from many levels on those whose interval holds it."""
    up = f"aggregate(slice(sequence(1, {CLIMBED}), 2, {e}.depth - 1), array({e}.parent), (s, i) -> concat(array(get({page}, get(s, 0) - 1).parent), s))"
    return (
        f"case when {e}.depth = 0 then slice({page}, 1, 0) when {e}.depth <= {CLIMBED} then transform({up}, i -> get({page}, i - 1)) "
        f"else filter(slice({page}, 1, {e}.seq - 1), x -> x.last >= {e}.seq) end"
    )


def owners(page: Column, element: Column) -> Column:
    """Elements around ``element``, outermost first."""
    return apply(f"p -> {owners_sql('p.page', 'p.element')}", F.struct(page.alias("page"), element.alias("element")))
