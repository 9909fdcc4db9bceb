"""Text expressions: ``Column -> Column``, all JVM-side.

Regexes that use word, space or digit classes start with ``(?U)`` so that they
mean the same for every alphabet.
"""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from storelens import rules

TAG = r"<[^>]+>"
HIDDEN = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>)"
REGIONS = r"(?is)<(nav|header|footer)\b.*?</\1\s*>"
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"


ENTITY_NAMES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def apply(sql_lambda: str, value: Column) -> Column:
    """Like ``let`` with the rule as a SQL lambda, which costs one call however long the rule is."""
    return F.get(F.call_function("transform", F.array(value), F.expr(sql_lambda)), F.lit(0))


def _code_point(number: str) -> str:
    # decode() takes bytes, so a code point is spelled as four big-endian bytes.
    return (
        f"get(transform(array(try_cast({number} as bigint)), cp -> if(cp between 1 and 1114111 "
        "and not cp between 55296 and 57343, decode(unhex(lpad(hex(cp), 8, '0')), 'UTF-32'), null)), 0)"
    )


def _unescape(c: str) -> str:
    # The names are one literal that folds to a constant map.
    pairs = "\\u0001".join(f"{n}\\u0002\\u{ord(char):04x}" for n, char in sorted(ENTITY_NAMES.items()))
    names = f"str_to_map('{pairs}', '\\u0001', '\\u0002')"
    hexadecimal, decimal = _code_point("conv(substr(ref, 3, 6), 16, 10)"), _code_point("substr(ref, 2, 7)")
    char = (
        f"case when ref rlike '^#[xX]' then {hexadecimal} when startswith(ref, '#') then {decimal}"
        f" else element_at({names}, ref) end"
    )
    decoded = f"coalesce(concat({char}, substr(piece, length(ref) + 2)), concat('&', piece))"
    reference = f"get(transform(array(regexp_extract(piece, r'{ENTITY}', 1)), ref -> {decoded}), 0)"
    return f"if(contains({c}, '&'), array_join(transform(split({c}, '&'), (piece, i) -> if(i = 0, piece, {reference})), ''), {c})"


def _strip(h: str) -> str:
    decoded = f"get(transform(array(regexp_replace({h}, r'{TAG}', ' ')), bare -> {_unescape('bare')}), 0)"
    return f"trim(regexp_replace({decoded}, r'(?U)\\s+', ' '))"


UNESCAPE = f"c -> {_unescape('c')}"
STRIP_TAGS = f"h -> {_strip('h')}"


def first_of(values: Column, accept) -> Column:
    """First entry of an array that is acceptable."""
    return F.get(F.filter(values, accept), F.lit(0))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern in a short text, NULL when there is none."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return let(c, lambda v: F.when(v != "", v))


def squeeze(c: Column) -> Column:
    """Whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """Squeeze, then keep only word characters, spaces and ``. , ! ? - ( )``."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"(?U)[^\w\s.,!?()-]", ""))


def clean_faq_text(c: Column) -> Column:
    """Squeeze, blank out invisible characters, tidy a trailing ``?`` or ``:``."""
    spaced = F.regexp_replace(squeeze(c), "[\u00a0\u200b\u200c\u200d\ufeff]", " ")
    tidy = F.regexp_replace(F.regexp_replace(spaced, r"\s*\?\s*$", "?"), r"\s*:\s*$", ":")
    return F.trim(tidy)


def markup(html: Column) -> Column:
    """HTML without comments, scripts and styles."""
    return F.regexp_replace(html, HIDDEN, " ")


def strip_tags(html: Column) -> Column:
    """Text of an HTML fragment; every tag becomes one space."""
    return apply(STRIP_TAGS, html)


def visible_text(html: Column, *, drop_regions: bool = False) -> Column:
    """Visible text of a page, optionally without nav, header and footer."""
    body = markup(html)
    return strip_tags(without_regions(body) if drop_regions else body)


def without_regions(body: Column) -> Column:
    """Markup without nav, header and footer."""
    return F.regexp_replace(body, REGIONS, " ")


def unescape_html(c: Column) -> Column:
    """Decode named, decimal and hexadecimal character references."""
    return apply(UNESCAPE, c)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c: Column, words, *, word_boundary: bool = False) -> Column:
    """True when ``c`` holds any of ``words`` (substring, or whole words)."""
    if word_boundary or len(words) > 1:
        alternatives = "|".join(rf"\Q{w}\E" for w in words)
        return c.rlike(rf"(?U)\b(?:{alternatives})\b" if word_boundary else alternatives)
    return c.contains(words[0])


def first_class(ordered_rules, *texts: Column, default=None, word_boundary: bool = False) -> Column:
    """Label of the first rule ``(label, words)`` with a word in any of ``texts``."""
    case = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, words in ordered_rules:
        hit = any_of(contains_any(t, words, word_boundary=word_boundary) for t in texts)
        case = case.when(hit, F.lit(label))
    return case.otherwise(F.lit(default).cast("string"))


def extract_price(c: Column) -> Column:
    """First price-looking text, by pattern order."""
    return let(c, lambda t: F.trim(F.coalesce(*[found(t, "(?iU)" + p) for p in rules.PRICE_PATTERNS])))


def price_amount(c: Column) -> Column:
    """Number inside a price text."""
    digits = F.regexp_extract(c, r"([\d,]*\.?\d+)", 1)
    return F.regexp_replace(digits, ",", "").try_cast("decimal(18,2)")


def price_currency(c: Column) -> Column:
    """Currency sign or code of a price text as an ISO code."""
    return let(
        c,
        lambda t: F.when(t.contains("$"), "USD")
        .when(t.contains("€"), "EUR")
        .when(t.contains("£"), "GBP")
        .when(t.contains("₹") | t.rlike(r"(?i)\brs\b"), "INR")
        .when(t.contains("¥"), "JPY")
        .when(t.rlike(r"(?i)usd"), "USD"),
    )


def format_price(price: Column, currency: Column) -> Column:
    """``$1.00`` for USD, ``1.00 EUR`` otherwise, the raw text when not a number."""
    amount = F.format_string("%.2f", price.try_cast("double"))
    return (
        F.when(price.isNull() | (price == ""), F.lit(None).cast("string"))
        .when(price.try_cast("double").isNull(), price)
        .when(currency == "USD", F.concat(F.lit("$"), amount))
        .otherwise(F.concat_ws(" ", amount, currency))
    )


def extract_emails(c: Column) -> Column:
    """Sorted distinct e-mail addresses."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("(?U)" + rules.EMAIL_PATTERN), F.lit(0))))


def extract_phones(c: Column) -> Column:
    """Sorted distinct phone numbers over all phone patterns."""
    found = [F.regexp_extract_all(c, F.lit("(?U)" + p), F.lit(0)) for p in rules.PHONE_PATTERNS]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def faq_category(question: Column, category_rules=rules.FAQ_CATEGORY_RULES) -> Column:
    return first_class(category_rules, F.lower(question), default=rules.FAQ_DEFAULT_CATEGORY)


def is_faq_category_header(c: Column) -> Column:
    """True for headings that name a group of questions."""
    pattern = "|".join(f"(?:{p})" for p in rules.FAQ_HEADER_PATTERNS)
    return F.lower(F.trim(c)).rlike(pattern)


def policy_type(url: Column, title: Column) -> Column:
    text = F.lower(F.concat_ws(" ", url, title))
    return first_class(rules.POLICY_TYPE_RULES, text, default="legal")


def policy_type_from_content(title: Column, content: Column) -> Column:
    both = (F.coalesce(title, F.lit("")) != "") & (F.coalesce(content, F.lit("")) != "")
    text = F.when(both, F.lower(F.concat_ws(" ", title, content))).otherwise(F.lit(""))

    def labelled(t):
        # Word by word: on whole pages that costs less than one pattern of all words.
        case = F.when(F.lit(False), F.lit(None).cast("string"))
        for label, words in rules.POLICY_TYPE_CONTENT_RULES:
            case = case.when(any_of(t.contains(w) for w in words), F.lit(label))
        return case.otherwise("legal")

    return let(text, labelled)


def last_updated(text: Column) -> Column:
    """Date behind 'last updated', 'updated', 'effective' or 'revised'."""
    return let(F.lower(text), lambda t: F.coalesce(*[found(t, p, 1) for p in rules.POLICY_DATE_PATTERNS]))


def brand_category(
    text: Column, category_rules=rules.BRAND_CATEGORY_RULES, *, word_boundary: bool = False
) -> Column:
    return first_class(
        category_rules, F.lower(text), default=rules.BRAND_DEFAULT_CATEGORY, word_boundary=word_boundary
    )
