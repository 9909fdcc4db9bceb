"""Questions and answers from headings, accordions and definition lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens import rules
from storelens.functions import dom, text, urls
from storelens.functions.outline import HEADINGS
from storelens.operators import relations
from storelens.operators.ranking import first_per_key
from storelens.operators.registry import operator
from storelens.operators.relations import PAGE

COLUMNS = (*PAGE, "seq", "question", "answer", "category")
ANSWER_TAGS = ("p", "div", "ul", "ol", "li")


def _clean(span: Column) -> Column:
    return text.clean_faq_text(text.strip_tags(dom.inner_html(span)))


def _pair(question: Column, answer: Column, seq: Column) -> Column:
    return F.struct(seq.cast("int").alias("seq"), question.alias("question"), answer.alias("answer"))


def _heading_pairs(parts: Column) -> Column:
    """Headings that are questions, each with the paragraphs, blocks and lists up to the next heading."""
    heads = F.filter(parts, lambda e: e["tag"].isin(*HEADINGS))
    read = F.transform(
        heads,
        lambda e: F.struct(
            e["seq"].alias("seq"),
            _clean(e).alias("question"),
            F.array_join(
                F.transform(
                    F.filter(F.coalesce(e["around"], F.array()), lambda a: a["tag"].isin(*ANSWER_TAGS)),
                    lambda a: _clean(a),
                ),
                " ",
            ).alias("answer"),
        ),
    )
    return F.filter(
        read,
        lambda p: (F.length(p["question"]) >= 5)
        & ~text.is_faq_category_header(p["question"])
        & (F.length(p["answer"]) > 10),
    )


def _long_enough(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: (F.length(p["question"]) > 5) & (F.length(p["answer"]) > 10))


def _accordion_pairs(page: Column, parts: Column) -> Column:
    """First heading or button of an accordion item with its first answer block."""
    items = F.filter(
        parts, lambda e: e["tag"].isin("div", "section") & dom.class_has(e, rules.FAQ_ACCORDION_WORDS)
    )

    def pair(item):
        held = dom.inside(page, item)
        ask = F.filter(held, lambda e: e["tag"].isin(*HEADINGS, "button", "summary"))
        answer = F.filter(held, lambda e: e["tag"].isin("div", "p") & dom.class_has(e, rules.FAQ_ANSWER_WORDS))
        return _pair(_clean(F.get(ask, F.lit(0))), _clean(F.get(answer, F.lit(0))), item["seq"])

    return _long_enough(F.transform(items, pair))


@operator("dt_dd_zip")
def definition_pairs(page: Column, parts: Column) -> Column:
    """The i-th term of a definition list with its i-th definition."""

    def pairs_of(lst):
        held = dom.inside(page, lst)
        terms, texts = F.filter(held, lambda e: e["tag"] == "dt"), F.filter(held, lambda e: e["tag"] == "dd")
        return F.transform(
            terms, lambda t, i: _pair(_clean(t), _clean(F.get(texts, i)), t["seq"])
        )

    return F.flatten(F.transform(F.filter(parts, lambda e: e["tag"] == "dl"), pairs_of))


def _by_method(page: Column, parts: Column) -> Column:
    """Pairs of the first method that finds any: headings, accordions, definition lists."""
    by_list = _long_enough(definition_pairs(page, parts))
    by_fold = text.let(_accordion_pairs(page, parts), lambda p: F.when(F.size(p) > 0, p).otherwise(by_list))
    return text.let(_heading_pairs(parts), lambda p: F.when(F.size(p) > 0, p).otherwise(by_fold))


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("category", text.faq_category(F.col("question"))).select(*COLUMNS)


@operator("faq_blocks")
def faq_blocks(pages: DataFrame, *, whole_page: bool = False, fallback_content: bool = False) -> DataFrame:
    """Questions and answers of FAQ-like blocks (class, else id), in block order.

    ``fallback_content`` also looks at main, article or content blocks when a page has no FAQ block;
    ``whole_page`` takes the page itself as the block (used for page bodies from feeds).
    """
    page = F.col("dom")
    if whole_page:
        wrapped = F.concat(F.lit('<div class="faq">'), F.col("html"), F.lit("</div>"))
        blocks = relations.page_blocks(pages.withColumn("html", wrapped))
        return _named(blocks.select(*PAGE, F.inline(_by_method(page, page))))
    blocks = relations.page_blocks(pages)

    def held(name, tags):
        words = "|".join(rules.FAQ_CONTAINER_WORDS)
        value = {"class": lambda e: e["cls"], "id": lambda e: F.coalesce(dom.raw_attr(e["opener"], "id"), F.lit(""))}[name]
        return F.filter(page, lambda e: e["tag"].isin(*tags) & F.lower(value(e)).rlike(words))

    by_class = held("class", ("div", "section"))
    by_id = held("id", ("main", "article", "div") if fallback_content else ("div", "section"))
    body = [dom.first_match(page, s) for s in ("main", "article", ".content")] if fallback_content else []
    chosen = [by_class, by_id, F.slice(F.array_compact(F.array(*body)), 1, 1)] if body else [by_class, by_id]
    containers = text.first_of(F.array(*chosen), lambda c: F.size(c) > 0)
    listed = blocks.withColumn("containers", containers)
    pairs = F.flatten(F.transform("containers", lambda c: _by_method(page, dom.inside(page, c))))
    numbered = F.transform(pairs, lambda p, i: _pair(p["question"], p["answer"], i))
    return _named(listed.select(*PAGE, F.inline(numbered)))


@operator("dedup_faqs")
def dedup_faqs(faqs: DataFrame, order=("source_rank", "page_rank", "url", "seq")) -> DataFrame:
    """First entry per site and question."""
    order = [c for c in order if c in faqs.columns]
    return first_per_key(faqs, ["site", F.lower(F.trim("question"))], order)


@operator("faq_page_set")
def faq_page_set(pages: DataFrame, feed_faqs: DataFrame | None = None, paths=rules.FAQ_PATHS) -> DataFrame:
    """Questions of the known FAQ pages of every site; for each path its feed body wins over its HTML."""
    path_rank = F.array_position(F.array(*map(F.lit, paths)), urls.path_of(F.col("url")))
    known = pages.withColumn("source_rank", path_rank).filter(F.col("source_rank") > 0).drop("source_rank")
    html = faq_blocks(known, fallback_content=True).withColumn("source_rank", path_rank)
    if feed_faqs is None:
        return html
    feed = feed_faqs.withColumn("source_rank", path_rank).filter(F.col("source_rank") > 0)
    answered = feed.select("site", "source_rank").distinct()
    return feed.unionByName(html.join(answered, ["site", "source_rank"], "left_anti"))


@operator("union_faqs")
def union_faqs(main_pages: DataFrame, pages: DataFrame, feed_faqs: DataFrame | None = None) -> DataFrame:
    """Questions of the main page, then of the known FAQ pages, deduplicated per site."""
    current = faq_blocks(main_pages).withColumn("source_rank", F.lit(0).cast("bigint"))
    return dedup_faqs(current.unionByName(faq_page_set(pages, feed_faqs)))


@operator("faq_legacy")
def faq_legacy(pages: DataFrame) -> DataFrame:
    """Older rule set: class selectors with question and answer inside, then every definition list.

    Nothing is deduplicated and there is no category.
    """
    page = F.col("dom")

    def field(held, selectors):
        return text.first_of(dom.first_texts(held, selectors), lambda t: t != "")

    def pair(item):
        return text.let(read(item), choose)

    def read(item):
        held = dom.inside(page, item)
        # Without marked parts, the first text line is the question and the rest the answer.
        lines = F.filter(
            F.transform(F.split(F.regexp_replace(dom.inner_html(item), text.TAG, ""), "\n"), text.squeeze), lambda t: t != ""
        )
        return F.struct(
            field(held, rules.FAQ_LEGACY_QUESTION).alias("ask"),
            field(held, rules.FAQ_LEGACY_ANSWER).alias("answer"),
            lines.alias("lines"),
            item["seq"].alias("seq"),
        )

    def choose(r):
        by_line = (r["ask"].isNull() | r["answer"].isNull()) & (F.size(r["lines"]) >= 2)
        rest = F.array_join(F.slice(r["lines"], F.lit(2), F.size(r["lines"])), " ")
        return _pair(
            F.when(by_line, F.get(r["lines"], F.lit(0))).otherwise(r["ask"]),
            F.when(by_line, rest).otherwise(r["answer"]),
            r["seq"],
        )

    def by(selector):
        return F.transform(F.filter(page, lambda e: dom.matches(e, selector)), pair)

    pairs = F.concat(*[by(s) for s in rules.FAQ_LEGACY_SELECTORS], definition_pairs(page, page))
    usable = F.filter(pairs, lambda p: (F.length(p["question"]) > 5) & (p["answer"] != ""))
    numbered = F.transform(
        usable, lambda p, i: _pair(text.clean_text(p["question"]), text.clean_text(p["answer"]), i)
    )
    return relations.page_blocks(pages).select(*PAGE, F.inline(numbered))
