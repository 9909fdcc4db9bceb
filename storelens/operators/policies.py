"""Policies: links to them, text on the page itself, full policy pages, and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens import rules
from storelens.functions import dom, text
from storelens.functions.outline import HEADINGS
from storelens.operators import relations
from storelens.operators.links import classify_links
from storelens.operators.ranking import first_per_key, last_wins
from storelens.operators.registry import operator
from storelens.operators.relations import PAGE

ORDER = ("branch", "page_rank", "url", "seq")
COLUMNS = (*PAGE, "branch", "seq", "policy_group", "title", "content", "policy_url")


@operator("policy_links")
def policy_links(links: DataFrame, policy_rules=rules.POLICY_LINK_RULES) -> DataFrame:
    """Policy records named by links, one per (link, matching group).

    Within a group, links whose target matches come before links whose text matches.
    """
    href, shown = F.lower("href"), F.lower("text")

    def hit(rank: int, group: str, title: str, words) -> Column:
        by_href, by_text = text.contains_any(href, words), text.contains_any(shown, words)
        return F.when(
            by_href | by_text,
            F.struct(
                F.lit(2 * rank).alias("branch"), F.lit(group).alias("policy_group"), F.lit(title).alias("fallback"),
                F.when(by_href, 0).otherwise(1).alias("by_text"),
            ),
        )

    groups = F.array_compact(F.array(*[hit(i, *rule) for i, rule in enumerate(policy_rules)]))
    found = links.withColumn("hit", F.explode(groups)).select(*PAGE, "seq", "link_url", "text", "hit.*")
    named = F.when(F.length("text") >= 3, F.col("text")).otherwise(F.col("fallback"))
    return found.select(
        *PAGE,
        "branch",
        (F.col("by_text").cast("long") * 1_000_000_000 + F.col("seq")).alias("seq"),
        "policy_group",
        text.clean_text(named).alias("title"),
        F.lit(rules.POLICY_LINK_CONTENT).alias("content"),
        F.col("link_url").alias("policy_url"),
    )


@operator("policy_links_legacy")
def policy_links_legacy(links: DataFrame, policy_rules=rules.POLICY_LINK_RULES_LEGACY) -> DataFrame:
    """Per site and slot the first matching link, under a fixed title."""
    slotted = classify_links(links, [(slot, words) for slot, _, words in policy_rules])
    title = F.when(F.lit(False), F.lit(None).cast("string"))
    for slot, name, _ in policy_rules:
        title = title.when(F.col("slot") == slot, F.lit(name))
    first = first_per_key(slotted, ["site", "slot"], ["page_rank", "url", "seq"])
    return first.select(
        "site",
        "slot",
        title.alias("title"),
        F.concat(F.lit("Policy available at: "), F.col("link_url")).alias("content"),
        F.col("link_url").alias("policy_url"),
    )


@operator("policy_embedded")
def policy_embedded(pages: DataFrame, heading_rules=rules.POLICY_HEADING_RULES) -> DataFrame:
    """Policy text under headings of the page itself, one record per page and group.

    A heading counts once per keyword it holds, keyword order first; each contributes the first
    eleven following parts longer than ten characters.
    """
    blocks = relations.page_blocks(pages)
    heads = F.transform(
        F.filter("dom", lambda e: e["tag"].isin(*HEADINGS)),
        lambda e: F.struct(
            text.strip_tags(dom.inner_html(e)).alias("heading"),
            F.slice(
                F.filter(
                    F.transform(F.coalesce(e["around"], F.array()), lambda a: text.strip_tags(dom.inner_html(a))),
                    lambda t: F.length(t) > 10,
                ),
                1,
                rules.EMBEDDED_PARTS_LIMIT,
            ).alias("parts"),
        ),
    )
    filled = blocks.withColumn("heads", F.filter(heads, lambda h: F.size(h["parts"]) > 0)).drop("dom", "pieces")

    def of_group(rank, group, title, words):
        def under(word):
            picked = F.filter("heads", lambda h: F.lower(h["heading"]).contains(word))
            return F.transform(
                picked, lambda h: F.concat(F.lit("## "), h["heading"], F.lit("\n"), F.array_join(h["parts"], "\n"))
            )

        joined = F.array_join(F.concat(*[under(w) for w in words]), "\n\n")
        return text.let(
            joined,
            lambda content: F.when(
                content != "",
                F.struct(
                    F.lit(2 * rank + 1).alias("branch"), F.lit(group).alias("policy_group"),
                    F.lit(title).alias("title"), content.alias("content"),
                ),
            ),
        )

    records = F.array_compact(F.array(*[of_group(i, *rule) for i, rule in enumerate(heading_rules)]))
    found = filled.withColumn("record", F.explode(records))
    return found.select(
        *PAGE, "record.branch", F.lit(0).cast("long").alias("seq"), "record.policy_group", "record.title",
        "record.content", relations.base_url(F.col("url")).alias("policy_url"),
    )


@operator("dedup_policies")
def dedup_policies(policies: DataFrame) -> DataFrame:
    """First policy per site, URL and title, in any case."""
    key = [F.lower(F.coalesce("policy_url", F.lit(""))), F.lower("title")]
    return first_per_key(policies.filter(F.col("title") != ""), ["site", *key], ORDER)


@operator("union_policies")
def union_policies(pages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Link and embedded policies in group order, deduplicated per site."""
    links = relations.links(pages) if links is None else links
    return dedup_policies(policy_links(links).select(*COLUMNS).unionByName(policy_embedded(pages).select(*COLUMNS)))


@operator("policy_slots")
def policy_slots(policies: DataFrame, slot_rules=rules.POLICY_SLOT_RULES) -> DataFrame:
    """Per site and slot (chosen by title) the last policy."""
    slot = text.first_class(slot_rules, F.lower("title"))
    slotted = policies.withColumn("slot", slot).filter(F.col("slot").isNotNull())
    record = F.struct("title", "content", F.col("policy_url").alias("url"))
    return last_wins(slotted.withColumn("policy", record), ["site", "slot"], "policy", ORDER)


def _block_lines(child: Column) -> Column:
    """Text lines of one child of a policy text block."""
    return text.let(text.strip_tags(child["html"]), lambda shown: _lines(child, shown))


def _lines(child: Column, shown: Column) -> Column:
    items = F.filter(
        F.transform(
            F.regexp_extract_all(child["html"], F.lit(r"(?is)<li\b[^>]*>(.*?)(?=</li\b|<li\b|\z)"), F.lit(1)),
            lambda li, i: F.struct((i + 1).alias("n"), text.strip_tags(li).alias("t")),
        ),
        lambda li: li["t"] != "",
    )
    return (
        F.when(child["tag"].isin(*HEADINGS), F.array(F.concat(F.lit("\n## "), shown, F.lit("\n"))))
        .when(child["tag"] == "ul", F.transform(items, lambda li: F.concat(F.lit("• "), li["t"])))
        .when(
            child["tag"] == "ol",
            F.transform(items, lambda li: F.concat(li["n"].cast("string"), F.lit(". "), li["t"])),
        )
        .when(child["tag"].isin("p", "div", "") & (shown != ""), F.array(shown))
        .otherwise(F.array().cast("array<string>"))
    )


@operator("policy_page_detail")
def policy_page_detail(pages: DataFrame) -> DataFrame:
    """Title, structured text, last-updated date and class of a policy page.

    Text blocks longer than 100 characters are joined in selector order; without any, the page
    text without navigation, header and footer is used.  Pages without title or text are dropped.
    """
    base = relations.with_site(pages)

    def block(selector):
        # heading elements list what follows them, so only blocks with children count here
        found = F.filter("dom", lambda e: dom.matches(e, selector) & e["around"].isNotNull() & ~e["tag"].isin(*HEADINGS))
        spans = F.get(found, F.lit(0))["around"]
        parts = F.transform(spans, lambda a: F.struct(a["tag"].alias("tag"), dom.inner_html(a).alias("html")))
        lines = F.flatten(F.transform(parts, _block_lines))
        return F.array_join(lines, "\n")

    def title(selector):
        if selector == "title":
            return relations.title_text(F.col("html"))
        if selector == "h1":
            return text.strip_tags(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1", 1))
        return dom.element_text(dom.first_match(F.col("dom"), selector))

    titles = text.first_of(F.array(*map(title, rules.POLICY_TITLE_SELECTORS)), lambda t: F.length(t) > 3)
    blocks = F.array(*[block(s) for s in rules.POLICY_CONTENT_SELECTORS])
    long_blocks = F.array_join(F.filter(blocks, lambda b: F.length(b) > 100), "\n\n")
    body = F.col("body")
    read = relations.with_dom(base, *PAGE, "html", text.markup(F.col("html")).alias("body"))
    detail = F.struct(
        text.clean_text(titles).alias("title"),
        F.coalesce(
            text.blank_to_null(long_blocks), text.blank_to_null(text.strip_tags(text.without_regions(body))),
        ).alias("content"),
        text.last_updated(text.strip_tags(body)).alias("last_updated"),
    )
    # As an array of one, not as columns with a filter, which would be moved below them and read every page a second time.
    kept = F.filter(F.array(detail), lambda d: (d["title"] != "") & d["content"].isNotNull())
    filled = read.select(*PAGE, F.inline(kept))
    return filled.withColumn("policy_url", relations.base_url(F.col("url"))).withColumn(
        "policy_type", text.policy_type_from_content(F.col("title"), F.col("content"))
    )


@operator("policy_type")
def with_policy_type(policies: DataFrame) -> DataFrame:
    """Policy records with their class by URL and title."""
    return policies.withColumn("policy_type", text.policy_type(F.col("policy_url"), F.col("title")))
