"""Links sorted into slots by ordered rules: social, important, product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens import rules
from storelens.functions import text, urls
from storelens.operators.ranking import first_wins, last_wins
from storelens.operators.registry import operator

ORDER = ("page_rank", "url", "seq")


@operator("classify_links")
def classify_links(links: DataFrame, link_rules, *, word_boundary: bool = False) -> DataFrame:
    """Links with the ``slot`` of the first rule found in target or text; unmatched links are dropped."""
    slot = text.first_class(link_rules, F.lower("href"), F.lower("text"), word_boundary=word_boundary)
    return links.withColumn("slot", slot).filter(F.col("slot").isNotNull())


def social_slot(href: Column, social_rules=rules.SOCIAL_RULES, *, strict: bool = True) -> Column:
    """Platform of a link.  ``strict`` compares the host, otherwise any substring counts."""
    lowered = F.lower(href)
    host = urls.host_of(F.when(lowered.startswith("//"), F.concat(F.lit("https:"), lowered)).otherwise(lowered))
    case = F.when(F.lit(False), F.lit(None).cast("string"))
    for slot, domains in social_rules:
        hit = text.any_of(urls.on_domain(host, d) if strict else lowered.contains(d) for d in domains)
        case = case.when(hit, F.lit(slot))
    return case


@operator("social_links")
def social_links(links: DataFrame, social_rules=rules.SOCIAL_RULES, *, strict: bool = True) -> DataFrame:
    """Per site and platform the last link, without its query string."""
    found = links.withColumn("slot", social_slot(F.col("href"), social_rules, strict=strict)).filter(
        F.col("slot").isNotNull()
    )
    cleaned = found.withColumn("link_url", urls.clean_social_url(F.col("href")))
    return last_wins(cleaned, ["site", "slot"], "link_url", ORDER)


@operator("important_links")
def important_links(links: DataFrame, link_rules=rules.IMPORTANT_LINK_RULES) -> DataFrame:
    """Per site and slot the first link; a link counts only for its first matching slot."""
    return first_wins(classify_links(links, link_rules), ["site", "slot"], "link_url", ORDER)


def as_map(slots: DataFrame, name: str, value: str = "link_url") -> DataFrame:
    """One map per site from rows unique per (site, slot); slots are few by rule."""
    entries = F.array_sort(F.collect_list(F.struct("slot", value)))
    return slots.groupBy("site").agg(F.map_from_entries(entries).alias(name))
