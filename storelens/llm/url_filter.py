"""URL filter: host and path rules, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import ascii_lower
from storelens.session import stage

#: Rules (host, path, verdict). A rule fits its host and all subdomains if the path starts with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled URLs that the trees are grown on at most, by a hash of the URL.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 10, 4, 32, 0.3
FEATURES = (
    "url_length host_length path_length query_length depth labels digit_share host_digit_share entropy hyphens longest_part parameters "
    "parameter_length has_port has_fragment is_https has_extension suffix_length suffix_vowels host_vowels"
).split()


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) from after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (of its host and path together; of equals the first), else null."""
    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in order]
    case = lambda values: F.coalesce(*[F.when(fit, F.lit(v)) for fit, v in zip(fits, values, strict=True)])
    return case([h + p for h, p, _ in order]), case([v for _, _, v in order])


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character of the distribution of characters."""
    letters = F.split(text, "")
    n = F.greatest(F.size(letters), F.lit(1))
    of = F.transform(F.array_distinct(letters), lambda c: (F.size(letters) - F.size(F.array_remove(letters, c))) / n)
    return F.aggregate(of, F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))


def features(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host, path and the lexical features; null URLs count as empty ones."""
    df = urls.withColumn("_url", F.coalesce(F.col(url_col), F.lit("")))
    df = df.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    df = df.withColumns({
        "_query": F.regexp_extract("_url", r"(?s)^[^?#]*\?([^#]*)", 1), "_name": F.regexp_replace("host", r":\d*$", ""), "_parts": F.split("path", "/"),
    }).withColumn("_suffix", F.substring_index("_name", ".", -1))
    length = lambda c: F.length(c).cast("double")
    share = lambda c, pattern: _count(F.col(c), pattern) / F.greatest(length(c), F.lit(1.0))
    flag = lambda c: c.cast("double")
    return df.withColumns({
        "url_length": length("_url"), "host_length": length("host"), "path_length": length("path"), "query_length": length("_query"),
        "depth": _count(F.col("path"), "/"), "labels": _count(F.col("_name"), r"\."), "digit_share": share("_url", "[0-9]"),
        "host_digit_share": share("host", "[0-9]"), "entropy": _entropy(F.col("_url")), "hyphens": _count(F.col("_url"), "[-_]"),
        "longest_part": F.coalesce(F.array_max(F.transform("_parts", F.length)), F.lit(0)).cast("double"),
        "parameters": F.when(F.col("_query") == "", 0.0).otherwise(_count(F.col("_query"), "&") + 1), "parameter_length": F.coalesce(length(F.regexp_extract("_query", "=([^&]*)", 1)), F.lit(0.0)),
        "has_port": flag(F.col("host").rlike(r":\d+$")), "has_fragment": flag(F.col("_url").contains("#")), "is_https": flag(F.col("_url").startswith("https://")),
        "has_extension": flag(F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$")), "suffix_length": length("_suffix"),
        "suffix_vowels": share("_suffix", "[aeiou]"), "host_vowels": share("_name", "[aeiou]"),
    })


def fit(labelled: DataFrame, label_col: str = "label", sample_rows: int = SAMPLE_ROWS) -> GBTClassificationModel | None:
    """Trees on featurized rows with label 1.0 (block) or 0.0 (allow); None if there aren't both.

    At most ``sample_rows`` distinct URLs are used, those with the smallest hashes, so the passes that
    boosting makes over its rows stay bounded whatever the input.
    """
    chosen = labelled.select(label_col, "_url", *FEATURES).dropDuplicates(["_url", label_col])
    chosen = stage(chosen.orderBy(F.xxhash64("_url"), "_url", label_col).limit(sample_rows), "labelled")
    if chosen.select(label_col).distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(chosen).select("features", label_col).coalesce(4)
    return GBTClassifier(labelCol=label_col, maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=RATE, seed=5, cacheNodeIds=False).fit(rows)


def judge(pages: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict of every page's URL: (page_id, host, path, rule, verdict, score).

    The longest rule that fits decides. URLs that a rule decides are the labelled ones; trees grown on
    their lexical features decide the others, block at a probability (score) of 0.5 or more. Without
    labels of both kinds the others are allowed, or blocked if all labels are block.

    A null URL or one without ``://`` has an empty host and path. Rows that repeat each get a row; a null
    page_id stays null. Other columns are ignored. Only the sample is shuffled.
    """
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    held = features(urls)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    held = held.withColumns({"rule": rule, "decided": verdict})
    labelled = held.filter("decided is not null").withColumn("label", (F.col("decided") == "block").cast("double"))
    model = fit(labelled, "label", sample_rows)
    if model is None:
        blocked = labelled.agg(F.coalesce(F.min("label"), F.lit(0.0))).first()[0]
        scored = held.withColumn("score", F.lit(float(blocked)))
    else:
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(held)
        scored = model.transform(assembled).withColumn("score", vector_to_array("probability")[1])
    other = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", other).alias("verdict"), "score")
