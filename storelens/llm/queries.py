"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from storelens.llm import align, bpe, decontam, html_paths, langid, maxent, minhash, phrases, quality, toxicity, url_filter, vectors, warc
from storelens.llm.common import table

#: Vocabulary files of the tokenizers; the operators take any path.
VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_warc", warc.SQL)
def warc_round_trip(spark, sf):
    return warc.round_trip(table(spark, sf, "pages"))


@query("op2_bpe_trie")
def bpe_trie(spark, sf):
    return bpe.digests(bpe.encode_decode(table(spark, sf, "documents"), vocabulary_path()))


@query("op3_int8_tiles")
def int8_tiles(spark, sf):
    return vectors.near_vectors(table(spark, sf, "embeddings"))


@query("op4_tag_paths")
def tag_paths(spark, sf):
    return html_paths.extract(table(spark, sf, "pages"))


@query("op5_decontaminate", decontam.SQL)
def decontaminate(spark, sf):
    return decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op6_toxicity")
def toxic(spark, sf):
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_minhash_join")
def minhash_join(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query("op8_language")
def language(spark, sf):
    return langid.identify(table(spark, sf, "documents"))


@query("op9_maxent")
def maxent_scores(spark, sf):
    return maxent.language_model(table(spark, sf, "documents"))


@query("op10_url_trees")
def url_trees(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"))


@query("op11_merge_path")
def merge_path(spark, sf):
    aligned = align.align(table(spark, sf, "documents"), vocabulary_path(), vocabulary_path(PIECES))
    return align.counted(align.digests(aligned))


@query("op12_toivonen", phrases.SQL)
def toivonen(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


@query("op13_compression")
def compression(spark, sf):
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
