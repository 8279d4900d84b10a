"""The ``opN_<name>`` queries: one operator each, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _bucket(column: str, n: int) -> Column:
    """crc32 of a number's decimal text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, held_out = table(spark, sf_dir, "documents"), _bucket("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op6_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .flac import digests, to_media

    return digests(to_media(table(spark, sf_dir, "documents")))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    held_out = _bucket("doc_id", 3) == 1
    model = langid.fit(docs.where(~held_out))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import digests, remove_repeats

    return digests(remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_html_text, op2_toxicity, op3_licenses, op4_token_counts, op5_bpe_codec,
        op6_media_flac, op7_ngram_jaccard, op8_decontamination, op9_language_id, op10_suffix_dedup,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can say; models, tokenizers, markup and alignments are tested against brute force instead."""
    from . import oracles

    return {"op7_ngram_jaccard": oracles.NGRAM_JACCARD, "op10_suffix_dedup": oracles.repeated_bytes(400)}
