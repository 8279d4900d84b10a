"""Training-corpus pipeline over ``documents``: five operators, each on what its predecessor kept.

Toxic documents go; of each group of near duplicates one stays; passages that stand at two places
are removed from the texts; documents that hold benchmark items go; what is left is encoded.
``run`` applies the stages in one session; each takes (spark, docs, sf_dir) and returns a DataFrame,
and all but the last return the columns of ``documents``.

Cases, by stage. Null and empty texts: kept by each (toxicity scores them like a text without any
feature), encoded to no tokens at last. Null ids: kept by each; they are nobody's near duplicate.
Repeated rows: one stays after ngram_jaccard, a row of each text if an id has several. Very long
texts: read whole. Ties: the smallest doc_id of a group stays. Labels of one class or none: toxicity
rejects nothing. Empty tables: every stage returns an empty table. Further columns of any name are
kept to the end of decontamination.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import bpe_codec, decontaminate, jaccard, suffixes, toxicity
from stowage.llm.common import cut, table

#: Bytes of a passage that must not stand twice: what 50 short words take at least.
PASSAGE_BYTES = 200


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels of these documents, doesn't call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are the smallest doc_id of their near-duplicate group.

    Rows with a null id stay. Of rows that repeat an id with one text the first in the order of
    their other columns stays; an id that has several texts keeps a row of each.
    """
    group = cut(jaccard.jaccard_components(docs, n=5, percent=80).where("component_id <> doc_id").select(F.col("doc_id").alias("_later")).distinct())
    kept = docs.join(group, docs["doc_id"] == group["_later"], "left_anti")
    again = cut(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again"))
    if not again.limit(1).count():
        return kept
    once = kept.join(again, kept["doc_id"] == again["_again"], "left_anti")
    several = kept.join(again, kept["doc_id"] == again["_again"], "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return once.unionByName(several.select("_row.*"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand at two places; a character that loses a byte goes whole."""
    kept = suffixes.remove_repeats(docs, PASSAGE_BYTES)
    changed = F.col("n_removed") > 0
    own = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return kept.select(*(own[c].alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns))


def not_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    return bpe_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)


STAGES = [("toxicity", not_toxic), ("ngram_jaccard", one_of_each_group), ("suffix_dedup", without_repeats), ("decontamination", not_benchmark), ("bpe_encoding", encoded)]

#: A classifier, a merge table and an alignment aren't SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
