"""A corpus from raw documents: toxic ones go, near copies go, sources are mixed, texts become token ids.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes each
stage's result to the folder in ``spark.checkpoint.dir`` and reads it again.

Defined cases, as the stages' modules have them: null and empty texts get the score of a text without words, have no
copies and aren't taken into the mix, as they have no words; without labels nothing is toxic; of rows that repeat an id
and a text all stay or go together, and rows that repeat an id with other texts, or have none, are judged by their
own text; ties go to the smallest id; texts of any length are handled whole; columns beyond those of documents pass
the first three stages unchanged, whatever they are called; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, mixing, near_dup, toxicity
from weftgraph.llm.common import materialize, table
from weftgraph.llm.queries import TOKENIZER


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's toxicity threshold."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return near_dup.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.apply_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: number and digest of its token ids, digest of the decoded bytes."""
    return bpe.token_digests(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic_out), ("near_dedup", near_copies_out), ("source_mix", source_mix), ("byte_bpe", token_ids)]

#: A trained classifier and an LSH search can't be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
