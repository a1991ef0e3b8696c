"""Corpus pipeline: documents to a mixed, clean token stream.

Stages, each over all that the one before kept:
  quality    documents below the learnt quality threshold go
  dedupe     of each group linked by n-gram Jaccard similarity the smallest id stays
  decontam   documents that hold a copy of a benchmark item go
  mix        the rest in the order of the target weights (rows in stream order)
  tokens     token ids, written in that order as packed blocks and read back

The order is a function of the ids and sources alone, so the last stage, which reads
rows in whatever order the store gives them, derives it again from the same operator.
The stages' operators say what they do with nulls, empty texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routewise.llm import decontam_sw, jaccard_join, pfair_mix, pfor_blocks, quality_bt
from routewise.llm.common import stored, table
from routewise.llm.textblocks import SMALL_CHUNK_BYTES
from routewise.llm.queries import REST_WEIGHT, WEIGHTS, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_bt.accepted(docs, quality_bt.train(docs, table(spark, sf_dir, "labels")))


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam_sw.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    col = pfair_mix.free_name(docs)
    return pfair_mix.in_order(pfair_mix.mix(docs, WEIGHTS, REST_WEIGHT, out_col=col), col)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    col = pfair_mix.free_name(docs)
    placed = pfair_mix.mix(docs, WEIGHTS, REST_WEIGHT, out_col=col).selectExpr("doc_id", "text", f"{col}.position as position")
    return pfor_blocks.encode_documents(placed, tokenizer_path(), order_col="position", chunk_bytes=SMALL_CHUNK_BYTES)


STAGES = [("quality", quality), ("dedupe", dedupe), ("decontam", decontam), ("mix", mix), ("tokens", tokens)]

#: Learnt scores, alignments and tokenizers are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
