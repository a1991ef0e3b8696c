"""Queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routewise.llm import decontam_sw, embed_lsh, hard_negatives, jaccard_join, language_id, pfair_mix, pfor_blocks, pii_bootstrap, prefix_trie, quality_bt, secret_entropy, toxicity_crf, warc_merkle
from routewise.llm.common import table

#: Target weights: the largest source is held to a fifth, three get their own, all others share the rest.
WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.10, "src3": 0.05}
REST_WEIGHT = 0.55
TOKENIZER = "word_bpe_49k.json"
#: Pieces of the language models.
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_crf.score(docs, toxicity_crf.train(docs, table(spark, sf_dir, "labels")))


def op2_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_entropy.digest(secret_entropy.scan(table(spark, sf_dir, "documents")))


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.digest(pii_bootstrap.scan(table(spark, sf_dir, "documents")))


def op4_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc_merkle.audit(pages, warc_merkle.aged_copy(pages), "page_id", ["url", "html"]).withColumnRenamed("offset", "page_id")


def op5_quality_bt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_bt.score(docs, quality_bt.train(docs, table(spark, sf_dir, "labels")))


def op6_decontam_sw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam_sw.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pfor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor_blocks.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_embed_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_lsh.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair_mix.mix(docs, WEIGHTS, REST_WEIGHT).select("doc_id", "source", "mix.block", "mix.slot", "mix.position")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=hard_negatives.shifted_label())


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs, tokenizer_path(PIECES)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_toxicity_crf, op2_secret_entropy, op3_pii_bootstrap, op4_warc_merkle, op5_quality_bt, op6_decontam_sw, op7_pfor_blocks, op8_jaccard_join, op9_embed_lsh, op10_pfair_mix,
                                  op11_hard_negatives, op12_language_id, op13_prefix_trie)}
ORACLE_SQL: dict[str, str] = {
    "op2_secret_entropy": secret_entropy.oracle_sql(),
    "op4_warc_merkle": warc_merkle.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
