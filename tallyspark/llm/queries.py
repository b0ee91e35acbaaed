"""Registered queries of the operators, and their SQL where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversations, mixing, ngram_join, quality_gam, sharding, site_lines, surrogates, tag_paths, templates, trie_tokens, warc, whitening, winnowing


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the temperature mix reads them."""
    docs = _docs(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", F.col("_words").alias("n_words"), F.col("_epoch").alias("epoch"),
                                   F.col("_block").alias("block"), F.col("_rank").alias("block_rank"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts."""
    return winnowing.edited_pairs(_docs(spark, sf_dir))


def op3_template_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items that they contain."""
    found = templates.matches(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_windows", "coverage", "exact")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and components of documents linked at 0.75."""
    return ngram_join.linked_components(_docs(spark, sf_dir))


def op5_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of documents."""
    return trie_tokens.token_counts(_docs(spark, sf_dir))


def op6_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of pages."""
    return tag_paths.extract_pages(_pages(spark, sf_dir))


def op7_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that a source's pages share."""
    docs = _docs(spark, sf_dir).select("doc_id", "source", "text")
    return site_lines.drop_site_lines(docs).select("doc_id", "source", "text", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the pages' archives, read back."""
    return warc.archived(_pages(spark, sf_dir)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of documents."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    model = quality_gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gam.with_score(docs, model).select("doc_id", quality_gam.held_out().alias("held_out"), F.col("_score").alias("score"),
                                                      (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return surrogates.pseudonymise(docs).select("doc_id", "text", F.col("_entities").alias("n_entities"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embedding vectors, one row for each component."""
    return whitening.whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.sharded_documents(_docs(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired hash of damaged conversations."""
    return conversations.repaired_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_winnowing, op3_template_matches, op4_ngram_join, op5_trie_tokens,
                            op6_tag_paths, op7_site_lines, op8_warc, op9_quality, op10_surrogates, op11_whitening, op12_feistel_shards,
                            op13_conversation_repair)
}
ORACLE: dict[str, str] = {"op1_mix_sources": mixing.ORACLE, "op7_site_lines": site_lines.ORACLE}
