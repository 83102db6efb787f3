"""One query for each operator, over its whole table, with production parameters; SQL for DuckDB where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crf, decontaminate, divergence, huffman, license_scan, ngram_trie, sharding, superminhash, url_rules
from .common import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def tokenizer(name: str) -> str:
    """A file of the public vocabularies; BRINDLE_TOKENIZERS names another folder for them."""
    if folder := os.environ.get("BRINDLE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer("word_bpe_49k.json"), ids=None, digests=True).drop("text")


def huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = Scratch(spark, "huffman").uri
    huffman.write(table(spark, sf_dir, "documents"), uri, tokenizer("byte_bpe_50k.json"), end=2)
    return huffman.read(spark, uri)


def crf_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.detect(table(spark, sf_dir, "documents"))


def trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score(table(spark, sf_dir, "documents"))


def template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = superminhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.measure(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_license_digests": license_digests,
    "op2_trie_scores": trie_scores,
    "op3_template_windows": template_windows,
    "op4_histogram_sort": histogram_sort,
    "op5_transducer_bpe": transducer_bpe,
    "op6_association_rules": association_rules,
    "op7_super_minhash": super_minhash,
    "op8_huffman_files": huffman_files,
    "op9_crf_spans": crf_spans,
    "op10_distribution_divergence": distribution_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_digests": license_scan.oracle_sql(),
    "op6_association_rules": url_rules.oracle_sql(),
    "op7_super_minhash": superminhash.oracle_sql(2),
}
