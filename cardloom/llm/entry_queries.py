"""The queries over the driver's tables: each applies one operator to its whole table.

``queries()`` and ``oracle_sql()`` are added to those of ``__spark_entry__``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import circulant_dedup, code_store, consistent_parsing, content_region, frames, jump_sharding, merge_rounds, oracles, owned_secrets, robust_quality, slack_packing, warc_derivatives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 8 shards by their ids."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jump_sharding.shard_documents(docs, shards=8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of 1024 ids."""
    docs = _table(spark, sf_dir, "documents")
    return slack_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; a source owns what its documents hold, in one repository for each language."""
    docs = _table(spark, sf_dir, "documents")
    found = owned_secrets.find_secrets(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_owned", "n_copied", "n_live")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules on all documents."""
    told = robust_quality.judge(_table(spark, sf_dir, "documents"), by=["lang", "source"])
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = _table(spark, sf_dir, "pages")
    return content_region.extract(pages, content_region.learn(pages))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return consistent_parsing.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages, from WARC files."""
    return warc_derivatives.derivatives(_table(spark, sf_dir, "pages"), frames.new_folder(spark, "warc"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return circulant_dedup.near_duplicates(_table(spark, sf_dir, "documents"), share=75)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return merge_rounds.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to token files and read back."""
    folder = frames.new_folder(spark, "tokens")
    code_store.write_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return code_store.read_store(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_packing": op2_packing,
        "op3_secrets": op3_secrets,
        "op4_quality": op4_quality,
        "op5_html": op5_html,
        "op6_fingerprints": op6_fingerprints,
        "op7_warc_derivatives": op7_warc_derivatives,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_token_files": op10_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": oracles.SHARDS, "op3_secrets": oracles.SECRETS, "op8_near_duplicates": oracles.NEAR_DUPLICATES}
