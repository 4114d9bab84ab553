"""Corpus preparation: quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``.  All but the last return the columns of
``documents``.

Edge cases of all stages: an empty table gives an empty result; other columns are kept by all but the last, whatever
their names, as the stages' own columns are named ``_cardloom_...``; a missing ``n_chars`` is not added.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom import session
from cardloom.llm import circulant_dedup, frames, owned_secrets, robust_quality, slack_packing

#: What replaces a secret in a text.
PLACEHOLDER = "<SECRET>"
#: Decisions are broadcast up to so many bytes; beyond that they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of a row of a decision (keys and overhead) and of a span.
ROW_BYTES, SPAN_BYTES = 64, 16
#: The stages' own columns.
KEY, HASH, GROUP, SPANS = "_cardloom_key", "_cardloom_hash", "_cardloom_group", "_cardloom_spans"
#: Parts that rows sharing id and text are dealt out to.
LOTS = 8


def _shipped(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with the package at hand on the executors."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session.ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def _matched(docs: DataFrame, decisions: DataFrame, by: dict[str, Column], how: str) -> DataFrame:
    """Join decisions to the documents whose expressions ``by`` equal their columns (null equals null).

    A small table of decisions is broadcast, by its bytes.  Of a large one each row has ``LOTS`` copies,
    and documents meet any of them, so that rows with equal expressions do not meet in one task.
    """
    decisions = frames.cut(decisions)
    spans = F.sum(F.size(SPANS)) if SPANS in decisions.columns else F.lit(0)
    told = decisions.agg(F.count(F.lit(1)).alias("n"), F.coalesce(spans, F.lit(0)).alias("spans")).first()
    on = functools.reduce(operator.and_, (own.eqNullSafe(F.col(name)) for name, own in by.items()))
    wanted = [*docs.columns, *([SPANS] if how == "left" else [])]
    if told["n"] * ROW_BYTES + told["spans"] * SPAN_BYTES <= BROADCAST_BYTES:
        return docs.join(F.broadcast(decisions), on, how).select(*wanted)
    copies = decisions.withColumn("_cardloom_copy", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1))))
    dealt = docs.withColumn("_cardloom_lot", (F.monotonically_increasing_id() % LOTS).cast("int"))
    return dealt.join(copies, on & (F.col("_cardloom_lot") == F.col("_cardloom_copy")), how).select(*wanted)


@_shipped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust verdict reject go.

    Null, empty and very short texts fail the base rules and go; a very long text is judged as a whole; equal rows go or stay
    together; rows that share id and text but not language or source are judged apart.
    """
    groups = ["lang", "source"]
    told = robust_quality.judge(docs, by=groups)
    rejected = told.where("not kept").select(F.col("doc_id").alias(KEY), F.col("_hash").alias(HASH), F.xxhash64("_narrow").alias(GROUP)).distinct()
    return _matched(docs, rejected, {KEY: F.col("doc_id"), HASH: F.xxhash64("text"), GROUP: F.xxhash64(robust_quality.group_of(groups))}, "left_anti")


@_shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays.

    Null and empty texts and rows without an id are linked with nothing and stay; rows that share an id are one document and
    stay or go together; very long texts are compared as wholes.
    """
    told = circulant_dedup.near_duplicates(docs, share=75)
    return _matched(docs, told.where("not kept").select(F.col("doc_id").alias(KEY)).distinct(), {KEY: F.col("doc_id")}, "left_anti")


@_shipped
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret, base or added, is replaced by a placeholder; no document goes.

    Overlapping secrets become one placeholder; n_chars is that of the new text; null and empty texts stay as they are; equal rows
    are changed alike.
    """
    found = owned_secrets.find_secrets(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    spans = F.expr("transform(found, x -> named_struct('s', x.s, 'e', x.e))")
    rows = found.where("size(found) > 0").select(F.col("doc_id").alias(KEY), F.col("_hash").alias(HASH), spans.alias(SPANS))
    joined = _matched(docs, rows.groupBy(KEY, HASH).agg(F.first(SPANS).alias(SPANS)), {KEY: F.col("doc_id"), HASH: F.xxhash64("text")}, "left")
    # `at`: up to where the text is copied or replaced; a span that begins before it only moves it on
    kept = f"""aggregate({SPANS}, named_struct('at', 0, 'out', ''), (a, x) -> named_struct(
        'at', greatest(a.at, x.e),
        'out', if(x.s >= a.at, concat(a.out, substring(text, a.at + 1, x.s - a.at), '{PLACEHOLDER}'), a.out)),
        a -> concat(a.out, substring(text, a.at + 1)))"""
    changed = F.col(SPANS).isNotNull()
    out = joined.withColumn("text", F.when(changed, F.expr(kept)).otherwise(F.col("text")))
    out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out
    return out.select(*docs.columns)


@_shipped
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 1024 ids.

    A null or empty text is its end id alone; a null id stays null; equal rows are packed each; a very long text gives many whole
    sequences and one remainder.
    """
    return slack_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL cannot express the robust estimate or the packing; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row over all documents; each result is written to the shared folder and read again.

    A stage's result is removed when the next one is written, the last one when the application ends.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = frames.new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if last:
            frames.remove(spark, last)
        last = folder
    return docs
