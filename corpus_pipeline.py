"""The corpus pipeline: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import ngram_join, packing, quality, secret_scan
from ledgerline.llm.queries import tokenizer_path
from ledgerline.llm.storage import settle

#: Packing needs the tokenizer, which SQL cannot express; the tests hold the rows against a plain version.
ORACLE_SQL = None
#: A list of dropped documents of up to so many ids (8 bytes each) is broadcast; a longer one is joined by shuffle.
BROADCAST_IDS = 500_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id (rows that share an id are one document)."""
    groups = ngram_join.join(docs.select("doc_id", "text"))
    dropped = settle(groups.where("doc_id != component_id").select("doc_id").distinct(), "near-copies")
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind in brackets."""
    # The other columns travel in one, so that none of their names can clash.
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    scanned = secret_scan.scan(docs.select("doc_id", "text", rest))
    redacted = secret_scan.redact(scanned.withColumn("changed", F.size("secrets") > 0))
    kept = {c: F.col("text") if c == "text" else F.col("rest")[c] for c in docs.columns}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("changed"), F.char_length("text")).otherwise(kept["n_chars"]).cast(
            docs.schema["n_chars"].dataType)
    return redacted.select(*[column.alias(c) for c, column in kept.items()])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", near_copy_stage), ("secret scans", secret_stage),
          ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = settle(docs, name.replace(" ", "-"))
    return docs
