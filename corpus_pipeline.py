"""A training corpus in five stages, from documents to packed sequences.

Every stage but the last takes and returns the columns of documents; rows may
come in any order. Null and empty texts, very long ones, ties, repeated rows,
empty tables and extra columns of any name are defined at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import mixing, neardup, packing, secrets, toxicity
from logwarden.llm.common import stage


#: Dropped documents up to this number are joined by broadcast (8 bytes each); beyond it the documents are shuffled.
BROADCAST_IDS = 1_000_000


def free_name(docs: DataFrame, name: str) -> str:
    """name, with marks behind it if docs has such a column."""
    while name in docs.columns:
        name += "_"
    return name


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine scores at 0.3 or more go; the threshold itself goes, too.

    A null or empty text, like one of unknown words, has the machine's bias as
    its score, which is low. Texts are scored whole; equal texts share their
    fate. Without labels nothing goes. Ids may repeat or be null.
    """
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, machine)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays, one row of it.

    Documents without words, and rows without an id, all stay. Rows with the
    same doc_id but different texts are in the groups of their texts; of rows
    that tie in id, the one with the least hash of all its columns stays. The
    helper columns' names are not taken from docs.
    """
    row = free_name(docs, "row_")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        out = stage(neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
        return docs.join(F.broadcast(out) if out.count() <= BROADCAST_IDS else out, "doc_id", "left_anti").select(*columns)
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = neardup.near_duplicates(numbered.where("doc_id is not null").select(F.col(row).alias("doc_id"), "text"))
    groups = found.where("n_shingles > 0").select(F.col("doc_id").alias("r"), "component_id")
    order = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*columns).alias("hash"), F.col(row).alias("r"))
    ranked = stage(numbered.select(F.col(row).alias("r"), order.alias("place")).join(groups, "r"), "ranked")
    first = ranked.groupBy("component_id").agg(F.min("place").alias("first"))
    out = stage(ranked.join(first, "component_id").where("place != first").select(F.col("r").alias(row)), "dropped")
    return numbered.join(F.broadcast(out) if out.count() <= BROADCAST_IDS else out, row, "left_anti").select(*columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are replaced by a mark, and n_chars follows. Null texts stay null, and repeated rows are each changed. A secret that several owners have is replaced if a base pattern finds it."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, three times at most. Documents without words are not taken. A null source is a source. Equal rows share their copies; reruns agree."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences. A null or empty text is one token; each of several equal rows is packed. A text longer than a sequence is cut."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("secrets", secret_scan), ("mixing", source_mix), ("packing", pack)]

#: Learning, similarity joins and packing are beyond SQL here; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
