"""Corpus pipeline over `documents`: quality rules, exact duplicates, near duplicates, source mix,
packing. Each stage works on all that the one before kept; `run` writes each stage's rows as
Parquet to the shared folder and reads them back as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm.common import lookup
from corpusweave.llm.exact_dedup import exact_duplicates
from corpusweave.llm.jaccard import similar_documents
from corpusweave.llm.mixing import mix_sources
from corpusweave.llm.packing import pack_documents
from corpusweave.llm.quality import keep_good, train_quality
from corpusweave.session import land, spread


PACK_CACHE_BYTES = 64 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the verdict learnt from `labels`."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(spread(docs), train_quality(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts. Rows that share an id (or have none) are told apart
    by their text's checksum."""
    found = land(exact_duplicates(spread(docs)).select("doc_id", "kept", "text_sha256"), "pipeline-exact")
    gone = land(found.filter("not kept").select("doc_id").distinct(), "pipeline-gone")
    shared = land(found.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id"), "pipeline-shared")
    if shared.isEmpty():
        return lookup(docs, gone, ["doc_id"], "left_anti")
    rest = lookup(lookup(docs, shared, ["doc_id"], "left_anti"), gone, ["doc_id"], "left_anti")
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marked = lookup(docs, shared, ["doc_id"], "left_semi").withColumn("__text", F.sha2(text, 256))
    kept = land(found.filter("kept").select("doc_id", F.col("text_sha256").alias("__text")), "pipeline-kept")
    own = lookup(marked, kept, ["doc_id", "__text"], "left_semi").dropDuplicates(["doc_id", "__text"]).drop("__text")
    return rest.unionByName(own)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each component of similar texts; rows without an id stay."""
    found = similar_documents(spread(docs))
    gone = land(found.filter("doc_id <> component_id").select("doc_id").distinct(), "pipeline-near")
    return lookup(docs, gone, ["doc_id"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, at most twice. Rows are chosen by id; equal ids
    within a stage's input have equal text after the stages before, or stay as often as one does."""
    found = land(mix_sources(spread(docs)).groupBy("doc_id").agg(F.max("copies").alias("__copies")).filter("__copies <> 1"), "pipeline-mix")
    copies = F.coalesce(F.col("__copies"), F.lit(1))
    taken = lookup(docs, found, ["doc_id"]).filter(copies > 0)
    return taken.withColumn("__turn", F.explode(F.sequence(F.lit(1), copies))).drop("__turn", "__copies")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences. Workers of the stages before are used again, so
    they remember fewer pieces of text than when packing runs alone."""
    return pack_documents(spread(docs), cache_bytes=PACK_CACHE_BYTES)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard", near),
    ("source_mix", mix),
    ("best_fit_packing", pack),
]

#: A learnt verdict has no SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
