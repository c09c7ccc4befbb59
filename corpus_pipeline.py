"""From raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; what it returns is written as Parquet and
read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_net
from framelake.llm.common import free_names, table
from framelake.llm.queries import quality_model, tokenizer_path
from framelake.session import stage

#: Near duplicates here: five-word shingles, a similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80
KEEP_AT = 0.5  #: quality scores below it are rejected
BROADCAST_IDS = 2_000_000  #: up to so many ids (16 MB) of superfluous documents are broadcast, beyond they are joined


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject; it learns from this stage's documents and ``labels``."""
    return quality_net.keep_good(docs, quality_model(docs, table(spark, sf_dir, "labels")), KEEP_AT)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that five or more of them have, but for one; ``n_chars`` follows the text."""
    done = line_dedup.drop_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id (null comes last), and all without words.

    Rows are told apart by a 64-bit hash of id and text, whatever ids repeat; of rows equal in both one stays.
    """
    key, = free_names(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    linked = jaccard_join.link(keyed.select(row.alias("doc_id"), "text"), words=NEAR_WORDS, percent=NEAR_PERCENT)
    decided = stage(linked.filter("n_links > 0").groupBy(F.col("doc_id.key").alias(key)).agg(
        F.max(F.expr("doc_id.key <> component_id.key")).alias("extra"), F.count("*").alias("rows"),
    ).filter("extra OR rows > 1"), "extra")
    taken = decided.select(key)
    taken = F.broadcast(taken) if decided.count() <= BROADCAST_IDS else taken
    kept = keyed.join(taken, key, "left_anti")
    repeated = decided.filter("NOT extra").select(key)
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(repeated, key, "left_semi").dropDuplicates([key]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text they decode to."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", clean_of_benchmarks), ("BPE encoding and decoding", tokens)]

#: No SQL says what a trained network keeps or how a BPE vocabulary merges; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
