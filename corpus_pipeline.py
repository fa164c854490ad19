"""The corpus pipeline: five training-data operators in a row over ``documents``.

Each stage reads what its predecessor wrote. All but the last return the columns of documents; a row that a
stage doesn't keep is gone for the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.llm import bpe, decontaminate, minhash, quality_gbt, secrets
from strandql.llm.common import crc_bucket, dropped, new_folder, read_table, swept, text_of
from strandql.llm.queries import tokenizer

#: A document is kept if the classifier gives it this score at least.
KEEP_SCORE = 0.3
SHINGLE_WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees don't reject. Learned from the labels of documents that this stage gets."""
    forest = quality_gbt.train(docs, read_table(spark, sf_dir, "labels"), where=crc_bucket("doc_id", 5) != 0)
    score = quality_gbt.score_udf(spark, forest)
    return docs.withColumn("_score", score("text")).where(F.col("_score") >= KEEP_SCORE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of smallest id. Rows without an id stay. Different texts under one
    id are documents of their own, which come after all others in their groups; rows that are equal in every column are one, and
    rows of equal id and text that differ elsewhere all stay or go together."""
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(_print()).alias("lo"), F.max(_print()).alias("hi")).where("n > 1").select(F.col("doc_id").alias("_again"), (F.col("lo") != F.col("hi")).alias("_differ"))
    repeated = again.limit(1).count() > 0
    if repeated:
        apart = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", _print()), F.lit(1 << 61))
        rows = docs.join(_marked(again), F.col("doc_id") == F.col("_again"), "left").withColumn("_node", F.when(F.col("_differ"), apart).otherwise(F.col("doc_id")))
    else:
        rows = docs.withColumn("_node", F.col("doc_id"))
    found = minhash.near_duplicates(rows, k=SHINGLE_WORDS, id_col="_node")
    gone = found.where(~F.col("kept")).select(F.col("_node").alias("_gone")).distinct()
    kept = rows.join(_marked(gone), F.col("_node") == F.col("_gone"), "left_anti")
    if not repeated:
        return kept.select(*docs.columns)
    one = kept.where("_again is not null").select(*docs.columns).dropDuplicates()
    return kept.where("_again is null").select(*docs.columns).unionByName(one)


def _print() -> Column:
    return F.xxhash64(text_of("text"))


def _marked(ids: DataFrame) -> DataFrame:
    """ids, for broadcast where a count shows at most a million; beyond it the join shuffles."""
    return F.broadcast(ids) if ids.limit(1_000_001).count() <= 1_000_000 else ids


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.hits(docs, read_table(spark, sf_dir, "benchmark")).select(F.col("id").alias("_id"), F.col("fp").alias("_fp")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text_of("text")) == F.col("_fp"))
    return docs.join(_marked(found), on, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the live secrets in their texts replaced by a mark and n_chars counted again. Ownership is counted over
    the corpus as it was read: an example stays one that thousands hold, though near copies of it are gone by now."""
    clean = secrets.redact(docs, corpus=read_table(spark, sf_dir, "documents"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids as little-endian 32-bit integers, and whether they decode to the text."""
    return bpe.encoded(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("secret_scan", secret_scan),
    ("bpe_encoding", encode),
]

#: SQL can express neither boosted trees nor merges by rank; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again. What a stage stored on its
    way, and what its predecessor wrote, is deleted once it has written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        with swept(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
        if before is not None:
            dropped(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
