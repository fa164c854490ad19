"""The fixed tables as the engine's inputs: stores, alignments, hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.operators import msa, store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its scan has fewer tasks than there are, as a small file in one piece does; a scan of
    many tasks stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.store(table(spark, sf_dir, "documents"), F.col("doc_id"), F.coalesce("text", F.lit("")))


def alignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as members (msa, k, row) of the alignment of their language and source."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return msa.text_rows(docs, F.concat_ws("/", F.col("lang"), F.col("source")), F.col("doc_id"), F.col("text"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.long_form(alignment_rows(spark, sf_dir), "msa", "k", "row")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as hits: query is the supplier, target the part, score and lengths from the numbers of a line."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file"),
        (F.col("l_quantity") * 2 + F.col("l_extendedprice") % 37).alias("score"), (F.col("l_discount") * 20).alias("score_ss"),
        (F.col("l_partkey") % 400 + 20).cast("int").alias("t_len"), (1 + F.col("l_tax") * 100).alias("t_neff"), (F.col("l_suppkey") % 300 + 30).cast("int").alias("q_len"), (1 + F.col("l_suppkey") % 7).cast("double").alias("q_neff"),
    )


#: SQL of what the functions above give, for use in a WITH clause.
ROWS_SQL = """rows_ as (select concat_ws('/', lang, source) as msa, doc_id as k,
  regexp_replace(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '-', 'g') as "row" from documents)"""
CELLS_SQL = ROWS_SQL + """, cells as (select msa, k, unnest(generate_series(1, len("row"))) as i, unnest(string_split("row", '')) as r from rows_ where "row" <> '')"""
HITS_SQL = """hits as (select l_suppkey as query, l_partkey as target, l_orderkey * 10 + l_linenumber as file,
  l_quantity * 2 + fmod(l_extendedprice, 37) as score, l_discount * 20 as score_ss, cast(l_partkey % 400 + 20 as integer) as t_len,
  1 + l_tax * 100 as t_neff, cast(l_suppkey % 300 + 30 as integer) as q_len, cast(1 + l_suppkey % 7 as double) as q_neff from lineitem)"""
