"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.session import dropped, new_folder, reachable, stored, swept

__all__ = ["ascii_lower", "bounded_batches", "crc_bucket", "dropped", "new_folder", "numbered", "read_table", "stored", "swept", "text_of", "words_of"]

#: Bytes of an Arrow batch, and the bound that Spark has by itself.
ARROW_BYTES, SPARK_ARROW_BYTES = "8m", "67108864b"

#: Words are runs of anything but these ASCII white-space characters.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_BYTES, where the session keeps Spark's own bound: whole texts are wide rows, and a
    task holds a batch several times (in the engine, in Arrow, as Python strings). Workers are led to this package too."""
    reachable(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == SPARK_ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text, by the ASCII white space alone."""
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_bucket(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with consecutive numbers from 1 on in a total order, which rows that are equal in it share out among themselves.

    Rows are range-partitioned and sorted once, as a stored table whose row ids tell the partition and the place in it; one
    count for each partition comes to the driver. No second shuffle, and no task holds more than its range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt, "numbered").withColumn("_part", F.shiftright("_at", 33))
    before, offsets = 0, []
    for part, count in sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        offsets.append((part, before))
        before += count
    table = spark.createDataFrame(offsets or [(0, 0)], "_part long, _before long")
    return dealt.join(F.broadcast(table), "_part").withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before", "_at")
