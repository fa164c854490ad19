"""The flat-file form of a blob store: a data file of payloads, each with an end byte, and an index of
``name<TAB>offset<TAB>length`` lines. Tables are the working form; these are for exchange."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """name, offset, length of an index file."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("name"), parts[1].cast("long").alias("offset"), parts[2].cast("long").alias("length"))


def read_store(spark: SparkSession, data: str, index: str) -> DataFrame:
    """Entries of a store whose data is a file, or a folder of parts that are read one after the other in order of their numbers. Files are cut at
    their end bytes by the reader's own splits, so a large one is read by many tasks; entries and index lines meet by their
    place in the order of offsets."""
    from pyspark.sql import Window

    path = F.col("_metadata.file_path")
    part = F.coalesce(F.regexp_extract(path, r"/part-([0-9]+)[^/]*$", 1).try_cast("int"), F.lit(-1))
    entries = spark.read.option("lineSep", "\x00").text(data).select(F.col("value").alias("payload"), F.struct(part.alias("part"), path.alias("path"), F.col("_metadata.file_block_start").alias("start")).alias("_block"), F.monotonically_increasing_id().alias("_id"))
    sized = entries.withColumn("_size", F.octet_length("payload") + 1)
    blocks = sized.groupBy("_block").agg(F.sum("_size").alias("_sum"))
    # One row a split: their running sum is small.
    before = blocks.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_before"))
    along = Window.partitionBy("_block").orderBy("_id")
    placed = sized.join(F.broadcast(before), "_block").withColumn("offset", F.col("_before") + F.sum("_size").over(along) - F.col("_size"))
    return read_index(spark, index).join(placed.select("offset", "payload"), "offset").select("name", "payload")


def write_store(entries: DataFrame, folder: str) -> None:
    """Store parts below a folder: each partition of the name-sorted entries writes its payloads as text rows with the end
    byte between them, and index lines whose offsets are whole for the concatenated parts."""
    from strandql.operators.ordered import running

    sized = running(entries.select("name", "payload", (F.octet_length("payload") + 1).cast("long").alias("length")), ["name"], F.col("length"), "_end")
    lines = F.concat_ws("\t", "name", (F.col("_end") - F.col("length")).cast("string"), F.col("length").cast("string"))
    ordered = sized.repartitionByRange(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_end").sortWithinPartitions("_end")
    ordered.select("payload").write.option("lineSep", "\x00").text(f"{folder}/data")
    ordered.select(lines.alias("value")).write.text(f"{folder}/index")


def unpack(entries: DataFrame, folder: str) -> int:
    """Each entry as a file of a folder that all machines share, on a cluster below the session's shared one; returns how many.
    Names are written as in addresses (a slash as %2F), so that no two share a file."""
    from strandql.session import shared_dir

    spark = entries.sparkSession
    if not spark.sparkContext.master.startswith("local") and not folder.startswith(shared_dir(spark)):
        raise ValueError("on a cluster entries are unpacked below spark.checkpoint.dir")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        from urllib.parse import quote

        os.makedirs(folder, exist_ok=True)
        for f in frames:
            for name, payload in zip(f["name"], f["payload"]):
                with open(os.path.join(folder, quote(name, safe=" ")), "w") as out:
                    out.write(payload)
            yield pd.DataFrame({"n": [len(f)]})

    return entries.select("name", "payload").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def is_text_state_format(first_entries: DataFrame, payload: str = "payload") -> bool:
    """Whether a column-state store is of the old text format: a record mark in its first entries."""
    return bool(first_entries.limit(5).where(F.col(payload).cast("string").startswith(">")).limit(1).count())
