"""Keyed blob stores as tables: ``name`` and ``payload``, and the algebra over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandql.operators.ordered import numbered, running


def store(df: DataFrame, name: Column, payload: Column) -> DataFrame:
    return df.select(name.cast("string").alias("name"), payload.alias("payload"))


def lookup(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Entries of the given names; unknown names are skipped."""
    return entries.join(names.select("name").distinct(), "name", "left_semi")


def at_ordinal(entries: DataFrame, ordinals: DataFrame) -> DataFrame:
    """Entries by their place in name order; ``ordinal`` counts from 1. Names alone are put in order; payloads meet what is wanted."""
    wanted = numbered(entries.select("name"), ["name"], "ordinal").join(ordinals.select("ordinal").distinct(), "ordinal", "left_semi")
    return entries.join(wanted, "name")


def unlink(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Entries without the given names. Every entry is examined, the last one too."""
    return entries.join(names.select("name").distinct(), "name", "left_anti")


def merge(*stores: DataFrame) -> DataFrame:
    """All entries of several stores; equal names stay beside each other."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    return out


def sort_by_name(entries: DataFrame) -> DataFrame:
    return entries.orderBy("name")


def reorder(entries: DataFrame, order: DataFrame) -> DataFrame:
    """Entries with their place in a list of (name, pos); names that either side lacks are skipped."""
    return entries.join(order.select("name", "pos"), "name")


def index(entries: DataFrame) -> DataFrame:
    """name, offset and length as a flat data file in name order would hold them: each payload and one end byte."""
    sized = entries.select("name", (F.octet_length("payload") + 1).cast("long").alias("length"))
    return running(sized, ["name"], F.col("length"), "_end").select("name", (F.col("_end") - F.col("length")).alias("offset"), "length")


def split_records(entries: DataFrame, id_text: str, delimiter: str, field: int, start: Column, rest: Column) -> tuple[DataFrame, DataFrame]:
    """Header and sequence stores of records, keyed by the field-th part of a delimited id."""
    key = F.split_part(F.col(id_text), F.lit(delimiter), F.lit(field))
    return store(entries, key, start), store(entries, key, rest)


def duplicates(entries: DataFrame) -> DataFrame:
    """Names that occur more than once, and how often."""
    return entries.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def missing(entries: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected names without an entry."""
    return expected.select("name").distinct().join(entries.select("name"), "name", "left_anti")


def overhead(entries: DataFrame, expected: DataFrame) -> DataFrame:
    """Names of entries that nobody expects."""
    return entries.select("name").distinct().join(expected.select("name"), "name", "left_anti")


def unsorted_runs(entries: DataFrame, group: str, position: str) -> DataFrame:
    """Entries that stand before a smaller name in the physical order of their file ``group``."""
    along = Window.partitionBy(group).orderBy(position)
    return entries.withColumn("next_name", F.lead("name").over(along)).where("next_name < name")


def repaired(entries: DataFrame, corrupt: Column, recompute: DataFrame) -> DataFrame:
    """Entries that are not corrupt, and recomputed ones for names that are missing then."""
    good = entries.where(~corrupt)
    return good.unionByName(recompute.select(*entries.columns).join(good.select("name").distinct(), "name", "left_anti"))


def filter_members(members: DataFrame, names: DataFrame, always: Column) -> DataFrame:
    """Members (cluster, name, ...) that are listed or always kept; clusters without a listed member go."""
    listed = names.select("name").distinct().withColumn("_in", F.lit(1))
    marked = members.join(listed, "name", "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    live = marked.where("_in = 1").select("cluster").distinct()
    return marked.where((F.col("_in") == 1) | always).join(live, "cluster", "left_semi").drop("_in")


def large(entries: DataFrame, cluster: str, more_than: int = 50) -> DataFrame:
    """Clusters of more than so many members; if none is that large, the largest one (of least name)."""
    sizes = entries.groupBy(cluster).agg(F.count("*").alias("n"))
    top = sizes.agg(F.max_by(cluster, F.struct("n")).alias("_"), F.max("n").alias("most"))
    best = sizes.join(F.broadcast(top.select("most")), sizes["n"] == F.col("most")).groupBy("n").agg(F.min(cluster).alias(cluster)).select(cluster, "n")
    kept = sizes.where(F.col("n") > more_than)
    return kept.unionByName(best.where(F.col("n") <= more_than))
