"""A database of entries in generations: incremental builds by manifest, an atomic switch, and sources in order of precedence.

A folder holds ``data`` (kind, name, payload by generation), a ``manifest`` of each generation (kind, name, hash, generation in which the entry
was last written) and a mark in ``committed`` for each generation that is complete. A build writes only entries that are new or
whose content differs, and the whole manifest, which is narrow; it is seen as soon as its mark is there, and never before. A mark
can be made once only, so of two builds that began from one generation the second fails and nothing is lost. Readers that
opened an older generation keep what they read. All files are written by Spark; the marks are empty files of the same store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY, MANIFEST = "kind string, name string, payload string, generation int", "kind string, name string, hash string, generation int"
#: Which source of an entry is read where it has several.
PRECEDENCE = ("hhm", "ca3m", "a3m")


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def generations(spark: SparkSession, folder: str) -> list[int]:
    """The complete generations, in order: one small file each."""
    path, fs = _store(spark, f"{folder}/committed")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []


def _commit(spark: SparkSession, folder: str, generation: int) -> None:
    path, fs = _store(spark, f"{folder}/committed/{generation}")
    fs.create(path, False).close()  # fails where the mark is there already


def manifest(spark: SparkSession, folder: str, generation: int | None = None) -> DataFrame:
    """(kind, name, hash, generation) of all entries of a generation, by default the last."""
    known = generations(spark, folder)
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/{known[-1] if generation is None else generation}")


def opened(spark: SparkSession, folder: str, generation: int | None = None) -> DataFrame:
    """(kind, name, payload, generation) of a generation's entries. Only generations that the manifest names are read."""
    known = manifest(spark, folder, generation)
    needed = sorted(r["generation"] for r in known.select("generation").distinct().collect())
    if not needed:
        return spark.createDataFrame([], ENTRY)
    data = spark.read.schema("kind string, name string, payload string").parquet(*(f"{folder}/data/generation={n}" for n in needed)).withColumn("generation", F.regexp_extract(F.input_file_name(), r"/generation=([0-9]+)/", 1).cast("int"))
    return data.join(known.select("kind", "name", "generation"), ["kind", "name", "generation"])


def build(spark: SparkSession, folder: str, entries: DataFrame, removed: DataFrame | None = None) -> dict[str, int]:
    """One more generation: entries (kind, name, payload) put in or exchanged where their content differs, and removed (kind, name) left
    out. Of equal names the least content stands. Returns its number and how many entries it wrote and holds."""
    before = manifest(spark, folder)
    number = max(generations(spark, folder), default=0) + 1
    given = entries.select("kind", "name", F.sha2(F.coalesce("payload", F.lit("")).cast("binary"), 256).alias("hash"))
    given = given.groupBy("kind", "name").agg(F.min("hash").alias("hash"))
    if removed is not None:
        given = given.join(removed.select("kind", "name"), ["kind", "name"], "left_anti")
    old = before.select("kind", "name", F.col("hash").alias("_old"), F.col("generation").alias("_gen"))
    both = given.join(old, ["kind", "name"], "full")
    if removed is not None:
        both = both.join(removed.select("kind", "name").distinct(), ["kind", "name"], "left_anti")
    changed = F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("_old"))
    both.select("kind", "name", F.when(changed, F.col("hash")).otherwise(F.col("_old")).alias("hash"), F.when(changed, number).otherwise(F.col("_gen")).alias("generation")).write.mode("overwrite").parquet(f"{folder}/manifest/{number}")
    made = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/{number}")
    fresh = made.where(F.col("generation") == number).select("kind", "name", "hash")
    rows = entries.select("kind", "name", F.coalesce("payload", F.lit("")).alias("payload")).withColumn("hash", F.sha2(F.col("payload").cast("binary"), 256))
    rows.join(fresh, ["kind", "name", "hash"]).select("kind", "name", "payload").dropDuplicates(["kind", "name"]).write.mode("overwrite").parquet(f"{folder}/data/generation={number}")
    out = {"generation": number, "written": fresh.count(), "entries": made.count()}
    _commit(spark, folder, number)
    return out


def by_precedence(entries: DataFrame, order: tuple[str, ...] = PRECEDENCE) -> DataFrame:
    """One entry a name: of the first kind in order that the name has. The choice is made on names alone."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    first = entries.where(rank > 0).groupBy("name").agg(F.min_by("kind", rank).alias("kind"))
    return entries.join(first, ["name", "kind"])


def stale(known: DataFrame, source: str, derived: str) -> DataFrame:
    """Names whose derived entry is missing, or older than their source's: what a build has to compute again."""
    ages = known.where(F.col("kind").isin(source, derived)).groupBy("name").agg(F.max(F.when(F.col("kind") == source, F.col("generation"))).alias("source"), F.max(F.when(F.col("kind") == derived, F.col("generation"))).alias("derived"))
    return ages.where(F.col("source").isNotNull() & (F.col("derived").isNull() | (F.col("derived") < F.col("source")))).select("name")


def searched(spark: SparkSession, folder: str, names: DataFrame, generation: int) -> int:
    """How many different names have been searched so far, those of this step taken in: names that no earlier generation has are
    written, and the total is the sum of the tables' sizes. Exact, and a step costs what it brings; a step done again counts once."""
    path, fs = _store(spark, f"{folder}/searched")
    earlier = sorted(n for s in fs.listStatus(path) if (n := int(s.getPath().getName())) != generation) if fs.exists(path) else []
    new = names.select("name").where("name is not null").distinct()
    if earlier:
        seen = spark.read.schema("name string").parquet(*(f"{folder}/searched/{n}" for n in earlier))
        new = new.join(seen, "name", "left_anti")
    new.write.mode("overwrite").parquet(f"{folder}/searched/{generation}")
    return sum(spark.read.schema("name string").parquet(f"{folder}/searched/{n}").count() for n in [*earlier, generation])
