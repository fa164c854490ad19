"""What a session needs: its Python workers find this package, and tables in the shared folder cut lineage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> SparkSession:
    """Put the folder that holds this package on the workers' module path, where it isn't yet. On a cluster whose machines
    don't share that folder, ship the package with --py-files as well."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, have]))
    return spark


#: Rows of a table over residue pairs, states or parameters that a broadcast may hold.
BROADCAST_ROWS = 100_000


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows at most limit rows; else the join shuffles it."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Used by local sessions that name no checkpoint folder, as in tests.
LOCAL_SHARED = "/tmp/strandql-shared"

#: Folders made so far by each thread, so that jobs of several threads don't clear each other's tables; names only.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def made() -> list[str]:
    found = _MADE.get()
    if found is None:
        _MADE.set(found := [])
    return found


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local session may leave it unset; on a cluster a folder of
    one machine would be of no use to the others, so there it must be named."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = LOCAL_SHARED
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    made().append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return made()[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of stored() tables that nothing reads any more."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            _delete(spark, name.rsplit("/", 1)[0])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete at the end all tables that were stored inside, for work whose result has been written by then; but for those that were
    put into the list: what a result that is still to be read reads."""
    begun, kept = len(made()), []
    try:
        yield kept
    finally:
        stay = {name.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in kept for name in df.inputFiles()[:1]}
        rest = made()[begun:]
        for folder in rest:
            if folder.rsplit("/", 1)[1] not in stay:
                _delete(spark, folder)
        made()[begun:] = [f for f in rest if f.rsplit("/", 1)[1] in stay]
