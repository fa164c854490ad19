"""Total orders without a single task: numbering and running sums over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandql.session import stored


def running(df: DataFrame, order: list[str], value: Column, out: str, ascending: bool = True) -> DataFrame:
    """df with ``out``, the sum of an integer value over all rows before and including each row in a total order.

    Rows are range-partitioned; one sum for each partition is collected (their number is the shuffle width, not
    the data), and each partition adds what lies before it. ``order`` must name a unique key. The dealt rows are a table
    in the shared folder: dealt again, after an executor was lost, they could be cut at other places.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc() if ascending else F.col(c).desc() for c in order]
    dealt = df.withColumn("_v", value.cast("long")).repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id())
    dealt = stored(dealt, "dealt")
    sums = sorted((r["_p"], r["s"] or 0) for r in dealt.groupBy("_p").agg(F.sum("_v").alias("s")).collect())
    before, offsets = 0, []
    for p, s in sums:
        offsets.append((p, before))
        before += s
    table = spark.createDataFrame(offsets or [(0, 0)], "_p int, _o long")
    along = Window.partitionBy("_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(table), "_p").withColumn(out, F.sum("_v").over(along) + F.col("_o")).drop("_p", "_v", "_o")


def numbered(df: DataFrame, order: list[str], out: str, first: int = 1, ascending: bool = True) -> DataFrame:
    """df with consecutive numbers from ``first`` on in a total order."""
    return running(df, order, F.lit(1), "_n", ascending).withColumn(out, F.col("_n") - 1 + first).drop("_n")
