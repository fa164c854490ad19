"""Alignment matrices of hits as binary rows: probabilities in 8 bits, in runs of neighbouring columns.

A run is a hit's cells of one query column whose target columns follow each other; runs are islands of (column less rank), so they
come from a window over one query column of one hit. A matrix is the text of its runs in order of column, each run as first query
column, first target column (both 16 bits, little-endian), its bytes, and a zero; an empty matrix is the end mark alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hits of less probability aren't written, nor longer ones.
LEAST_PROBABILITY, LONGEST = 20.0, 4000
KEY = ("query", "target", "irep")


def to_byte(p: Column) -> Column:
    """A probability as a number from 0 to 255: sixteenth powers of two, 0 for what is below them all."""
    return F.when(p < 2.0**-15.9, 0).otherwise(F.least(F.lit(255), F.greatest(F.lit(1), F.floor(255.5 + 16 * F.log2(p))))).cast("int")


def _hex16(n: Column) -> Column:
    """Two bytes, the lower one first, as hexadecimal digits."""
    both = F.lpad(F.hex(n.cast("long")), 4, "0")
    return F.concat(F.substring(both, 3, 2), F.substring(both, 1, 2))


def runs(cells: DataFrame, kind: str = "kind") -> DataFrame:
    """(query, target, irep, kind, i, j, n, bytes) of cells (query, target, irep, kind, i, j, p): runs, their first cell and their bytes in hexadecimal."""
    along = Window.partitionBy(*KEY, kind, "i").orderBy("j")
    placed = cells.withColumn("_island", F.col("j") - F.row_number().over(along))
    one = placed.groupBy(*KEY, kind, "i", "_island").agg(F.min("j").alias("j"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("j", to_byte(F.col("p")).alias("b")))).alias("_c"))
    return one.select(*KEY, kind, "i", "j", "n", F.array_join(F.transform("_c", lambda c: F.lpad(F.hex(c["b"].cast("long")), 2, "0")), "").alias("bytes"))


def matrices(runs_: DataFrame, kind: str = "kind") -> DataFrame:
    """(query, target, irep, kind, matrix) of runs: one matrix of a hit, which its cells bound."""
    text = F.concat(_hex16(F.col("i")), _hex16(F.col("j")), F.col("bytes"), F.lit("00"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "j", text.alias("t"))))
    return runs_.groupBy(*KEY, kind).agg(F.unhex(F.concat(F.array_join(F.transform(ordered, lambda r: r["t"]), ""), F.lit("0000"))).alias("matrix"))


def cells_of(written: DataFrame, kind: str = "kind") -> DataFrame:
    """The cells of runs, with the probabilities that their bytes stand for: the way back."""
    byte = F.conv(F.substring("bytes", 2 * F.col("x") + 1, F.lit(2)), 16, 10).cast("int")
    at = written.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    return at.select(*KEY, kind, "i", (F.col("j") + F.col("x")).alias("j"), F.when(byte == 0, 0.0).otherwise(F.pow(F.lit(2.0), (byte - 255) / 16)).alias("p"))


def printable(hits: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Hits whose matrices are written: probable and short enough, with sums of both profiles near one; of repeated names (a hit
    that was aligned again) the last stands. hits: query, target, irep, number, probab, t_len, forward, backward (sums)."""
    good = hits.where((F.col("probab") >= LEAST_PROBABILITY) & (F.col("t_len") < LONGEST))
    for side in ("forward", "backward"):
        good = good.where((F.col(side) > 1 - tolerance) & (F.col(side) < 1 + tolerance))
    rest = [c for c in good.columns if c not in KEY]
    return good.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "number").alias("_h")).select(*KEY, "_h.*")


def written(hits: DataFrame, found: DataFrame, kinds: tuple[str, ...] = ("backward", "forward", "posterior")) -> DataFrame:
    """(query, target, irep, entry): a hit's name, length, probability, similarity in tenths and matrices in order, as bytes. hits: also
    name, similarity; found: ``matrices``. A kind that a hit lacks is an empty matrix."""
    one = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.hex("matrix"))), F.lit("0000"))
    body = found.groupBy(*KEY).agg(F.concat(*(one(k) for k in kinds)).alias("_body"))
    met = hits.join(body, list(KEY), "left")
    signed = F.pmod(F.floor(F.col("similarity") * 10).cast("long"), F.lit(1 << 16))
    head = F.concat(F.hex(F.encode("name", "UTF-8")), F.lit("00"), _hex16(F.col("t_len")), F.lpad(F.hex(F.floor("probab").cast("long")), 2, "0"), _hex16(signed))
    return met.select(*KEY, F.unhex(F.concat(head, F.coalesce("_body", F.lit("0000" * len(kinds))))).alias("entry"))
