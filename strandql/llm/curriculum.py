"""Mixing sources to target weights by a time-varying curriculum.

Every source has a schedule: its weight over training time 0 to 1, linear between knots. The integral is the source's
overall weight; sources share ``total`` words by these, but none gets more than ``repeats`` times its own words, and what is
cut off is shared again by weight until none is above (its *target*). A source's demand at time t is its target times the
integral of its schedule up to t, relative to the whole one. Its documents stand in a fixed order (md5 of seed and id) and
are gone through again and again until the target is met, the last one in part; a document whose words begin at word x
of that stream gets as training position the time at which the demand reaches x: the inverse of a piecewise quadratic.
``ordered`` range-sorts what was drawn by position.

Only (id, source, size, order) of the documents move. Running sums are those of (source, leading digits of the order), of which
there are at most 65,536 for a source, and windows within such a cell; so a source of any size is dealt out.

Null and empty texts have size 0 and are never drawn; a null source is a source of its own, after all others; null ids
are in order as the empty text; repeated rows are documents of their own; an empty table gives an empty table.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandql.llm.common import numbered, stored, text_of
from strandql.session import few

WORD = r"[^\x20\x09-\x0D]+"
#: Overall weights and shapes of the sources' schedules, repeating over the sources by code point: knots (time, share of weight).
WEIGHTS = (1.0, 2.0, 3.0)
SHAPES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (0.5, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
REPEATS = 3
#: Documents of a cell that the number of leading digits aims at, and most digits.
CELL_ROWS, MOST_DIGITS = 256, 4

Knots = Sequence[tuple[float, float]]


def _knots(points: Knots, weight: float = 1.0) -> Column:
    return F.array(*(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w) * weight).alias("w")) for t, w in points))


def _repeating(number: Column, values: Sequence[Column]) -> Column:
    return F.element_at(F.array(*values), (F.pmod(number - 1, F.lit(len(values))) + 1).cast("int"))


def integrals(knots: Column) -> Column:
    """Running integrals of a schedule at its knots, from 0 on."""
    area = F.zip_with(F.slice(knots, F.lit(1), F.size(knots) - 1), F.slice(knots, F.lit(2), F.size(knots) - 1), lambda a, b: (a["w"] + b["w"]) / 2 * (b["t"] - a["t"]))
    sums = F.aggregate(area, F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    return sums


def inverted(y: Column, knots: Column, sums: Column) -> Column:
    """The time at which a schedule's running integral reaches y."""
    k = F.least(F.size(F.filter(sums, lambda c: c <= y)), F.size(knots) - 1)
    a, b, rest = F.element_at(knots, k), F.element_at(knots, k + 1), y - F.element_at(sums, k)
    slope = (b["w"] - a["w"]) / (b["t"] - a["t"])
    root = a["w"] + F.sqrt(F.greatest(F.lit(0.0), a["w"] * a["w"] + 2 * slope * rest))
    return F.when(rest <= 0, a["t"]).otherwise(F.least(b["t"], a["t"] + 2 * rest / root))


def scheduled(sources: DataFrame, schedules: Mapping[str | None, Knots] | None) -> DataFrame:
    """sources (source, ...) with knots: of the mapping (a source that it doesn't name has weight 0), or by code point."""
    if schedules is None:
        ranked = numbered(sources, [F.col("source").asc_nulls_last()], "_n")
        # A shape's weights are multiplied where they stand, so that the integral is the weight exactly.
        return ranked.withColumn("knots", _repeating(F.col("_n"), [_knots(s, w) for s, w in zip(SHAPES, WEIGHTS, strict=True)])).drop("_n")
    given = sources.sparkSession.createDataFrame([(k, [(float(t), float(w)) for t, w in v]) for k, v in schedules.items()], "named string, knots array<struct<t:double,w:double>>")
    met = sources.join(few(given), F.col("source").eqNullSafe(F.col("named")), "left").drop("named")
    return met.withColumn("knots", F.coalesce("knots", _knots([(0.0, 0.0), (1.0, 0.0)])))


def targets(sources: DataFrame, repeats: int = REPEATS, total: int | None = None) -> DataFrame:
    """sources (source, source_size, knots, ...) with sums (running integrals), weight and target (words, real). Each round is a
    sum over the table of sources: those above their bound stop there, and the excess is shared again."""
    sources = stored(sources.withColumn("sums", integrals(F.col("knots"))).withColumn("weight", F.element_at("sums", -1)).withColumn("bound", repeats * F.col("source_size")), "sources")
    first = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    want = first["size"] or 0 if total is None else total
    rate, stopped = want / first["weight"] if first["weight"] else 0.0, -1
    while first["weight"]:
        over = F.col("weight") * rate > F.col("bound")
        s = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("bound"))).alias("bound"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if s["n"] == stopped or not s["weight"]:
            break
        stopped, rate = s["n"], float(want - (s["bound"] or 0)) / s["weight"]
    return sources.withColumn("target", F.least(F.col("bound").cast("double"), F.col("weight") * rate)).drop("bound")


def mix(df: DataFrame, schedules: Mapping[str | None, Knots] | None = None, repeats: int = REPEATS, total: int | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target, taken (words that the mix takes) and draws, an array of (position, epoch, words),
    one row per row of df. total: words to share out; by default as many as there are."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"), order.alias("order"))
    # Sources that are null need a key too; no other begins with this.
    docs = stored(docs.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "sizes")
    known = targets(scheduled(docs.groupBy("key", "source").agg(F.sum("size").alias("source_size")), schedules), repeats, total)

    rows, digits = docs.count(), 0
    while digits < MOST_DIGITS and rows > CELL_ROWS * 16**digits:
        digits += 1
    cell = F.substring("order", 1, digits).alias("cell")
    cells = docs.groupBy("key", cell).agg(F.sum("size").alias("cell_size"))
    cells = cells.withColumn("offset", F.sum("cell_size").over(Window.partitionBy("key").orderBy("cell")) - F.col("cell_size")).drop("cell_size")
    # The documents meet the table of cells, not that of sources: no key of the join holds a large source.
    cells = cells.join(few(known.drop("source")), "key")
    along = Window.partitionBy("key", "cell").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.withColumn("cell", cell).join(cells, ["key", "cell"]).withColumn("before", F.sum("size").over(along) - F.col("size") + F.col("offset"))

    wanted, size, whole = F.floor("target"), F.col("size"), F.col("source_size")
    begun = F.when((size > 0) & (wanted > F.col("before")), F.floor((wanted - F.col("before") - 1) / whole).cast("int") + 1).otherwise(0)
    at = lambda e: e.cast("long") * whole + F.col("before")
    draw = lambda e: F.struct(
        inverted(at(e) / F.col("target") * F.col("weight"), F.col("knots"), F.col("sums")).alias("position"), e.alias("epoch"), F.least(size, wanted - at(e)).alias("words")
    )
    draws = F.when(F.col("begun") > 0, F.transform(F.sequence(F.lit(0), F.col("begun") - 1), draw)).otherwise(F.array().cast("array<struct<position:double,epoch:int,words:bigint>>"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    out = placed.withColumn("begun", begun).withColumn("draws", draws)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), "draws")


def ordered(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The draws of a mix, one row each, range-sorted by training position: id, position, epoch, words (its first ones that count)."""
    return mixed.select(id_col, F.inline("draws")).orderBy("position", F.col(id_col).asc_nulls_last(), "epoch")
