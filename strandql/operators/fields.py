"""Conditional random fields over profile windows as relations: no model on the driver, no function in Python.

A field is three tables: weights (state, d, r, w) for the residue r at distance d from the middle of a window, biases (state,
bias), and what each state emits (state, r, pc). A window's score for a state is its bias and the sum of weight times count
over the window: an equi-join on the residue, a shift by the distance, and a sum that is combined before it moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandql.session import few

#: Fixed value: numbers of a field's file are thousandths.
SCALE = 1000.0
#: The weight of what a state excludes (written as a star).
NEVER = -1e6


def read_states(lines: DataFrame, file: str = "file", at: str = "at", text: str = "line") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weights, biases and emissions of a field's text, of lines (file, at: place in it, line). A state is a record from its class
    line to ``//``: NAME, BIAS, LENG, ALPH, the residues' names, a line of weights for each window position, and one of
    pseudocount weights (PC). A file of a model is small, and its lines are numbered within it."""
    from pyspark.sql import Window

    along = Window.partitionBy(file).orderBy(at)
    part = F.split(F.trim(F.col(text)), r"\s+")
    rows = lines.select(file, at, part.alias("p"))
    rows = rows.withColumn("state", F.sum((F.get("p", F.lit(0)) == "CrfState").cast("int")).over(along)).where("state > 0")
    key = F.get("p", F.lit(0))
    # The line of names is the only other one of a record that is as long: it holds no number.
    names = rows.where((F.size("p") >= 20) & ~F.get("p", F.lit(1)).rlike("^[-*0-9]")).groupBy(file).agg(F.min_by(F.filter("p", lambda x: F.length(x) == 1), at).alias("names"))
    number = lambda x: F.when(x == "*", F.lit(NEVER)).otherwise(x.try_cast("double") / SCALE)
    bias = rows.where(key == "BIAS").select(file, "state", F.get("p", F.lit(1)).cast("double").alias("bias"))
    size = rows.where(key == "LENG").select(file, "state", F.get("p", F.lit(1)).cast("int").alias("n"))
    values = rows.where(key.rlike("^[0-9]+$") | (key == "PC")).join(names, file).select(file, "state", key.alias("key"), F.posexplode(F.slice("p", F.lit(2), F.size("names"))).alias("x", "v"), "names")
    values = values.select(file, "state", "key", F.get("names", F.col("x")).alias("r"), F.coalesce(number(F.col("v")), F.lit(0.0)).alias("w"))
    weights = values.where("key <> 'PC'").join(size, [file, "state"]).select(file, "state", (F.col("key").cast("int") - 1 - F.floor(F.col("n") / 2)).cast("int").alias("d"), "r", "w")
    raw = values.where("key = 'PC'").select(file, "state", "r", F.exp("w").alias("e"))
    emits = raw.join(raw.groupBy(file, "state").agg(F.sum("e").alias("all")), [file, "state"]).select(file, "state", "r", (F.col("e") / F.col("all")).alias("pc"))
    return weights, bias, emits


def window_scores(counts: DataFrame, weights: DataFrame, bias: DataFrame) -> DataFrame:
    """(hmm, i, state, z): bias and weighted sum of every column's window for every state. counts: (hmm, i, r, c); windows end where the
    profile does, and a column is any that has a count."""
    columns = counts.groupBy("hmm", "i").agg(F.lit(1).alias("_one"))
    parts = counts.where("c <> 0").join(few(weights), "r").select("hmm", (F.col("i") - F.col("d")).alias("i"), "state", (F.col("w") * F.col("c")).alias("z"))
    # A state's bias is one part more of each column, so that windows without a weight have it too.
    base = columns.withColumn("_k", F.lit(1)).join(few(bias.withColumn("_k", F.lit(1))), "_k").select("hmm", "i", "state", F.col("bias").alias("z"))
    inside = parts.join(columns.select("hmm", "i"), ["hmm", "i"], "left_semi")
    return inside.unionByName(base).groupBy("hmm", "i", "state").agg(F.sum("z").alias("z"))


def state_posteriors(scores: DataFrame) -> DataFrame:
    """(hmm, i, state, p): the softmax of the states' scores of each column."""
    top = scores.groupBy("hmm", "i").agg(F.max("z").alias("most"))
    e = scores.join(top, ["hmm", "i"]).select("hmm", "i", "state", F.exp(F.col("z") - F.col("most")).alias("e"))
    total = e.groupBy("hmm", "i").agg(F.sum("e").alias("all"))
    return e.join(total, ["hmm", "i"]).select("hmm", "i", "state", (F.col("e") / F.col("all")).alias("p"))


def pseudocounts(posteriors: DataFrame, emits: DataFrame) -> DataFrame:
    """(hmm, i, r, pc): what the states emit, by their posteriors."""
    out = posteriors.join(few(emits), "state").groupBy("hmm", "i", "r").agg(F.sum(F.col("p") * F.col("pc")).alias("pc"))
    total = out.groupBy("hmm", "i").agg(F.sum("pc").alias("all"))
    return out.join(total, ["hmm", "i"]).select("hmm", "i", "r", (F.col("pc") / F.col("all")).alias("pc"))


def admixed(p: DataFrame, pc: DataFrame, tau: float) -> DataFrame:
    """Profiles (hmm, i, r, p) mixed with pseudocounts."""
    met = p.join(pc, ["hmm", "i", "r"], "full")
    return met.select("hmm", "i", "r", ((1 - tau) * F.coalesce("p", F.lit(0.0)) + tau * F.coalesce("pc", F.lit(0.0))).alias("p"))
