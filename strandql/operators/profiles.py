"""Scoring models and pseudocounts over long profiles (hmm, i, r, f), and profile-profile column scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandql.session import few


def substitution_model(joint: DataFrame) -> DataFrame:
    """From joint probabilities (a, b, p): p normalised and symmetric, background of both, conditional r = P(a|b) and
    log-odds s in bits (a, b, p, pa, pb, r, s). 400 rows."""
    both = joint.select("a", "b", "p").union(joint.select(F.col("b").alias("a"), F.col("a").alias("b"), "p")).groupBy("a", "b").agg(F.sum("p").alias("p"))
    total = both.agg(F.sum("p")).first()[0] or 1.0  # one number
    p = both.select("a", "b", (F.col("p") / F.lit(total)).alias("p"))
    own = p.groupBy("a").agg(F.sum("p").alias("pa"))
    out = p.join(own, "a").join(own.select(F.col("a").alias("b"), F.col("pa").alias("pb")), "b")
    return out.select("a", "b", "p", "pa", "pb", (F.col("p") / F.col("pb")).alias("r"), F.log2(F.col("p") / (F.col("pa") * F.col("pb"))).alias("s"))


def counted_joint(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Joint probabilities estimated from alignment columns: the outer product of weighted residue shares, summed over
    columns. Columns are pre-aggregated to at most 20 residues first, so pairs stay at 400 a column."""
    from strandql.operators.msa import column_frequencies, frequency_vectors

    f = column_frequencies(frequency_vectors(rows, weights))
    a, b = f.select("msa", "i", F.col("r").alias("a"), F.col("f").alias("fa")), f.select("msa", "i", F.col("r").alias("b"), F.col("f").alias("fb"))
    return a.join(b, ["msa", "i"]).groupBy("a", "b").agg(F.sum(F.col("fa") * F.col("fb")).alias("p"))


def spread(freqs: DataFrame, model: DataFrame) -> DataFrame:
    """g(i, a) = sum over b of P(a|b) f(i, b) (hmm, i, r, g)."""
    m = few(model.select("a", F.col("b").alias("r"), F.col("r").alias("cond")))
    return freqs.join(m, "r").groupBy("hmm", "i", "a").agg(F.sum(F.col("cond") * F.col("f")).alias("g")).select("hmm", "i", F.col("a").alias("r"), "g")


def admixture(neff: Column, mode: int, a: float, b: float, c: float) -> Column:
    """Share of pseudocounts by a column's Neff. Mode 0: none; 1: constant a; 2: a / (1 + (Neff / b)^c), 1 at most;
    3: for profiles of one diversity, (0.793 + 0.048 (b - 10)) (1 - x + c x (1 - x)) with x = Neff / b, 0 at least."""
    if mode == 0:
        return F.lit(0.0)
    if mode == 1:
        return F.lit(float(a))
    x = neff / b
    if mode == 2:
        return F.least(F.lit(1.0), a / (1.0 + F.pow(x, F.lit(float(c)))))
    return F.greatest(F.lit(0.0), (0.793 + 0.048 * (b - 10.0)) * (1.0 - x + c * x * (1.0 - x)))


def with_pseudocounts(freqs: DataFrame, spread_: DataFrame, neff: DataFrame, mode: int = 2, a: float = 0.9, b: float = 4.0, c: float = 1.0) -> DataFrame:
    """p = (1 - tau) f + tau g with tau by the column's Neff (hmm, i, r, p)."""
    met = spread_.join(freqs, ["hmm", "i", "r"], "left").join(neff, ["hmm", "i"]).withColumn("tau", admixture(F.col("neff"), mode, a, b, c))
    return met.select("hmm", "i", "r", ((1 - F.col("tau")) * F.coalesce("f", F.lit(0.0)) + F.col("tau") * F.col("g")).alias("p"))


def transition_pseudocounts(tr: DataFrame, d: float = 0.15, e: float = 1.0, f: float = 0.6, g: float = 0.6, h: float = 0.6, i: float = 0.6, b: float = 1.0) -> DataFrame:
    """log2 of transition probabilities with pseudocounts, from shares (hmm, i, length, m2m, m2i, m2d, i2m, i2i, d2m, d2d,
    neff_m, neff_i, neff_d); columns 0 to length, 0 being the begin.

    The priors are fixed by gap opening d and extension e, and weigh b columns against Neff - 1 (from a match) or Neff of
    the state. f, g, h and i scale the logs of m2d, m2i, d2d and i2i. Nothing but a match follows the begin and the last
    column's match, and no delete the last one's; such a transition is null.
    """
    open_ = 0.0286 * d
    stay = e / (e - 1 + 1 / 0.75)
    edge = (F.col("i") == 0) | (F.col("i") == F.col("length"))
    last = F.col("i") == F.col("length")
    mixed = lambda c, weight, prior: F.col(weight) * F.coalesce(c, F.lit(0.0)) + b * prior
    from_m = {c: mixed(c, "_m", p) for c, p in (("m2m", 1 - 2 * open_), ("m2d", open_), ("m2i", open_))}
    from_m = {c: v if c == "m2m" else F.when(edge, 0.0).otherwise(v) for c, v in from_m.items()}
    from_i = {"i2m": mixed("i2m", "neff_i", 1 - stay), "i2i": mixed("i2i", "neff_i", stay)}
    from_d = {"d2m": mixed("d2m", "neff_d", 1 - stay), "d2d": F.when(last, 0.0).otherwise(mixed("d2d", "neff_d", stay))}
    scale, out = {"m2d": f, "m2i": g, "i2i": i, "d2d": h}, {}
    for group in (from_m, from_i, from_d):
        total = sum(group.values(), F.lit(0.0))
        out |= {c: F.when(v > 0, F.log2(v / total)) * scale.get(c, 1.0) for c, v in group.items()}
    return tr.withColumn("_m", F.col("neff_m") - 1).withColumns(out).drop("_m")


def local_background(p: DataFrame, prior: DataFrame, reach: int = 40, pseudo: float = 10.0) -> DataFrame:
    """p divided by the square root of its local mean (hmm, i, r, q).

    The mean is over the 2 reach + 1 columns around a column; near an end over the first or last such window that fits, and
    over the whole profile where that is shorter. pseudo columns of the prior (r, prior) count along.
    """
    along, whole, width = Window.partitionBy("hmm", "r").orderBy("i"), Window.partitionBy("hmm", "r"), 2 * reach + 1
    n, at = F.count("*").over(whole), F.row_number().over(along)
    near = p.withColumns({"_n": n, "_at": at, "_mid": F.sum("p").over(along.rowsBetween(-reach, reach))})
    # The windows of the columns reach + 1 from either end; a shorter profile's is the whole.
    ends = near.withColumns({"_left": F.max(F.when(F.col("_at") == reach + 1, F.col("_mid"))).over(whole), "_right": F.max(F.when(F.col("_at") == F.col("_n") - reach, F.col("_mid"))).over(whole), "_all": F.sum("p").over(whole)})
    window = F.when(F.col("_n") <= width, F.col("_all")).when(F.col("_at") <= reach, F.col("_left")).when(F.col("_at") > F.col("_n") - reach, F.col("_right")).otherwise(F.col("_mid"))
    mean = ends.withColumn("_local", window).join(few(prior), "r")
    local = (F.col("_local") + pseudo * F.col("prior")) / (F.least(F.col("_n"), F.lit(width)) + pseudo)
    return mean.select("hmm", "i", "r", (F.col("p") / F.sqrt(local)).alias("q"))


def over_null(p: DataFrame, null: DataFrame | None = None, mode: int = 0, query: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
    """Target probabilities (hmm, i, r, p) divided by a null model (hmm, i, r, q).

    Mode 0: the database's background null (r, n). 1: the mean of the query's (r, pav) and the own target's (hmm, r, pav); 2: the
    target's; 3: the query's. 5: locally corrected profiles, see ``local_background``, as they are. 10: each column scaled
    by 1 / sqrt of its sum of null * p; apply it to queries as well. 11: no null model.
    """
    if mode in (5, 11):
        return p.withColumnRenamed("p", "q")
    if mode == 10:
        met = p.join(few(null), "r").withColumn("_all", F.sum(F.col("n") * F.col("p")).over(Window.partitionBy("hmm", "i")))
        return met.select("hmm", "i", "r", (F.col("p") / F.sqrt("_all")).alias("q"))
    if mode == 1:
        met = p.join(target.withColumnRenamed("pav", "_t"), ["hmm", "r"]).join(few(query.withColumnRenamed("pav", "_q")), "r").withColumn("n", 0.5 * (F.col("_q") + F.col("_t")))
    elif mode == 2:
        met = p.join(target.withColumnRenamed("pav", "n"), ["hmm", "r"])
    else:
        met = p.join(few(null if mode == 0 else query.withColumnRenamed("pav", "n")), "r")
    return met.select("hmm", "i", "r", (F.col("p") / F.col("n")).alias("q"))


def column_scores(q: DataFrame, t: DataFrame, null: DataFrame, shift: float = 0.0) -> DataFrame:
    """log2 of the sum of q t / null over residues, for all columns of queries against all columns of targets
    (hmm, i, target, j, s). An equi-join on the residue and a sum."""
    left = q.select("hmm", "i", "r", F.col("p").alias("pq")).join(few(null), "r").withColumn("pq", F.col("pq") / F.col("n")).drop("n")
    right = t.select(F.col("hmm").alias("target"), F.col("i").alias("j"), "r", F.col("p").alias("pt"))
    return left.join(right, "r").groupBy("hmm", "i", "target", "j").agg((F.log2(F.sum(F.col("pq") * F.col("pt"))) + shift).alias("s"))


def score_table(scores: DataFrame, offset: int = 50, bit_factor: int = 4) -> DataFrame:
    """Column scores as bytes: whole part of s * bit_factor + offset + 0.5 between 0 and 255."""
    return scores.withColumn("byte", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("s") * bit_factor + offset + 0.5))).cast("int")).drop("s")


def normalised(p: DataFrame) -> DataFrame:
    return p.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("hmm", "i")))


def entropy(p: DataFrame) -> DataFrame:
    """Entropy of each column in bits (hmm, i, h)."""
    return p.where("p > 0").groupBy("hmm", "i").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"))


def shifted(p: DataFrame, by: float) -> DataFrame:
    return p.withColumn("p", F.col("p") + by)


def nearest_state(p: DataFrame, library: DataFrame) -> DataFrame:
    """The library state (state, r, lp = log2 p, prior) of largest posterior for each column (hmm, i, state, post)."""
    lib = few(library)
    z = p.join(lib, "r").groupBy("hmm", "i", "state", "prior").agg(F.sum(F.col("p") * F.col("lp")).alias("z")).withColumn("z", F.col("z") + F.log2("prior"))
    top = z.groupBy("hmm", "i").agg(F.max("z").alias("most"), F.max_by("state", F.struct("z", -F.col("state"))).alias("state"))
    sums = z.join(top, ["hmm", "i"]).groupBy("hmm", "i", top["state"]).agg((1.0 / F.sum(F.pow(F.lit(2.0), F.col("z") - F.col("most")))).alias("post"))
    return sums
