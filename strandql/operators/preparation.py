"""From alignments to what a search compares, and the search itself: profiles with pseudocounts, state sequences for the prefilter, hits,
and the queries' alignments with their hits' members merged in.

An alignment is A3M rows (msa, k, name, row), the first of which is its query. A profile is one row (name, p: array of columns of
20 probabilities, states: a byte a column, neff), bounded by its length. Every step is a plan over all alignments at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandql.functions.residues import LETTERS
from strandql.operators import dp, hits, maps, msa, profiles, tiles
from strandql.params import ITERATIVE, Params
from strandql.session import few, stored


def match_rows(rows: DataFrame, least: int = 6) -> DataFrame:
    """A3M rows as match columns alone (msa, k, row). An alignment of one member with fewer than ``least`` match columns takes all its residues
    as such: nothing says then that its lower case means anything."""
    own = rows.select("msa", "k", "row", F.length(F.regexp_replace("row", "[^A-Z-]", "")).alias("_n"))
    first = own.groupBy("msa").agg(F.min_by("_n", "k").alias("_first"), F.count("*").alias("_members"))
    met = own.join(few(first), "msa")
    bare = (F.col("_members") == 1) & (F.col("_first") < least)
    return met.select("msa", "k", F.when(bare, F.regexp_replace(maps.upper_ascii(F.col("row")), "[.-]", "")).otherwise(F.regexp_replace("row", "[a-z.]", "")).alias("row"))


def joint_of_scores(scores: DataFrame, background: DataFrame, bits: float = 0.5) -> DataFrame:
    """Joint probabilities (a, b, p) of a published matrix of scores (a, b, s: units of ``bits`` bits) over a background (r, f):
    the product of both shares by two to the score, normalised. Pairs of other letters are left out."""
    b = few(background)
    met = scores.join(b.select(F.col("r").alias("a"), F.col("f").alias("fa")), "a").join(b.select(F.col("r").alias("b"), F.col("f").alias("fb")), "b")
    raw = met.select("a", "b", (F.col("fa") * F.col("fb") * F.pow(F.lit(2.0), F.col("s") * bits)).alias("p"))
    total = raw.agg(F.sum("p")).first()[0] or 1.0  # of 400 rows
    return raw.select("a", "b", (F.col("p") / F.lit(total)).alias("p"))


def read_scores(lines: DataFrame, text: str = "value") -> DataFrame:
    """A matrix text (a head of letters, then a letter and its scores a line; # comments) as scores (a, b, s)."""
    part = lines.where(~F.col(text).startswith("#") & (F.trim(text) != "")).select(F.col(text).rlike(r"^\s").alias("head"), F.split(F.trim(F.col(text)), r"\s+").alias("p"))
    names = few(part.where("head").select(F.col("p").alias("names")).limit(1))
    rows = part.where("not head").withColumn("_k", F.lit(1)).join(names.withColumn("_k", F.lit(1)), "_k")  # one head
    cells = rows.select(F.get("p", F.lit(0)).alias("a"), F.posexplode(F.slice("p", F.lit(2), F.size("names"))).alias("x", "s"), "names")
    return cells.select("a", F.get("names", F.col("x")).alias("b"), F.col("s").try_cast("double").alias("s")).where("s is not null")


def matrix_of(model: DataFrame, value: str) -> np.ndarray:
    """A model's values as a matrix in the order of LETTERS: 400 rows."""
    out = np.zeros((20, 20))
    for r in model.select("a", "b", value).collect():
        if r["a"] in LETTERS and r["b"] in LETTERS:
            out[LETTERS.index(r["a"]), LETTERS.index(r["b"])] = r[value]
    return out


def background_of(model: DataFrame) -> np.ndarray:
    return matrix_of(model, "p").sum(1)


def _vector(values) -> Column:
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def column_profiles(rows: DataFrame, model: DataFrame, params: Params = ITERATIVE) -> DataFrame:
    """(msa, i, f, neff, p) of alignments of match columns: weighted frequencies, effective number, and frequencies with pseudocounts
    by the model's conditional probabilities."""
    w = msa.global_weights(rows)
    v = msa.frequency_vectors(rows, w).withColumn("neff", F.pow(F.lit(2.0), F.aggregate("f", F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(0.0))))
    cond = matrix_of(model, "r")  # P(a|b)
    dot = lambda row: F.aggregate(F.zip_with("f", _vector(row), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    mean = v.groupBy("msa").agg(F.avg("neff").alias("_mean"))
    met = v.join(few(mean), "msa").withColumn("g", F.array(*(dot(r) for r in cond)))
    tau = profiles.admixture(F.col("_mean"), 2, params.pca, params.pcb, params.pcc)
    return met.withColumn("p", F.zip_with("f", "g", lambda x, y: (1 - tau) * x + tau * y)).select("msa", "i", "f", "neff", "p")


def prepared(rows: DataFrame, model: DataFrame, params: Params = ITERATIVE) -> DataFrame:
    """(name, p, states, neff, length) of each alignment (msa, k, row of match columns). A column without any residue has the background, and so
    has an ambiguous one of a single sequence, whose other columns are its residues. states: for each column the residue of largest share over its
    background, from 1 on; 0 for a column without one."""
    back = background_of(model)
    cols = column_profiles(rows, model, params)
    width = rows.groupBy("msa").agg(F.max(F.length("row")).alias("length"))
    known = cols.groupBy("msa").agg(F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.struct("p", "f").alias("c")))).alias("m"), F.avg("neff").alias("neff"))
    met = width.join(known, "msa", "left")
    at = F.when(F.col("length") > 0, F.transform(F.sequence(F.lit(1), F.col("length")), lambda i: F.try_element_at("m", i)))
    met = met.withColumn("c", F.coalesce(at, F.array().cast("array<struct<p:array<double>,f:array<double>>>")))
    best = lambda f: F.array_max(F.transform(F.zip_with(f, _vector(back), lambda x, b: x / b), lambda x, k: F.struct(x.alias("x"), (k + 1).alias("k"))))["k"]
    states = F.transform("c", lambda c: F.coalesce(best(c["f"]), F.lit(0)))
    text = F.array_join(F.transform(states, lambda k: F.lpad(F.hex(k.cast("long")), 2, "0")), "")
    return met.select(F.col("msa").alias("name"), F.transform("c", lambda c: F.coalesce(c["p"], _vector(back))).alias("p"), F.unhex(text).alias("states"), F.coalesce("neff", F.lit(1.0)).alias("neff"), "length")


def count_profile(columns: DataFrame, by_column: bool = True) -> DataFrame:
    """(msa, i, c): residue counts of columns (msa, i, f, neff), their shares times the column's effective number, or the alignment's mean one."""
    if not by_column:
        columns = columns.drop("neff").join(few(columns.groupBy("msa").agg(F.avg("neff").alias("neff"))), "msa")
    return columns.select("msa", "i", F.transform("f", lambda x: x * F.col("neff")).alias("c"))


def query_table(p: np.ndarray, back: np.ndarray, params: Params) -> np.ndarray:
    """A profile's score table as bytes: log-odds of each residue in units of a bit's part, the offset added; state 0 is no residue."""
    s = np.clip(np.floor(np.log2(np.maximum(p / back, 1e-30)) * params.bit_factor + params.score_offset + 0.5), 0, 255).astype(np.uint8)
    return np.concatenate([np.zeros((len(p), 1), dtype=np.uint8), s], 1)


def search(queries: DataFrame, targets: DataFrame, model: DataFrame, params: Params = ITERATIVE, realign: bool = True) -> DataFrame:
    """Hits of prepared queries among prepared targets: prefiltered, aligned, realigned by posteriors, with statistics against the number of targets
    searched. (query, target, irep, score, ..., log_eval, eval, probab, matched_cols, path)."""
    back = background_of(model)
    packed = queries.select(F.col("name").alias("query"), F.transform("p", lambda c: F.transform(c, lambda x: x.cast("float"))).alias("p"))

    def pack(frames):
        for f in frames:
            f["states"] = [np.array([list(c) for c in p], dtype=np.float32).tobytes() for p in f["p"]]
            yield f[["query", "states"]]

    kind = dict(queries.dtypes)["name"]
    small = packed.mapInPandas(pack, f"query {kind}, states binary")
    table = lambda b: query_table(np.frombuffer(b, dtype=np.float32).reshape(-1, 20).astype(float), back, params)
    kept = stored(tiles.prefilter(small, targets.select("name", "states"), table, params), "kept")
    q = queries.select(F.col("name").alias("query"), F.col("p").alias("q"))
    t = targets.select(F.col("name").alias("target"), F.col("p").alias("t"))
    pairs = kept.select("query", F.col("name").alias("target")).join(few(q, tiles.TILE), "query").join(t, "target")
    found = stored(dp.align_join(pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query", "target"), back, params, realign), "aligned")
    size = targets.select("name").distinct().count()
    nq, nt = queries.select(F.col("name").alias("query"), F.col("neff").alias("q_neff")), targets.select(F.col("name").alias("target"), F.col("neff").alias("t_neff"))
    full = found.join(few(nq), "query").join(nt, "target").withColumns({"score_ss": F.lit(0.0), "file": F.col("target")})
    return hits.calibrated(full, size, params)


def realigned_selection(found: DataFrame, params: Params = ITERATIVE) -> DataFrame:
    """Which hits of a list (query, line, eval, probab) are aligned again: all significant ones up to realign_max lines, further ones only while the
    lists that are shown ask for them, by number, probability and E-value."""
    wide, short = max(params.B, params.Z), max(params.b, params.z)
    plain = (F.col("line") <= wide) & ((F.col("line") <= short) | (F.col("probab") >= params.p) & (F.col("eval") <= params.E))
    return found.where(F.when(F.col("eval") <= params.e, F.col("line") <= max(params.realign_max, wide)).otherwise(plain))


def searched_rounds(own: DataFrame, members: DataFrame, model: DataFrame, params: Params = ITERATIVE, realign: bool = True) -> tuple[DataFrame, DataFrame]:
    """The fix point of search and merge for all queries: (their alignments (query, n, name, row), the last round's hits with the round that
    took each in). own: queries' alignments (query, k, name, row), members: the targets' (msa, k, name, row), all A3M. A round's new
    alignments are tables; a query without new hits stays as it is, and the loop ends when none has any."""
    model = stored(model, "model")  # 400 rows, read for every preparation
    targets = stored(prepared(match_rows(members), model, params), "targets")
    target_rows = members.select("msa", "k", "name", "row")
    kind = dict(members.dtypes)["msa"]
    at = F.struct(F.lit(None).cast(kind).alias("target"), F.lit(None).cast("int").alias("irep"), F.col("k").cast(dict(members.dtypes)["k"]).alias("k"))
    now = stored(own.select("query", F.lit(0).alias("round"), at.alias("at"), "name", "row"), "queries")
    seen, last = None, None
    for turn in range(1, params.rounds + 1):
        numbered_ = now.select(F.col("query").alias("msa"), F.struct("round", "at").alias("k"), "row")
        queries = stored(prepared(match_rows(numbered_), model, params), "profiles")
        found = search(queries, targets, model, params, realign)
        found = found.join(few(queries.select(F.col("name").alias("query"), "length")), "query")
        ready = found.select("query", "target", "irep", F.col("target").alias("msa"), "eval", "matched_cols", "length", F.col("target").cast("string").alias("name"), "path", "score", "probab")
        if seen is not None:
            ready = ready.join(seen, ["query", "target", "irep"], "left")
        else:
            ready = ready.withColumn("first_round", F.lit(None).cast("int"))
        fresh = F.col("first_round").isNull() & (F.col("eval") <= params.e) & (F.col("matched_cols") >= params.min_columns)
        last = stored(ready.withColumn("first_round", F.when(fresh, F.lit(turn)).otherwise(F.col("first_round"))), "round")
        new = last.where(F.col("first_round") == turn)
        if not new.limit(1).count():
            break
        maps_ = maps.column_map(new.select("query", "target", "irep", "msa", "length", F.transform("path", lambda s: F.struct(s["i"].alias("i"), s["j"].alias("j"))).alias("path")))
        added = maps.merged_members(maps_, target_rows).select("query", F.lit(turn).alias("round"), F.struct("target", "irep", "k").alias("at"), "name", "row")
        now = stored(now.unionByName(added), "queries")
        seen = last.where("first_round is not null").select("query", "target", "irep", "first_round")
    return now, last


def consensus_text(columns: DataFrame, model: DataFrame, unsure: str = "x") -> DataFrame:
    """(msa, row): each alignment's consensus, a letter a column: see ``msa.consensus``; unsure: for columns where no residue is common (``~`` in reports)."""
    back = columns.sparkSession.createDataFrame([(r, float(b)) for r, b in zip(LETTERS, background_of(model))], "r string, prior double")
    letters = msa.consensus(columns.select("msa", "i", "f"), back).withColumn("c", F.when(F.col("c") == "x", unsure).otherwise(F.col("c")))
    return letters.groupBy("msa").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]), "").alias("row"))


def write_consensus(texts: DataFrame, path: str) -> None:
    """Consensus sequences (msa, row) as FASTA, added to what lies below the path."""
    texts.select(F.concat(F.lit(">"), F.col("msa").cast("string"), F.lit("_consensus\n"), F.col("row")).alias("value")).write.mode("append").text(path)


def write_psi(rows: DataFrame, path: str) -> None:
    """Alignments (msa, k, name, row) as lines of a name and its row without inserts, a folder for each alignment."""
    line = F.concat(F.rpad(F.col("name"), 20, " "), F.lit(" "), F.regexp_replace("row", "[a-z.]", ""))
    rows.select(F.col("msa").cast("string").alias("alignment"), line.alias("value"), "k").repartition("alignment").sortWithinPartitions("alignment", "k").select("alignment", "value").write.partitionBy("alignment").text(path)


def write_rounds(rows: DataFrame, path: str) -> None:
    """The members of iterative searches (query, round, name, row) as A3M text, a folder for each round: what the query's alignment gained in it."""
    rows.select("round", F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("row")).alias("value")).write.partitionBy("round").text(path)
