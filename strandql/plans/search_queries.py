"""Searches, filters, trees and conversions that SQL can't express, or only slowly."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from strandql.functions.residues import LETTERS, upper_ascii
from strandql.operators import context, dp, hits, iterate, msa, ordered, preparation, profiles, ranking, redundancy, tiles
from strandql.params import ITERATIVE, PAIRWISE
from strandql.plans.tables import alignment_rows, spread, table
from strandql.session import few, stored
from strandql.sources import matrices

OFFSET = ITERATIVE.score_offset
#: Words that stand for tags in names: what is to be neutral, and how many columns around it.
NAME_TAGS = [("BOLT", 1), ("SMALL", 0)]
#: Texts of one language share words by nature, so here a run has to be longer than one of them to pass the prefilter.
TEXTS = replace(ITERATIVE, smax_thresh=50)


def letter_codes(text: Column) -> Column:
    """A text's letters as bytes 1-26, everything else left out (translate takes a zero byte for a deletion)."""
    return F.encode(F.translate(F.regexp_replace(upper_ascii(text), "[^A-Z]", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, range(1, 27)))), "UTF-8")


def letter_shares(spark, sf_dir) -> np.ndarray:
    """Background of the letters: their shares in all queries' texts. 26 numbers come to the driver."""
    text = upper_ascii(F.coalesce("text", F.lit("")))
    counts = table(spark, sf_dir, "benchmark").agg(*(F.coalesce(F.sum(F.length(text) - F.length(F.replace(text, F.lit(a)))), F.lit(0)).alias(a) for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).first()
    seen = np.array(list(counts), dtype=float) + 1
    return seen / seen.sum()


def byte_table(query: bytes, shares: np.ndarray, own: float = 0.8) -> np.ndarray:
    """The score table of a query sequence: log2 of (own letter's share mixed with the background) over the background, in
    units of a bit's part, as bytes with the offset added, one row a position. State 0 is no letter."""
    mixed = (1 - own) * np.tile(shares, (len(query), 1))
    mixed[np.arange(len(query)), np.array(list(query), dtype=np.int64) - 1] += own
    scores = np.clip(np.floor(np.log2(mixed / shares) * ITERATIVE.bit_factor + OFFSET + 0.5), 0, 255).astype(np.uint8)
    return np.concatenate([np.zeros((len(query), 1), dtype=np.uint8), scores], 1)


def query_sequence(spark, sf_dir) -> bytes:
    """The query: the benchmark item of least id, as codes. One row comes to the driver."""
    row = table(spark, sf_dir, "benchmark").select("item_id", letter_codes(F.col("text")).alias("s")).orderBy("item_id").limit(1).collect()
    return bytes(row[0]["s"]) if row else b""


def _targets(spark, sf_dir, only=None):
    """All documents, or those of the names in only, as state sequences, dealt evenly: the work of a row is far larger than its bytes."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), "text")
    docs = docs if only is None else docs.join(few(only), "name", "left_semi")
    return docs.repartition(n).select("name", letter_codes(F.coalesce("text", F.lit(""))).alias("states"))


def ungapped_prefilter(spark, sf_dir):
    return dp.prefilter_join(_targets(spark, sf_dir), byte_table(query_sequence(spark, sf_dir), letter_shares(spark, sf_dir)), "ungapped")


def gapped_prefilter(spark, sf_dir):
    return dp.prefilter_join(_targets(spark, sf_dir), byte_table(query_sequence(spark, sf_dir), letter_shares(spark, sf_dir)), "gapped")


def top_hits(spark, sf_dir):
    """The ranked hit list of one query sequence over all documents: cheap scores, length correction, floored top-k, gapped
    scores of what is left, statistics against the number of documents searched, paging."""
    q = query_sequence(spark, sf_dir)
    own = byte_table(q, letter_shares(spark, sf_dir))
    first = dp.prefilter_join(_targets(spark, sf_dir), own, "ungapped").where("t_len > 0")
    first = stored(first.withColumn("score", hits.length_corrected(F.col("score"), F.lit(max(1, len(q))), F.col("t_len"), ITERATIVE.bit_factor)), "first-scores")  # read by the floor and by the threshold; three numbers a row
    left = hits.floor_top_k(first, "score", "name", ITERATIVE.min_prefilter_hits, TEXTS.smax_thresh).select("name")
    again = dp.prefilter_join(_targets(spark, sf_dir, left), own, "gapped")
    found = again.select(F.lit("query").alias("query"), F.col("name").alias("target"), F.col("name").alias("file"), (F.col("score") / float(ITERATIVE.bit_factor)).alias("score"), F.lit(0.0).alias("score_ss"), F.col("t_len").cast("int").alias("t_len"), F.lit(3.0).alias("t_neff"), F.lit(max(1, len(q))).alias("q_len"), F.lit(3.0).alias("q_neff"))
    listed = hits.paged(hits.calibrated(found, first.select("name").distinct().count()), ITERATIVE.z, ITERATIVE.Z, ITERATIVE.p, ITERATIVE.E)
    return listed.select("line", "target", "t_len", "score", F.round("probab", 4).alias("probab"), F.round("log_eval", 4).alias("log_eval"))


def batch_prefilter(spark, sf_dir):
    """What the prefilter keeps of all documents for every benchmark item, in tiles of items."""
    shares = letter_shares(spark, sf_dir)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), letter_codes(F.coalesce("text", F.lit(""))).alias("states"))
    return tiles.prefilter(queries, _targets(spark, sf_dir), lambda q: byte_table(q, shares), replace(TEXTS, min_prefilter_hits=10))


def seqid_filter(spark, sf_dir):
    return redundancy.identity_filter(alignment_rows(spark, sf_dir), 90)


def diversity_filter(spark, sf_dir):
    return redundancy.identity_filter(alignment_rows(spark, sf_dir), 90, diversity=5)


def neff_filter(spark, sf_dir):
    return redundancy.neff_filter(alignment_rows(spark, sf_dir), 3.0)


def display_filter(spark, sf_dir):
    return redundancy.most_dissimilar(alignment_rows(spark, sf_dir), 10)


def local_profiles(spark, sf_dir):
    """Position-specific weighting of the names of each brand's parts: columns, effective number, commonest residue."""
    f = redundancy.local_profiles(msa.text_rows(table(spark, sf_dir, "part"), F.col("p_brand"), F.col("p_partkey"), F.col("p_name")))
    return f.groupBy("msa", "i").agg(F.round(F.max("neff"), 6).alias("neff"), F.max_by("r", F.struct("f", "r")).alias("r"))


def _names(spark, sf_dir, name, key, col):
    return _as_profiles(table(spark, sf_dir, name), key, col)


def _as_profiles(df, key, col):
    """Texts as profiles (name, p): each letter's column has 0.81 of its own letter and 0.01 of every other."""
    seq = F.filter(F.split(F.translate(upper_ascii(F.col(col)), "UBZ", "CDE"), ""), lambda c: F.lit(LETTERS).contains(c) & (c != ""))
    column = lambda c: F.transform(F.split(F.lit(LETTERS), ""), lambda a: F.when(a == c, 0.81).otherwise(0.01))
    return df.select(F.col(key).alias("name"), F.transform(seq, column).alias("p"))


def _pairs(spark, sf_dir, parts=None):
    """Every part (or each of the profiles given) against the five regions, a table of fixed size."""
    q = _names(spark, sf_dir, "region", "r_regionkey", "r_name").select(F.col("name").cast("long").alias("query"), F.col("p").alias("q"))
    parts = _names(spark, sf_dir, "part", "p_partkey", "p_name") if parts is None else parts
    t = parts.select(F.col("name").alias("target"), F.col("p").alias("t"))
    return t.withColumn("_one", F.lit(1)).join(F.broadcast(q.withColumn("_one", F.lit(1))), "_one").drop("_one").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "target")


def viterbi(spark, sf_dir):
    a = dp.align_join(_pairs(spark, sf_dir), np.full(20, 0.05), PAIRWISE)
    return a.select("query", "target", "irep", F.round("score", 6).alias("score"), "q_len", "t_len", "matched_cols")


def posterior_mac(spark, sf_dir):
    a = dp.align_join(_pairs(spark, sf_dir), np.full(20, 0.05), PAIRWISE, realign=True)
    posts = F.aggregate("path", F.lit(0.0), lambda s, x: s + x["post"])
    return a.select("query", "target", "irep", "matched_cols", F.round(posts, 6).alias("sum_probs"))


def posterior_matrices(spark, sf_dir):
    """Every part's posteriors with the five regions, of a hundredth or more, as the bytes of its matrix, in hexadecimal digits. Parts of one name
    have one profile, so each name is aligned once, and its matrices meet its parts."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    a = dp.align_join(_pairs(spark, sf_dir, _as_profiles(parts.select("p_name").distinct(), "p_name", "p_name")), np.full(20, 0.05), PAIRWISE, realign=True, least=0.01)
    cells = a.select("query", "target", "irep", F.lit("posterior").alias("kind"), F.inline("cells"))
    found = stored(matrices.matrices(matrices.runs(cells)).select("query", F.col("target").alias("p_name"), "irep", F.hex("matrix").alias("matrix")), "matrices")
    return parts.join(few(found), "p_name").select("query", F.col("p_partkey").alias("target"), "irep", "matrix")


def tabular_hits(spark, sf_dir):
    a = dp.align_join(_pairs(spark, sf_dir), np.full(20, 0.05), PAIRWISE)
    path = F.transform("path", lambda s: F.struct(s["i"].alias("i"), s["j"].alias("j"), s["state"].alias("state"), (s["s"] > 2).alias("same")))
    return hits.tabular(a.select("query", "target", path.alias("path"), "t_len", F.exp(-F.col("score")).alias("eval"), (-F.col("score")).alias("score_aass"))).withColumn("eval", F.round("eval", 8))


def neutral_tags(spark, sf_dir):
    """The names of parts as profiles, in which the columns of two words, one with a column on both sides, are set to the background."""
    letters = F.split(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.regexp_replace(upper_ascii("p_name"), "[^A-Z]", "").alias("consensus")).where("consensus <> ''")
    parts = parts.withColumn("p", F.transform(F.split("consensus", ""), lambda c: F.transform(letters, lambda a: F.when(a == c, 0.75).otherwise(0.01))))
    cols = ranking.neutral_tags(parts, [1 / 26] * 26, tags=NAME_TAGS).select("name", F.posexplode("p").alias("i", "c"))
    return cols.select("name", F.col("i").cast("long").alias("i"), (F.array_max("c") < 0.5).alias("neutral"))


def _label_columns(spark, sf_dir):
    """Embeddings as columns (name, i, p) of their label's profile, in order of their ids, and the labels' means (states, residues)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("w"))
    # The sum is bound once a row, not once an element.
    total = F.aggregate("w", F.lit(0.0), lambda s, y: s + y)
    e = e.withColumn("p", F.get(F.transform(F.array(total), lambda t: F.transform("w", lambda x: x / t)), F.lit(0))).drop("w")
    n = ordered.numbered(e.select("label", "vec_id"), ["label", "vec_id"], "n")
    first = few(n.groupBy("label").agg(F.min("n").alias("first")))
    i = n.join(first, "label").select("vec_id", (F.col("n") - F.col("first")).alias("i"))
    # At most as many means as labels, ten here: a dimension table.
    means = e.select("label", F.posexplode("p")).groupBy("label", "pos").agg(F.avg("col").alias("p")).orderBy("label", "pos").toPandas()
    return e.join(i, "vec_id").select(F.col("label").alias("name"), "i", "p"), np.stack([g["p"].to_numpy() for _, g in means.groupby("label")])


def state_translation(spark, sf_dir):
    """Embeddings as columns of profiles, by label, translated to the states of their own label means."""
    columns, emits = _label_columns(spark, sf_dir)
    lib = context.Library(np.log2(emits)[:, None, :], np.full(len(emits), -np.log2(len(emits))), emits)
    return context.state_texts(context.translated_columns(columns, lib)).select("name", F.hex("states").alias("states"))


def state_columns(spark, sf_dir):
    """The same columns with a context of the columns before and after them."""
    columns, emits = _label_columns(spark, sf_dir)
    lib = context.Library(np.log2(np.repeat(emits[:, None, :], 3, 1)), np.full(len(emits), -np.log2(len(emits))), emits)
    return context.translated_columns(columns, lib).select("name", F.col("i").cast("long").alias("i"), "state")


def iterative_search(spark, sf_dir):
    """Vectors near a growing query: each round scores all profiles against the mean of what was taken in so far."""
    from strandql.operators import profiles as P

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hmm"), F.col("label").alias("i"), F.posexplode("embedding").alias("r", "x")).withColumn("w", F.exp(F.col("x").cast("double")))
    p = e.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("hmm"))).select("hmm", "i", "r", "p")
    null = p.groupBy("r").agg(F.avg("p").alias("n"))

    def find(query):
        s = P.column_scores(query, p, null)
        return s.select(F.col("target"), F.lit(1).alias("irep"), F.round("s", 6).alias("score"), F.round(F.exp(-20 * F.col("s")), 9).alias("eval"))

    def take(query, new):
        met = p.join(new.select(F.col("target").alias("hmm")), "hmm", "left_semi").select("r", "p").unionByName(query.select("r", "p"))
        mean = met.groupBy("r").agg(F.avg("p").alias("p")).select(F.lit(-1).cast("long").alias("hmm"), F.lit(0).alias("i"), "r", "p")
        rows = mean.orderBy("r").collect()  # one profile: a row for each residue
        neff = 2 ** -sum(x["p"] * np.log2(x["p"]) for x in rows)
        return spark.createDataFrame(rows, mean.schema), neff, 0

    start = p.join(p.agg(F.min("hmm").alias("hmm")), "hmm", "left_semi").select(F.lit(-1).cast("long").alias("hmm"), F.lit(0).alias("i"), "r", "p")
    search = iterate.Search(find, take, replace(ITERATIVE, rounds=4, e=0.2, neff_max=1e9))
    return search.run(start, spark).select("target", "score", "eval", "first_round")


def _families(spark, sf_dir):
    """Parts as aligned members of the family of their name: the letters of name and type."""
    p = table(spark, sf_dir, "part")
    row = F.regexp_replace(upper_ascii(F.concat("p_name", "p_type")), "[^A-Z]", "")
    return p.select(F.col("p_name").alias("msa"), F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("name"), row.alias("row"))


def search_rounds(spark, sf_dir):
    """The first part of every name, as a query of one sequence, against the families of all names: searched, merged and searched again with
    what was found, by a model counted from the families themselves."""
    members = _families(spark, sf_dir)
    rows = preparation.match_rows(members)
    joint = stored(profiles.counted_joint(rows, stored(msa.global_weights(rows), "weights")), "joint")  # 400 rows at most, read several times
    own = members.groupBy(F.col("msa").alias("query")).agg(F.min(F.struct("k", "name", "row")).alias("m")).select("query", "m.*")
    # A pair that never shares a column still has a small share.
    every = spark.createDataFrame([(a, b, 1e-4) for a in LETTERS for b in LETTERS], "a string, b string, p double")
    model = profiles.substitution_model(joint.unionByName(every).groupBy("a", "b").agg(F.sum("p").alias("p")))
    now, last = preparation.searched_rounds(own, members, model, replace(ITERATIVE, rounds=2, min_prefilter_hits=5), realign=False)
    size = now.groupBy("query").agg(F.count("*").alias("members"))
    return last.join(few(size), "query").select("query", "target", "irep", "matched_cols", F.round("score", 4).alias("score"), F.col("first_round"), "members")


def count_profiles(spark, sf_dir):
    """Residue counts of the columns of families, normalised to each column's effective number."""
    rows = preparation.match_rows(_families(spark, sf_dir))
    cols = msa.frequency_vectors(rows, msa.global_weights(rows)).withColumn("neff", F.pow(F.lit(2.0), F.aggregate("f", F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(0.0))))
    named = F.filter(F.transform("c", lambda x, a: F.struct(F.substring(F.lit(LETTERS), a + 1, F.lit(1)).alias("r"), F.round(x, 6).alias("c"))), lambda x: x["c"] > 0)
    return preparation.count_profile(cols).select("msa", "i", F.inline(named))


def similarity_tree(spark, sf_dir):
    """The tree of the labels' mean profiles by Bhattacharyya similarity."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("r", "x")).groupBy("label", "r").agg(F.avg(F.exp(F.col("x").cast("double"))).alias("w"))
    p = e.withColumn("p", F.sqrt(F.col("w") / F.sum("w").over(Window.partitionBy("label")))).select("label", "r", "p")
    sim = p.select(F.col("label").alias("a"), "r", F.col("p").alias("pa")).join(p.select(F.col("label").alias("b"), "r", F.col("p").alias("pb")), "r").where("a < b").groupBy("a", "b").agg(F.sum(F.col("pa") * F.col("pb")).alias("sim"))
    joins = redundancy.trees(redundancy.distances(sim).withColumn("tree", F.lit(1)), "tree")
    return joins.select("step", "left", "right", F.round("height", 6).alias("height"))


def prune_similar(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("v"))
    return redundancy.prune_similar(v, "label", "vec_id", "v", 10)


def greedy_cover(spark, sf_dir):
    """Suppliers that cover the parts of a brand best, by discounted quantity as a probability."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    gains = lines.groupBy(F.col("p_brand").alias("query"), F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("i")).agg(F.max(F.col("l_quantity") / 51.0).alias("p"))
    return redundancy.greedy_cover(gains)


def independent_hits(spark, sf_dir):
    """Order lines of a supplier, by price, whose spans of days and quantity overlap little."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("target"), F.datediff("l_shipdate", F.lit("1990-01-01")).cast("long").alias("i1"), "l_quantity", "l_extendedprice")
    lines = lines.withColumn("i2", F.col("i1") + F.col("l_quantity").cast("long"))
    return redundancy.independent(lines.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("l_extendedprice").desc(), "target"))), 5)


QUERIES = {
    f.__name__: f
    for f in (
        top_hits, ungapped_prefilter, gapped_prefilter, batch_prefilter, search_rounds, count_profiles, seqid_filter, diversity_filter, neff_filter, display_filter, local_profiles, viterbi, posterior_mac,
        posterior_matrices, tabular_hits, neutral_tags, state_translation, state_columns, iterative_search, similarity_tree, prune_similar, greedy_cover, independent_hits,
    )
}
#: Greedy turns one after the other, each over what the one before it left open.
_COVER = "".join(
    f""", g{k} as materialized (select query, target, round(sum(exp(p - best) - 1), 9) as g from o{k} group by 1, 2),
 k{k} as materialized (select query, target from (select *, row_number() over (partition by query order by g desc, target) as n from g{k} where g > 0) where n = 1),
 o{k + 1} as materialized (select * from (select o.query, o.target, o.i, o.p, greatest(o.best, coalesce(c.p, 0)) as best from o{k} o left join (select x.query, x.i, x.p from o{k} x join k{k} using (query, target)) c using (query, i)) where p > best)"""
    for k in range(1, 11)
)
#: A run's score changes at equal letters and falls evenly between them, so only equal letters need rows: the best run of a diagonal is the
#: largest rise of the running sum over its least value before. Bytes saturate at 255, the offset included.
SQL: dict[str, str] = {
    "greedy_cover": """with o1 as materialized (select p_brand as query, l_suppkey as target, l_partkey as i, max(l_quantity / 51.0::double) as p, 0.0::double as best from lineitem join part on l_partkey = p_partkey group by 1, 2, 3)"""
    + _COVER
    + " " + " union all ".join(f"select query, target, {k} as turn from k{k}" for k in range(1, 11)),
    "neutral_tags": """with s as (select p_partkey as name, regexp_replace(translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '', 'g') as s from part),
 c as (select name, s, unnest(range(length(s))) as i from s where s <> '')
 select name, i, len(list_filter(range(length(s)), lambda a: (substr(s, a + 1, 4) = 'BOLT' and i between a - 1 and a + 4) or (substr(s, a + 1, 5) = 'SMALL' and i between a and a + 4))) > 0 as neutral from c""",
    "state_columns": """with e as (select label, vec_id, row_number() over (partition by label order by vec_id) - 1 as i, embedding from embeddings),
 x as (select label, i, unnest(range(len(embedding))) as r, exp(cast(unnest(embedding) as double)) as w from e), prof as (select label, i, r, w / sum(w) over (partition by label, i) as p from x),
 cen as (select dense_rank() over (order by label) - 1 as state, r, avg(p) as c from prof group by label, r),
 own as (select prof.label, prof.i, state, sum(p * log2(c)) as z from prof join cen using (r) group by 1, 2, 3),
 z as (select label, i, state, 1.6::double * z + 1.6::double * 0.85::double * (coalesce(lag(z) over k, 0) + coalesce(lead(z) over k, 0)) as z from own window k as (partition by label, state order by i))
 select label as name, i, cast(arg_max(state, z) as integer) as state from z group by 1, 2""",
    "count_profiles": """with r as (select p_name as msa, p_partkey as k, regexp_replace(translate(p_name || p_type, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '', 'g') as s from part),
 c as (select msa, k, unnest(generate_series(1, length(s))) as i, unnest(string_split(s, '')) as r from r where s <> ''), res as (select msa, k, i, translate(r, 'UBZ', 'CDE') as r from c where r not in ('J', 'O', 'X')),
 cnt as (select msa, i, r, count(*) as n from res group by 1, 2, 3), kinds as (select msa, i, count(*) as kinds from cnt group by 1, 2), raw as (select res.msa, res.k, sum(1.0::double / (n * kinds)) / (count(*) + 30) + 1e-6 as raw from res join cnt using (msa, i, r) join kinds using (msa, i) group by 1, 2),
 w as (select msa, k, raw / sum(raw) over (partition by msa) as w from raw), s as (select msa, i, r, sum(w) as s from res join w using (msa, k) group by 1, 2, 3), f as (select msa, i, r, s / sum(s) over (partition by msa, i) as f from s),
 n as (select msa, i, pow(2.0, -sum(f * log2(f))) as neff from f group by 1, 2) select msa, i, r, round(f * neff, 6) as c from f join n using (msa, i)""",
    "ungapped_prefilter": r"""with l as (select unnest(range(26)) as a), sh as (select a, (sum(length(t) - length(replace(t, chr(cast(65 + a as integer)), ''))) + 1.0::double) as n from (select translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as t from benchmark), l group by a),
f as (select a, n / sum(n) over () as f from sh),
w as (select f.a as a, cast(floor(log2((0.2 * f + 0.8) / f) * 4 + 50.5) as integer) - 50 as same, cast(floor(log2(0.2 * f / f) * 4 + 50.5) as integer) - 50 as other from f),
qs as (select regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '', 'g') as s from benchmark order by item_id limit 1),
q as (select unnest(generate_series(1, length(s))) as i, unnest(string_split(s, '')) as c from qs),
ds as (select doc_id, regexp_replace(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '', 'g') as s from documents),
d as (select doc_id, unnest(generate_series(1, length(s))) as j, unnest(string_split(s, '')) as c from ds where s <> ''),
m as (select doc_id, j - i as g, i, same, other from d join q using (c) join w on a = ascii(c) - 65),
p as (select doc_id, g, i, sum(same - other) over (partition by doc_id, g order by i) as up, same, other from m),
e as (select doc_id, g, up + other * i as here, up - (same - other) + other * (i - 1) as before, i from p),
b as (select doc_id, here - min(before) over (partition by doc_id, g order by i) as s from e),
t as (select doc_id, least(205, max(s)) as s from b group by 1)
select doc_id as name, length(ds.s) as t_len, cast(coalesce(t.s, 0) as bigint) as score from ds left join t using (doc_id)""",
}
