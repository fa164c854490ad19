"""Statistics, ranking and selection over order lines, customers, parts and embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandql.functions import strings
from strandql.functions.evd import LAMBDA_NET, MU_NET, MU_SCALE
from strandql.operators import hits as H
from strandql.operators import profiles as P
from strandql.plans.tables import HITS_SQL, hits, table

SEARCHED = 1000


def evd_pvalue(spark, sf_dir):
    c = H.calibrated(hits(spark, sf_dir), SEARCHED)
    return c.select("file", *(F.round(x, 6).alias(x) for x in ("lam", "mu", "log_pval", "score_aass", "probab")))


def composite_evalue(spark, sf_dir):
    c = H.composite(H.calibrated(hits(spark, sf_dir), SEARCHED), SEARCHED)
    return c.select("file", F.round("log_eval", 6).alias("log_eval"))


def hit_paging(spark, sf_dir):
    c = H.calibrated(hits(spark, sf_dir), SEARCHED).withColumns({"score_aass": F.round("score_aass", 6), "probab": F.round("probab", 6), "eval": F.round("log_eval", 6)})
    return H.paged(c, z=10, Z=50, p=20.0, E=1.0).select("query", "target", "file", F.col("line").cast("long").alias("line"))


def best_per_target(spark, sf_dir):
    c = H.calibrated(hits(spark, sf_dir), SEARCHED).withColumn("score_aass", F.round("score_aass", 6))
    return H.best_per_target(c.select("query", "target", "score_aass", "file", "score")).select("query", "target", "file", F.round("score", 6).alias("score"))


def topk_floor(spark, sf_dir):
    scored = hits(spark, sf_dir).select("file", H.length_corrected(F.floor("score").cast("int"), F.col("q_len"), F.col("t_len"), 1).cast("long").alias("score"))
    return H.floor_top_k(scored, "score", "file", 100, 110)


def prefilter_evalue(spark, sf_dir):
    e = hits(spark, sf_dir).select("file", H.prefilter_evalue(F.floor("score"), F.col("t_len"), F.lit(1e6)).alias("e"))
    return H.floor_by_evalue(e, "e", "file", 100, 5.0, 20000).select("file", "e", "rank")


def early_stop_blocks(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return H.early_stop(ev, "event_id", F.abs("value"), 500, 0.2).select("block", "n", F.round("total", 4).alias("total"), "go_on")


def cluster_reps(spark, sf_dir):
    return H.cluster_representatives(table(spark, sf_dir, "part"), "p_brand", "p_partkey", ["p_retailprice", "p_size"], ["p_retailprice"])


def template_preselect(spark, sf_dir):
    return H.preselected(hits(spark, sf_dir), "file", ["score", "score_ss", "t_neff"], 5)


def scop_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    fam = F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), F.col("c_mktsegment"), F.col("c_custkey").cast("string"))
    h = strings.hierarchy(fam)
    return c.select("c_custkey", h["cl"].alias("cl"), h["fold"].alias("fold"), h["sfam"].alias("sfam"), fam.alias("fam"))


def relation_level(spark, sf_dir):
    """Each order's customer against each of its suppliers, by their dotted ids of region, nation and number."""
    n = F.broadcast(table(spark, sf_dir, "nation"))
    cust = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(".", F.col("n_regionkey"), F.col("n_nationkey"), F.lit("c"), F.col("c_custkey")).alias("c_fam"))
    supp = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat_ws(".", F.col("n_regionkey"), F.col("n_nationkey"), F.lit("s"), F.col("s_suppkey")).alias("s_fam"))
    pairs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("s_suppkey"))
    met = pairs.join(cust, "c_custkey").join(supp, "s_suppkey")
    rel = H.relation_level(F.concat(F.lit("c"), F.col("c_custkey")), F.col("c_fam"), F.concat(F.lit("s"), F.col("s_suppkey")), F.col("s_fam"))
    return met.select(rel.cast("long").alias("rel")).groupBy("rel").agg(F.count("*").alias("n"))


def region_exclusion(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("pos"))
    return H.outside(lines, "pos", "1-9,20-33,50").groupBy("pos").agg(F.count("*").alias("n"))


def seen_split(spark, sf_dir):
    docs, seen = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("quality = 1")
    new, old = H.split_seen(docs, seen, "doc_id")
    return new.withColumn("seen", F.lit(False)).unionByName(old.withColumn("seen", F.lit(True)))


def _profiles(spark, sf_dir):
    """Embeddings as profiles of one column: the softmax of their numbers (hmm, i, r, p)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hmm"), F.col("label").alias("i"), F.posexplode("embedding").alias("_r", "x")).withColumn("r", F.col("_r").cast("long")).drop("_r")
    e = e.withColumn("w", F.exp(F.col("x").cast("double")))
    return e.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("hmm"))).select("hmm", "i", "r", "p")


def _centres(p):
    return p.groupBy(F.col("i").alias("hmm"), "r").agg(F.avg("p").alias("p")).withColumn("i", F.lit(1)).select("hmm", "i", "r", "p")


def column_score(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    null = p.groupBy("r").agg(F.avg("p").alias("n"))
    s = P.column_scores(_centres(p), p, null)
    return s.select(F.col("hmm").alias("label"), F.col("target").alias("vec_id"), F.round("s", 6).alias("s"))


def query_score_table(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    null = p.groupBy("r").agg(F.avg("p").alias("n"))
    t = P.score_table(P.column_scores(_centres(p), p, null).withColumn("s", F.round("s", 6)), 50, 100)
    return t.select(F.col("hmm").alias("label"), F.col("target").alias("vec_id"), F.col("byte").cast("long").alias("byte"))


def profile_entropy(spark, sf_dir):
    return P.entropy(P.normalised(P.shifted(_profiles(spark, sf_dir), 0.001))).select("hmm", F.round("h", 6).alias("h"))


def local_background(spark, sf_dir):
    p = _profiles(spark, sf_dir).select(F.col("i").alias("hmm"), F.col("hmm").alias("i"), "r", "p")
    prior = p.groupBy("r").agg(F.avg("p").alias("prior"))
    return P.local_background(p, prior, 5).select("i", "r", F.round("q", 6).alias("q"))


def null_models(spark, sf_dir):
    """A label's vectors as the columns of a profile, over every null model; the query is the label of least number."""
    p = _profiles(spark, sf_dir).select(F.col("i").alias("hmm"), F.col("hmm").alias("i"), "r", "p")
    own = p.groupBy("hmm", "r").agg(F.avg("p").alias("pav"))
    query = own.join(F.broadcast(own.agg(F.min("hmm").alias("hmm"))), "hmm").select("r", "pav")
    null = p.groupBy("r").agg(F.avg("p").alias("n"))
    by_mode = [P.over_null(p, null, m, query, own).withColumn("mode", F.lit(m)) for m in (0, 1, 2, 3, 10, 11)]
    return reduce(lambda x, y: x.unionByName(y), by_mode).select("i", "r", "mode", F.round("q", 5).alias("q"))


def pseudocount_modes(spark, sf_dir):
    """The share of pseudocounts of each embedding profile, by its Neff, in every mode."""
    neff = P.entropy(_profiles(spark, sf_dir)).select("hmm", F.pow(F.lit(2.0), F.col("h")).alias("neff"))
    taus = [F.round(P.admixture(F.col("neff"), m, 0.9, 60.0, c), 8).alias(f"tau_{m}_{k}") for m in range(4) for k, c in enumerate((1.0, 0.5))]
    return neff.select("hmm", *taus)


def transition_pseudocounts(spark, sf_dir):
    """Orders as profiles, their lines as columns: shares from the rates of a line, effective numbers from its keys."""
    lines = table(spark, sf_dir, "lineitem")
    length = lines.groupBy("l_orderkey").agg((F.max("l_linenumber") - 1).alias("length"))
    one = lambda c: (1 - F.col(c)).alias
    tr = lines.join(length, "l_orderkey").select(
        F.col("l_orderkey").alias("hmm"), (F.col("l_linenumber") - 1).alias("i"), "length", (1 - F.col("l_discount") - F.col("l_tax")).alias("m2m"), F.col("l_tax").alias("m2i"), F.col("l_discount").alias("m2d"),
        F.col("l_discount").alias("i2i"), one("l_discount")("i2m"), F.col("l_tax").alias("d2d"), one("l_tax")("d2m"),
        (1 + F.col("l_suppkey") % 7).cast("double").alias("neff_m"), (F.col("l_suppkey") % 3).cast("double").alias("neff_i"), (F.col("l_partkey") % 4).cast("double").alias("neff_d"),
    )
    return P.transition_pseudocounts(tr).select("hmm", "i", *(F.round(c, 6).alias(c) for c in ("m2m", "m2i", "m2d", "i2m", "i2i", "d2m", "d2d")))


def nearest_state(spark, sf_dir):
    """The label whose mean profile gives a vector the largest posterior."""
    p = _profiles(spark, sf_dir)
    lib = _centres(p).select(F.col("hmm").alias("state"), "r", F.log2("p").alias("lp")).withColumn("prior", F.lit(0.1))
    return P.nearest_state(p, lib).select("hmm", F.col("state").cast("long").alias("state"), F.round("post", 6).alias("post"))


def substitution_model(spark, sf_dir):
    """Joint counts of order priority and status as a model: odds in bits."""
    j = table(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("a"), F.substring("o_orderpriority", 3, 1).alias("b")).agg(F.count("*").cast("double").alias("p"))
    m = P.substitution_model(j)
    return m.select("a", "b", *(F.round(c, 6).alias(c) for c in ("p", "pa", "pb", "r", "s")))


def aa_pseudocounts(spark, sf_dir):
    """Embedding profiles mixed with their label's mean profile by a Neff of their entropy."""
    p = _profiles(spark, sf_dir)
    neff = P.entropy(p).select("hmm", "i", F.pow(F.lit(2.0), F.col("h")).alias("neff"))
    mean = p.groupBy("i", "r").agg(F.avg("p").alias("g"))
    spread = p.select("hmm", "i", "r").join(mean, ["i", "r"]).select("hmm", "i", "r", "g")
    return P.with_pseudocounts(p.withColumnRenamed("p", "f"), spread, neff).select("hmm", "r", F.round("p", 8).alias("p"))


def _net_sql(net: list, inputs: list[str]) -> str:
    return "(" + " + ".join(f"{o} / (1 + exp(-({b} + " + " + ".join(f"{x} * {v}" for x, v in zip(inputs, w)) + ")))" for w, b, o in net) + ")"


_IN = ["(ln(q_len) / ln(1000.0))", "(ln(t_len) / ln(1000.0))", "(q_neff / 10.0)", "(t_neff / 10.0)"]
_CAL = HITS_SQL + f""", l as (select *, cast({_net_sql(LAMBDA_NET, _IN)} as double) as lam, cast({MU_SCALE} * {_net_sql(MU_NET, _IN)} as double) as mu from hits),
 h as (select *, lam * (score - mu) as h from l),
 pv as (select *, case when h > 10 then exp(-h) else 1.0::double - exp(-exp(-h)) end as pval, case when h > 10 then -h when h < -2.5 then -exp(-exp(-h)) else ln(1.0::double - exp(-exp(-h))) end as log_pval from h),
 sa as (select *, (case when log_pval < -10 then log_pval else ln(-ln(1 - pval)) end) / 0.45 - least(lam * score_ss, greatest(0.0, 0.2 * (score - 8.0))) / 0.45 - 3.0 as score_aass from pv),
 cal as (select *, log_pval + ln({SEARCHED}.0) as log_eval, case when -score_aass > 200 then 100.0 else 100.0 / (1.0 + pow(sqrt(4000.0) * exp(score_aass / 5.0) + sqrt(0.15) * exp(score_aass / 68.0), 2)) end as probab from sa)"""
_PROF = """e as (select vec_id, label, unnest(range(0, 64)) as r, unnest(embedding) as x from embeddings), w as (select vec_id, label, r, exp(cast(x as double)) as w from e),
 prof as (select vec_id, label, r, w / sum(w) over (partition by vec_id) as p from w), cen as (select label, r, avg(p) as p from prof group by 1, 2), nul as (select r, avg(p) as n from prof group by 1),
 cs as (select c.label, p.vec_id, log2(sum(c.p / n * p.p)) as s from cen c join nul using (r) join prof p using (r) group by 1, 2)"""
SQL = {
    "evd_pvalue": f"with {_CAL} select file, round(lam, 6) as lam, round(mu, 6) as mu, round(log_pval, 6) as log_pval, round(score_aass, 6) as score_aass, round(cast(probab as double), 6) as probab from cal",
    "composite_evalue": f"with {_CAL} select file, round(log_pval + ln({SEARCHED}.0) + (0.4 + 0.02 * (t_neff - 1) * (1 - 0.1 * (q_neff - 1))) * ln(1000.0 / {SEARCHED}), 6) as log_eval from cal",
    "hit_paging": f"with {_CAL}, r as (select query, target, file, round(score_aass, 6) as s, round(cast(probab as double), 6) as probab, round(log_eval, 6) as ev from cal), a as (select *, row_number() over (partition by query order by s, file) as rn from r), b as (select *, min(case when rn > 10 then probab end) over (partition by query order by s, file rows between unbounded preceding and current row) as low from a), k as (select *, row_number() over (partition by query order by s, file) as line from b where rn <= 10 or (low >= 20 and ev <= 1)) select query, target, file, line from k where line <= 50",
    "best_per_target": f"with {_CAL}, a as (select *, row_number() over (partition by query, target order by round(score_aass, 6), file) as rn from cal) select query, target, file, round(score, 6) as score from a where rn = 1",
    "topk_floor": f"with {HITS_SQL}, a as (select file, cast(floor(score) as bigint) - cast(floor(log2(q_len) + log2(t_len)) as bigint) as score from hits), b as (select *, row_number() over (order by score desc, file desc) as rn from a) select file, score from b where rn <= 100 or score > 110",
    "prefilter_evalue": f"with {HITS_SQL}, a as (select file, 1e6 * t_len * pow(2.0, -floor(floor(score) / 4)) as e from hits), b as (select *, row_number() over (order by floor(e), file, e) as rank from a) select file, e, rank from b where rank <= 20000 and rank < coalesce((select min(rank) from b where rank > 100 and e > 5), 1000000000)",
    "early_stop_blocks": "with b as (select cast(floor((row_number() over (order by event_id) - 1) / 500) as bigint) as block, 1.0::double / (1.0 + abs(value)) as v from events), s as (select block, count(*) as n, sum(v) as total from b group by 1) select block, n, round(total, 4) as total, block < coalesce((select min(block) from s where total < 100.0), 1000000000) as go_on from s",
    "cluster_reps": "with a as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as x, row_number() over (partition by p_brand order by p_size, p_partkey) as y, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as z from part) select distinct p_brand, p_partkey from a where x = 1 or y = 1 or z = 1",
    "template_preselect": f"with {HITS_SQL}, a as (select query, file, row_number() over (partition by query order by score desc, file) as x, row_number() over (partition by query order by score_ss desc, file) as y, row_number() over (partition by query order by t_neff desc, file) as z from hits) select query, file from a where x <= 5 or y <= 5 or z <= 5",
    "scop_split": "select c_custkey, cast(n_regionkey as varchar) as cl, n_regionkey || '.' || n_nationkey as fold, n_regionkey || '.' || n_nationkey || '.' || c_mktsegment as sfam, n_regionkey || '.' || n_nationkey || '.' || c_mktsegment || '.' || c_custkey as fam from customer join nation on c_nationkey = n_nationkey",
    "relation_level": "select cast(case when cn.n_nationkey = sn.n_nationkey then 2 when cn.n_regionkey = sn.n_regionkey then 1 else 0 end as bigint) as rel, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey group by 1",
    "region_exclusion": "select cast(l_quantity as integer) as pos, count(*) as n from lineitem where cast(l_quantity as integer) between 10 and 19 or cast(l_quantity as integer) between 34 and 49 or cast(l_quantity as integer) > 50 group by 1",
    "seen_split": "select doc_id, lang, doc_id in (select doc_id from labels where quality = 1) as seen from documents",
    "column_score": f"with {_PROF} select label, vec_id, round(s, 6) as s from cs",
    "query_score_table": f"with {_PROF} select label, vec_id, cast(least(255, greatest(0, floor(round(s, 6) * 100 + 50 + 0.5))) as bigint) as byte from cs",
    "profile_entropy": f"with {_PROF}, n as (select vec_id, (p + 0.001) / sum(p + 0.001) over (partition by vec_id) as p from prof) select vec_id as hmm, round(-sum(p * log2(p)), 6) as h from n group by 1",
    # Windows by prefix sums: the 11 columns around one, held at the ends; 10 columns of the prior count along.
    "local_background": f"""with {_PROF}, k as (select vec_id, label, r, p, row_number() over (partition by label, r order by vec_id) as k, count(*) over (partition by label, r) as n, sum(p) over (partition by label, r order by vec_id rows unbounded preceding) as c from prof),
 win as (select *, case when n <= 11 then 1 else greatest(1, least(k - 5, n - 10)) end as lo, case when n <= 11 then n else greatest(1, least(k - 5, n - 10)) + 10 end as hi from k),
 s as (select win.vec_id, win.label, win.r, win.p, win.n, h.c - coalesce(l.c, 0) as s from win join k h on h.label = win.label and h.r = win.r and h.k = win.hi left join k l on l.label = win.label and l.r = win.r and l.k = win.lo - 1)
 select vec_id as i, s.r, round(p / sqrt((s + 10 * nul.n) / (least(s.n, 11) + 10)), 6) as q from s join nul using (r)""",
    "null_models": f"""with {_PROF}, pav as (select label, r, avg(p) as pav from prof group by 1, 2), q as (select r, pav as qav from pav where label = (select min(label) from pav)),
 a as (select vec_id as i, r, p, n, pav, qav, sum(n * p) over (partition by vec_id) as co from prof join nul using (r) join pav using (label, r) join q using (r)),
 u as (select i, r, unnest([0, 1, 2, 3, 10, 11]) as mode, unnest([p / n, p / (0.5 * (qav + pav)), p / pav, p / qav, p / sqrt(co), p]) as q from a) select i, r, cast(mode as integer) as mode, round(q, 5) as q from u""",
    "pseudocount_modes": f"""with {_PROF}, f as (select vec_id as hmm, pow(2.0, -sum(p * log2(p))) / 60.0 as x from prof group by 1), t as (select *, 0.793 + 0.048 * (60.0 - 10.0) as a from f)
 select hmm, 0.0::double as tau_0_0, 0.0::double as tau_0_1, 0.9::double as tau_1_0, 0.9::double as tau_1_1, round(least(1.0, 0.9 / (1 + x)), 8) as tau_2_0, round(least(1.0, 0.9 / (1 + pow(x, 0.5))), 8) as tau_2_1,
 round(greatest(0.0, cast(a as double) * (1 - x + 1.0 * x * (1 - x))), 8) as tau_3_0, round(greatest(0.0, cast(a as double) * (1 - x + 0.5 * x * (1 - x))), 8) as tau_3_1 from t""",
    "transition_pseudocounts": """with a as (select l_orderkey as hmm, l_linenumber - 1 as i, max(l_linenumber - 1) over (partition by l_orderkey) as len, cast(l_discount as double) as d, cast(l_tax as double) as t, l_suppkey % 7 as m, l_suppkey % 3 as ni, l_partkey % 4 as nd, 0.15::double * 0.0286 as o from lineitem),
 w as (select *, m * (1 - d - t) + (1 - 2 * o) as mm, case when i in (0, len) then 0 else m * d + o end as md, case when i in (0, len) then 0 else m * t + o end as mi, ni * (1 - d) + 0.25::double as im, ni * d + 0.75::double as ii, nd * (1 - t) + 0.25::double as dm, case when i = len then 0 else nd * t + 0.75::double end as dd from a)
 select hmm, cast(i as integer) as i, round(log2(mm / (mm + md + mi)), 6) as m2m, round(case when mi > 0 then log2(mi / (mm + md + mi)) * 0.6 end, 6) as m2i, round(case when md > 0 then log2(md / (mm + md + mi)) * 0.6 end, 6) as m2d,
 round(log2(im / (im + ii)), 6) as i2m, round(log2(ii / (im + ii)) * 0.6, 6) as i2i, round(log2(dm / (dm + dd)), 6) as d2m, round(case when dd > 0 then log2(dd / (dm + dd)) * 0.6 end, 6) as d2d from w""",
    "nearest_state": f"with {_PROF}, z as (select vec_id, c.label as state, sum(prof.p * log2(c.p)) + log2(0.1) as z from prof join cen c using (r) group by 1, 2), t as (select vec_id, max(z) as most, sum(pow(2.0, z)) as total from z group by 1), k as (select vec_id, state, z, row_number() over (partition by vec_id order by z desc, state) as rn from z) select vec_id as hmm, cast(state as bigint) as state, round(pow(2.0, z) / total, 6) as post from k join t using (vec_id) where rn = 1",
    "substitution_model": "with j as (select substr(o_orderpriority, 1, 1) as a, substr(o_orderpriority, 3, 1) as b, cast(count(*) as double) as p from orders group by 1, 2), s as (select a, b, sum(p) as p from (select a, b, p from j union all select b, a, p from j) group by 1, 2), n as (select a, b, p / sum(p) over () as p from s), o as (select a, sum(p) as pa from n group by 1) select n.a, n.b, round(n.p, 6) as p, round(x.pa, 6) as pa, round(y.pa, 6) as pb, round(n.p / y.pa, 6) as r, round(log2(n.p / (x.pa * y.pa)), 6) as s from n join o x on n.a = x.a join o y on n.b = y.a",
    "aa_pseudocounts": f"with {_PROF}, nf as (select vec_id, pow(2.0, -sum(p * log2(p))) as neff from prof group by 1), t as (select vec_id, least(1.0, 0.9 / (1.0 + neff / 4.0)) as tau from nf) select vec_id as hmm, r, round((1 - tau) * prof.p + tau * cen.p, 8) as p from prof join cen using (label, r) join t using (vec_id)",
}
QUERIES = {name: globals()[name] for name in SQL}
