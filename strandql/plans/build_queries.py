"""Database builds, the filter tool, random fields and matrix entries over the fixed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandql.functions.residues import LETTERS, upper_ascii
from strandql.operators import database, fields, msa, ranking
from strandql.plans.msa_queries import SQL as _MSA
from strandql.plans.tables import alignment_rows, table
from strandql.session import new_folder
from strandql.sources import matrices


def _built(spark, sf_dir):
    """A database of documents in two generations: profiles of good documents beside all alignments; then every seventh is changed, all
    others are given again as they were, and toxic ones go."""
    folder = new_folder(spark, "database")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("payload"))
    labels = table(spark, sf_dir, "labels")
    all_ = docs.select(F.lit("a3m").alias("kind"), "name", "payload")
    good = docs.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").select(F.lit("hhm").alias("kind"), "name", F.concat(F.lit("H"), "payload").alias("payload"))
    database.build(spark, folder, all_.unionByName(good))
    again = docs.select(F.lit("a3m").alias("kind"), "name", F.when(F.col("doc_id") % 7 == 0, upper_ascii(F.col("payload"))).otherwise(F.col("payload")).alias("payload"))
    gone = labels.where("toxic = 1").select(F.explode(F.array(F.lit("a3m"), F.lit("hhm"))).alias("kind"), F.col("doc_id").cast("string").alias("name"))
    database.build(spark, folder, again, gone)
    return folder


def database_open(spark, sf_dir):
    """Each name's entry of the first source that has it, from the last generation."""
    entries = database.by_precedence(database.opened(spark, _built(spark, sf_dir)))
    return entries.select("name", "kind", "generation", F.length("payload").cast("long").alias("size"), F.md5(F.col("payload").cast("binary")).alias("md5"))


def database_stale(spark, sf_dir):
    """Documents whose profile is missing or older than their alignment."""
    return database.stale(database.manifest(spark, _built(spark, sf_dir)), "a3m", "hhm")


def searched_count(spark, sf_dir):
    """Different customers searched after each of three steps, kept as a table: those of urgent orders, of all, and of suppliers' numbers."""
    folder, o = new_folder(spark, "searched"), table(spark, sf_dir, "orders")
    steps = [o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("n")), o.select(F.col("o_custkey").alias("n")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"))]
    totals = [(k, database.searched(spark, folder, s.select(F.concat(F.lit("c"), F.col("n").cast("string")).alias("name")), k)) for k, s in enumerate(steps, 1)]
    return spark.createDataFrame(totals, "step int, searched long")


def filter_tool(spark, sf_dir):
    """All figures of a member, and whether it stays, from one walk along its row."""
    scores = spark.createDataFrame([(a, b, 4.0 if a == b else -1.0) for a in LETTERS for b in LETTERS], "a string, b string, s double")
    out = msa.filter_tool(alignment_rows(spark, sf_dir), scores, 20, 10, -1.0, texts=False)
    return out.select("msa", "k", "nres", "columns", "differ", F.round("score", 6).alias("score"), "kept")


def random_field(spark, sf_dir):
    """Pseudocounts for the names of nations by a field whose states are the types of parts: weights are log shares of a residue at a place
    of their names, modulo five."""
    letters = F.filter(F.split(F.translate(upper_ascii(F.col("p_name")), "UBZ", "CDE"), ""), lambda c: F.lit(LETTERS).contains(c) & (c != ""))
    at = table(spark, sf_dir, "part").select(F.col("p_type").alias("state"), F.posexplode(letters).alias("x", "r"))
    at = at.select("state", (F.col("x") % 5 - 2).alias("d"), "r")
    full = at.select("state").distinct().withColumn("d", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("r", F.explode(F.split(F.lit(LETTERS), ""))).where("r <> ''")
    seen = full.join(at.groupBy("state", "d", "r").agg(F.count("*").alias("n")), ["state", "d", "r"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = seen.groupBy("state", "d").agg(F.sum("n").alias("all"))
    weights = seen.join(total, ["state", "d"]).select("state", "d", "r", (F.log((F.col("n") + 1.0) / (F.col("all") + 20.0)) / 2).alias("w"))
    size = at.groupBy("state").agg(F.count("*").alias("n"))
    bias = size.select("state", F.log(F.col("n").cast("double") / 1000).alias("bias"))
    emits = seen.groupBy("state", "r").agg(F.sum("n").alias("n")).join(size.select("state", F.col("n").alias("all")), "state").select("state", "r", ((F.col("n") + 1.0) / (F.col("all") + 20.0)).alias("pc"))
    names = F.filter(F.split(F.translate(upper_ascii(F.col("n_name")), "UBZ", "CDE"), ""), lambda c: F.lit(LETTERS).contains(c) & (c != ""))
    counts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("hmm"), F.posexplode(names).alias("x", "r")).select("hmm", (F.col("x") + 1).alias("i"), "r", F.lit(1.0).alias("c"))
    post = fields.state_posteriors(fields.window_scores(counts, weights, bias))
    return fields.pseudocounts(post, emits).select("hmm", "i", "r", F.round("pc", 6).alias("pc"))


def _cells(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    cells = lines.select(F.col("l_suppkey").alias("query"), (F.col("l_partkey") % 20).alias("target"), F.lit(1).alias("irep"), F.when(F.col("l_returnflag") == "A", "backward").when(F.col("l_returnflag") == "N", "forward").otherwise("posterior").alias("kind"), F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("int").alias("j"), (F.col("l_discount") * 9).alias("p"))
    return cells.groupBy("query", "target", "irep", "kind", "i", "j").agg(F.max("p").alias("p"))


def matrix_entries(spark, sf_dir):
    """The matrices of hits of suppliers and parts as bytes, in hexadecimal digits."""
    cells = _cells(spark, sf_dir)
    hits = cells.select("query", "target", "irep").distinct().select(
        "query", "target", "irep", F.lit(1).alias("number"), (10 + F.col("query") % 90).cast("double").alias("probab"), (100 + F.col("target") * 200).alias("t_len"), (1 + (F.col("query") % 5) * 0.03).alias("forward"), F.lit(1.0).alias("backward"),
        F.concat(F.lit("part"), F.col("target").cast("string")).alias("name"), ((F.col("target") - 9) / 4).alias("similarity"),
    )
    out = matrices.written(matrices.printable(hits), matrices.matrices(matrices.runs(cells)))
    return out.select("query", "target", F.hex("entry").alias("entry"))


def matrix_runs(spark, sf_dir):
    return matrices.runs(_cells(spark, sf_dir)).drop("irep")


def ranked_templates(spark, sf_dir):
    """Each supplier's ten best order lines by the net that ranks templates."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("target")).agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("e"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    hits = lines.select("query", "target", F.col("q").alias("score"), (F.col("d") * 50).alias("score_ss"), (F.col("e") / 4000).alias("sum_probs"), (F.floor("q") * 2).alias("matched_cols"), (F.col("t") * 10).alias("similarity"), F.lit(40).alias("q_len"))
    return ranking.ranked_templates(hits).select("query", "target", "predicted", "rank")


_DB = """d as (select doc_id, cast(doc_id as varchar) as name, coalesce(text, '') as t from documents), good as (select distinct doc_id from labels where quality = 1), bad as (select distinct doc_id from labels where toxic = 1),
u as (select *, case when doc_id % 7 = 0 then translate(t, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') else t end as now from d where doc_id not in (select doc_id from bad)),
m as (select doc_id, name, 'a3m' as kind, now as p, case when now <> t then 2 else 1 end as generation from u union all select doc_id, name, 'hhm', 'H' || t, 1 from u where doc_id in (select doc_id from good))"""
_CELLS = """c as (select l_suppkey as query, l_partkey % 20 as target, case l_returnflag when 'A' then 'backward' when 'N' then 'forward' else 'posterior' end as kind, l_linenumber as i, cast(l_quantity as integer) as j, max(l_discount * 9) as p from lineitem group by all),
b as (select *, case when p < pow(2.0, -15.9) then 0 else cast(least(255, greatest(1, floor(255.5 + 16 * log2(p)))) as integer) end as b, j - row_number() over (partition by query, target, kind, i order by j) as island from c),
r as (select query, target, kind, i, cast(min(j) as integer) as j, count(*) as n, string_agg(format('{:02X}', b), '' order by j) as bytes from b group by query, target, kind, i, island)"""
_U16 = "format('{{:02X}}', {0} % 256) || format('{{:02X}}', {0} // 256)"
SQL = {
    "database_open": f"with {_DB} select name, kind, cast(generation as integer) as generation, length(p) as size, md5(p) as md5 from m where kind = 'hhm' or doc_id not in (select doc_id from m where kind = 'hhm')",
    "database_stale": f"with {_DB} select name from m group by name having max(case when kind = 'a3m' then generation end) > coalesce(max(case when kind = 'hhm' then generation end), 0)",
    "searched_count": """with s as (select 1 as step, o_custkey as n from orders where o_orderpriority = '1-URGENT' union all select 2, o_custkey from orders union all select 3, s_suppkey from supplier), f as (select n, min(step) as step from s group by 1)
 select cast(k as integer) as step, (select count(*) from f where f.step <= k) as searched from unnest([1, 2, 3]) as t(k)""",
    "filter_tool": f"""with c as ({_MSA["coverage_filter"]}), i as ({_MSA["query_identity"]}), s as ({_MSA["query_score"]}), f as (select c.msa, c.k, c.nres, c.columns, i.differ, s.score, c.kept and i.kept and s.score >= -1.0 * c.nres as kept from c join i using (msa, k) join s using (msa, k))
 select msa, k, nres, columns, differ, round(score, 6) as score, kept or (not bool_or(kept) over (partition by msa) and k = min(k) over (partition by msa)) as kept from f""",
    "random_field": f"""with l as (select p_type as state, list_filter(string_split(translate(upper(p_name), 'UBZ', 'CDE'), ''), lambda x: x <> '' and contains('{LETTERS}', x)) as s from part), cc as (select state, unnest(s) as r, unnest(range(len(s))) % 5 - 2 as d from l),
 a as (select unnest(string_split('{LETTERS}', '')) as r), full_ as (select state, d, r from (select distinct state from cc), (select unnest(range(-2, 3)) as d), a), seen as (select full_.state, full_.d, full_.r, count(cc.r) as n from full_ left join cc using (state, d, r) group by all),
 w as (select state, d, r, ln((n + 1.0::double) / (sum(n) over (partition by state, d) + 20.0::double)) / 2 as w from seen), size as (select state, count(*) as n from cc group by 1), bias as (select state, ln(cast(n as double) / 1000) as bias from size),
 em as (select state, r, (sum(seen.n) + 1.0::double) / (any_value(size.n) + 20.0::double) as pc from seen join size using (state) group by 1, 2),
 q as (select n_nationkey as hmm, list_filter(string_split(translate(upper(n_name), 'UBZ', 'CDE'), ''), lambda x: x <> '' and contains('{LETTERS}', x)) as s from nation), c as (select hmm, unnest(s) as r, unnest(generate_series(1, len(s))) as i from q),
 z as (select x.hmm, x.i, bias.state, any_value(bias) + coalesce(sum(w), 0) as z from c x, bias left join (select c.hmm, c.i - w.d as i, w.state, w.w from c join w using (r)) y on y.hmm = x.hmm and y.i = x.i and y.state = bias.state group by 1, 2, 3),
 p as (select hmm, i, state, exp(z - max(z) over (partition by hmm, i)) as e from z), t as (select hmm, i, r, sum(e * pc) as e from p join em using (state) group by 1, 2, 3)
 select hmm, cast(i as integer) as i, r, round(e / sum(e) over (partition by hmm, i), 6) as pc from t""",
    "ranked_templates": """with h as (select l_suppkey as query, concat_ws(':', l_orderkey, l_linenumber, l_partkey) as target, max(l_quantity) as s, max(l_discount) * 50 as ss, max(l_extendedprice) / 4000 / 40 as p, max(l_quantity) / greatest(1, floor(max(l_quantity)) * 2) as c, max(l_tax) * 10 as m from lineitem group by 1, 2),
 u as (select query, target, 1 / (1 + exp(-(-0.0003129355 * s - 0.01589077 * ss - 2.161848 * p + 0.2226650 * c - 0.4868254 * m + 2.849843))) as a, 1 / (1 + exp(-(0.004035841 * s + 0.08064615 * ss - 16.59731 * p + 0.8745763 * c - 1.147158 * m + 2.111072))) as b,
  1 / (1 + exp(-(0.004432926 * s + 0.04485627 * ss + 16.12531 * p - 6.115551 * c - 3.739336 * m - 10.83691))) as d, 1 / (1 + exp(-(0.08667732 * s + 0.2469719 * ss + 3.679384 * p - 0.8063131 * c - 4.584766 * m - 4.135554))) as e, 1 / (1 + exp(-(-0.8657036 * s - 0.3492344 * ss - 0.1328472 * p - 0.5744038 * c + 0.03360329 * m - 0.4120570))) as f from h),
 o as (select query, target, round(1 / (1 + exp(-(-7.531151 * a - 0.9724150 * b - 2.660009 * d + 0.7692027 * e + 1.438417 * f + 2.0))), 6) as predicted from u)
 select query, target, predicted, cast(rank as integer) as rank from (select *, row_number() over (partition by query order by predicted desc, target) as rank from o) where rank <= 10""",
    "matrix_runs": f"with {_CELLS} select query, target, kind, i, j, n, bytes from r",
    "matrix_entries": f"""with {_CELLS}, h as (select distinct query, target from c where 10 + query % 90 >= 20 and 100 + target * 200 < 4000 and 1 + (query % 5) * 0.03 < 1.1::double),
 m as (select query, target, kind, string_agg({_U16.format("i")} || {_U16.format("j")} || bytes || '00', '' order by i, j) || '0000' as t from r group by 1, 2, 3),
 body as (select query, target, coalesce(max(case when kind = 'backward' then t end), '0000') || coalesce(max(case when kind = 'forward' then t end), '0000') || coalesce(max(case when kind = 'posterior' then t end), '0000') as t from m group by 1, 2),
 n as (select *, cast(floor((target - 9) / 4 * 10) as bigint) as sim from h) select query, target, hex(encode('part' || target)) || '00' || {_U16.format("(100 + target * 200)")} || format('{{:02X}}', 10 + query % 90) || {_U16.format("((sim + 65536) % 65536)")} || t as entry from n join body using (query, target)""",
}
QUERIES = {name: globals()[name] for name in SQL}
