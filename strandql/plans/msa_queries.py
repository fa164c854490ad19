"""Alignment and profile operators over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandql.functions.residues import LETTERS
from strandql.operators import msa
from strandql.plans.tables import CELLS_SQL, ROWS_SQL, alignment_rows, cells, table


def flat_prior(spark):
    """The same prior for each of the 20 residues; a caller with a substitution model passes its own."""
    return spark.createDataFrame([(r, 0.05) for r in LETTERS], "r string, prior double")


def _vectors(spark, sf_dir):
    rows = alignment_rows(spark, sf_dir)
    return msa.frequency_vectors(rows, msa.global_weights(rows))


def _even(rows):
    return rows.select("msa", "k", F.lit(1.0).alias("w"))


def msa_validate(spark, sf_dir):
    return msa.validate(alignment_rows(spark, sf_dir))


def endgap_mark(spark, sf_dir):
    return msa.end_gaps(alignment_rows(spark, sf_dir))


def match_gap_rule(spark, sf_dir):
    rows = alignment_rows(spark, sf_dir).withColumn("w", F.lit(1.0))
    return msa.by_gap_share(rows).select("msa", "i", F.round("gap_share", 6).alias("gap_share"), "is_match")


def match_first_rule(spark, sf_dir):
    return msa.by_first(cells(spark, sf_dir))


def insert_count(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.lit("d").alias("msa"), F.col("doc_id").alias("k"), F.regexp_replace("text", "[^A-Za-z]", "-").alias("a3m"))
    return msa.insert_runs(rows, "a3m").drop("msa")


def rle_compress(spark, sf_dir):
    return alignment_rows(spark, sf_dir).select("msa", "k", msa.compressed_text(F.col("row")).alias("blocks"))


def rle_round_trip(spark, sf_dir):
    """Each row compressed and extracted again."""
    rows = alignment_rows(spark, sf_dir).withColumn("blocks", msa.compress(F.col("row"))).withColumn("residues", F.replace("row", F.lit("-"), F.lit("")))
    back = rows.select("msa", "k", msa.extract(F.col("blocks"), F.col("residues")).alias("row"))
    return back.select("msa", "k", F.length("row").cast("long").alias("columns"), F.md5(F.col("row").cast("binary")).alias("md5"))


def henikoff_weights(spark, sf_dir):
    return msa.global_weights(alignment_rows(spark, sf_dir)).select("msa", "k", F.round("w", 8).alias("w"))


def column_freqs(spark, sf_dir):
    return msa.column_frequencies(_vectors(spark, sf_dir)).select("msa", "i", "r", F.round("f", 6).alias("f"))


def match_transitions(spark, sf_dir):
    rows = alignment_rows(spark, sf_dir)
    return msa.match_transitions(rows, msa.global_weights(rows)).select("msa", "i", F.round("mm", 6).alias("mm"), F.round("md", 6).alias("md"))


def delete_transitions(spark, sf_dir):
    rows = alignment_rows(spark, sf_dir)
    return msa.delete_transitions(rows, msa.global_weights(rows)).select("msa", "i", F.round("dm", 6).alias("dm"), F.round("dd", 6).alias("dd"))


def insert_transitions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.lit("d").alias("msa"), F.col("doc_id").alias("k"), F.regexp_replace("text", "[^A-Za-z]", "-").alias("a3m"))
    even = docs.select(F.lit("d").alias("msa"), F.col("doc_id").alias("k"), F.lit(1.0).alias("w"))
    return msa.insert_transitions(msa.insert_runs(rows, "a3m"), even).select("after", F.round("im", 6).alias("im"), F.round("ii", 6).alias("ii"))


def neff_columns(spark, sf_dir):
    return msa.effective_number(_vectors(spark, sf_dir)).select("msa", "i", F.round("neff", 6).alias("neff"))


def neff_alignment(spark, sf_dir):
    both = msa.alignment_numbers(_vectors(spark, sf_dir))
    return both.select("msa", F.round("neff", 6).alias("neff"), F.round("pairs", 6).alias("pairs"))


def background_freqs(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return msa.background(v, flat_prior(spark)).select("msa", "r", F.round("pav", 6).alias("pav"))


def consensus(spark, sf_dir):
    rows = alignment_rows(spark, sf_dir)
    return msa.consensus(msa.frequency_vectors(rows, _even(rows)), flat_prior(spark))


def coverage_filter(spark, sf_dir):
    return msa.coverage(cells(spark, sf_dir), 20)


def query_identity(spark, sf_dir):
    return msa.near_query(alignment_rows(spark, sf_dir), 10)


def query_score(spark, sf_dir):
    scores = spark.createDataFrame([(a, b, 4.0 if a == b else -1.0) for a in LETTERS for b in LETTERS], "a string, b string, s double")
    return msa.scored_by_query(alignment_rows(spark, sf_dir), scores, 0.0)


_RES = CELLS_SQL + """, res as (select msa, k, i, translate(r, 'UBZ', 'CDE') as r from cells where r not in ('-', 'J', 'O', 'X'))"""
_ENDS = """, ends as (select msa, k, min(i) as "first", max(i) as "last", count(*) as nres from cells where r <> '-' group by 1, 2)"""
_W = _RES + """, cnt as (select msa, i, r, count(*) as n from res group by 1, 2, 3), kinds as (select msa, i, count(*) as kinds from cnt group by 1, 2),
 raw as (select res.msa, res.k, sum(1.0::double / (n * kinds)) / (count(*) + 30) + 1e-6 as raw from res join cnt using (msa, i, r) join kinds using (msa, i) group by 1, 2),
 w as (select msa, k, raw / sum(raw) over (partition by msa) as w from raw)"""
_F = _W + """, s as (select msa, i, r, sum(w) as s from res join w using (msa, k) group by 1, 2, 3), f as (select msa, i, r, s / sum(s) over (partition by msa, i) as f from s)"""
_N = _F + """, cn as (select msa, i, pow(2.0, -sum(f * log2(f))) as neff, 1.0 / sum(f * f) as pairs from f group by 1, 2), an as (select msa, avg(neff) as neff, avg(pairs) as pairs from cn group by 1)"""
_FIRST = """, q as (select cells.msa, i, r as q from cells join (select msa, min(k) as k from cells group by 1) using (msa, k))"""
SQL = {
    "msa_validate": f"with {ROWS_SQL} select msa, count(*) as members, min(length(\"row\")) as least, max(length(\"row\")) as most, min(length(\"row\")) = max(length(\"row\")) and min(length(\"row\")) > 0 as valid from rows_ group by 1",
    "endgap_mark": f"with {CELLS_SQL}{_ENDS} select * from ends",
    "match_gap_rule": f"with {CELLS_SQL}{_ENDS}, g as (select msa, i, 100.0::double * count(*) filter (where r = '-') / count(*) as g from cells join ends using (msa, k) where i between \"first\" and \"last\" group by 1, 2) select msa, i, round(g, 6) as gap_share, g <= 50 as is_match from g",
    "match_first_rule": f"with {CELLS_SQL} select msa, i from cells join (select msa, min(k) as k from cells group by 1) using (msa, k) where r <> '-'",
    "insert_count": "with p as (select doc_id as k, regexp_extract_all('-' || regexp_replace(text, '[^A-Za-z]', '-', 'g'), '[A-Z-][^A-Z-]*') as parts from documents), u as (select k, unnest(generate_series(0, len(parts) - 1)) as after, unnest(parts) as part from p) select k, after, length(part) - 1 as n from u where length(part) > 1",
    "rle_compress": f"with {ROWS_SQL}, p as (select msa, k, case when \"row\" = '' then [] else regexp_extract_all(\"row\", '[^-]{{0,127}}-{{1,127}}|[^-]{{1,127}}') end as parts from rows_) select msa, k, array_to_string(list_transform(parts, lambda x: length(replace(x, '-', '')) || ':' || (length(replace(x, '-', '')) - length(x))), ' ') as blocks from p",
    "rle_round_trip": f"with {ROWS_SQL} select msa, k, length(\"row\") as columns, md5(\"row\") as md5 from rows_",
    "henikoff_weights": f"with {_W} select msa, k, round(w, 8) as w from w",
    "column_freqs": f"with {_F} select msa, i, r, round(f, 6) as f from f",
    "match_transitions": f"with {_W}{_ENDS}, n as (select cells.msa, cells.k, i, r, lead(r) over (partition by cells.msa, cells.k order by i) as nx from cells join ends on cells.msa = ends.msa and cells.k = ends.k where i between \"first\" and \"last\"), t as (select msa, i, sum(case when nx <> '-' then w else 0 end) / sum(w) as mm from n join w using (msa, k) where r <> '-' and nx is not null group by 1, 2) select msa, i, round(mm, 6) as mm, round(1 - mm, 6) as md from t",
    "delete_transitions": f"with {_W}{_ENDS}, n as (select cells.msa, cells.k, i, r, lead(r) over (partition by cells.msa, cells.k order by i) as nx from cells join ends on cells.msa = ends.msa and cells.k = ends.k where i between \"first\" and \"last\"), t as (select msa, i, sum(case when nx <> '-' then w else 0 end) / sum(w) as dm from n join w using (msa, k) where r = '-' and nx is not null group by 1, 2) select msa, i, round(dm, 6) as dm, round(1 - dm, 6) as dd from t",
    "insert_transitions": "with p as (select doc_id as k, regexp_extract_all('-' || regexp_replace(text, '[^A-Za-z]', '-', 'g'), '[A-Z-][^A-Z-]*') as parts from documents), u as (select k, unnest(generate_series(0, len(parts) - 1)) as after, unnest(parts) as part from p), t as (select after, cast(count(*) as double) / sum(length(part) - 1) as im from u where length(part) > 1 group by 1) select after, round(im, 6) as im, round(1 - im, 6) as ii from t",
    "neff_columns": f"with {_N} select msa, i, round(neff, 6) as neff from cn",
    "neff_alignment": f"with {_N} select msa, round(neff, 6) as neff, round(pairs, 6) as pairs from an",
    "background_freqs": f"with {_N}, p as (select unnest(string_split('{LETTERS}', '')) as r), b as (select msa, r, coalesce(s, 0) + 100.0 * 0.05 / neff as raw from an cross join p left join (select msa, r, sum(f) as s from f group by 1, 2) using (msa, r)) select msa, r, round(raw / sum(raw) over (partition by msa), 6) as pav from b",
    "consensus": f"with {_RES}, f as (select msa, i, r, cast(count(*) as double) / sum(count(*)) over (partition by msa, i) as f from res group by 1, 2, 3), b as (select *, row_number() over (partition by msa, i order by f - 0.05 desc, r desc) as rn from f) select msa, i, case when f > 0.6 then r when f > 0.4 then lower(r) else 'x' end as c from b where rn = 1",
    "coverage_filter": f"with {_RES}, l as (select msa, max(i) as columns from cells group by 1), n as (select msa, k, count(*) as nres from res group by 1, 2) select msa, k, nres, columns, 100 * nres >= 20 * columns as kept from n join l using (msa)",
    "query_identity": f"with {_RES}, q as (select res.msa, i, r as q from res join (select msa, min(k) as k from cells group by 1) using (msa, k)), d as (select res.msa, res.k, count(*) as nres, count(*) filter (where q is null or q <> r) as differ from res left join q using (msa, i) group by 1, 2) select msa, k, nres, differ, differ < floor((0.9999 - 0.01 * 10) * nres + 0.9999) as kept from d",
    "query_score": f"with {_RES}{_ENDS}{_FIRST}, m as (select cells.msa, cells.k, cells.i, translate(cells.r, 'UBZ', 'CDE') as r, translate(coalesce(q, '-'), 'UBZ', 'CDE') as q from cells join ends on cells.msa = ends.msa and cells.k = ends.k left join q on cells.msa = q.msa and cells.i = q.i where cells.i between \"first\" and \"last\"), st as (select *, case when r not in ('-', 'J', 'O', 'X') and q not in ('-', 'J', 'O', 'X') then 'm' when r not in ('-', 'J', 'O', 'X') and q = '-' then 'q' when r = '-' and q not in ('-', 'J', 'O', 'X') then 'k' end as state from m), c as (select *, case when state = 'm' then case when r = q then 4.0 else -1.0 end when lag(state) over (partition by msa, k order by i) = state then -1.0 else -6.0 end as s from st where state is not null), t as (select msa, k, cast(sum(s) as double) as score from c group by 1, 2), n as (select msa, k, count(*) as nres from res group by 1, 2) select msa, k, score, nres, score >= 0 as kept from t join n using (msa, k)",
}
QUERIES = {name: globals()[name] for name in SQL}
