"""Conversions and round trips of alignment rows, members and stores, over documents and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandql.functions import evd, residues
from strandql.operators import msa, store
from strandql.plans.tables import documents_store, spread, table
from strandql.session import new_folder
from strandql.sources import store_files


def _a3m(spark, sf_dir):
    """Documents as A3M rows: letters as they are, everything else a gap."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return docs.select(F.concat_ws("/", "lang", "source").alias("msa"), F.col("doc_id").alias("k"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "-").alias("row"))


def _sized(df, col="row"):
    return df.select("msa", "k", F.length(col).cast("long").alias("size"), F.md5(F.col(col).cast("binary")).alias("md5"))


def match_states(spark, sf_dir):
    return _a3m(spark, sf_dir).select("msa", "k", residues.match_count(F.col("row")).cast("long").alias("n"))


def drop_inserts(spark, sf_dir):
    return _sized(_a3m(spark, sf_dir).withColumn("row", msa.without_inserts(F.col("row"))))


def match_subrange(spark, sf_dir):
    return _sized(_a3m(spark, sf_dir).withColumn("row", msa.subrange(F.col("row"), 3, 40)))


def residue_codes(spark, sf_dir):
    """The symbols of all texts by their code, form and letter."""
    one = table(spark, sf_dir, "part").select(F.explode(F.split(F.concat("p_name", F.lit("-._ \t*7UBZJOXubzjox")), "")).alias("c")).where("c <> ''")
    c = F.col("c")
    out = one.select(c, residues.code(c).alias("code"), residues.letter(residues.code(c)).alias("letter"), residues.as_match(c).alias("up"), residues.as_insert(c).alias("low"), residues.is_word(c).alias("word"))
    return out.groupBy("c", "code", "letter", "up", "low", "word").agg(F.count("*").alias("n"))


def structure_codes(spark, sf_dir):
    """Structure symbols, and digits of confidence, of the letters of part names."""
    one = table(spark, sf_dir, "part").select(F.explode(F.split(F.concat("p_name", F.lit("-.HESTGBIC~09")), "")).alias("c")).where("c <> ''")
    c = F.col("c")
    return one.select(c, F.coalesce(residues.structure_code(c), F.lit(-1)).alias("dssp"), residues.structure_letter(residues.structure_code(c)).alias("back"), residues.eight_to_three(c).alias("three"), F.coalesce(residues.confidence_code(c), F.lit(-1)).alias("conf")).groupBy("c", "dssp", "back", "three", "conf").agg(F.count("*").alias("n"))


def merge_members(spark, sf_dir):
    """Parts of a brand by name: those of even size, and after them what the others have that is new."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("msa"), F.concat_ws("/", "p_name", F.col("p_size") % 7).alias("header"), F.col("p_type").alias("row"), "p_size")
    return msa.merge_columns(p.where("p_size % 2 = 0").drop("p_size"), p.where("p_size % 2 = 1").drop("p_size"))


def reorder_members(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("msa"), F.col("p_partkey").alias("header"), F.col("p_name").alias("row"))
    order = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_brand").alias("msa"), F.col("p_partkey").alias("header"), (100 - F.col("p_size")).alias("pos"))
    return msa.rearranged(p, order)


def stored_members(spark, sf_dir):
    """Members as blocks against their full sequences, and back. A sequence is the row's residues with some before them."""
    rows = _a3m(spark, sf_dir).withColumn("row", residues.upper_ascii(F.col("row"))).withColumn("entry", F.col("k"))
    sequences = rows.select("entry", F.concat(F.lit("WW"), F.replace("row", F.lit("-"), F.lit(""))).alias("residues"))
    return _sized(msa.extracted_members(msa.compressed_members(rows, sequences), sequences))


def never_empty(spark, sf_dir):
    """Parts larger than the limit of their brand, the first one where none is."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("msa"), F.col("p_partkey").alias("k"), (F.col("p_size") >= 49).alias("kept"))
    return msa.never_empty(p).where("kept").select("msa", "k")


def weighted_gap_rule(spark, sf_dir):
    """The gap rule with weights that differ between members."""
    rows = msa.text_rows(table(spark, sf_dir, "part"), F.col("p_brand"), F.col("p_partkey"), F.col("p_name")).withColumn("w", (1 + F.col("k") % 5).cast("double"))
    return msa.by_gap_share(rows, 30).select("msa", "i", F.round("gap_share", 6).alias("gap_share"), "is_match")


def weighted_inserts(spark, sf_dir):
    rows = _a3m(spark, sf_dir).withColumnRenamed("row", "a3m")
    runs = msa.insert_runs(rows, "a3m")
    return msa.insert_transitions(runs, rows.select("msa", "k", (1 + F.col("k") % 5).cast("double").alias("w"))).select("msa", "after", F.round("im", 6).alias("im"), F.round("ii", 6).alias("ii"))


def probabilities(spark, sf_dir):
    """Scores of order lines as probabilities, local or global, with structure scores or without."""
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (-(F.col("l_quantity") * 2 - F.col("l_extendedprice") % 37)).alias("s"))
    return s.select("l_orderkey", "l_linenumber", *(F.round(evd.probability(F.col("s"), loc, ss), 6).alias(f"p_{int(loc)}{int(ss)}") for loc in (True, False) for ss in (True, False)))


def store_files_round_trip(spark, sf_dir):
    """Documents as a flat data file with its index, and read back."""
    folder = new_folder(spark, "flat-store")
    entries = documents_store(spark, sf_dir)
    store_files.write_store(entries, folder)
    sizes = store_files.read_index(spark, f"{folder}/index").select("name", "offset", "length")
    back = store_files.read_store(spark, f"{folder}/data", f"{folder}/index")
    return sizes.join(back, "name").select("name", "offset", "length", F.md5(F.col("payload").cast("binary")).alias("md5"))


def store_named(spark, sf_dir):
    """Templates by name: documents that labels mark as good, and their sizes."""
    names = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("name"))
    return store.lookup(documents_store(spark, sf_dir), names).select("name", F.octet_length("payload").cast("long").alias("size"))


def long_hits(spark, sf_dir):
    """Orders as alignments of as many columns as they have lines."""
    from strandql.operators import dp

    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("matched_cols"))
    return dp.long_enough(lines, 6)


_A3M = """a3m as (select concat_ws('/', lang, source) as msa, doc_id as k, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '-', 'g') as "row" from documents)"""
_SIZED = """msa, k, length("row") as size, md5("row") as md5"""
# The constants of the four curves, written out here as they were published: (local, with structure) to squared factor, width, squared factor, width.
_PROB = {
    key: f"case when -s > 200 then 100.0::double else 100.0 / (1 + pow(sqrt({a}::double) * exp(s / {b}) + sqrt({c}::double) * exp(s / {d}), 2)) end"
    for key, a, b, c, d in (((True, True), 6000.0, 5.0, 0.12, 64.0), ((True, False), 4000.0, 5.0, 0.15, 68.0), ((False, True), 4000.0, 6.0, 0.13, 68.0), ((False, False), 6000.0, 5.0, 0.10, 74.0))
}
SQL = {
    "match_states": f"""with {_A3M} select msa, k, length(regexp_replace("row", '[a-z]', '', 'g')) as n from a3m""",
    "drop_inserts": f"""with {_A3M}, b as (select msa, k, regexp_replace("row", '[a-z]', '', 'g') as "row" from a3m) select {_SIZED} from b""",
    "match_subrange": f"""with {_A3M}, p as (select msa, k, list_slice(regexp_extract_all("row", '[A-Z-][a-z]*'), 3, 40) as p from a3m), b as (select msa, k, regexp_replace(array_to_string(p, ''), '[a-z]*$', '') as "row" from p) select {_SIZED} from b""",
    "residue_codes": """with c as (select unnest(string_split(p_name || '-._ ' || chr(9) || '*7UBZJOXubzjox', '')) as c from part), d as (select c, case when upper(c) in ('J', 'O', 'X') then 20 when c in ('-', '.', '_') then 21 when c in (' ', chr(9)) then -1
  when translate(upper(c), 'UBZ', 'CDE') in ('A', 'R', 'N', 'D', 'C', 'Q', 'E', 'G', 'H', 'I', 'L', 'K', 'M', 'F', 'P', 'S', 'T', 'W', 'Y', 'V') then instr('ARNDCQEGHILKMFPSTWYV', translate(upper(c), 'UBZ', 'CDE')) - 1 else -2 end as code from c where c <> '')
 select c, cast(code as integer) as code, case when code between 0 and 19 then substr('ARNDCQEGHILKMFPSTWYV', cast(code as integer) + 1, 1) when code = 20 then 'X' when code = 21 then '-' else '?' end as letter,
 case when c = '.' then '-' else upper(c) end as up, case when c = '-' then '.' else lower(c) end as low, regexp_matches(c, '^[A-Za-z]$') as word, count(*) as n from d group by all""",
    "structure_codes": """with c as (select unnest(string_split(p_name || '-.HESTGBIC~09', '')) as c from part) select c, cast(coalesce(d, -1) as integer) as dssp, case when d is not null then substr('-HESTGBI', cast(d as integer) + 1, 1) end as back,
 case when upper(c) in ('H', 'E') then upper(c) when upper(c) in ('G', 'I') then 'H' when upper(c) = 'B' then 'E' when upper(c) in ('S', 'T', 'C', ' ', '~') then 'C' else '-' end as three,
 case when c between '0' and '9' then cast(ascii(c) - 47 as integer) when c in ('-', '.') then 0 else -1 end as conf, count(*) as n
 from (select c, case when c in ('-', '.', '_') then 0 when instr('-HESTGBI', upper(c)) > 0 then instr('-HESTGBI', upper(c)) - 1 end as d from c where c <> '') group by all""",
    "merge_members": """with p as (select p_brand as msa, p_name || '/' || (p_size % 7) as header, p_type as "row", p_size from part) select msa, header, "row" from p where p_size % 2 = 0
 union all select msa, header, "row" from p where p_size % 2 = 1 and (msa, header) not in (select (msa, header) from p where p_size % 2 = 0)""",
    "reorder_members": """select p_brand as msa, p_partkey as header, p_name as "row", 100 - p_size as pos from part where p_size > 10""",
    "stored_members": f"""with {_A3M}, b as (select msa, k, upper("row") as "row" from a3m) select {_SIZED} from b""",
    "never_empty": """select p_brand as msa, p_partkey as k from part where p_size >= 49 union all select p_brand, min(p_partkey) from part group by 1 having max(p_size) < 49""",
    "weighted_gap_rule": """with r as (select p_brand as msa, p_partkey as k, 1 + p_partkey % 5 as w, regexp_replace(upper(p_name), '[^A-Z]', '-', 'g') as "row" from part), c as (select msa, w, unnest(generate_series(1, length("row"))) as i, unnest(string_split("row", '')) as r, length("row") - length(ltrim("row", '-')) + 1 as a, length(rtrim("row", '-')) as b from r)
 select msa, i, round(100.0::double * sum(case when r = '-' then w else 0 end) / sum(w), 6) as gap_share, 100.0 * sum(case when r = '-' then w else 0 end) <= 30 * sum(w) as is_match from c where i between a and b group by 1, 2""",
    "weighted_inserts": f"""with {_A3M}, p as (select msa, k, regexp_extract_all('-' || "row", '[A-Z-][a-z]*') as parts from a3m), u as (select msa, 1 + k % 5 as w, unnest(generate_series(0, len(parts) - 1)) as after, unnest(parts) as part from p),
 t as (select msa, after, cast(sum(w) as double) / sum(w * (length(part) - 1)) as im from u where length(part) > 1 group by 1, 2) select msa, after, round(im, 6) as im, round(1 - im, 6) as ii from t""",
    "probabilities": "with a as (select l_orderkey, l_linenumber, -(l_quantity * 2 - fmod(l_extendedprice, 37)) as s from lineitem) select l_orderkey, l_linenumber, " + ", ".join(f"round({_PROB[loc, ss]}, 6) as p_{int(loc)}{int(ss)}" for loc in (True, False) for ss in (True, False)) + " from a",
    "store_files_round_trip": """with e as (select cast(doc_id as varchar) as name, md5(coalesce(text, '')) as md5, octet_length(encode(coalesce(text, ''))) + 1 as length from documents) select name, cast(sum(length) over (order by name rows unbounded preceding) - length as bigint) as "offset", cast(length as bigint) as length, md5 from e""",
    "store_named": """select cast(doc_id as varchar) as name, octet_length(encode(coalesce(text, ''))) as size from documents where doc_id in (select doc_id from labels where quality = 1)""",
    "long_hits": "select l_orderkey, count(*) as matched_cols from lineitem group by 1 having count(*) >= 6",
}
QUERIES = {name: globals()[name] for name in SQL}
