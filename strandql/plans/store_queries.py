"""Store algebra over documents, pages and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandql.functions import strings
from strandql.operators import store
from strandql.plans.tables import documents_store, table


def _names(spark, sf_dir, name="labels", col="doc_id"):
    return table(spark, sf_dir, name).select(F.col(col).cast("string").alias("name"))


def _measured(entries):
    return entries.select("name", F.length("payload").cast("long").alias("size"))


def store_lookup(spark, sf_dir):
    return _measured(store.lookup(documents_store(spark, sf_dir), _names(spark, sf_dir)))


def store_ordinal(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1).alias("ordinal"))
    return store.at_ordinal(documents_store(spark, sf_dir), wanted).select("ordinal", "name", F.length("payload").cast("long").alias("size"))


def store_index(spark, sf_dir):
    return store.index(documents_store(spark, sf_dir))


def store_unlink(spark, sf_dir):
    return _measured(store.unlink(documents_store(spark, sf_dir), _names(spark, sf_dir)))


def store_merge(spark, sf_dir):
    bench = store.store(table(spark, sf_dir, "benchmark"), F.concat(F.lit("b"), F.col("item_id").cast("string")), F.col("text"))
    return _measured(store.merge(documents_store(spark, sf_dir), bench))


def store_reorder(spark, sf_dir):
    order = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("name"), (1_000_000_000 - F.col("doc_id")).alias("pos"))
    return store.reorder(documents_store(spark, sf_dir), order).select("name", "pos", F.length("payload").cast("long").alias("size"))


def store_split_id(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    heads, bodies = store.split_records(pages, "url", "/", 3, F.col("url"), F.col("html"))
    a = heads.groupBy("name").agg(F.count("*").alias("headers"), F.sum(F.length("payload")).alias("header_chars"))
    b = bodies.groupBy("name").agg(F.sum(F.length("payload")).alias("body_chars"))
    return a.join(b, "name")


def store_duplicates(spark, sf_dir):
    by_text = store.store(table(spark, sf_dir, "documents"), F.md5(F.col("text").cast("binary")), F.col("doc_id"))
    return store.duplicates(by_text)


def store_missing(spark, sf_dir):
    return store.missing(_names(spark, sf_dir).withColumn("payload", F.lit("")), _names(spark, sf_dir, "documents"))


def store_overhead(spark, sf_dir):
    return store.overhead(_names(spark, sf_dir, "documents").withColumn("payload", F.lit("")), _names(spark, sf_dir))


def store_unsorted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "source", "doc_id")
    return store.unsorted_runs(docs, "source", "doc_id").select("source", "name", "next_name")


def store_repair(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.length("text").cast("long").alias("size"))
    spare = _names(spark, sf_dir).withColumn("size", F.lit(-1).cast("long"))
    return store.repaired(docs, F.col("size") < 100, spare)


def store_setfilter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("cluster"), F.col("doc_id").cast("string").alias("name"), "lang")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("name"))
    return store.filter_members(docs, toxic, F.col("lang") == "de")


def store_large(spark, sf_dir):
    return store.large(table(spark, sf_dir, "documents"), "source", 30)


def header_ids(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(">db|"), F.regexp_extract("url", "([0-9]+)", 1), F.lit("|x"), F.col("page_id").cast("string"), F.lit(" "), F.col("url")).alias("header"))
    return pages.select("page_id", strings.name_of_header(F.col("header")).alias("name"), strings.short_id(F.col("header")).alias("short_id"), strings.cluster_size(F.col("header")).alias("cluster_size"), strings.is_consensus(F.col("header")).alias("is_consensus"))


def path_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", strings.without_path(u).alias("file"), strings.without_extension(u).alias("stem"), strings.extension(u).alias("extension"), strings.folder(u).alias("folder"))


def text_numbers(spark, sf_dir):
    p = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", strings.first_int(p).alias("first_int"), strings.first_float(F.col("p_retailprice").cast("string")).alias("first_float"), strings.count_char(p, "a").cast("long").alias("n_a"),
        strings.delete_chars(p, "aeiou").alias("consonants"), strings.first_word(p).alias("word1"), strings.word(p, 2).alias("word2"), strings.cut_before(F.col("p_brand"), "#").alias("cut"),
    )


_DOC = "select cast(doc_id as varchar) as name, coalesce(text, '') as payload from documents"
_LAB = "select cast(doc_id as varchar) as name from labels"
SQL = {
    "store_lookup": f"select name, length(payload) as size from ({_DOC}) where name in ({_LAB})",
    "store_ordinal": f"select ordinal, name, length(payload) as size from (select *, row_number() over (order by name) as ordinal from ({_DOC})) where ordinal in (select item_id + 1 from benchmark)",
    "store_index": f"select name, cast(sum(n) over (order by name rows between unbounded preceding and current row) - n as bigint) as \"offset\", cast(n as bigint) as length from (select name, strlen(payload) + 1 as n from ({_DOC}))",
    "store_unlink": f"select name, length(payload) as size from ({_DOC}) where name not in ({_LAB})",
    "store_merge": f"select name, length(payload) as size from ({_DOC}) union all select 'b' || cast(item_id as varchar), length(text) from benchmark",
    "store_reorder": f"select d.name, 1000000000 - l.doc_id as pos, length(payload) as size from ({_DOC}) d join labels l on d.name = cast(l.doc_id as varchar)",
    "store_split_id": "select split_part(url, '/', 3) as name, count(*) as headers, cast(sum(length(url)) as bigint) as header_chars, cast(sum(length(html)) as bigint) as body_chars from pages group by 1",
    "store_duplicates": "select md5(text) as name, count(*) as n from documents group by 1 having count(*) > 1",
    "store_missing": f"select distinct cast(doc_id as varchar) as name from documents where cast(doc_id as varchar) not in ({_LAB})",
    "store_overhead": "select distinct cast(doc_id as varchar) as name from documents where doc_id not in (select doc_id from labels)",
    "store_unsorted": "select source, name, next_name from (select source, cast(doc_id as varchar) as name, lead(cast(doc_id as varchar)) over (partition by source order by doc_id) as next_name from documents) where next_name < name",
    "store_repair": f"with good as (select cast(doc_id as varchar) as name, length(text) as size from documents where length(text) >= 100) select name, size from good union all select name, cast(-1 as bigint) from ({_LAB}) where name not in (select name from good)",
    "store_setfilter": "with m as (select source as cluster, cast(doc_id as varchar) as name, lang, doc_id in (select doc_id from labels where toxic = 1) as hit from documents) select name, cluster, lang from m where (hit or lang = 'de') and cluster in (select cluster from m where hit)",
    "store_large": "with s as (select source, count(*) as n from documents group by 1) select source, n from s where n > 30 union all select min(source), n from s where n = (select max(n) from s) and n <= 30 group by n",
    "header_ids": "select page_id, 'db|' || regexp_extract(url, '([0-9]+)', 1) || '|x' || page_id as name, regexp_extract(url, '([0-9]+)', 1) as short_id, try_cast(nullif(regexp_extract('db|' || regexp_extract(url, '([0-9]+)', 1) || '|x' || page_id || ' ' || url, '^[^|]*\\|[^0-9]*?(-?[0-9]+)', 1), '') as bigint) as cluster_size, false as is_consensus from pages",
    "path_parts": "select page_id, regexp_replace(url, '^.*/', '') as file, regexp_replace(url, '\\.[^./]*$', '') as stem, regexp_extract(url, '\\.([^./]*)$', 1) as extension, regexp_extract(url, '^(.*/)', 1) as folder from pages",
    "text_numbers": "select p_partkey, try_cast(nullif(regexp_extract(p_name, '^[^0-9]*?(-?[0-9]+)', 1), '') as bigint) as first_int, p_retailprice as first_float, length(p_name) - length(replace(p_name, 'a', '')) as n_a, translate(p_name, 'aeiou', '') as consonants, regexp_extract(p_name, '(\\S+)', 1) as word1, coalesce(split_part(trim(p_name), ' ', 2), '') as word2, split_part(p_brand, '#', 1) as cut from part",
}
QUERIES = {name: globals()[name] for name in SQL}
