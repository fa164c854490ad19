"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.llm import bpe, curriculum, decontaminate, html_extract, langid, lexical, licenses, minhash, oracles, quality_gbt, quality_rules, rans, resample, secrets
from strandql.llm.common import crc_bucket, read_table


def tokenizer(name: str) -> str:
    """Where a public vocabulary lies; on every machine from the same installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs, where=crc_bucket("doc_id", 4) != 2)
    guess = docs.select("doc_id", langid.predict_udf(spark, model)("text").alias("p"))
    return guess.select("doc_id", F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "p.lang_pred", "p.score")


def op2_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2, vocab_size=49_408)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), k=2)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with whether it is contaminated, and the items found in it."""
    out = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.score(docs, quality_rules.weights(docs, trusted))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    forest = quality_gbt.train(docs, read_table(spark, sf_dir, "labels"), where=crc_bucket("doc_id", 5) != 0)
    scored = docs.select("doc_id", quality_gbt.score_udf(spark, forest)("text").alias("score"))
    return scored.select("doc_id", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"), F.concat_ws("/", m["matched"].cast("string"), m["words"].cast("string")))), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), spans.alias("spans"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read_table(spark, sf_dir, "documents")))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the training position of their first draw; those that are never drawn stand first, with none."""
    mixed = curriculum.mix(read_table(spark, sf_dir, "documents"))
    first = F.round(F.get("draws", F.lit(0))["position"], 6).alias("first_position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("draws").alias("n_draws"), first).orderBy("first_position", "doc_id")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, stats = lexical.index(read_table(spark, sf_dir, "documents"))
    return lexical.search(table, stats, read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": op1_langid,
        "op2_rans": op2_rans,
        "op3_minhash": op3_minhash,
        "op4_decontaminate": op4_decontaminate,
        "op5_rules": op5_rules,
        "op6_quality": op6_quality,
        "op7_bpe": op7_bpe,
        "op8_licenses": op8_licenses,
        "op9_secrets": op9_secrets,
        "op10_html": op10_html,
        "op11_curriculum": op11_curriculum,
        "op12_resample": op12_resample,
        "op13_lexical": op13_lexical,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
