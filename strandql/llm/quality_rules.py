"""Quality rules: a hashed n-gram log-likelihood ratio beside counted rules, in DataFrame operations alone.

Words, and pairs of the last two characters of neighbouring words, are hashed into BUCKETS. Two multinomials over the
buckets are counted: the raw corpus (every document) and a trusted target (documents of a given id list). The score
of a document is the mean log ratio of its n-grams, in whole micro-nats, so that the sum doesn't depend on its
order. A document is kept if no counted rule rejects it and its score reaches a fixed threshold.

Both counts cover whole texts: the raw one of all documents, the target's of all trusted ones. The trusted ids are
broadcast if a count shows few of them, else the join shuffles. The weight table is bounded by BUCKETS.

Null and empty texts have no words and fail by the word count; a text without n-grams scores 0; repeated rows give
repeated rows (they are grouped by id and text hash, and dealt out again by their number); without trusted
documents every score is 0; an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandql.llm.common import stored, text_of

BUCKETS, SMOOTHING, WINDOW = 1 << 16, 1.0, 8
#: Trusted ids that a broadcast may hold.
BROADCAST_IDS = 1_000_000
#: Mean micro-nats an n-gram below which a document is rejected.
THRESHOLD = -120_000
SYMBOLS = "[#*$%&|<>]"
BREAK, BREAKS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"


def _split() -> Column:
    """The words of ``text``; none: an empty array."""
    trimmed = F.btrim("text", F.lit(BREAKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BREAK)).alias("words")


def with_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, fp (hash of the text), text and words (none: an empty array)."""
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return docs.select("id", F.xxhash64("text").alias("fp"), "text", _split())


def repeated_words(df: DataFrame) -> DataFrame:
    """df (with words) and n_repeat_words: words in windows of WINDOW words that the text holds twice or more.

    Windows are compared by 64-bit hashes. Texts without a repeated window stop at counting the distinct ones.
    """
    n = F.size("words")
    last = n - (WINDOW - 1)
    hashes = F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_hashes", hashes)
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    df = df.withColumn("_sorted", F.when(some, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    m = F.size("_sorted")
    pairs = F.zip_with(F.slice("_sorted", F.lit(1), m - 1), F.slice("_sorted", F.lit(2), m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("_at", F.when(some, F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))))
    k = F.size("_at")
    steps = F.zip_with(F.slice("_at", F.lit(1), k - 1), F.slice("_at", F.lit(2), k - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.col("_at").isNull(), 0).otherwise(F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x))
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("_hashes", "_sorted", "_at")


def counted(df: DataFrame) -> DataFrame:
    """df (with text and words) and the counted rules' figures."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    return repeated_words(
        df.withColumns(
            {
                "n_words": F.size("words").cast("long"),
                "word_chars": F.length(F.array_join("words", "")).cast("long"),
                "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            }
        ).drop("_lines")
    )


def _grams() -> tuple[Column, Column]:
    """Buckets of the word at ``pos`` and of its pair with the word before (null at the first word)."""
    end = lambda w: F.substring(w, -2, 2)
    word, before = F.col("word"), F.get("words", F.col("pos") - 1)
    return F.pmod(F.xxhash64(F.lit(1), word), F.lit(BUCKETS)).cast("int"), F.when(F.col("pos") > 0, F.pmod(F.xxhash64(F.lit(2), end(before), end(word)), F.lit(BUCKETS)).cast("int"))


def weights(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket and weight (micro-nats, whole): the log ratio of the trusted and the raw multinomial.
    trusted: a table whose first column holds the ids of trusted documents."""
    ids = trusted.select(F.col(trusted.columns[0]).alias("id")).where("id is not null").distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids.hint("merge")
    # Beyond the bound whole texts move, but not their words.
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    words = docs.join(ids.withColumn("good", F.lit(1)), "id", "left").select("good", _split())
    one, two = _grams()
    each = words.select(F.coalesce("good", F.lit(0)).cast("long").alias("good"), "words", F.posexplode_outer("words").alias("pos", "word")).where("pos is not null").select("good", F.explode(F.array(one, two)).alias("bucket")).where("bucket is not null")
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    counts = stored(counts, "gram-counts")  # at most BUCKETS rows, read three times
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    if not total["target"]:
        return counts.select("bucket", F.lit(0).cast("long").alias("weight"))
    share = lambda c, n: F.log(F.col(c) + SMOOTHING) - log(n + SMOOTHING * BUCKETS)
    return counts.select("bucket", F.round(1e6 * (share("target", total["target"]) - share("raw", total["raw"]))).cast("long").alias("weight"))


def score(df: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """id, the counted figures, base_failed, llr (mean micro-nats an n-gram) and kept, one row per row of df."""
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    docs = counted(with_words(df, id_col, text_col)).select("id", "fp", *figures, "words")
    each = docs.select("id", "fp", *figures, "words", F.posexplode_outer("words").alias("pos", "word"))
    one, two = _grams()
    each = each.select("id", "fp", *figures, (F.coalesce("pos", F.lit(0)) == 0).cast("int").alias("first"), one.alias("b1"), two.alias("b2"))
    side = lambda n: F.broadcast(table.select(F.col("bucket").alias(f"b{n}"), F.col("weight").alias(f"w{n}")))  # noqa: E731  at most BUCKETS rows
    each = each.join(side(1), "b1", "left").join(side(2), "b2", "left")
    summed = each.groupBy("id", "fp", *figures).agg(F.sum(F.coalesce("w1", F.lit(0)) + F.coalesce("w2", F.lit(0))).alias("sum"), (F.count("w1") + F.count("w2")).alias("grams"), F.sum("first").cast("int").alias("rows"))
    llr = F.when(F.col("grams") > 0, F.col("sum") / F.col("grams")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = summed.select("id", *figures, failed.alias("base_failed"), llr.alias("llr"), "rows").withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return out.select(F.explode(F.array_repeat(F.lit(1), F.col("rows"))).alias("_"), F.col("id").alias(id_col), *figures, "base_failed", "llr", "kept").drop("_")
