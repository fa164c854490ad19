"""Benchmark decontamination by spaced seeds, in DataFrame operations alone.

Words are runs of letters and digits, in lower case. A mask is a fixed pattern over at most SPAN neighbouring words of
which only the marked ones are hashed, so a word that was exchanged at an unmarked place doesn't hide a passage. Hashes
of all places of the test items meet those of all places of the documents; along each hit's diagonal the words of
both are compared. A document is contaminated by an item if OVERLAP aligned words in a row hold at least MATCHES equal ones.

Items of fewer than SPAN words, down to a single one, are found as a whole and exactly.

The seeds of the test items are broadcast if a count shows few of them, else the join shuffles. Hits are reduced to one row
for each document and item before they move. Null and empty texts have no words; repeated rows get equal results;
an empty benchmark contaminates nothing. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandql.llm.common import dropped, stored, text_of

#: Marked places of the fixed masks, each over at most SPAN words. Together they leave a seed in every overlap that counts:
#: 13 words whichever two are exchanged, 12 or 11 whichever one is, and 10 equal ones (an item of 11 words cut short).
SPAN = 11
MASKS = [(0, 1, 2, 3, 5, 6, 7), (0, 1, 4, 6, 7, 8, 9), (0, 1, 3, 4, 7, 9, 10)]
OVERLAP, MATCHES = 13, 11
#: Seeds, items, and words of the hits' items that a broadcast may hold.
BROADCAST_SEEDS, BROADCAST_ITEMS, BROADCAST_WORDS = 1_000_000, 10_000, 2_000_000


def _split(text_col: str) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text_of(text_col)), r"[^\p{L}\p{N}]+", " ")), " ")


def _few(df: DataFrame, limit: int) -> DataFrame:
    """df, marked for broadcast if a count shows at most limit rows; else the join shuffles it."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, fp (hash of the text) and words."""
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("fp"), _split(text_col).alias("words"))


def _hash(mask: tuple[int, ...], number: int, pos: str = "pos") -> Column:
    """Hash of the words at a mask's marked places from pos on; null where the words end before it does."""
    return F.when(F.col(pos) + (mask[-1] + 1) <= F.size("words"), F.xxhash64(F.lit(number), *(F.get("words", F.col(pos) + k) for k in mask)))


def _seeds(df: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """The places of df's words with their seed hash under every mask."""
    at = df.select("*", F.posexplode_outer("words").alias("pos", "_word")).drop("_word")
    return at.select("*", F.posexplode_outer(F.array(*(_hash(m, k) for k, m in enumerate(masks)))).alias("mask", "seed")).where("seed is not null")


def _compared(hit: Column) -> Column:
    """item, equal (most equal words of OVERLAP aligned ones in a row along the diagonal, as far as both texts reach) and
    n (the item's words) of a hit in the row's words."""
    a, b = F.greatest(F.lit(0), hit["diagonal"]), F.greatest(F.lit(0), -hit["diagonal"])
    n = F.least(F.size("words") - a, F.size(hit["item_words"]) - b)
    same = F.zip_with(F.slice("words", a + 1, n), F.slice(hit["item_words"], b + 1, n), lambda x, y: (x == y).cast("int"))
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (OVERLAP - 1))), lambda i: F.aggregate(F.slice(same, i, OVERLAP), F.lit(0), lambda s, x: s + x))
    return F.struct(hit["item"].alias("item"), F.array_max(sums).alias("equal"), F.size(hit["item_words"]).alias("n"))


def hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, fp, item and best (most equal words of OVERLAP aligned ones) of every contaminated document and item."""
    items = _words(bench, item_col, item_text_col).withColumn("n", F.size("words"))
    items = items.where((F.col("n") > 1) | (F.get("words", F.lit(0)) != ""))
    # Short items are whole masks of their own length: at most SPAN - 1 of them.
    lengths = [r["n"] for r in items.where(F.col("n") < SPAN).select("n").distinct().orderBy("n").collect()]
    masks = MASKS + [tuple(range(n)) for n in lengths]
    known = _seeds(items, masks)
    whole = F.element_at(F.array(*(F.lit(len(m) if k >= len(MASKS) else 0) for k, m in enumerate(masks))), F.col("mask") + 1)
    known = known.where((F.col("n") >= SPAN) & (whole == 0) | (F.col("n") == whole)).select("seed", F.col("id").alias("item"), F.col("pos").alias("item_pos"))
    known = _few(known, BROADCAST_SEEDS)
    # One row for each document, item and diagonal: the words stay behind.
    diagonal = (F.col("pos") - F.col("item_pos")).alias("diagonal")
    found = _seeds(_words(docs, id_col, text_col), masks).select("id", "fp", "pos", "seed").join(known, "seed").select("id", "fp", "item", diagonal).distinct()
    found = stored(found, "seed-hits")

    # Each document's hits are gathered, so its text is split once and none of its words is copied for a hit.
    texts = items.select(F.col("id").alias("item"), F.col("words").alias("item_words"))
    met = found.join(_few(texts, BROADCAST_ITEMS), "item")
    size = met.agg(F.sum(F.size("item_words"))).first()[0] or 0
    hit = met.groupBy("id", "fp").agg(F.collect_list(F.struct("item", "diagonal", "item_words")).alias("hits"))
    hit = hit.select(F.col("id").alias("hit_id"), F.col("fp").alias("hit_fp"), "hits")
    hit = F.broadcast(hit) if size <= BROADCAST_WORDS else hit
    own = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("fp", F.xxhash64("text"))
    met = own.join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("fp") == F.col("hit_fp"))).select("id", "fp", "hits", _split("text").alias("words"))
    best = met.select("id", "fp", F.explode(F.transform("hits", _compared)).alias("h")).select("id", "fp", "h.*").groupBy("id", "fp", "item").agg(F.max("equal").alias("best"), F.max("n").alias("n"))
    # An item shorter than OVERLAP words needs the same share of its own; one shorter than SPAN was found as a whole.
    enough = F.col("best") * OVERLAP >= MATCHES * F.least(F.lit(OVERLAP), F.greatest(F.lit(SPAN), F.col("n")))
    best = stored(best.where(enough | (F.col("n") < SPAN)).drop("n"), "contaminated")
    dropped(docs.sparkSession, found)
    return best


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, contaminated, n_items, best and items (ids of the items found, in order), one row per row of docs."""
    by_doc = hits(docs, bench, id_col, text_col, item_col, item_text_col).groupBy("id", "fp").agg(F.count("*").alias("n_items"), F.max("best").cast("long").alias("best"), F.sort_array(F.collect_list("item")).alias("items"))
    own = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(text_of(text_col)).alias("own_fp"))
    met = own.join(by_doc, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_fp") == F.col("fp")), "left")
    zero = F.lit(0).cast("long")
    return met.select(F.col("own_id").alias(id_col), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("best", zero).alias("best"), F.coalesce("items", F.array().cast(by_doc.schema["items"].dataType)).alias("items"))
