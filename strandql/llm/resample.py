"""Importance resampling towards a target distribution, by hashed word n-grams.

Words are runs of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case. The n-grams of a batch of
texts are listed by a suffix array over its word ids: suffixes are sorted to the longest n-gram's depth, neighbours'
common prefixes (LCP) part them into runs of one n-gram each, a run is hashed once, and its bucket is scattered back to
all its places. Buckets are counted over the whole raw corpus and the whole target; a bucket's gain is the log ratio of the
two smoothed shares, in whole thousandths of a nat. A document's score is the sum of its n-grams' gains plus a Gumbel
number drawn from its id, so the highest scores are a sample without replacement by importance; the best ``percent`` of
documents of ``min_words`` words or more are drawn and ranked.

A partition is worked through in Arrow batches, with a suffix array for each, so memory is bounded by a batch; a text
lies in one batch whole. What is gathered is ``buckets`` counts a task, and the table of gains is bounded by ``buckets``.

Null and empty texts have no n-gram and weight 0; a null id draws its number as the empty text; repeated rows are
documents of their own, whose equal scores share consecutive ranks; an empty corpus gives an empty table, an empty target
gains that still follow the formula. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandql.llm.common import bounded_batches, numbered, stored
from strandql.llm.wordcodes import word_codes

BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, "2024", 10, 20


def suffix_array(codes: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes sorted by their first ``depth`` words, and how many of these each shares with the one before.
    ends: for each place where its text ends; a suffix that ends sooner comes first. Ranks double in depth each turn."""
    n = len(codes)
    rank, reach = codes.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while reach < depth:
        next_rank = np.full(n, -1, dtype=np.int64)
        inside = np.flatnonzero(np.arange(n) + reach < ends)
        next_rank[inside] = rank[inside + reach]
        order = np.lexsort((next_rank, rank))
        step = (rank[order[1:]] != rank[order[:-1]]) | (next_rank[order[1:]] != next_rank[order[:-1]])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(step))) if n else np.zeros(0, dtype=np.int64)
        reach *= 2
    shared = np.zeros(n, dtype=np.int32)
    same = np.ones(max(0, n - 1), dtype=bool)
    for k in range(depth):
        a, b = order[:-1] + k, order[1:] + k
        same &= (a < ends[order[:-1]]) & (b < ends[order[1:]])
        at = np.flatnonzero(same)
        same[at] = codes[a[at]] == codes[b[at]]
        shared[1:] += same
    return order, shared


def feature_buckets(words: list[bytes], codes: np.ndarray, bounds: np.ndarray, low: int, high: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length n: n, and the bucket of the n-gram at every place (-1: the text ends before it does)."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    order, shared = suffix_array(codes, ends, high)
    for n in range(low, high + 1):
        whole = order + n <= ends[order]
        at, head = order[whole], (shared < n)[whole]
        if len(at):
            head[0] = True
        hashed = np.fromiter((crc32(b" ".join([words[c] for c in codes[p : p + n].tolist()])) % buckets for p in at[head].tolist()), dtype=np.int64, count=int(head.sum()))
        found = np.full(len(codes), -1, dtype=np.int64)
        found[at] = hashed[np.cumsum(head) - 1]
        yield n, found


def bucket_counts(df: DataFrame, low: int, high: int, buckets: int, text_col: str = "text") -> np.ndarray:
    """How many n-grams of all texts fall into each bucket: a row for each bucket and task is summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, at in feature_buckets(*word_codes(b.column(0)), low, high, buckets):
                total += np.bincount(at[at >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of a nat for each bucket: the log ratio of the target's share and the raw corpus', each smoothed by one."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([floor(1000 * log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist())], dtype=np.int64)


def weights(df: DataFrame, table: np.ndarray, low: int = 1, high: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features and weight (sum of gains) of every row of df. table: the gain of each bucket."""
    schema = f"id {df.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, codes, bounds = word_codes(b.column(1))
            count, weight = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64)
            for _, at in feature_buckets(words, codes, bounds, low, high, len(table)):
                one = (at >= 0).astype(np.int64)
                for out, value in ((count, one), (weight, np.where(one, table[at], 0))):
                    sums = np.concatenate(([0], np.cumsum(value)))
                    out += sums[bounds[1:]] - sums[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), pa.array(count), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """id, n_features, weight, score and rank (1, 2, 3, ... of the drawn documents; null for the others), one row per row of docs."""
    bounded_batches(docs.sparkSession)
    table = gains(bucket_counts(docs, low, high, buckets, text_col), bucket_counts(target, low, high, buckets, target_text_col))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = stored(weights(docs, table, low, high, id_col, text_col).withColumn("score", F.col("weight") + noise), "scores")
    enough = F.col("n_words") >= min_words
    # Equal rows are dealt out by a number of their own, so that many of them don't share a range.
    ranked = numbered(scored.where(enough).withColumn("_tie", F.rand(7)), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight").desc(), F.col("_tie")], "rank")
    most = percent * scored.where(enough).count() // 100
    out = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("_tie").unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
