"""Ranked lexical search over a two-level quantised index.

``index`` turns every batch of documents into a block: its terms, and for each the documents that hold it with how often
(level two, exact) and with one byte, the term's saturated frequency in steps of STEP rounded upward (level one). A
term's weight times byte times STEP never lies below its exact share of the score, and with the byte less one never above it.

``search`` takes the queries in tiles. First the bytes alone are read: each task keeps, for each query, the ``top`` best lower
bounds of its blocks; the ``top``-th best of all tasks is the query's threshold. Then every document whose upper bound
reaches the threshold is scored exactly in whole numbers, so nothing that belongs in the answer is lost; again a task keeps
``top`` for each query, by score and then by least id, and these are ranked. No pair of a query and a document leaves a task
but those, and no block, query or copy of a text is a group of its own.

Terms are runs of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case. Null and empty texts have
no term and are no document of the statistics; an item without terms, or whose terms no document holds, has no row. Repeated documents
are documents of their own with equal scores, repeated items are ranked each by itself, null ids come after all
others among equal scores; an empty table of documents or items gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandql.llm.common import bounded_batches, stored
from strandql.llm.wordcodes import word_codes
from strandql.session import few

TOP, TILE = 50, 512
#: Scores are in parts of SCALE; SATURATION and LENGTH are k1 and b of the usual formula, in tenths and hundredths.
SCALE, SATURATION, LENGTH = 1_000_000_000, 20, 50
#: One step of a byte: 255 of them reach the largest saturated frequency, SCALE / 1000.
STEP = -(-SCALE // 1000 // 255)
#: Documents of a block at most; its texts are bounded by an Arrow batch. Places in a block fit two bytes.
BLOCK = 4096
NO_ID = (1 << 63) - 1

_BLOCK = "docs long, words long, terms array<binary>, held array<int>, starts binary, places binary, counts binary, ids binary, sizes binary"


class Stats(NamedTuple):
    """Documents with a term, and all terms with repeats."""

    docs: int
    words: int

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        """A document's length norm m in hundredths."""
        return 100 - LENGTH + (LENGTH * sizes * self.docs) // self.words

    def weight(self, held: int) -> int:
        """The weight of a term that so many documents hold."""
        return int(np.floor(1000 * np.log((2.0 * self.docs + 2) / (2.0 * held + 1))))


def saturated(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return (SCALE * counts) // (1000 * counts + SATURATION * lengths)


def blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Level two: a row for each block of documents, with exact frequencies and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                n = part.num_rows
                words, codes, bounds = word_codes(part.column(1))
                sizes = np.diff(bounds)
                keys, counts = np.unique(codes.astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)
                starts = np.searchsorted(keys, np.arange(len(words) + 1) * n).astype("<i4")
                ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
                row = [int((sizes > 0).sum()), int(sizes.sum()), words, np.diff(starts).tolist(), starts.tobytes(), (keys % n).astype("<u2").tobytes(), counts.astype("<u4").tobytes(), ids.tobytes(), sizes.astype("<i8").tobytes()]
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["docs", "words", "terms", "held", "starts", "places", "counts", "ids", "sizes"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _BLOCK)


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Stats]:
    """The stored index of all rows of df, and its statistics: the blocks with ``impacts``, the bytes of level one, added."""
    bounded_batches(df.sparkSession)
    exact = stored(blocks(df, id_col, text_col), "postings")
    s = exact.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    stats = Stats(s["docs"] or 0, s["words"] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bytes_ = []
            for places, counts, sizes in zip(*(b.column(c).to_pylist() for c in ("places", "counts", "sizes"))):
                lengths = stats.lengths(np.frombuffer(sizes, dtype="<i8")) if stats.words else np.zeros(0, dtype=np.int64)
                q = saturated(np.frombuffer(counts, dtype="<u4").astype(np.int64), lengths[np.frombuffer(places, dtype="<u2")])
                bytes_.append((-(-q // STEP)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bytes_, pa.binary())], names=[*b.schema.names, "impacts"])

    both = stored(exact.mapInArrow(run, _BLOCK + ", impacts binary"), "index")
    return both, stats


class Tile(NamedTuple):
    """Queries that go through the index together: the terms of all, and each one's (places in terms, weights)."""

    terms: pa.Array
    queries: list[tuple[np.ndarray, np.ndarray]]


def tiles(items: DataFrame, found: DataFrame, stats: Stats, size: int) -> Iterator[tuple[Tile, list]]:
    """Tiles of queries and their items' numbers. items: stored (item, terms); found: (term, held) of the index."""
    weighed = items.select("item", F.explode("terms").alias("term")).join(few(found), "term").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "held"))).alias("terms"))
    weighed = stored(weighed.withColumn("tile", F.pmod(F.xxhash64("item"), F.lit(max(1, -(-items.count() // size)))).cast("int")), "queries")
    for t in sorted(r["tile"] for r in weighed.select("tile").distinct().collect()):
        rows = weighed.where(F.col("tile") == t).orderBy("item").collect()  # about ``size`` queries
        terms = sorted({bytes(x["term"]) for r in rows for x in r["terms"]})
        place = {x: k for k, x in enumerate(terms)}
        queries = [(np.array([place[bytes(x["term"])] for x in r["terms"]]), np.array([stats.weight(x["held"]) for x in r["terms"]], dtype=np.int64)) for r in rows]
        yield Tile(pa.array(terms, pa.binary()), queries), [r["item"] for r in rows]


class Block:
    """The level-one postings that one block has for a tile's terms."""

    def __init__(self, tile: Tile, row: dict):
        self.starts, places = np.frombuffer(row["starts"], dtype="<i4"), np.frombuffer(row["places"], dtype="<u2")
        impacts = np.frombuffer(row["impacts"], dtype=np.uint8)
        self.size = row["size"]
        self.at = pc.index_in(tile.terms, value_set=pa.array(row["terms"], pa.binary())).fill_null(-1).to_numpy().tolist()
        self.lists: dict[int, tuple[np.ndarray | None, np.ndarray, int]] = {}
        for t, k in enumerate(self.at):
            if k >= 0:
                own, value = places[self.starts[k] : self.starts[k + 1]], impacts[self.starts[k] : self.starts[k + 1]].astype(np.int64)
                most = int(value.max())
                if 8 * len(own) > self.size:  # a term of many documents is added as a whole row
                    row_ = np.zeros(self.size, dtype=np.int64)
                    row_[own] = value
                    self.lists[t] = None, row_, most
                else:
                    self.lists[t] = own, value, most
        self.work = np.empty(self.size, dtype=np.int64)

    def bounds(self, terms: np.ndarray, weights: np.ndarray, less: int, least: int = 0) -> np.ndarray | None:
        """Every document's sum of weight times byte less ``less``, in steps. None: no document can reach ``least``."""
        have = [(self.lists[t], w) for t, w in zip(terms.tolist(), weights.tolist()) if t in self.lists]
        if sum(w * most for (_, _, most), w in have) < max(1, least):
            return None
        total = np.zeros(self.size, dtype=np.int64)
        for (own, value, _), w in have:
            if own is None:
                np.subtract(value, less, out=self.work)
                np.maximum(self.work, 0, out=self.work)
                self.work *= w
                total += self.work
            else:
                total[own] += w * np.maximum(value - less, 0)
        return total


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    for k in range(b.num_rows):
        yield b.slice(k, 1).to_pylist()[0]


def thresholds(table: DataFrame, tile: Tile, top: int) -> list[int]:
    """For each query the top-th best lower bound of all documents, in steps; 0 where fewer have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(tile.queries), top), dtype=np.int64)
        for b in batches:
            for row in _rows(b):
                block = Block(tile, row)
                for q, (terms, weights) in enumerate(tile.queries):
                    low = block.bounds(terms, weights, 1, int(best[q, 0]))
                    if low is not None:
                        low = low[low > best[q, 0]]
                        if len(low):
                            best[q] = np.sort(np.concatenate((best[q], low)))[-top:]
        q, k = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[q, k])], names=["query", "low"])

    got = table.select("terms", "starts", "places", "impacts", (F.length("sizes") / 8).cast("int").alias("size")).mapInArrow(run, "query int, low long")
    got = got.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.col("low").desc()))).where(F.col("n") <= top)
    out = [0] * len(tile.queries)
    for r in got.groupBy("query").agg(F.count("*").alias("n"), F.min("low").alias("low")).where(F.col("n") == top).collect():
        out[r["query"]] = r["low"]
    return out


def rescored(table: DataFrame, stats: Stats, tile: Tile, least: list[int], top: int) -> DataFrame:
    """query, doc_id and exact score of each task's ``top`` best among the documents whose upper bound reaches the query's ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A query's best so far, as (-score, id) in order: the last one is what a further document has to beat.
        best = [np.zeros((2, 0), dtype=np.int64) for _ in tile.queries]
        for b in batches:
            for row in _rows(b):
                block = Block(tile, row)
                places, counts = np.frombuffer(row["places"], dtype="<u2"), np.frombuffer(row["counts"], dtype="<u4")
                ids, lengths = np.frombuffer(row["ids"], dtype="<i8"), stats.lengths(np.frombuffer(row["sizes"], dtype="<i8"))
                for q, (terms, weights) in enumerate(tile.queries):
                    high = block.bounds(terms, weights, 0, least[q])
                    if high is None:
                        continue
                    met = np.flatnonzero(high >= max(1, least[q]))
                    if not len(met):
                        continue
                    score = np.zeros(len(met), dtype=np.int64)
                    for t, w in zip(terms.tolist(), weights.tolist()):
                        k = block.at[t]
                        if k >= 0:
                            own, count = places[block.starts[k] : block.starts[k + 1]], counts[block.starts[k] : block.starts[k + 1]]
                            at = np.minimum(np.searchsorted(own, met), len(own) - 1)
                            hit = own[at] == met
                            score[hit] += w * saturated(count[at[hit]].astype(np.int64), lengths[met[hit]])
                    some = score > 0
                    both = np.concatenate((best[q], np.stack((-score[some], ids[met[some]]))), axis=1)
                    best[q] = both[:, np.lexsort((both[1], both[0]))[:top]]
        query = np.repeat(np.arange(len(best), dtype=np.int32), [x.shape[1] for x in best])
        all_ = np.concatenate(best, axis=1) if best else np.zeros((2, 0), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(all_[1]), pa.array(-all_[0])], names=["query", "doc_id", "score"])

    wide = table.select("terms", "starts", "places", "impacts", "counts", "ids", "sizes", (F.length("sizes") / 8).cast("int").alias("size"))
    return wide.mapInArrow(run, "query int, doc_id long, score long")


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item (a number), item_id and terms (distinct) of every row of items, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, codes, bounds = word_codes(b.column(1))
            terms = [[words[c] for c in np.unique(codes[x:y]).tolist()] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])

    kind = items.schema[item_col].dataType.simpleString()
    out = items.select(F.col(item_col), F.col(text_col).cast("string")).mapInArrow(run, f"item_id {kind}, terms array<binary>")
    return stored(out.withColumn("item", F.monotonically_increasing_id()), "items")


def search(table: DataFrame, stats: Stats, items: DataFrame, top: int = TOP, tile_size: int = TILE, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` best documents of an index."""
    spark: SparkSession = table.sparkSession
    own = item_terms(items, item_col, text_col)
    out = []
    if stats.docs:
        vocabulary = own.select(F.explode("terms").alias("term")).distinct()
        held = table.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).select("t.terms", "t.held").join(few(vocabulary), F.col("terms") == F.col("term"), "left_semi")
        held = stored(held.groupBy(F.col("terms").alias("term")).agg(F.sum("held").alias("held")), "held")
        for tile, numbers in tiles(own, held, stats, tile_size):
            got = rescored(table, stats, tile, thresholds(table, tile, top), top)
            names = spark.createDataFrame(list(enumerate(numbers)), "query int, item long")  # about tile_size rows
            out.append(stored(got.join(F.broadcast(names), "query").select("item", "doc_id", "score"), "found"))
    if not out:
        return own.select(F.col("item_id").alias(item_col), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id"))
    best = reduce(DataFrame.union, out).withColumn("rank", place).where(F.col("rank") <= top)
    named = best.join(few(own.select("item", "item_id")), "item")
    return named.select(F.col("item_id").alias(item_col), "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
