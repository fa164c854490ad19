"""Byte-level BPE encoding and decoding over a segment tree of adjacent pair ranks.

A piece (what the pre-tokenizer splits off) is a row of symbols. Leaf p of its tree holds
``rank * width + p`` for the pair that starts at slot p, or INF where no merge exists, so the minimum at
the root is the lowest rank and among equals the leftmost pair. A merge changes three leaves (the pair's
own, its right slot's, its left neighbour's) and their paths to the root.

Short pieces are merged many at once: one numpy row per piece, all rows one merge per step. Long pieces
use the same tree alone, in O(n log n). Results are kept per distinct piece in a bounded cache.

Input: any table; only the id and text columns are used, so further columns and their names don't matter.
Null and empty texts give no ids and an empty decoded text; repeated rows give repeated rows; an empty table
gives an empty table. A special token's string in a text becomes its id, as in the tokenizers library.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandql.llm.common import bounded_batches

#: Characters whose classes are the same in every Unicode version of the two regular-expression engines.
STABLE = regex.compile(r"[^\u0000-՗؀-ݿऀ-ॿ‐-‧₠-₿　-ヾ一-鿿가-힣]")
#: The fixed split pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
INF = np.int32(2**31 - 1)
#: Pairs of the longest piece that is merged in a numpy row; longer ones get a tree of their own.
ROW_PAIRS = 64
CACHE_PIECES = 300_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class PairHash:
    """Rank and merged id of pairs of ids, by numpy gathers: each pair lies in the first table whose slot it won."""

    BITS = 20

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.keys = np.array([(a << 32) | b for a, b in pairs] + [-1], dtype=np.int64)
        self.rank = np.array([r for r, _ in pairs.values()] + [-1], dtype=np.int32)
        self.new = np.array([n for _, n in pairs.values()] + [-1], dtype=np.int32)
        # In the first table, a free slot holds -1, whose key is -1: no pair's.
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left, factor = np.arange(len(pairs)), 0x9E3779B97F4A7C15
        while len(left) or not self.tables:
            table = np.full(1 << self.BITS, -1, dtype=np.int32)
            at = self._slot(self.keys[left], np.uint64(factor))
            table[at] = left
            self.tables.append((np.uint64(factor), table))
            left = left[table[at] != left]
            factor = (factor * 0xD1342543DE82EF95 + 2) % 2**64 | 1

    def _slot(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((keys.view(np.uint64) * factor) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row of each pair in rank and new; the last row, of rank -1, where the pair doesn't merge."""
        key = (a.astype(np.int64) << 32) | b
        factor, table = self.tables[0]
        got = table[self._slot(key, factor)]
        held = self.keys[got]
        out = np.where(held == key, got, -1)
        left = np.flatnonzero((held != key) & (got >= 0))
        for factor, table in self.tables[1:]:  # another pair has the slot
            got = table[self._slot(key[left], factor)]
            held = self.keys[got]
            out[left] = np.where(held == key[left], got, -1)
            left = left[(held != key[left]) & (got >= 0)]
        return out


class PairTrees:
    """Merges pieces, given as bytes, into ids: one segment tree over the pair ranks of each piece."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]], byte_ids: np.ndarray, last_ids: np.ndarray):
        """ranks: (left, right) -> (rank, merged id); byte_ids, last_ids: id of a byte, and of a piece's last byte."""
        self.ranks, self.byte_ids, self.last_ids = ranks, byte_ids.astype(np.int32), last_ids.astype(np.int32)
        self.hash = PairHash(ranks)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as packed native 32-bit integers."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, b in enumerate(pieces):
            n = len(b)
            if n == 1:
                out[i] = self.last_ids[b[0]].tobytes()
            elif n - 1 > ROW_PAIRS:
                out[i] = np.array(self.merge_long(b), dtype=np.int32).tobytes()
            else:
                by_width.setdefault(2 if n < 4 else 1 << (n - 2).bit_length(), []).append(i)
        for width, group in by_width.items():
            for k in range(0, len(group), 16_384):
                part = group[k : k + 16_384]
                for i, ids in zip(part, self._merge_rows(width, [pieces[i] for i in part])):
                    out[i] = ids
        return out

    def _merge_rows(self, width: int, group: list[bytes]) -> list[bytes]:
        """All pieces of a group at once; width: leaves of each tree, a power of two. Arrays are flat: row * slots + slot."""
        n, slots, nodes = len(group), width + 1, 2 * width
        sizes = np.fromiter(map(len, group), dtype=np.int32, count=n)
        raw = np.frombuffer(b"".join(b.ljust(slots, b"\0") for b in group), dtype=np.uint8).reshape(n, slots)
        col = np.arange(slots, dtype=np.int32)
        sym = np.where(col < sizes[:, None], self.byte_ids[raw], np.int32(-1))
        sym[np.arange(n), sizes - 1] = self.last_ids[raw[np.arange(n), sizes - 1]]
        nxt = np.where(col + 1 < sizes[:, None], col + 1, slots).astype(np.int32).ravel()
        prv = np.broadcast_to(col - 1, (n, slots)).astype(np.int32).ravel()
        rank = self.hash.rank[self.hash.find(sym[:, :-1].ravel(), sym[:, 1:].ravel())].reshape(n, width)
        tree = np.full((n, nodes), INF, dtype=np.int32)
        tree[:, width:] = np.where(rank >= 0, rank * width + col[:-1], INF)
        for level in range(width.bit_length() - 2, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        sym, tree = sym.ravel(), tree.ravel()
        rows = np.flatnonzero(tree[1::nodes] < INF)
        while len(rows):
            s, t = rows * slots, rows * nodes
            p = tree[t + 1] % width
            q = nxt[s + p]
            new = self.hash.new[self.hash.find(sym[s + p], sym[s + q])]
            r, left = nxt[s + q], prv[s + p]
            sym[s + p] = new
            sym[s + q] = -1
            nxt[s + p] = r
            more = r < slots
            prv[(s + r)[more]] = p[more]
            # The three leaves that a merge changes: the pair's own, the right slot's, the left neighbour's.
            found = self.hash.rank[self.hash.find(new, np.where(more, sym[s + np.minimum(r, width)], -1))]
            self._set(tree, t, p, np.where(found >= 0, found * width + p, INF), width)
            inner = q < width
            self._set(tree, t[inner], q[inner], INF, width)
            has = left >= 0
            at = left[has]
            found = self.hash.rank[self.hash.find(sym[s[has] + at], new[has])]
            self._set(tree, t[has], at, np.where(found >= 0, found * width + at, INF), width)
            rows = rows[tree[t + 1] < INF]
        keep = (sym >= 0).reshape(n, slots)
        flat, ends = sym[keep.ravel()].tobytes(), (4 * np.cumsum(keep.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _set(tree: np.ndarray, base: np.ndarray, leaf: np.ndarray, value, width: int) -> None:
        """Set a leaf of each of the trees that start at base, and the minima above it."""
        node = leaf + width
        tree[base + node] = value
        for _ in range(width.bit_length() - 1):
            node = node >> 1
            below = base + 2 * node
            tree[base + node] = np.minimum(tree[below], tree[below + 1])

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece of any length with a tree of its own."""
        n = len(piece)
        sym = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        sym[-1] = int(self.last_ids[piece[-1]])
        width = 1 << max(1, (n - 1).bit_length())
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        none, ranks = 1 << 60, self.ranks

        def leaf(p: int) -> int:
            q = nxt[p]
            got = ranks.get((sym[p], sym[q])) if q >= 0 else None
            return none if got is None else got[0] * width + p

        tree = [none] * (2 * width)
        for p in range(n):
            tree[width + p] = leaf(p)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(p: int, value: int) -> None:
            k = width + p
            tree[k] = value
            k >>= 1
            while k:
                best = tree[2 * k] if tree[2 * k] < tree[2 * k + 1] else tree[2 * k + 1]
                if tree[k] == best:
                    return
                tree[k] = best
                k >>= 1

        while tree[1] < none:
            p = tree[1] % width
            q = nxt[p]
            sym[p] = ranks[sym[p], sym[q]][1]
            r = nxt[p] = nxt[q]
            sym[q] = -1
            if r >= 0:
                prv[r] = p
            put(q, none)
            put(p, leaf(p))
            if prv[p] >= 0:
                put(prv[p], leaf(prv[p]))
        return [s for s in sym if s >= 0]


class ByteBpe:
    """Vocabulary, merge ranks and the two directions. One per Python worker."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        self.to_byte = {c: b for b, c in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(self.to_byte[c] for c in token.removesuffix(self.suffix))
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        ranks = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.trees = PairTrees(ranks, np.array([vocab[c] for c in symbols]), np.array([vocab[c + self.suffix] for c in symbols]))
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.path, self.library = path, None
        self.cache: dict[str, list[int]] = {}
        self.cache_pieces = cache_pieces

    def pieces(self, text: str) -> list:
        """Pieces of a text; ids stand for special tokens."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list:
        if text.isascii() or not STABLE.search(text):
            return self.split.findall(text)
        if self.library is None:  # letters of newer Unicode versions: ask the library how it splits
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [bytes(self.to_byte[c] for c in p).decode("utf-8") for p, _ in self.library.pre_tokenize_str(text)]

    def learn(self, pieces: set) -> None:
        """Put the ids of all these pieces into the cache; when it is full, only these stay in it."""
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > self.cache_pieces:
            kept = {p: self.cache[p] for p in pieces if p in self.cache}
            self.cache.clear()
            self.cache.update(kept)
        text = [p for p in new if p.__class__ is str]
        self.cache.update((p, np.array([p], dtype=np.int32).tobytes()) for p in new if p.__class__ is not str)
        self.cache.update(zip(text, self.trees.merge([p.encode() for p in text])))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        collecting = gc.isenabled()
        gc.disable()  # many small objects, no cycles
        try:
            split = [self.pieces(t) for t in texts]
            seen: set = set()
            for p in split:
                seen.update(p)
            self.learn(seen)
            get = self.cache.__getitem__
            return [np.frombuffer(b"".join(map(get, p)), dtype=np.int32) for p in split]
        finally:
            if collecting:
                gc.enable()

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


#: Characters that a worker encodes at once; a batch of rows is cut at this size.
BATCH_CHARS = 2_000_000


def _cuts(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _parts(batch) -> Iterator[tuple]:
    """(ids, texts) of an Arrow batch of (id, text), a few texts at a time, so that few are Python strings at once."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    turn = np.cumsum(size) // BATCH_CHARS
    bounds = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(bounds, bounds[1:]):
        if hi > lo:
            part = batch.slice(lo, hi - lo)
            yield part.column(0), ["" if t is None else t for t in part.column(1).to_pylist()]


def encode_udf(path: str):
    """text -> array of ids."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = bpe(path)
        for s in batches:
            texts, out = ["" if t is None else t for t in s.tolist()], []
            for cut in _cuts(texts):
                out += model.encode_batch(texts[cut])
            yield pd.Series(out, dtype=object)

    return encode


def decode_udf(path: str):
    """array of ids -> text; ids are decoded one by one, special tokens as their strings."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = bpe(path)
        for s in batches:
            yield pd.Series(["" if ids is None else model.decode(ids.tolist()) for ids in s], dtype=object)

    return decode


def ids_digest(ids: Column) -> Column:
    """sha256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with the ids of its text."""
    return df.withColumn(ids_col, encode_udf(path)(F.col(text_col)))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of its ids."""
    return df.withColumn(out_col, decode_udf(path)(F.col(ids_col)))


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids and the text decoded from the ids, one row per row of df."""
    from pyspark.sql import types as T

    id_type = df.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        import pyarrow as pa

        model = bpe(path)
        for b in batches:
            for rows, texts in _parts(b):
                ids = model.encode_batch(texts)
                sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = np.concatenate(ids)
                arrays = [rows, pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([model.decode(x.tolist()) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_tokens", "ids", "decoded"])

    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, out)


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, token_ids (packed little-endian 32-bit integers) and decoded_equal: the ids decode to the text."""
    from pyspark.sql import types as T

    out = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()), T.StructField("decoded_equal", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        model = bpe(path)
        for b in batches:
            for rows, texts in _parts(b):
                ids = model.encode_batch(texts)
                same = [model.decode(x.tolist()) == t for x, t in zip(ids, texts)]
                arrays = [rows, pa.array(list(map(len, ids)), pa.int64()), pa.array([x.astype("<i4").tobytes() for x in ids], pa.binary()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_tokens", "token_ids", "decoded_equal"])

    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, out)
