"""Token ids as files: static range asymmetric numeral system over interleaved lanes.

One frequency table, counted over every id of the corpus, is shared by all blocks. A block holds whole
documents; its ids are dealt over LANES interleaved states, so encoder and decoder advance all lanes by one
numpy step. Each block stands alone: its end states, its words, and every STEPS steps a checkpoint (states
and place in the words) from which the rest decodes without what comes before. A crc32 guards each block.

State: 64 bits in [2^31, 2^63), renormalised by 32-bit words; frequencies sum to 2^SCALE.

The files are Parquet so that any store Spark writes to will do, a lost executor's part is written again, and
commits are atomic: one row per block. ``write`` orders all rows by id (null ids first, equal ids by their
token ids), one shard per range partition. ``read`` checks each block's sum, cuts it at its checkpoints, deals the
segments out over all tasks and decodes them apart from each other; a document that spans segments is joined again.

Null and empty texts give the end id alone; repeated rows are kept; an empty table gives empty files; extra
columns don't matter, as only the id and text columns are read.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandql.llm.common import bounded_batches, dropped, new_folder, stored

SCALE, LANES, STEPS, BLOCK_IDS = 18, 2048, 128, 1 << 19
LOW, WORD = np.uint64(1 << 31), np.uint64(32)
CACHE_WORDS, SLICE_DOCS = 700_000, 10_000

# ---- the coder ------------------------------------------------------------------------------------------


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE, at least 1 for every id that occurs."""
    counts = np.asarray(counts, dtype=np.int64)
    total, size = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), dtype=np.uint64)
    if np.count_nonzero(counts) > size:
        raise ValueError(f"more than {size} different ids")
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * size / total).astype(np.int64)), 0)
    order, over = np.argsort(-freq, kind="stable"), int(freq.sum()) - size
    for i in order:  # what rounding left over goes to, or comes from, the most frequent ids
        if over == 0:
            break
        change = -over if over < 0 else -min(over, int(freq[i]) // 2)
        freq[i] += change
        over += change
    if over:
        for i in order:
            take = min(over, int(freq[i]) - 1) if freq[i] else 0
            freq[i] -= take
            over -= take
    return freq.astype(np.uint64)


class Tables:
    """Frequency, start and slot tables of the coder."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.int32), freq.astype(np.int64))


def encode_block(ids: np.ndarray, t: Tables) -> dict:
    """Words, end states and checkpoints of a block."""
    n = len(ids)
    steps = -(-n // LANES)
    x = np.full(LANES, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    emitted, scale = 0, np.uint64(SCALE)
    top = np.uint64(31 - SCALE + 32)
    freq, start = t.freq[ids], t.start[ids]
    for k in range(steps - 1, -1, -1):
        lo, hi = k * LANES, min(n, k * LANES + LANES)
        f, c, s = freq[lo:hi], start[lo:hi], x[: hi - lo]
        full = s >= (f << top)
        if full.any():
            out = s[full]
            words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
            emitted += len(out)
            s[full] = out >> WORD
        q = s // f
        s[:] = (q << scale) + (s - q * f) + c
        if k and k % STEPS == 0:
            marks.append((k, emitted, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, dtype="<u4")
    payload = stream.tobytes()
    check = b"".join(int(v).to_bytes(8, "little") for k, e, _ in marks[::-1] for v in (k, emitted - e)) + b"".join(s.astype("<u8").tobytes() for _, _, s in marks[::-1])
    states = x.astype("<u8").tobytes()
    return {"payload": payload, "states": states, "checkpoints": check, "n_checkpoints": len(marks), "crc": zlib.crc32(check, zlib.crc32(states, zlib.crc32(payload)))}


def segments(block: dict) -> list[tuple[int, int, np.ndarray]]:
    """(first step, place in the words, states) of the block's parts that decode apart from each other."""
    m, raw = block["n_checkpoints"], block["checkpoints"]
    heads = np.frombuffer(raw[: 16 * m], dtype="<u8").reshape(m, 2)
    states = np.frombuffer(raw[16 * m :], dtype="<u8").reshape(m, LANES)
    return [(0, 0, np.frombuffer(block["states"], dtype="<u8")), *((int(k), int(at), states[i]) for i, (k, at) in enumerate(heads))]


def decode_segment(words: np.ndarray, first: int, at: int, states: np.ndarray, last: int, n: int, t: Tables) -> np.ndarray:
    """Ids of steps first to last (exclusive) of a block of n ids."""
    x, out = states.astype(np.uint64), np.empty(min(n, last * LANES) - first * LANES, dtype=np.uint32)
    mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for k in range(first, last):
        lo, hi = k * LANES, min(n, k * LANES + LANES)
        s = x[: hi - lo]
        low = s & mask
        ids = t.slot[low.astype(np.int64)]
        out[lo - first * LANES : hi - first * LANES] = ids
        s[:] = t.freq[ids] * (s >> scale) + low - t.start[ids]
        short = s < LOW
        need = int(np.count_nonzero(short))
        if need:
            s[short] = (s[short] << WORD) | words[at : at + need]
            at += need
    return out


def checked(block: dict) -> None:
    """Raise if a block's checksum doesn't hold."""
    if zlib.crc32(block["checkpoints"], zlib.crc32(block["states"], zlib.crc32(block["payload"]))) != block["crc"]:
        raise ValueError(f"block {block.get('shard')}.{block.get('block')} is damaged")


def decode_block(block: dict, t: Tables) -> np.ndarray:
    """All ids of a block, one segment after the other."""
    checked(block)
    n, words = block["n_ids"], np.frombuffer(block["payload"], dtype="<u4").astype(np.uint64)
    parts, steps = segments(block), -(-n // LANES)
    ends = [p[0] for p in parts[1:]] + [steps]
    return np.concatenate([decode_segment(words, *p, end, n, t) for p, end in zip(parts, ends)])


# ---- tokens ---------------------------------------------------------------------------------------------


#: The normaliser and pre-tokenizer of the vocabularies whose chunks can be cut before the library sees them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
WHITE, LETTER, DIGIT, OTHER, ODD, WHOLE = range(6)
#: Pieces that the library gets in one string.
LINE_PIECES = 1000


def _kinds(special: list[str]) -> np.ndarray:
    """What each byte of UTF-8 is: of ASCII its class; odd are contractions' marks, first bytes of special tokens and what isn't ASCII."""
    kind = np.full(256, ODD, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        kind[b] = WHITE if c in " \t\n\v\f\r" else LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER
    kind[[ord("'"), *(t.encode()[0] for t in special)]] = ODD
    return kind


class WordEncoder:
    """Ids as the tokenizers library gives them; it encodes each distinct piece once.

    For vocabularies whose normaliser (NFC, white space to one blank, lower case) and pre-tokenizer never look across
    white space. Chunks between white space of ASCII and of the letters from U+00C0 to U+00FF are cut where the split pattern
    cuts them: runs of letters in lower case, single digits, runs of other characters. A chunk that holds anything else, an
    apostrophe or what may begin a special token is one piece, as is every chunk where the vocabulary's steps are others.
    """

    def __init__(self, path: str, dtype: str):
        import json
        import os
        import string

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = dtype
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        special = [t["content"] for t in spec["added_tokens"]]
        self.cuts = bool(suffix) and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and all(t[0] in string.punctuation for t in special)
        #: By byte; if chunks aren't cut, every byte but white space makes its chunk a whole piece.
        self.kind = _kinds(special)
        if not self.cuts:
            self.kind[self.kind != WHITE] = ODD
        self.lower = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
        #: The same model for pieces that are cut and in lower case, with blanks between them; and which ids end a piece.
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True
        #: White space beyond ASCII's, as Unicode has it.
        self.odd = regex.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        #: Known pieces with the number of their ids, and all these ids in turn.
        self.known, self.size, self.flat = pa.array([""], pa.string()), np.zeros(1, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each chunk that isn't cut, and the ids."""
        size, flat = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
        for k in range(0, len(words), 20_000):
            ids = [e.ids for e in self.tok.encode_batch_fast(words[k : k + 20_000], add_special_tokens=False)]
            size.append(np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(size[-1].sum())))
        return np.concatenate(size), np.concatenate(flat)

    def _learn_cut(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each cut piece, and the ids: many pieces a string, told apart by the ids that end one."""
        lines = [" ".join(pieces[k : k + LINE_PIECES]) for k in range(0, len(pieces), LINE_PIECES)]
        flat = [np.zeros(0, dtype=np.int32)]
        for k in range(0, len(lines), 20):
            flat += [np.array(e.ids, dtype=np.int32) for e in self.model.encode_batch_fast(lines[k : k + 20], add_special_tokens=False)]
        flat = np.concatenate(flat)
        size = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1).astype(np.int32)
        if len(size) != len(pieces) or size.sum() != len(flat):
            raise ValueError("pieces and the ids that end them differ in number")
        return size, flat

    def _pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All pieces of the texts in turn, which of them are whole chunks, and where each text's pieces begin and end."""
        bounds = pa.array(texts, pa.string()).buffers()[1]
        starts = np.frombuffer(bounds, dtype=np.int32, count=len(texts) + 1) + np.arange(len(texts) + 1)  # a line feed after each text
        data = np.frombuffer("\n".join([*texts, ""]).encode(), dtype=np.uint8)
        kind, low = self.kind[data], self.lower[data]
        if self.cuts:
            at = np.flatnonzero(data == 0xC3)  # U+00C0 to U+00FF: letters but for the signs of multiplication and division
            after = data[at + 1]
            letter = (after != 0x97) & (after != 0xB7)
            kind[at[letter]] = kind[at[letter] + 1] = LETTER
            low[at[letter & (after < 0x9F)] + 1] += 32
        gaps, odd = np.flatnonzero(kind == WHITE), np.flatnonzero(kind == ODD)
        if len(odd):
            chunk = np.searchsorted(gaps, odd)
            chunk = chunk[np.diff(chunk, prepend=-1) > 0]
            turn = np.zeros(len(data), dtype=np.int8)
            turn[np.where(chunk > 0, gaps[chunk - 1] + 1, 0)] = 1
            turn[gaps[chunk]] = -1
            inside = np.cumsum(turn, dtype=np.int8).view(bool)
            kind[inside], low[inside] = WHOLE, data[inside]
        cut = kind == DIGIT
        cut[1:] |= kind[1:] != kind[:-1]
        cut[:1] = True
        first = np.flatnonzero(cut)
        what = kind[first]
        held = what != WHITE
        size = np.diff(first, append=len(data))[held]
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(low[kind != WHITE]))
        return pieces, what[held] == WHOLE, np.searchsorted(first[held], starts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        collecting = gc.isenabled()
        gc.disable()  # many small objects, no cycles
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        texts = [t if t.isascii() or not self.odd.search(t) else self.odd.sub(" ", t) for t in texts]
        pieces, whole, bounds = self._pieces(texts)
        del texts
        pieces = pieces.dictionary_encode()
        distinct, codes = pieces.dictionary, pieces.indices.to_numpy()
        at = pc.index_in(distinct, value_set=self.known)
        is_new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().copy()
        if is_new.any():
            uncut = np.zeros(len(distinct), dtype=bool)
            uncut[codes[whole]] = True
            cut, uncut = np.flatnonzero(is_new & ~uncut), np.flatnonzero(is_new & uncut)
            new = distinct.take(pa.array(np.concatenate([cut, uncut])))
            if len(self.known) + len(new) > CACHE_WORDS:  # keep what these texts need
                kept, at[~is_new] = np.unique(at[~is_new], return_inverse=True)
                self.flat = _gather(self.flat, self.size, kept)
                self.known, self.size = self.known.take(pa.array(kept)), self.size[kept]
            at[np.concatenate([cut, uncut])] = len(self.known) + np.arange(len(new))
            words = new.to_pylist()
            (size, flat), (more, rest) = self._learn_cut(words[: len(cut)]), self._learn(words[len(cut) :])
            self.known, self.size, self.flat = pa.concat_arrays([self.known, new]), np.concatenate([self.size, size, more]), np.concatenate([self.flat, flat, rest])
        codes, out = at[codes], []
        start, size, flat = np.cumsum(self.size) - self.size, self.size, self.flat.astype(self.dtype)
        for k in range(0, len(bounds) - 1, 2000):  # the ids of some texts at a time
            own = bounds[k : k + 2001]
            code = codes[own[0] : own[-1]]
            ends = np.concatenate(([0], np.cumsum(size[code])))
            out += np.split(_gather(flat, size, code, start), ends[own - own[0]][1:-1])
        return out


def _gather(flat: np.ndarray, size: np.ndarray, codes: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The runs of flat that codes name, one after the other; size: the length of each run."""
    start = np.cumsum(size) - size if start is None else start
    n = size[codes]
    ends = np.cumsum(n)
    return flat[np.repeat(start[codes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def _encoder(path: str, dtype: str) -> WordEncoder:
    return WordEncoder(path, dtype)


def _pack(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b)


def _unpack(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


def _tokens(df: DataFrame, path: str, end_id: int, dtype: str, size: int, id_col: str, text_col: str) -> DataFrame:
    """id and packed token ids of each text, the end id appended; some rows also hold the id counts of a slice."""
    out = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    end = np.array([end_id], dtype=dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, dtype)
        for b in batches:
            for k in range(0, b.num_rows, SLICE_DOCS):
                part = b.slice(k, SLICE_DOCS)
                ids = enc.encode(["" if t is None else t for t in part.column(1).to_pylist()])
                total = np.bincount(np.concatenate(ids), minlength=size)
                total[end_id] += len(ids)
                counts = [None] * (len(ids) - 1) + [_pack(total.astype("<i8").tobytes())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_pack(x.tobytes() + end) for x in ids], pa.binary()), pa.array(counts, pa.binary())], names=["id", "ids", "counts"])

    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out)


def _count(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the whole corpus; the result is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(_unpack(x), dtype="<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["token", "n"])

    rows = tokens.select("counts").where(F.col("counts").isNotNull()).mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, dtype=np.int64)
    out[rows["token"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


BLOCK_SCHEMA = "shard long, block int, shard_start long, doc_ids array<long>, doc_n_ids array<int>, n_ids long, payload binary, states binary, checkpoints binary, n_checkpoints int, crc long"


def write(df: DataFrame, folder: str, path: str, end_id: int, vocab_size: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token ids of every text below folder, in ascending order of an integer id column: blocks and table."""
    from pyspark import TaskContext

    spark = df.sparkSession
    dtype = "<u2" if vocab_size <= 1 << 16 else "<u4"
    tokens = stored(_tokens(df, path, end_id, dtype, vocab_size, id_col, text_col), "tokens")
    freq = frequencies(_count(tokens, vocab_size))
    spark.createDataFrame(pd.DataFrame({"token": np.arange(vocab_size), "freq": freq.astype(np.int64)}), "token int, freq long").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, shard = Tables(shared.value), TaskContext.get().partitionId()
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        size = block = before = 0

        def cut():
            nonlocal ids, parts, size, block, before
            row = encode_block(np.concatenate(parts).astype(np.int64), t)
            row |= {"shard": shard, "block": block, "shard_start": before, "doc_ids": ids, "doc_n_ids": list(map(len, parts)), "n_ids": size}
            block, before, ids, parts, size = block + 1, before + size, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_ARROW)

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                parts.append(np.frombuffer(_unpack(x), dtype=dtype))
                size += len(parts[-1])
                if size >= BLOCK_IDS:
                    yield cut()
        if parts:
            yield cut()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id, or of none, are told apart by a print of theirs, so that many of them are no single range.
    keyed = tokens.select("id", "ids", F.xxhash64("ids").alias("print"))
    keyed.repartitionByRange(n, "id", "print").sortWithinPartitions("id", "print").select("id", "ids").mapInArrow(run, BLOCK_SCHEMA).write.parquet(f"{folder}/blocks")
    dropped(spark, tokens)


BLOCK_ARROW = pa.schema([("shard", pa.int64()), ("block", pa.int32()), ("shard_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_n_ids", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("payload", pa.binary()), ("states", pa.binary()), ("checkpoints", pa.binary()), ("n_checkpoints", pa.int32()), ("crc", pa.int64())])


SEGMENT_SCHEMA = "shard long, shard_start long, n_ids long, first long, last long, states binary, words binary, doc_ids array<long>, doc_at array<long>, doc_n_ids array<int>"
SEGMENT_ARROW = pa.schema([("shard", pa.int64()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("states", pa.binary()), ("words", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_at", pa.list_(pa.int64())), ("doc_n_ids", pa.list_(pa.int32()))])


def cut(block: dict) -> list[dict]:
    """The block's segments with their words and the documents that each holds a part of; raises if its checksum doesn't hold."""
    checked(block)
    parts, n = segments(block), block["n_ids"]
    ends = np.cumsum(block["doc_n_ids"])
    starts, out = ends - block["doc_n_ids"], []
    for i, (first, at, states) in enumerate(parts):
        last, stop = (parts[i + 1][0], 4 * parts[i + 1][1]) if i + 1 < len(parts) else (-(-n // LANES), len(block["payload"]))
        a, b = np.searchsorted(ends, first * LANES, "right"), np.searchsorted(starts, min(n, last * LANES), "left")
        out.append({"shard": block["shard"], "shard_start": block["shard_start"], "n_ids": n, "first": first, "last": last, "states": states.tobytes(), "words": block["payload"][4 * at : stop], "doc_ids": block["doc_ids"][a:b], "doc_at": starts[a:b].tolist(), "doc_n_ids": block["doc_n_ids"][a:b]})
    return out


def read(spark: SparkSession, folder: str, what: str = "digest") -> DataFrame:
    """Documents of the files: id, start (ids before it in all files), n_tokens, and ids (what="ids") or their
    crc32 as little-endian unsigned 32-bit integers (what="digest")."""
    table = spark.read.parquet(f"{folder}/table").orderBy("token").toPandas()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast(table["freq"].to_numpy(dtype=np.uint64))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    digest = what == "digest"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for part in cut(b.slice(i, 1).to_pylist()[0]):
                    yield pa.RecordBatch.from_pylist([part], schema=SEGMENT_ARROW)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                words = np.frombuffer(row["words"], dtype="<u4").astype(np.uint64)
                ids = decode_segment(words, row["first"], 0, np.frombuffer(row["states"], dtype="<u8"), row["last"], row["n_ids"], t).astype("<u4")
                at, size, base = np.array(row["doc_at"]), np.array(row["doc_n_ids"]), row["first"] * LANES
                lo, hi = np.maximum(at - base, 0), np.minimum(at + size - base, len(ids))
                whole = hi - lo == size
                got = [ids[x:y].tobytes() for x, y in zip(lo.tolist(), hi.tolist())]
                crc = [zlib.crc32(x) if w and digest else None for x, w in zip(got, whole)]
                part = [None if w and digest else x for x, w in zip(got, whole)]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(got), pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(at + row["shard_start"]), pa.array(size.astype(np.int64)), pa.array(lo + base), pa.array(crc, pa.int64()), pa.array(part, pa.binary())], names=["shard", "doc_id", "at", "n_tokens", "place", "crc", "part"])

    dealt = blocks.mapInArrow(split, SEGMENT_SCHEMA).repartition("shard", "shard_start", "first")
    parts = dealt.mapInArrow(decode, "shard long, doc_id long, at long, n_tokens long, place long, crc long, part binary")
    found = F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("place", "part"))))
    docs = parts.groupBy("shard", "at", "doc_id", "n_tokens").agg(F.max("crc").alias("crc"), found.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, x["part"]))
    # One row per shard, that is per write task: bounded by the number of partitions.
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).toPandas().sort_values("shard")
    starts = pd.DataFrame({"shard": sums["shard"].astype("int64"), "before": (sums["n"].cumsum() - sums["n"]).astype("int64")})
    starts = spark.createDataFrame(starts, "shard long, before long")
    docs = docs.join(F.broadcast(starts), "shard").withColumn("start", F.col("before") + F.col("at"))
    if digest:
        return docs.select("doc_id", "start", "n_tokens", F.coalesce("crc", F.crc32(joined)).alias("ids_crc32"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([np.frombuffer(x, dtype="<u4").astype(np.int64) for x in b.column(3).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], ids], names=["doc_id", "start", "n_tokens", "ids"])

    return docs.select("doc_id", "start", "n_tokens", joined.alias("ids")).mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids array<long>")


def round_trip(df: DataFrame, path: str, end_id: int, vocab_size: int, what: str = "digest") -> DataFrame:
    """Write df's token ids to fresh files in the shared folder and read them back."""
    folder = new_folder(df.sparkSession, "rans")
    write(df, folder, path, end_id, vocab_size)
    return read(df.sparkSession, folder, what)
