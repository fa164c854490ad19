"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (character classes by Unicode category, words, repetition, lines) are cut into at most BINS bins by
quantiles of the training rows; trees of fixed depth are grown level by level from gradient histograms of the
logistic loss. A forest is flat arrays in heap order, so scoring walks all trees of all rows by numpy gathers.

Training takes at most ``train_rows`` labelled rows, those of smallest id hash; every text is scored. Rows without
a label or text are not learned from; without usable labels every score is 0.5. Null and empty texts are
scored like any other (all statistics 0). Repeated rows get equal scores. Other columns are never inputs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandql.llm.common import bounded_batches

TRAIN_ROWS, BINS, TREES, DEPTH, RATE, RIDGE = 20_000, 64, 80, 5, 0.15, 1.0

NAMES = ["log_chars", "log_words", "word_length", "letters", "upper", "digits", "spaces", "symbols", "pipes", "exclaims", "punctuation", "ends", "distinct", "adjacent", "repeat8", "repeat3", "dup_lines", "line_length", "line_ends", "short_words", "top_char", "entropy", "brackets", "wide", "case_changes"]
#: Symbols, sentence punctuation and ends, brackets, and the scripts that are written without spaces between words.
SYMBOLS, PUNCTUATION, ENDS, BRACKETS = "#*$%&|<>", ",;:.?!\"'-、，。；：？！…·«»„“”‘’—–؟،।", ".?!。？！…؟।", "()[]{}\"（）「」『』【】"
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
UPPER, LETTER, DIGIT, SPACE, SYMBOL, PUNCT, END, BRACKET, NO_SPACES = (1 << k for k in range(9))


@cache
def classes() -> np.ndarray:
    """The classes of every code point, by Unicode category, as bits."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint16)
    of = {"Lu": UPPER | LETTER, "Lt": UPPER | LETTER, "Ll": LETTER, "Lm": LETTER, "Lo": LETTER, "Mn": LETTER, "Mc": LETTER, "Nd": DIGIT}
    for c in range(sys.maxunicode + 1):
        out[c] = of.get(category(chr(c)), 0) | (SPACE if chr(c).isspace() else 0)
    for text, bit in ((SYMBOLS, SYMBOL), (PUNCTUATION, PUNCT), (ENDS, END), (BRACKETS, BRACKET)):
        out[[ord(c) for c in text]] |= bit
    for lo, hi in UNSPACED:
        out[lo : hi + 1] |= np.where(out[lo : hi + 1] & LETTER, NO_SPACES, 0).astype(np.uint16)
    return out


def _repeated(h: np.ndarray, n: int) -> float:
    """Share of n-word windows that occurred before."""
    if len(h) < n:
        return 0.0
    w = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        w ^= w >> np.uint64(29)
    return 1 - len(np.unique(w)) / len(w)


def statistics(text: str | None) -> np.ndarray:
    """The document statistics of one text, in the order of NAMES."""
    out = np.zeros(len(NAMES))
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(raw)
    kinds = classes()[raw]
    count = np.bincount(raw).astype(float)
    seen = np.flatnonzero(count)
    share = count[seen] / n
    of = lambda bit: float(np.count_nonzero(kinds & bit))
    words = text.split()
    # A word of a script without spaces counts as two letters.
    m = max(1.0, len(words) + of(NO_SPACES) / 2)
    letters = max(1.0, of(LETTER))
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    top = count[seen[(classes()[seen] & LETTER) > 0]]
    up = (kinds & UPPER) > 0
    out[:] = (
        np.log1p(n), np.log1p(m if words else 0), sizes.sum() / m, letters / n, of(UPPER) / letters, of(DIGIT) / n,
        of(SPACE) / n, of(SYMBOL) / m, text.count("|") / m, (text.count("!") + text.count("！")) / m, of(PUNCT) / m, of(END) / m,
        len(np.unique(h)) / max(1, len(words)), (h[1:] == h[:-1]).sum() / m, _repeated(h, 8), _repeated(h, 3), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        sum(x.rstrip()[-1] in ENDS for x in lines) / max(1, len(lines)), (sizes <= 2).sum() / m, top.max(initial=0) / n, -(share * np.log(share)).sum(), of(BRACKET) / m,
        (raw >= 128).sum() / n, (up[1:] != up[:-1]).sum() / m,
    )
    return out


class Forest:
    """Trees as flat arrays: node k of a tree has the children 2k+1 and 2k+2; leaves lie below depth DEPTH."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        z = self.base + self.leaf[trees, node - (1 << DEPTH) + 1].sum(1)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Grow a forest; deterministic: equal gains go to the lower feature and bin."""
    if not len(y):
        return Forest(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1 << DEPTH)))
    n, width = x.shape
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    flat = binned + np.arange(width) * BINS
    inner = (1 << DEPTH) - 1
    feature, cut, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 1 << DEPTH))
    z = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            first, k = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            grad = np.bincount(at, np.repeat(g, width), minlength=k * width * BINS).reshape(k, width, BINS)
            hess = np.bincount(at, np.repeat(h, width), minlength=k * width * BINS).reshape(k, width, BINS)
            gl, hl = grad.cumsum(2), hess.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = 0
            best = gain.reshape(k, -1).argmax(1)
            for i in range(k):
                if gain[i].ravel()[best[i]] > 1e-6:
                    feature[t, first + i] = best[i] // BINS
                    cut[t, first + i] = cuts[best[i] // BINS][best[i] % BINS]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        at = node - inner
        leaf[t] = -RATE * np.bincount(at, g, minlength=1 << DEPTH) / (np.bincount(at, h, minlength=1 << DEPTH) + RIDGE)
        z += leaf[t, at]
    return Forest(base, feature, cut, leaf)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", where: Column | None = None, train_rows: int = TRAIN_ROWS) -> Forest:
    """Fit on at most train_rows labelled documents. where: a condition on the labels' id."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column(1), b.column(2)], names=["x", "label", "h"])

    # The chosen ids are at most train_rows, and so may be broadcast.
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).select("text", "label", F.xxhash64(id_col).alias("h"))
    # An id may stand on many rows: the bound holds for rows too.
    got = rows.mapInArrow(run, "x binary, label int, h long").orderBy("h", "x", "label").limit(train_rows).toPandas()
    if not len(got):
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    x = np.stack([np.frombuffer(b) for b in got["x"]])
    order = np.lexsort([*x.T, got["h"].to_numpy()])  # the same forest whatever order the rows come in
    return fit(x[order], got["label"].to_numpy(dtype=float)[order])


def score_udf(spark, forest: Forest):
    """text -> score between 0 and 1."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.stack([statistics(t) for t in s]) if len(s) else np.zeros((0, len(NAMES)))
            yield pd.Series(np.concatenate([shared.value.score(x[k : k + 2000]) for k in range(0, len(x), 2000)] or [np.zeros(0)]))

    return score
