"""Licence scans: winnowed fingerprints of templates propose, banded alignment measures.

Words are runs of letters and digits in lower case. Templates' K-word grams are winnowed (of each WINDOW neighbouring
grams the one of least hash, a template of fewer grams keeps its least) into an inverted index. All grams of a
document are looked up, so every stretch of WINDOW + K - 1 template words is found. Hits are chained in the order of both
template and text; a step between diagonals costs little more than the logarithm of the words put in or left out, so that an
insertion of any length is crossed where enough of the notice stands on both sides of it. The band of the alignment follows the chain: between
two hits it is the stretch between them, whole; before the first and after the last it is BAND words wide (match +2,
mismatch and gap -1). That gives the matched words, their share of the template (coverage) and the span in code points.
Parts of notices are templates too, but their matches are given against the whole notice's words. Of overlapping
spans the one with more matched words stays, then the one of higher coverage, then the first.

Null and empty texts have no match; repeated rows get equal results; an empty table gives an empty table. Only the
named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandql.llm.common import bounded_batches
from strandql.llm.license_texts import PARTS, TEMPLATES

K, WINDOW, BAND = 3, 4, 8
#: An end's alignment stops where its score falls so far below the best.
DROP = 24
#: Least coverage of a template that is reported; one of at most SHORT words must be there whole.
COVERAGE, SHORT = 0.75, 8
WORD = re.compile(r"[^\W_]+")


class Index:
    """Templates as word codes, and their fingerprints by gram."""

    def __init__(self, templates: list[tuple[str, str]]):
        whole = [n for n, _ in templates]
        parts = [(n, t) for n, t in PARTS if n in whole]
        templates = templates + parts
        self.names = [n for n, _ in templates]
        words = [WORD.findall(t.lower()) for _, t in templates]
        self.code = {w: i for i, w in enumerate(sorted({w for t in words for w in t}))}
        self.size = len(self.code)
        self.templates = [[self.code[w] for w in t] for t in words]
        # Words of the notice; a part's are those of the first template of its name.
        self.words = [len(t) for t in words[: len(whole)]] + [len(words[whole.index(n)]) for n, _ in parts]
        found: dict[int, list[tuple[int, int]]] = {}
        for t, codes in enumerate(self.templates):
            grams = [(c[0] * self.size + c[1]) * self.size + c[2] for c in zip(codes, codes[1:], codes[2:])]
            order = [(zlib.crc32(g.to_bytes(8, "little")), i) for i, g in enumerate(grams)]
            picked = {min(order[i : i + WINDOW])[1] for i in range(max(1, len(grams) - WINDOW + 1))} if grams else set()
            for i in sorted(picked):
                found.setdefault(grams[i], []).append((t, i))
        self.grams = np.array(sorted(found), dtype=np.int64)
        self.places = [found[g] for g in self.grams.tolist()]


@lru_cache(maxsize=4)
def index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(list(templates))


def chains(hits: list[tuple[int, int]], size: int) -> list[list[tuple[int, int]]]:
    """Chains of (text place, template place) hits, ascending in both, the best first; every hit is in one chain at most.

    A chain's score is the template words that its grams cover, less 1 + log2(1 + change of diagonal) / 2 for
    each step off the diagonal. For each
    template place only the best chain that ends there is held, so a hit costs one pass over the template. Templates of
    at most SHORT words keep to their diagonals.
    """
    end = np.full(size, -np.inf)  # best score of a chain that ends at a template place,
    place, owner = np.zeros(size, dtype=np.int64), np.full(size, -1)  # where in the text, and with which hit
    before, score = [-1] * len(hits), [0.0] * len(hits)
    for h, (pos, i) in enumerate(hits):
        best, own = float(K), -1
        if i:
            ahead, up = pos - place[:i], i - np.arange(i)
            step = np.abs(ahead - up)
            gain = end[:i] + np.minimum(np.minimum(ahead, up), K) - (step > 0) - 0.5 * np.log2(1 + step)
            gain[(ahead <= 0) | (step > size // 4 if size <= SHORT else False)] = -np.inf
            k = i - 1 - int(gain[::-1].argmax())  # of equal ones the nearest
            if gain[k] > best:
                best, own = float(gain[k]), int(owner[k])
        before[h], score[h] = own, best
        if best >= end[i] - 1 - 0.5 * np.log2(1 + pos - place[i]):
            end[i], place[i], owner[i] = best, pos, h
    used, out = [False] * len(hits), []
    for h in sorted(range(len(hits)), key=lambda h: (-score[h], h)):
        chain = []
        while h >= 0 and not used[h]:
            used[h] = True
            chain.append(hits[h])
            h = before[h]
        if chain:
            out.append(chain[::-1])
    return out


def common(a: list[int], b: np.ndarray) -> int:
    """Length of the longest common subsequence of a stretch of the template and one of the text, a row at a time."""
    if not a or not len(b):
        return 0
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for w in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == w)))
    return int(row[-1])


def extend(template: list[int], codes: list[int]) -> tuple[int, int]:
    """Best alignment of the beginnings of two stretches within BAND of their diagonal: matched words, and text words used."""
    n, width = len(codes), 2 * BAND + 1
    low = -(1 << 30)
    score, matched = [low] * width, [0] * width
    for d in range(BAND, min(width, BAND + n + 1)):
        score[d] = BAND - d
    best = (0, 0, 0)
    for i, w in enumerate(template):
        new_s, new_m, top = [low] * width, [0] * width, low
        for d in range(width):
            at = i + d - BAND  # the text word that this cell ends with
            if at < -1 or at >= n:
                continue
            same = at >= 0 and codes[at] == w
            s, m = (score[d] + (2 if same else -1), matched[d] + same) if at >= 0 else (low, 0)
            if d + 1 < width and score[d + 1] - 1 > s:  # a template word is missing
                s, m = score[d + 1] - 1, matched[d + 1]
            if d and new_s[d - 1] - 1 > s:  # the text has a word more
                s, m = new_s[d - 1] - 1, new_m[d - 1]
            new_s[d], new_m[d], top = s, m, max(top, s)
            if same and s > best[0]:
                best = (s, m, at + 1)
        if top < best[0] - DROP:
            break
        score, matched = new_s, new_m
    return best[1:]


def align(template: list[int], codes: np.ndarray, chain: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Matched words, and first and last place in codes, of the alignment along a chain of hits."""
    (first, i), (last, j) = chain[0], chain[-1]
    reach = i + BAND
    m, back = extend(template[:i][::-1], codes[max(0, first - reach) : first][::-1].tolist())
    n, on = extend(template[j + K :], codes[last + K : last + K + len(template) - j - K + BAND].tolist())
    m += n + K
    for (p, a), (q, b) in zip(chain, chain[1:]):
        step = min(q - p, b - a)
        if q - p == b - a and step <= K:
            m += step
        elif step >= K:  # what stands between the grams, and the second gram
            m += K + common(template[a + K : b], codes[p + K : q])
        else:  # the grams overlap in one of the two, by a repeated word
            m += common(template[a + K : b + K], codes[p + K : q + K])
    return m, first - back, last + K - 1 + on


def find(text: str | None, idx: Index) -> list[tuple[str, int, int, int, int]]:
    """(name, start, end, matched words, template words) of a text's licence notices, by start."""
    if not text:
        return []
    low = text.lower()
    words = WORD.findall(low)
    get = idx.code.get
    c = np.array([get(w, -1) for w in words], dtype=np.int64)
    if len(c) < K:
        return []
    known = np.flatnonzero((c[:-2] >= 0) & (c[1:-1] >= 0) & (c[2:] >= 0))
    gram = (c[known] * idx.size + c[known + 1]) * idx.size + c[known + 2]
    at = np.minimum(np.searchsorted(idx.grams, gram), len(idx.grams) - 1)
    hit = idx.grams[at] == gram
    if not hit.any():
        return []
    begins: dict[int, list[tuple[int, int]]] = {}
    for pos, g in zip(known[hit].tolist(), at[hit].tolist()):
        for t, i in idx.places[g]:
            begins.setdefault(t, []).append((pos, i))
    found = []
    for t, hits in begins.items():
        template = idx.templates[t]
        for chain in chains(hits, len(template)):
            m, first, last = align(template, c, chain)
            if m >= (len(template) if len(template) <= SHORT else COVERAGE * len(template)):
                found.append((m, m / idx.words[t], first, last, t))
    if not found:
        return []
    if len(low) == len(text):
        spans = [m.span() for m in WORD.finditer(low)]
    else:  # a letter that grows in lower case: places of the text as it is
        grown = np.cumsum([0, *(len(ch.lower()) for ch in text)])
        spans = [(int(np.searchsorted(grown, a, "right")) - 1, int(np.searchsorted(grown, b, "left"))) for a, b in (m.span() for m in WORD.finditer(low))]
    out: list[tuple[str, int, int, int, int]] = []
    taken = np.zeros(len(c), dtype=bool)
    for m, _, a, b, t in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[4])):
        if not taken[a : b + 1].any():
            taken[a : b + 1] = True
            out.append((idx.names[t], spans[a][0], spans[b][1], m, idx.words[t]))
    return sorted(out, key=lambda x: x[1])


MATCH = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("matched", T.LongType()), T.StructField("words", T.LongType())]))
_MATCH = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("words", pa.int64())]))


def scan(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``matches``, the array of (license, start, end, matched, words), one row per row of df."""
    key = tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = index(key)
        fields = ("license", "start", "end", "matched", "words")
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                rows = [[dict(zip(fields, m)) for m in find(t, idx)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _MATCH)], names=[id_col, "matches"])

    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, T.StructType([df.schema[id_col], T.StructField("matches", MATCH)]))
