"""Language identification in two steps: the family, then one-versus-one linear SVMs within it.

Features are hashed character n-grams (one to three letters, a blank at word ends) of the whole lower-cased text,
square-rooted and scaled to length 1. Families are told apart by one-versus-one SVMs too. The model is
fitted on about SAMPLE_DOCS documents, chosen by id hash and spread evenly over the languages, each as a whole
and as a short cut; every text is then predicted.

A null text or one without a letter gives ``und`` and score 0. Rows without a language are predicted, never learned
from. Repeated rows get equal predictions. Other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandql.llm.common import bounded_batches

SAMPLE_DOCS, BITS, CHUNK, UNKNOWN = 4000, 12, 1 << 20, "und"
#: Families of ISO 639-1 codes. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indo-aryan": "hi bn ur mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "austronesian": "id ms tl jv mg",
    "dravidian": "ta te kn ml",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def features(text: str | None) -> np.ndarray | None:
    """Feature vector of a text; None if it has no letter."""
    if not text:
        return None
    total, tail, some = np.zeros(1 << BITS), np.array([32], dtype=np.uint32), False
    shift = np.uint32(32 - BITS)
    for k in range(0, len(text), CHUNK):
        code = np.frombuffer(text[k : k + CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = _letters()[code]
        some = some or bool(is_letter.any())
        c = np.concatenate([tail, np.where(is_letter, code, np.uint32(32)), np.array([32], dtype=np.uint32) if k + CHUNK >= len(text) else np.zeros(0, dtype=np.uint32)])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        new = len(tail)  # n-grams that end before this were counted with the chunk before
        h = c * np.uint32(0x9E3779B1)
        one = h[new:]
        total += np.bincount((one[c[new:] != 32] >> shift).astype(np.int64), minlength=1 << BITS)
        if len(c) > 1:
            two = (h[:-1] * np.uint32(0x85EBCA6B) + h[1:]) ^ np.uint32(0x27D4EB2F)
            two = two[max(0, new - 1) :]
            total += np.bincount(((two * np.uint32(0xC2B2AE35)) >> shift).astype(np.int64), minlength=1 << BITS)
        if len(c) > 2:
            three = (h[:-2] * np.uint32(0x165667B1) + h[1:-1]) * np.uint32(0x2C1B3C6D) + h[2:]
            three = three[max(0, new - 2) :]
            total += np.bincount(((three * np.uint32(0x297A2D39)) >> shift).astype(np.int64), minlength=1 << BITS)
        tail = c[-2:]
    if not some:
        return None
    v = np.sqrt(total)
    return (v / np.linalg.norm(v)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with hinge loss, by dual coordinate descent; y: +1 and -1."""
    n, d = x.shape
    w, a = np.zeros(d + 1, dtype=np.float32), np.zeros(n)
    norm = (x.astype(np.float64) ** 2).sum(1) + 1
    order, rng = np.arange(n), np.random.default_rng(7)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            step = (1 - y[i] * (float(x[i] @ w[:-1]) + float(w[-1]))) / norm[i]
            new = min(c, max(0.0, a[i] + step))
            if new != a[i]:
                change = np.float32((new - a[i]) * y[i])
                w[:-1] += change * x[i]
                w[-1] += change
                a[i] = new
    return w


class Duel:
    """One-versus-one SVMs over some classes."""

    def __init__(self, classes: list[str], x: np.ndarray, y: np.ndarray):
        self.classes = classes
        self.pairs = [(i, j) for i in range(len(classes)) for j in range(i + 1, len(classes))]
        ws = []
        for i, j in self.pairs:
            rows = np.flatnonzero((y == classes[i]) | (y == classes[j]))
            ws.append(fit_svm(x[rows], np.where(y[rows] == classes[i], 1.0, -1.0)))
        self.w = np.stack(ws) if ws else np.zeros((0, x.shape[1] + 1), dtype=np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class with most duels won (then the larger sum of margins) and its least margin."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, dtype=int), np.full(n, np.inf)
        m = x @ self.w[:, :-1].T + self.w[:, -1]
        won, total, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for p, (i, j) in enumerate(self.pairs):
            for side, s in ((i, 1), (j, -1)):
                won[:, side] += s * m[:, p] > 0
                total[:, side] += np.clip(s * m[:, p], -3, 3)
                least[:, side] = np.minimum(least[:, side], s * m[:, p])
        best = (won * 1e3 + total).argmax(1)
        return best, least[np.arange(n), best]


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        found = sorted(set(langs))
        families = np.array([family_of(v) for v in langs])
        self.families = sorted(set(families))
        self.members = [[v for v in found if family_of(v) == f] for f in self.families]
        self.top = Duel(self.families, x, families)
        self.within = [Duel(m, x, langs) for m in self.members]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fam, sure = self.top.predict(x)
        lang, score = np.empty(len(x), dtype=object), 1 / (1 + np.exp(-3 * sure))
        for f, duel in enumerate(self.within):
            rows = np.flatnonzero(fam == f)
            if len(rows):
                k, m = duel.predict(x[rows])
                lang[rows] = np.array(self.members[f], dtype=object)[k]
                score[rows] *= 1 / (1 + np.exp(-3 * m))
        return lang, score


def short_cut(text: str) -> str:
    """Eight words from a text's middle."""
    w = text.split()
    return " ".join(w[len(w) // 2 : len(w) // 2 + 8])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Fit on about sample_docs documents with a language; where: which ids may be learned from. None: nothing to learn."""
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = known.groupBy("lang").count().toPandas()  # one row per language
    if not len(counts):
        return None
    counts["share"] = sample_docs / len(counts) / counts["count"]
    shares = docs.sparkSession.createDataFrame(counts[["lang", "share"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                for k, t in enumerate((text, short_cut(text))):
                    v = features(t)
                    if v is not None:
                        at = np.flatnonzero(v)
                        out.append({"h": h, "k": k, "lang": lang, "at": at.astype("<u2").tobytes(), "v": v[at].tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("h", pa.int64()), ("k", pa.int32()), ("lang", pa.string()), ("at", pa.binary()), ("v", pa.binary())]))

    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    rows = known.join(F.broadcast(shares), "lang").where(chance < F.col("share")).select(F.xxhash64("id").alias("h"), "lang", "text")
    got = rows.mapInArrow(run, "h long, k int, lang string, at binary, v binary").toPandas().sort_values(["h", "k", "at", "v"])
    if not len(got):
        return None
    x = np.zeros((len(got), 1 << BITS), dtype=np.float32)
    for i, (at, v) in enumerate(zip(got["at"], got["v"])):
        x[i, np.frombuffer(at, dtype="<u2")] = np.frombuffer(v, dtype=np.float32)
    return Model(x, got["lang"].to_numpy(dtype=object))


def predict_udf(spark, model: Model | None):
    """text -> struct of lang_pred and score."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in batches:
            lang, score = np.full(len(s), UNKNOWN, dtype=object), np.zeros(len(s))
            for k in range(0, len(s), 1000):
                found = [(i, v) for i, v in enumerate(map(features, s.iloc[k : k + 1000]), k) if v is not None]
                if found and m is not None:
                    at = [i for i, _ in found]
                    lang[at], score[at] = m.predict(np.stack([v for _, v in found]))
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return predict
