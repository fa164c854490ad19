"""Context models: pseudocounts from a library of context profiles or a conditional random field, and state sequences.

Models are small dimension tables, parsed on the driver and broadcast; profiles arrive in Arrow batches and the work is
matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a profile that are scored together.
BLOCK = 1024


@dataclass(frozen=True)
class Library:
    """Log2 weights (states, window, residues), state log2 priors or biases, and emitted residue probabilities (states, residues)."""

    weights: np.ndarray
    bias: np.ndarray
    emits: np.ndarray
    centre: float = 1.6
    decay: float = 0.85

    def positions(self) -> np.ndarray:
        """Weight of each window position: largest in the middle."""
        reach = self.weights.shape[1] // 2
        return self.centre * self.decay ** np.abs(np.arange(-reach, reach + 1))


def parse_library(text: str, residues: int = 20) -> Library:
    """A library of context profiles; probabilities are written as -1000 log2 p when IS_LOG or LOG is T."""
    states, prior, rows, log_form = [], [], [], False
    for line in text.splitlines():
        part = line.split()
        if not part:
            continue
        if part[0] == "PRIOR":
            prior.append(float(part[1]))
        elif part[0] in ("LOG", "ISLOG", "IS_LOG"):
            log_form = part[1] in ("T", "1")
        elif part[0].isdigit() and len(part) >= residues + 1:
            rows.append([0.0 if x == "*" else 2.0 ** (-float(x) / 1000) for x in part[1 : residues + 1]])
        elif part[0] == "//" and rows:
            states.append(rows)
            rows = []
    if rows:
        states.append(rows)
    w = np.array(states, dtype=float)
    p = np.array(prior[: len(w)] or [1.0 / max(1, len(w))] * len(w))
    if log_form and p.max(initial=0) > 1:
        p = 2.0 ** (-p / 1000)
    return Library(np.log2(np.maximum(w, 1e-30)), np.log2(np.maximum(p, 1e-30)), w[:, w.shape[1] // 2] if len(w) else np.zeros((0, residues)))


def posteriors(p: np.ndarray, lib: Library, neff: np.ndarray | None = None) -> np.ndarray:
    """Posterior of every state at every column: a softmax of window-weighted cross terms of counts and log profiles."""
    n, window = len(p), lib.weights.shape[1]
    reach, pos = window // 2, lib.positions()
    counts = p if neff is None else p * neff[:, None]
    z = np.tile(lib.bias, (n, 1))
    for d in range(-reach, reach + 1):
        lo, hi = max(0, -d), min(n, n - d)
        if lo < hi:
            z[lo:hi] += pos[d + reach] * counts[lo + d : hi + d] @ lib.weights[:, d + reach].T
    z -= z.max(1, keepdims=True)
    e = np.exp2(z)
    return e / e.sum(1, keepdims=True)


def pseudocounts(p: np.ndarray, lib: Library, tau: float | np.ndarray, neff: np.ndarray | None = None) -> np.ndarray:
    """p mixed with what the states emit."""
    t = np.asarray(tau, dtype=float)
    t = t[:, None] if t.ndim else t
    return (1 - t) * p + t * (posteriors(p, lib, neff) @ lib.emits)


def profile_neff(p: np.ndarray) -> float:
    """Two to the mean entropy of the columns."""
    return float(2.0 ** (-(p * np.log2(np.maximum(p, 1e-30))).sum(1).mean())) if len(p) else 1.0


def to_neff(p: np.ndarray, lib: Library, target: float, rounds: int = 30) -> np.ndarray:
    """Pseudocounts of the admixture, found by bisection, that brings a profile to an effective number."""
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if profile_neff(pseudocounts(p, lib, mid)) < target else (lo, mid)
    return pseudocounts(p, lib, (lo + hi) / 2)


def state_sequence(p: np.ndarray, lib: Library) -> bytes:
    """One byte a column: the state of largest posterior."""
    return posteriors(p, lib).argmax(1).astype(np.uint8).tobytes() if len(p) else b""


def translated(profiles: DataFrame, lib: Library, name: str = "name", cols: str = "p") -> DataFrame:
    """name and state sequence (binary) of profiles (array of columns of probabilities)."""
    shared = profiles.sparkSession.sparkContext.broadcast(lib)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({name: f[name], "states": [state_sequence(np.stack(list(x)) if len(x) else np.zeros((0, shared.value.emits.shape[1])), shared.value) for x in f[cols]]})

    return profiles.select(name, cols).mapInPandas(run, f"{name} {dict(profiles.dtypes)[name]}, states binary")


def translated_columns(columns: DataFrame, lib: Library, block: int = BLOCK) -> DataFrame:
    """(name, i, state): the state of largest posterior of every column (name, i, p: array of probabilities).

    Profiles are cut into blocks of columns with the window's reach on both sides, so neither a long profile nor a name of most
    columns is ever in one task. Columns that a profile lacks, or whose p is null, count nothing in their neighbours' windows.
    """
    shared = columns.sparkSession.sparkContext.broadcast(lib)
    reach, residues = lib.weights.shape[1] // 2, lib.emits.shape[1]
    parts = F.sequence(F.floor((F.col("i") - reach) / block), F.floor((F.col("i") + reach) / block))
    kinds = dict(columns.dtypes)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        first = int(f["_block"].iloc[0]) * block - reach
        p = np.zeros((block + 2 * reach, residues))
        at = f["i"].to_numpy() - first
        p[at] = np.stack(list(f["p"]))
        own = f[(at >= reach) & (at < block + reach)]
        states = posteriors(p, shared.value).argmax(1)
        return pd.DataFrame({"name": own["name"], "i": own["i"], "state": states[own["i"].to_numpy() - first]})

    cut = columns.select("name", "i", "p", F.explode(parts).alias("_block")).where("p is not null")
    return cut.groupBy("name", "_block").applyInPandas(run, f"name {kinds['name']}, i {kinds['i']}, state int")


def state_texts(states: DataFrame) -> DataFrame:
    """(name, states): a profile's states as a sequence of one byte a column, in order; only the states move."""
    ordered = F.sort_array(F.collect_list(F.struct("i", "state")))
    return states.groupBy("name").agg(F.unhex(F.array_join(F.transform(ordered, lambda s: F.lpad(F.hex(s["state"].cast("long")), 2, "0")), "")).alias("states"))
