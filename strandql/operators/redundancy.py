"""Greedy redundancy and diversity filters: one alignment at a time, alignments in parallel.

The choice of a member depends on all chosen before it, so an alignment is the unit of work: a task holds a byte for each column of a
member between its ends, one alignment at a time. Members of an alignment are compared in pairs, so its time grows with the
square of their number; bits of 64 columns tell most pairs apart. Very large alignments should be
filtered by coverage or score first (``msa.filter_tool``), which goes row by row.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandql.session import BROADCAST_ROWS, dropped, stored

GAPS = 20  # codes from here on are no residues


def codes(rows: list[str]) -> np.ndarray:
    """Rows of equal length as a matrix of codes: letters 0-25 but for J, O, X; 255 for the rest."""
    width = max(map(len, rows), default=0)
    raw = np.frombuffer("".join(r.ljust(width, "-") for r in rows).encode("latin-1", "replace"), dtype=np.uint8).reshape(len(rows), width)
    out = np.where((raw >= 65) & (raw <= 90), raw - 65, 255).astype(np.uint8)
    for c in b"JOX":
        out[raw == c] = 255
    return out


#: Symbol to code: letters 0-25 but for J, O, X; 254 for what else is no residue, 255 for a gap.
_CODE = np.full(256, 254, dtype=np.uint8)
_CODE[[c for c in range(65, 91) if chr(c) not in "JOX"]] = [c - 65 for c in range(65, 91) if chr(c) not in "JOX"]
_CODE[ord("-")] = 255
LETTER_CODES = 26


class Members:
    """An alignment's members as codes, without the gaps at their ends: a row begins at column ``at``, its residues are from ``a`` to ``b`` (0 and -1
    without any)."""

    def __init__(self):
        self.rows: list[np.ndarray] = []
        self.at: list[int] = []
        self.a: list[int] = []
        self.b: list[int] = []
        self.nres: list[int] = []
        self.width = 0

    def add(self, row: np.ndarray) -> None:
        real, some = np.flatnonzero(row < LETTER_CODES), np.flatnonzero(row != 255)
        first, last = (int(some[0]), int(some[-1])) if len(some) else (0, -1)
        self.rows.append(row[first : last + 1].copy())
        self.at.append(first)
        self.a.append(int(real[0]) if len(real) else 0)
        self.b.append(int(real[-1]) if len(real) else -1)
        self.nres.append(len(real))
        self.width = max(self.width, len(row))

    @classmethod
    def of(cls, x: Members | np.ndarray | list[str]) -> Members:
        """Members of a matrix of codes, or of row texts."""
        if isinstance(x, Members):
            return x
        out = cls()
        for row in x:
            out.add(_CODE[np.frombuffer(row.encode("latin-1", "replace"), dtype=np.uint8)] if isinstance(row, str) else row)
        return out

    def __len__(self) -> int:
        return len(self.rows)

    def part(self, k: int, lo: int, hi: int) -> np.ndarray:
        return self.rows[k][lo - self.at[k] : hi + 1 - self.at[k]]

    def similar(self, k: int, r: int, least: float) -> bool:
        """Whether fewer than the share ``least`` of k's residues that meet one of r differ from it."""
        lo, hi = max(self.a[k], self.a[r]), min(self.b[k], self.b[r])
        if hi < lo:
            return False
        x, y = self.part(k, lo, hi), self.part(r, lo, hi)
        both = (x < LETTER_CODES) & (y < LETTER_CODES)
        differ = np.count_nonzero((x != y) & both)
        return differ < int(least * min(self.nres[k], hi - lo + 1) + 0.999) and differ < least * np.count_nonzero(both)


class _Bits:
    """The first WORDS * 64 columns of members as bits: whether there is a residue, and two bits of its letter's class. Members that differ in
    the class of a letter differ in the letter, so this tells which ones are surely no less than so many residues apart."""

    WORDS, CHUNK = 32, 4096

    def __init__(self, m: Members):
        self.m, self.n = m, 0
        seen = np.zeros(256, dtype=np.int64)
        for row in m.rows[:1000]:
            seen += np.bincount(row, minlength=256)
        # Four classes of about as many residues each.
        self.classes, load = np.zeros(256, dtype=np.uint8), [0] * 4
        for c in np.argsort(-seen[:LETTER_CODES], kind="stable").tolist():
            least = load.index(min(load))
            self.classes[c], load[least] = least, load[least] + int(seen[c]) + 1
        self.words = max(1, min(self.WORDS, -(-m.width // 64)))
        self.bits = np.zeros((3, self.words, len(m)), dtype=np.uint64)
        self.member = np.zeros(len(m), dtype=np.int64)
        self.room = np.zeros(self.CHUNK, dtype=np.uint64), np.zeros(self.CHUNK, dtype=np.uint64), np.zeros(self.CHUNK, dtype=np.uint8)

    def of(self, k: int) -> np.ndarray:
        out = np.zeros((3, self.words * 64), dtype=bool)
        a = self.m.at[k]
        row = self.m.rows[k][: max(0, self.words * 64 - a)]
        real = row < LETTER_CODES
        kind = self.classes[row]
        out[:, a : a + len(row)] = real, real & (kind & 1 > 0), real & (kind > 1)
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    def add(self, k: int) -> None:
        self.bits[:, :, self.n] = self.of(k)
        self.member[self.n] = k
        self.n += 1

    def near(self, k: int, differ: float) -> np.ndarray:
        """The members that may differ from k in fewer than so many residues."""
        own, found = self.of(k), []
        words = range(self.m.a[k] // 64, min(self.m.b[k] // 64 + 1, self.words))
        for begin in range(0, self.n, self.CHUNK):
            live: np.ndarray | None = None
            size = min(self.CHUNK, self.n - begin)
            apart = np.zeros(size, dtype=np.uint16)
            for turn, w in enumerate(words, 1):
                real, one, two = (x[w, begin : begin + size] if live is None else x[w, live] for x in self.bits)
                t, u, c = (x[: len(apart)] for x in self.room)
                np.bitwise_xor(one, own[1, w], out=t)
                np.bitwise_xor(two, own[2, w], out=u)
                np.bitwise_or(t, u, out=t)
                np.bitwise_and(t, real, out=t)
                np.bitwise_and(t, own[0, w], out=t)
                np.bitwise_count(t, out=c)
                np.add(apart, c, out=apart)
                if turn % 3 == 0:
                    stay = np.flatnonzero(apart < differ)
                    if len(stay) < 0.2 * len(apart):
                        live, apart = stay + begin if live is None else live[stay], apart[stay]
                        if not len(live):
                            break
            stay = np.flatnonzero(apart < differ)
            found.append(self.member[stay + begin if live is None else live[stay]])
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def _largest(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest value from lo to hi of each pair; 0 where hi is below lo."""
    out = np.zeros(len(lo), dtype=values.dtype)
    size = hi - lo + 1
    level, table = 0, values
    while (size > 0).any() and 1 << level <= int(size.max()):
        at = np.flatnonzero((size >= 1 << level) & (size < 2 << level))
        out[at] = np.maximum(table[lo[at]], table[hi[at] + 1 - (1 << level)])
        step = 1 << level
        table = np.maximum(table[:-step], table[step:]) if len(table) > step else table
        level += 1
    return out


#: Members kept from which on bits are compared first, and the identity in percent: below it they rarely decide.
MANY_KEPT, BITS_ID = 64, 40


def keep_diverse(x: Members | np.ndarray, first_id: int, max_id: int, diversity: int, keep: np.ndarray, reach: int = 25, enough: int | None = None) -> np.ndarray:
    """Members (of those in ``keep``; 2 marks one that always stays) that are less than max_id percent identical to a
    longer member kept before. With a diversity, the threshold starts at first_id and rises only where fewer than so
    many members cover a window of 2 * reach + 1 columns. Identity is a share of the shorter member's residues.
    enough: what is kept needn't be complete once it is more than so many."""
    m = Members.of(x)
    n, width = len(m), m.width
    accepted = keep == 2
    if first_id > max_id or not n:
        return accepted | (keep > 0)
    nres, a, b = (np.array(v, dtype=np.int64) for v in (m.nres, m.a, m.b))
    order = np.lexsort((np.arange(n), -nres))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    depth = np.zeros(width, dtype=np.int64)
    ranks = sorted(rank[accepted].tolist())  # of what is kept
    bits: _Bits | None = None
    for k in np.flatnonzero(accepted):
        depth[a[k] : b[k] + 1] += 1
    limit, refused = np.full(width, first_id, dtype=np.float64), np.full(n, -1.0)
    seqid, most, need_before, step = first_id, np.zeros(width, dtype=np.int64), max(1, diversity), 0
    lo = np.maximum(0, np.minimum(width - 2 * reach, np.arange(width) - reach))
    hi = np.minimum(width - 1, np.maximum(2 * reach - 1, np.arange(width) + reach))

    def rival(k: int, own: float) -> bool:
        """Whether a longer member that is kept is as similar."""
        nonlocal bits
        least = 0.9999 - 0.01 * own
        if own < BITS_ID or len(ranks) < MANY_KEPT:
            return any(m.similar(k, int(order[r]), least) for r in ranks[: bisect_left(ranks, rank[k])])
        if bits is None:
            bits = _Bits(m)
            for r in ranks:
                bits.add(int(order[r]))
        return any(rank[r] < rank[k] and m.similar(k, r, least) for r in bits.near(k, least * nres[k]).tolist())

    while seqid <= max_id:
        most = np.maximum(most, _largest(depth, lo, hi))
        open_ = most < diversity
        need = int((diversity - most[open_]).max(initial=0))
        if not open_.any():
            break
        limit[open_] = seqid
        own = np.maximum(first_id, _largest(limit, a, b))
        # A member that was refused at the same identity is so again: what refused it is still kept.
        for k in order[~accepted[order] & (keep[order] > 0) & ((refused[order] != own[order]) | (seqid >= 100))].tolist():
            if seqid >= 100:
                accepted[k] = True
                continue
            if rival(k, own[k]):
                refused[k] = own[k]
                continue
            accepted[k] = True
            insort(ranks, int(rank[k]))
            if bits is not None:
                bits.add(k)
            if enough is not None and len(ranks) > enough:
                return accepted
            depth[a[k] : b[k] + 1] += 1
        # Whole numbers throughout: the ratio is cut before it is multiplied.
        step = max(1, min(5, need // (need_before - need + 1) * step // 2)) if need_before >= need else 1
        need_before, seqid = need, seqid + step
    return accepted


def per_alignment(rows: DataFrame, choose: Callable[[Members], np.ndarray], schema_extra: str = "kept boolean") -> DataFrame:
    """rows (msa, k, row) with the choice made by ``choose(members) -> kept`` for each alignment. A task reads its alignments in order and holds
    the codes of one."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, members = [], [], Members()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.concat_arrays(held), pa.array(np.asarray(choose(members), dtype=bool))], names=["msa", "k", "kept"])

        last = None
        for batch in batches:
            msa, texts = batch.column("msa").to_pylist(), batch.column("row")
            begin = 0
            while begin < len(msa):
                end = next((x for x in range(begin, len(msa)) if msa[x] != msa[begin]), len(msa))
                if names and msa[begin] != last:
                    yield done()
                    names, held, members = [], [], Members()
                names.append(batch.column("msa").slice(begin, end - begin))
                held.append(batch.column("k").slice(begin, end - begin))
                last = msa[begin]
                for text in texts.slice(begin, end - begin):
                    members.add(_CODE[np.frombuffer(text.as_py().encode("latin-1", "replace"), dtype=np.uint8)])
                begin = end
        if names:
            yield done()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("msa", "k", "row").repartition(n, "msa").sortWithinPartitions("msa", F.col("k").asc_nulls_last())
    return dealt.mapInArrow(run, f"msa {kinds['msa']}, k {kinds['k']}, {schema_extra}")


def identity_filter(rows: DataFrame, max_id: int = 90, diversity: int = 0, first_id: int = 0) -> DataFrame:
    """Non-redundant members of each alignment (msa, k, kept). Without a diversity one pass at max_id; the first
    member, the query, always stays."""

    def choose(x: Members) -> np.ndarray:
        keep = np.ones(len(x), dtype=np.int64)
        keep[0] = 2
        n = diversity if diversity > 0 else len(x) + 1
        return keep_diverse(x, max_id if diversity <= 0 else max(first_id, 10), max_id, n, keep)

    return per_alignment(rows, choose)


def neff_of(x: Members | np.ndarray, some: np.ndarray | None = None) -> float:
    """Mean over columns of two to the entropy of the residues' weighted shares, by position-based weights of the members (of some of them)."""
    m = Members.of(x)
    members = range(len(m)) if some is None else np.flatnonzero(some).tolist()
    if not len(members):
        return 1.0
    places = np.arange(m.width) * LETTER_CODES

    def cells(k: int) -> np.ndarray:
        row = m.rows[k]
        real = np.flatnonzero(row < LETTER_CODES)
        return places[real + m.at[k]] + row[real]

    # A member has one residue a column, so none of its cells comes twice.
    counts = np.zeros(m.width * LETTER_CODES)
    for k in members:
        counts[cells(k)] += 1
    kinds = np.maximum(1, (counts.reshape(-1, LETTER_CODES) > 0).sum(1))
    share = (1.0 / (np.maximum(1, counts).reshape(-1, LETTER_CODES) * kinds[:, None])).ravel()
    w = np.array([share[cells(k)].sum() for k in members])
    w = w / w.sum() if w.sum() else np.full(len(w), 1.0 / len(w))
    counts[:] = 0
    for k, v in zip(members, w.tolist()):
        counts[cells(k)] += v
    f = counts.reshape(-1, LETTER_CODES)
    total = f.sum(1)
    p = f[total > 0] / total[total > 0, None]
    if not len(p):
        return 1.0
    return float(np.exp2(-(p * np.log2(np.where(p > 0, p, 1.0))).sum(1)).mean())


def query_scores(rows: Members | list[str], table: np.ndarray, gap_open: float = 6.0, gap_extend: float = 1.0) -> np.ndarray:
    """Score a residue of each member against the first, as ``msa.query_score`` has it. table: (26, 26), first's letter, member's."""
    m = Members.of(rows)
    first = np.full(m.width, 255, dtype=np.uint8)
    first[m.at[0] : m.at[0] + len(m.rows[0])] = m.rows[0]
    # Both residues, a gap of the query, a gap of the member; the rest scores 0 and holds runs.
    kinds = np.zeros((256, 256), dtype=np.uint8)
    kinds[:LETTER_CODES, :LETTER_CODES], kinds[255, :LETTER_CODES], kinds[:LETTER_CODES, 255] = 1, 2, 3
    out = np.full(len(m), -np.inf)
    for k, own in enumerate(m.rows):
        if not m.nres[k]:
            continue
        other = first[m.at[k] : m.at[k] + len(own)]
        kind = kinds[other, own]
        both, seen = kind == 1, kind[kind > 0]
        gaps = seen > 1
        longer = np.count_nonzero(gaps[1:] & (seen[1:] == seen[:-1]))
        cost = gap_open * (np.count_nonzero(gaps) - longer) + gap_extend * longer
        out[k] = (table[other[both], own[both]].sum() - cost) / m.nres[k]
    return out


def neff_filter(rows: DataFrame, target: float, scores: DataFrame | None = None, max_id: int = 90, coverage: int = 0) -> DataFrame:
    """Members by their score a residue against the query, the least such score found by bisection so that the
    alignment's effective number is at most the target. At each step the whole filter runs: coverage (percent of columns),
    score, and pairwise identity of those left. An alignment within the target stays as it is. scores: (a, b, s) of the
    query's and the member's residue; without them 4 for equal and -1 for other ones."""
    table = np.where(np.eye(26, dtype=bool), 4.0, -1.0)
    if scores is not None:
        table = np.zeros((26, 26))
        for r in scores.collect():  # 400 at most
            table[ord(r["a"]) - 65, ord(r["b"]) - 65] = r["s"]
    # U, B and Z score as C, D and E.
    like = np.arange(26)
    for a, b in zip("UBZ", "CDE"):
        like[ord(a) - 65] = ord(b) - 65
    table = table[np.ix_(like, like)]

    def choose(x: Members) -> np.ndarray:
        if neff_of(x) <= target:
            return np.ones(len(x), dtype=bool)
        score = query_scores(x, table)
        wide = 100 * np.array(x.nres) >= coverage * x.width

        def filtered(least: float) -> np.ndarray:
            keep = (wide & (score >= least)).astype(np.int64)
            keep[0] = 2
            return keep_diverse(x, max_id, max_id, len(x) + 1, keep)

        # Between two neighbouring scores nothing changes, so these are all the thresholds there are; the last leaves the query.
        steps = np.append(np.unique(score[np.isfinite(score)]), np.inf)
        lo, hi = -1, len(steps) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if neff_of(x, filtered(steps[mid])) <= target else (mid, hi)
        return filtered(steps[hi])

    return per_alignment(rows, choose)


def _counts(x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Residue counts (columns, 26) of members, weighted or not."""
    n, width = x.shape
    real = x != 255
    at = (np.arange(width) * 26 + np.where(real, x, 0)).ravel()[real.ravel()]
    w = None if weights is None else np.repeat(weights, width)[real.ravel()]
    return np.bincount(at, w, minlength=width * 26)[: width * 26].reshape(width, 26)


def henikoff(x: np.ndarray) -> np.ndarray:
    """Position-based weights of members, summing to 1."""
    counts = _counts(x)
    kinds = np.maximum(1, (counts > 0).sum(1))
    real = x != 255
    own = counts[np.arange(x.shape[1]), np.where(real, x, 0)]
    w = np.where(real, 1.0 / (np.maximum(1, own) * kinds), 0.0).sum(1)
    total = w.sum()
    return w / total if total else np.full(len(x), 1.0 / max(1, len(x)))


def local_columns(x: np.ndarray, end_gaps: float = 0.1, least: int = 10) -> list[tuple[int, float, np.ndarray]]:
    """(column, effective number, residue frequencies) with weights of each column's own sub-alignment: the members with a
    residue there, over the columns that at most a share of them misses by end gaps; with fewer than ``least`` such columns
    the whole alignment's weights. Columns of the same members are worked out once."""
    n, width = x.shape
    real = x != 255
    place = np.arange(width)
    first = np.where(real.any(1), real.argmax(1), width)
    last = np.where(real.any(1), width - 1 - real[:, ::-1].argmax(1), -1)
    inside = (place >= first[:, None]) & (place <= last[:, None])
    whole, known, out = henikoff(x), {}, []
    for i in range(width):
        key = real[:, i].tobytes()
        if key not in known:
            idx = np.flatnonzero(real[:, i])
            used = np.flatnonzero((~inside[idx]).sum(0) <= end_gaps * len(idx)) if len(idx) else np.zeros(0, dtype=int)
            if len(used) < least:
                used, w = np.arange(width), whole[idx]
            else:
                w = henikoff(x[np.ix_(idx, used)])
            w = w / w.sum() if w.sum() else w
            f = _counts(x[np.ix_(idx, used)], w)
            total = f.sum(1)
            f = f[total > 0] / total[total > 0, None]
            entropy = -(f * np.log2(np.where(f > 0, f, 1.0))).sum(1)
            known[key] = idx, w, float(2 ** entropy.mean()) if len(entropy) else 1.0
        idx, w, neff = known[key]
        f = np.bincount(x[idx, i], w, minlength=26)[:26] if len(idx) else np.zeros(26)
        out.append((i + 1, neff, f / f.sum() if f.sum() else f))
    return out


def local_profiles(rows: DataFrame) -> DataFrame:
    """Columns of each alignment by its position-specific weights: (msa, i, neff, r, f) where f > 0."""
    kinds = dict(rows.dtypes)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k", kind="stable")
        out = [(f["msa"].iloc[0], i, neff, chr(65 + a), v) for i, neff, freq in local_columns(codes(f["row"].tolist())) for a, v in enumerate(freq) if v > 0]
        return pd.DataFrame(out, columns=["msa", "i", "neff", "r", "f"])

    return rows.select("msa", "k", "row").groupBy("msa").applyInPandas(run, f"msa {kinds['msa']}, i long, neff double, r string, f double")


def most_dissimilar(rows: DataFrame, n: int, max_id: int = 90) -> DataFrame:
    """About n members to show: the largest identity threshold, from 10 up, that still leaves no more than n."""

    def choose(x: Members) -> np.ndarray:
        keep = np.ones(len(x), dtype=np.int64)
        keep[0] = 2
        best = keep == 2
        for seqid in range(min(10, max_id), max_id + 1):
            got = keep_diverse(x, seqid, seqid, len(x) + 1, keep, enough=n)
            if got.sum() > n:
                break
            best = got
        return best

    return per_alignment(rows, choose)


def prune_similar(vectors: DataFrame, group: str, name: str, vector: str, limit: int) -> DataFrame:
    """Members of each group left after dropping, one by one, that of the largest summed Bhattacharyya similarity."""
    kinds = dict(vectors.dtypes)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(name).reset_index(drop=True)
        v = np.sqrt(np.maximum(0, np.stack([np.asarray(x, dtype=float) for x in f[vector]])))
        v /= np.maximum(1e-30, np.linalg.norm(v, axis=1, keepdims=True))
        live = np.ones(len(f), dtype=bool)
        total = v @ v.sum(0)  # the similarities to all, without their matrix
        while live.sum() > limit:
            worst = int(np.where(live, total, -np.inf).argmax())
            live[worst] = False
            total = total - v @ v[worst]
        return f.loc[live, [group, name]]

    return vectors.select(group, name, vector).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {name} {kinds[name]}")


def independent(hits: DataFrame, limit: int) -> DataFrame:
    """Hits (query, target, rank, i1, i2) in order of rank that overlap each hit taken before by at most limit columns."""
    kinds = dict(hits.dtypes)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank", kind="stable").reset_index(drop=True)
        lo, hi, kept = f["i1"].to_numpy(), f["i2"].to_numpy(), []
        for r in range(len(f)):
            shared = np.minimum(hi[kept], hi[r]) - np.maximum(lo[kept], lo[r]) + 1 if kept else np.zeros(0)
            if not (shared > limit).any():
                kept.append(r)
        return f.loc[kept, ["query", "target", "rank"]]

    return hits.select("query", "target", "rank", "i1", "i2").groupBy("query").applyInPandas(run, f"query {kinds['query']}, target {kinds['target']}, rank {kinds['rank']}")


#: Decimals of a turn's gains: sums in another order are equal to so many, and less than half of the last one is no gain.
GAIN_DIGITS = 9


def greedy_cover(gains: DataFrame, alpha: float = 1.0, limit: int | None = 10) -> DataFrame:
    """Targets that together cover a query best (query, target, turn): each turn takes the target of the largest sum of
    exp(alpha * (p - best so far)) - 1 over the positions it improves, of equal ones the least; limit: turns at most, None for as many as
    gain anything. gains: (query, target, i, p); rows with a null are left out.

    A turn goes over all queries at once: sums by (query, target), one target a query, and the best of its positions joined
    back. A cell that a turn's best reaches can't gain any more and is gone, so the turns read less and less.
    """
    open_ = gains.where("query is not null and target is not null and i is not null and p > 0").groupBy("query", "target", "i").agg(F.max("p").cast("double").alias("p"))
    open_ = stored(open_.withColumn("best", F.lit(0.0)), "cover")
    taken, turn = [], 0
    while limit is None or turn < limit:
        turn += 1
        gain = open_.groupBy("query", "target").agg(F.round(F.sum(F.expm1(alpha * (F.col("p") - F.col("best")))), GAIN_DIGITS).alias("g")).where("g > 0")
        picked = stored(gain.groupBy("query").agg(F.min(F.struct((-F.col("g")).alias("g"), "target"))["target"].alias("target")).withColumn("turn", F.lit(turn)), "cover-turn")
        taken.append(picked)
        n = 0 if turn == limit else picked.limit(BROADCAST_ROWS + 1).count()
        if not n:
            break
        chosen = open_.join(F.broadcast(picked) if n <= BROADCAST_ROWS else picked, ["query", "target"]).select("query", "i", F.col("p").alias("now"))
        left = open_.join(chosen, ["query", "i"], "left").withColumn("best", F.greatest("best", F.coalesce("now", F.lit(0.0)))).where("p > best")
        before, open_ = open_, stored(left.select("query", "target", "i", "p", "best"), "cover")
        dropped(gains.sparkSession, before)
    dropped(gains.sparkSession, open_)
    return reduce(DataFrame.unionByName, taken)


def distances(sim: DataFrame) -> DataFrame:
    """-log2 of similarities (a, b, sim) held between 0.01 and 0.99, the least of both directions (a < b)."""
    d = sim.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (-F.log2(F.least(F.lit(0.99), F.greatest(F.lit(0.01), "sim")))).alias("d")).where("a <> b")
    return d.groupBy("a", "b").agg(F.min("d").alias("d"))


def upgma(names: list, d: np.ndarray) -> list[tuple[int, int, float]]:
    """Joins of average linkage: (node, node, height); nodes from len(names) on are joins in turn."""
    n = len(names)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), [1] * n, []
    live = list(range(n))
    while len(live) > 1:
        sub = d[np.ix_(live, live)]
        a, b = divmod(int(sub.argmin()), len(live))
        i, j = live[min(a, b)], live[max(a, b)]
        out.append((ids[i], ids[j], float(d[i, j]) / 2))
        mean = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, :] = d[:, i] = mean
        d[i, i] = np.inf
        size[i] += size[j]
        ids[i] = n + len(out) - 1
        live.remove(j)
    return out


def neighbour_joining(names: list, d: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Joins of the neighbour-joining tree: (node, node, branch, branch)."""
    n = len(names)
    d, ids, out = d.astype(float).copy(), list(range(n)), []
    while len(ids) > 2:
        k = len(ids)
        r = d.sum(1)
        q = (k - 2) * d - r[:, None] - r[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(q.argmin()), k))
        left = d[i, j] / 2 + (r[i] - r[j]) / (2 * (k - 2))
        out.append((ids[i], ids[j], float(left), float(d[i, j] - left)))
        new = (d[i] + d[j] - d[i, j]) / 2
        d[i, :] = d[:, i] = new
        d[i, i] = 0
        ids[i] = n + len(out) - 1
        d = np.delete(np.delete(d, j, 0), j, 1)
        ids.pop(j)
    if len(ids) == 2:
        out.append((ids[0], ids[1], float(d[0, 1]) / 2, float(d[0, 1]) / 2))
    return out


def trees(dist: DataFrame, group: str, method: str = "upgma") -> DataFrame:
    """The tree of each group's distances (group, a, b, d): one row for each join (step, left, right, height)."""
    kind = dict(dist.dtypes)[group]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(f["a"]) | set(f["b"]))
        at = {x: i for i, x in enumerate(names)}
        d = np.full((len(names), len(names)), f["d"].max())
        np.fill_diagonal(d, 0)
        for a, b, v in zip(f["a"], f["b"], f["d"]):
            d[at[a], at[b]] = d[at[b], at[a]] = v
        joins = upgma(names, d) if method == "upgma" else [(a, b, x + y) for a, b, x, y in neighbour_joining(names, d)]
        return pd.DataFrame([(f[group].iloc[0], i, a, b, h) for i, (a, b, h) in enumerate(joins)], columns=[group, "step", "left", "right", "height"])

    return dist.groupBy(group).applyInPandas(run, f"{group} {kind}, step long, left long, right long, height double")
