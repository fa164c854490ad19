"""Near-duplicate groups: MinHash with banding, signature and set verification, large-star and small-star.

1. Every text becomes the set of its distinct k-word shingles (64-bit hashes), a 128-bit print of the set and the
   minima of HASHES universal hash functions. Equal sets form a class; its smallest id stands for it.
2. The minima are cut into BANDS bands; representatives that share a band meet in a bucket. A bucket's smallest id is its
   hub; every member is compared with the hub: minima first, then the full sets.
3. Verified links are joined into components by alternating large-star and small-star.
4. Buckets that still hold several components: members outside the largest of them are compared with all members of
   other components, by minima and by the triangle inequality of the Jaccard distance (both distances to the hub are
   known), and what passes by full sets, in place: only links leave the task. The components are then joined again.

A link needs ``den * |A and B| >= num * |A or B|``. At similarity 0.8 two texts share no band with probability 5e-8, and a
true link has fewer than AGREE equal minima with probability 3e-7; nothing else is lost, and no pair but one of those
candidates is ever made. Large buckets are dealt out in chunks, of members as of those that are compared with them and by
their shingles as by their number, so no task holds one. A hub of many members and a set of many copies are several keys.

Null, empty and wordless texts have no shingle and link with nothing; texts of fewer than k words have one. Rows of
equal ids are one node; a null id links with nothing and gets a null component. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandql.llm.common import bounded_batches, dropped, stored, swept

HASHES, BANDS = 128, 32
ROWS = HASHES // BANDS
#: Equal minima that a candidate must have: five standard deviations below 0.8 of them.
AGREE = 80
#: Ids that a broadcast may hold; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Members of a bucket, members that are compared with them, and shingles of the former that one task holds at a time.
CHUNK, CHUNK_SHINGLES = 512, 2_000_000
#: Texts that a worker shingles at a time.
SLICE = 1000
#: Pairs of a hub that one of its salts holds, and copies of a set beyond which they meet its component by a broadcast.
SPLIT_PAIRS, SPLIT_COPIES = 1_000, 10_000
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)[:, None]


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: A-Z lowered, words told apart by ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(["" if t is None else t for t in texts], pa.string())))
    words = lists.flatten().dictionary_encode()
    distinct, codes = words.dictionary.to_pylist(), words.indices.to_numpy()
    bounds = lists.offsets.to_numpy()
    hashed = pd.util.hash_array(np.array(distinct, dtype=object), categorize=False) if distinct else np.zeros(0, dtype=np.uint64)
    if "" in distinct:
        real = codes != distinct.index("")
        bounds = np.concatenate(([0], np.cumsum(real)))[bounds]
        codes = codes[real]
    w = hashed[codes]

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    joined = w.copy()
    for j in range(1, k):
        joined[: len(w) - j] = mixed(joined[: len(w) - j] * np.uint64(0x9E3779B97F4A7C15)) + w[j:]
    joined = mixed(joined)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            digest = hashlib.blake2b(w[a:b].tobytes(), digest_size=8, person=b"short").digest()
            out.append(np.frombuffer(digest, dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def minima(s: np.ndarray) -> np.ndarray:
    """The HASHES minima of a set."""
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint64)
    x = s >> np.uint64(32)
    for i in range(0, len(x), 512):
        np.minimum(best, ((_A * x[i : i + 512] + _B) >> np.uint64(32)).min(1), out=best)
    return best.astype("<u4")


def signatures(df: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, f1 and f2 (print of the set) and sig (minima, packed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                sets = shingle_sets(part.column(1).to_pylist(), k)
                prints = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([minima(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["id", "n_shingles", "f1", "f2", "sig"],
                )

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_shingles long, f1 long, f2 long, sig binary")


def _bands() -> Column:
    """The hashes of a signature's bands."""
    return F.array(*(F.xxhash64(F.lit(b), F.substring("sig", 1 + 4 * ROWS * b, 4 * ROWS)) for b in range(BANDS)))


def _small(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """df, marked for broadcast if a count shows that it has at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _met(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) with their values of a side (id, value) as sa and sb. A hub that is a in more than SPLIT_PAIRS pairs would be one
    key: it is salted by b, its own row repeated for each salt."""
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT_PAIRS).cast("int").alias("salts")).where("salts > 1")
    left, right, on = pairs, side.select(F.col("id").alias("a"), F.col(value).alias("sa")), ["a"]
    if hot.limit(1).count():
        hot, on = _small(stored(hot, "hot-hubs")), ["a", "salt"]
        left = pairs.join(hot, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        right = right.join(hot, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    met = left.join(side.select(F.col("id").alias("b"), F.col(value).alias("sb")), "b")
    return met.join(right, on).select("a", "b", "sa", "sb")


def _agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) with at least AGREE equal minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u4").reshape(-1, HASHES) for c in (2, 3))
                near = pa.array((x == y).sum(1) >= AGREE)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], names=["a", "b"])

    return _met(pairs, sigs, "sig").mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and set (sorted hashes, packed) of the documents that ids names, as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1).to_pylist(), k)], pa.binary())], names=["id", "s"])

    return stored(docs.join(_small(ids.distinct()), "id", "left_semi").mapInArrow(run, "id long, s binary"), "shingle-sets")


def _measured(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """a, b, both (size of the intersection) and either (of the union) of full sets, for stored pairs of ids."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            common, total = [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                n = len(np.intersect1d(p, q, assume_unique=True))
                common.append(n)
                total.append(len(p) + len(q) - n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "both", "either"])

    own = _sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), k)
    return _met(pairs, own, "s").mapInArrow(compare, "a long, b long, both long, either long")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of the undirected edges (a, b), by alternating large-star
    and small-star until nothing changes, which takes a logarithm of the nodes in rounds. Each round is a table in the
    shared folder, and the one before it is deleted."""
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == last or not mark["n"]:
            break
        last, done = mark, now
        # Large-star: every larger neighbour of a node goes to the least of the node and its neighbours.
        either = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = either.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = either.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small-star: a node and its smaller neighbours go to the least of these.
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "small-star")
        dropped(spark, done, large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (bucket, chunk, part, side, ...) of a bucket's chunk and part together, its members (side 0) before its queries."""
    return rows.repartition("bucket", "chunk", "part").sortWithinPartitions("bucket", "chunk", "part", "side")


def _parted(near: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with the bucket's largest one (main), the number of its chunks of
    members, and that of its parts of queries: members outside the largest component."""
    sizes = near.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    split = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("most"), F.sum("w").alias("w"), F.count("*").alias("comps")).where("comps > 1")
    chunks = F.ceil(F.greatest(F.col("size") / CHUNK, F.col("w") / CHUNK_SHINGLES)).cast("int")
    split = split.select("bucket", "main", "size", (F.col("size") - F.col("most")).alias("asked"), chunks.alias("chunks"))
    return near.join(_small(split.withColumn("parts", F.ceil(F.col("asked") / CHUNK).cast("int"))), "bucket")


def _open_links(members: DataFrame, comps: DataFrame, dist: DataFrame, sigs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between different components of a bucket. members: bucket, band, hub, id, n_shingles of buckets of three or more.

    First by minima and distances to the hub, which leaves the members that have a partner at all; then these
    by their full sets. A pair is looked at in the first band that it shares only, and no row is made for a pair
    that isn't linked: one is for each query and component that it links to.
    """
    near = members.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    near = near.join(dist.select(F.col("a").alias("hub"), F.col("b").alias("id"), "far"), ["hub", "id"], "left").withColumn("far", F.when(F.col("id") == F.col("hub"), 0.0).otherwise(F.col("far")))
    near = stored(near, "bucket-members")
    parted = _parted(near)
    kept = ("band", "id", "component", "far")
    split = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = parted.select("bucket", split("chunks").alias("chunk"), every("parts").alias("part"), F.lit(0).alias("side"), *kept)
    asks = parted.where("component <> main and id <> hub").select("bucket", every("chunks").alias("chunk"), split("parts").alias("part"), F.lit(1).alias("side"), *kept)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, table, used = None, [], None, None
        for b in batches:
            out: list[tuple] = []
            for bucket, chunk, part, side, band, i, c, d, s in zip(*(x.to_pylist() for x in b.columns)):
                d = np.nan if d is None else d
                if (bucket, chunk, part) != key:
                    key, rows, table = (bucket, chunk, part), [], None
                if side == 0:
                    rows.append((i, c, d, s))
                    continue
                if not rows:
                    continue
                if table is None:
                    table = tuple(np.array([r[j] for r in rows]) for j in range(3)) + (np.frombuffer(b"".join(r[3] for r in rows), dtype="<u4").reshape(-1, HASHES),)
                    used = np.zeros(len(rows), dtype=bool)
                own = np.frombuffer(s, dtype="<u4")
                at = np.flatnonzero((table[1] != c) & ~(np.abs(table[2] - d) > 1 - num / den + 1e-9))
                same = table[3][at] == own
                good = same.sum(1) >= AGREE
                at, same = at[good], same[good]
                shared = same.reshape(-1, BANDS, ROWS).all(2)
                here = shared.argmax(1) == band
                at = at[here]
                if len(at):
                    out.append((bucket, chunk, part, 1, i, c))
                    for j in at[~used[at]].tolist():
                        out.append((bucket, chunk, part, 0, int(table[0][j]), int(table[1][j])))
                    used[at] = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["bucket", "chunk", "part", "side", "id", "component"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, table = None, [], None
        for b in batches:
            out: list[tuple[int, int]] = []
            for bucket, chunk, part, side, i, c, s in zip(*(x.to_pylist() for x in b.columns)):
                if (bucket, chunk, part) != key:
                    key, rows, table = (bucket, chunk, part), [], None
                own = np.frombuffer(s, dtype=np.uint64)
                if side == 0:
                    rows.append((i, c, own))
                    continue
                if not rows:
                    continue
                if table is None:  # all members' shingles in order, each with its member
                    size = np.array([len(r[2]) for r in rows])
                    flat = np.concatenate([r[2] for r in rows])
                    order = np.argsort(flat, kind="stable")
                    table = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), size, flat[order], np.repeat(np.arange(len(rows)), size)[order]
                lo, hi = np.searchsorted(table[3], own, "left"), np.searchsorted(table[3], own, "right")
                n = hi - lo
                ends = np.cumsum(n)
                both = np.bincount(table[4][np.repeat(lo - ends + n, n) + np.arange(ends[-1])], minlength=len(rows)) if len(own) else np.zeros(len(rows), dtype=int)
                hit = np.flatnonzero((table[1] != c) & (den * both >= num * (table[2] + len(own) - both)))
                for j in np.unique(table[1][hit], return_index=True)[1]:
                    out.append((min(i, int(table[0][hit[j]])), max(i, int(table[0][hit[j]]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["a", "b"])

    rows = base.union(asks).join(sigs.select("id", "sig"), "id").select("bucket", "chunk", "part", "side", *kept, "sig")
    alive = stored(_dealt(rows).mapInArrow(propose, "bucket long, chunk long, part long, side long, id long, component long"), "open-members")
    if not alive.limit(1).count():
        return alive.select(F.col("id").alias("a"), F.col("component").alias("b"))
    rows = alive.join(_sets(docs, alive.select("id"), k), "id").select("bucket", "chunk", "part", "side", "id", "component", "s")
    return _dealt(rows).mapInArrow(confirm, "a long, b long").distinct()


def near_duplicates(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links) and kept (the id is its component's), one row per row of df."""
    spark = df.sparkSession
    bounded_batches(spark)
    with swept(spark) as kept:
        docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        own = stored(signatures(df, k, id_col, text_col), "signatures")
        real = own.where("id is not null and n_shingles > 0")
        classes = stored(real.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.min("sig").alias("sig"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("n")), "classes")
        sigs = classes.select(F.col("rep").alias("id"), "sig").dropDuplicates(["id"])

        met = classes.select(F.col("rep").alias("id"), "n_shingles", F.posexplode(_bands()).alias("band", "bucket"))
        buckets = stored(met.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("other"), F.count("*").alias("n")).where("n > 1 and hub <> other"), "buckets")
        large = buckets.where("n > 2").select("bucket", "hub")
        members = stored(met.join(_small(large), "bucket"), "members")
        pairs = buckets.where("n = 2").select(F.col("hub").alias("a"), F.col("other").alias("b")).union(members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))).distinct()
        pairs = stored(pairs, "hub-pairs")
        near = stored(_agreeing(pairs, sigs), "near-pairs")
        first = stored(_measured(near, docs, k), "measured")
        linked = lambda m: m.where(den * F.col("both") >= num * F.col("either")).select("a", "b")

        # Ids that occur with different texts tie these texts' classes together.
        twice = real.groupBy("id").agg(F.min(F.struct("f1", "f2")).alias("lo"), F.max(F.struct("f1", "f2")).alias("hi")).where("lo <> hi").select("id")
        ties = real.join(twice, "id").join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
        links = stored(linked(first).union(ties), "links")
        comps = stored(components(links), "components")

        dist = first.select("a", "b", (1 - F.col("both") / F.col("either")).alias("far"))
        more = stored(_open_links(members, comps, dist, sigs, docs, k, num, den), "open-links")
        if more.limit(1).count():
            comps = stored(components(links.union(more)), "components")
        kept += [own, classes, comps]

    named = classes.join(comps, classes["rep"] == comps["node"], "left").where("n > 1 or component is not null").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    # Texts without shingles are all of one print, and many copies of one: neither may be a key of the join.
    none = own.where("id is null or n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    cold = own.where("id is not null and n_shingles > 0")
    hot = named.where(F.col("n") > SPLIT_COPIES).select("f1", "f2", F.col("component").alias("_hot"))
    parts = [none]
    if hot.limit(1).count():
        met = cold.join(_small(hot), ["f1", "f2"], "left")
        parts.append(met.where("_hot is not null").select("id", "n_shingles", F.col("_hot").alias("component_id")))
        cold = met.where("_hot is null").drop("_hot")
    parts.append(cold.join(named.where(F.col("n") <= SPLIT_COPIES), ["f1", "f2"], "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id")))
    out = reduce(DataFrame.union, parts)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
