"""Curriculum mixing, importance resampling and ranked lexical search against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pytest

from strandql.llm import curriculum, lexical, resample
from strandql.llm.wordcodes import word_codes

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_targets(sizes, weights, repeats, total):
    """Shared by weight, those above their bound stopped there, the excess shared again."""
    out, free = {}, dict(weights)
    left = float(total)
    while free:
        share = {s: left * w / sum(free.values()) if sum(free.values()) else 0.0 for s, w in free.items()}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = repeats * sizes[s]
            left -= out[s]
            del free[s]
    return out


def plain_mix(rows, weights, repeats=3, total=None):
    """Words taken by each row, in the order of rows: the stream of a source's documents, gone through until the target is met."""
    size = [len(SPACE_WORD.findall(t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    target = plain_targets(sizes, weights(sizes), repeats, sum(sizes.values()) if total is None else total)
    taken = [0] * len(rows)
    for s in sizes:
        own = sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (hashlib.md5(f"mix:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), size[i]))
        left = floor(target[s])
        while left > 0 and sizes[s]:
            for i in own:
                n = min(size[i], left)
                taken[i] += n
                left -= n
    return sorted(((r[0] if r[0] is not None else -1, n, round(target[r[2]], 6), t) for r, n, t in zip(rows, size, taken)), key=repr)


def by_point(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    return {s: float(k % 3 + 1) for k, s in enumerate(names)}


def got_mix(df):
    return sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], round(r["target"], 6), r["taken"]) for r in df.collect()), key=repr)


def test_mix_of_odd_documents(docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    mixed = curriculum.mix(docs)
    assert got_mix(mixed) == plain_mix(rows, by_point)
    assert all(r["taken"] <= 3 * r["size"] for r in mixed.collect())


def test_mix_of_one_hot_source_and_astral_names(spark):
    names = ["hot"] * 400 + ["￮", "\U0001f600", "a", None, ""] * 30
    rows = [(k, " ".join(["w"] * (k * 7919 % 61)), s) for k, s in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert got_mix(curriculum.mix(df)) == plain_mix(rows, by_point)
    assert got_mix(curriculum.mix(df, total=200)) == plain_mix(rows, by_point, total=200)


def test_positions_follow_the_schedules(spark):
    """The words that a source has given by time t are its target times its schedule's integral up to t; draws come range-sorted."""
    rows = [(k, "w " * 10, "ab"[k % 2]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {"a": [(0, 2), (0.25, 0), (1, 0)], "b": [(0, 0), (0.5, 1), (1, 1)], "unused": [(0, 1), (1, 1)]}
    mixed = curriculum.mix(df, schedules=plan)
    size = {"a": 2000, "b": 2000}
    want = plain_targets(size, {"a": 0.25, "b": 0.75}, 3, 4000)
    draws = curriculum.ordered(mixed).collect()
    assert [d["position"] for d in draws] == sorted(d["position"] for d in draws)
    for s, shape in plan.items():
        if s == "unused":
            continue
        own, done = [d for d in draws if "ab"[d["doc_id"] % 2] == s], 0
        assert sum(d["words"] for d in own) == floor(want[s])
        grid = np.linspace(0, 1, 200_001)
        w = np.interp(grid, [t for t, _ in shape], [v for _, v in shape])
        area = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2 * (grid[1] - grid[0]))))
        for d in own:
            assert abs(np.interp(d["position"], grid, area) / area[-1] * want[s] - done) < 0.5
            done += d["words"]
    assert {d["epoch"] for d in draws if d["doc_id"] % 2} == {0, 1}


def test_a_source_of_no_weight_and_no_documents(spark, no_docs):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, "d", "y")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["target"], r["taken"]) for r in curriculum.mix(df, schedules={"x": [(0, 1), (1, 1)]}).collect()}
    assert got == {1: (4.0, 4), 2: (0.0, 0)}
    assert curriculum.mix(no_docs).count() == 0 and curriculum.ordered(curriculum.mix(no_docs)).count() == 0


def test_word_codes_are_the_words(texts):
    import pyarrow as pa

    for values in ([t for _, t in texts], [], [None, ""], ["a", "", "bC", None, "É\x7fé z", "end"], ["x" * 5, "y"]):
        words, codes, bounds = word_codes(pa.array(["skipped", *values], pa.string()).slice(1))
        assert [[words[c].decode() for c in codes[a:b]] for a, b in zip(bounds[:-1], bounds[1:])] == [terms(t) for t in values]


def test_suffix_array_orders_and_shares():
    rng = np.random.default_rng(5)
    codes, bounds = rng.integers(0, 3, 300), np.array([0, 40, 40, 41, 300])
    ends = np.repeat(bounds[1:], np.diff(bounds))
    for depth in (1, 2, 3, 5):
        order, shared = resample.suffix_array(codes, ends, depth)
        suffix = [tuple(codes[p : min(ends[p], p + depth)]) for p in order]
        assert suffix == sorted(suffix) and sorted(order) == list(range(300))
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert list(shared[1:]) == [common(a, b) for a, b in zip(suffix, suffix[1:])]


def plain_resample(rows, aims, low, high, buckets, percent, least):
    grams = lambda t: [" ".join(w[i : i + n]) for w in [terms(t)] for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    raw, aim = (Counter(bucket(g) for t in ts for g in grams(t)) for ts in ([t for _, t in rows], aims))
    s, t = sum(raw.values()), sum(aim.values())
    gain = lambda b: floor(1000 * log((aim[b] + 1.0) * (s + buckets) / ((raw[b] + 1.0) * (t + buckets))))
    out = []
    for i, text in rows:
        g = grams(text)
        weight = sum(gain(bucket(x)) for x in g)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(g), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), len(terms(text)) >= least))
    enough = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter((r[:4], k) for k, r in enumerate(enough[: percent * len(enough) // 100], 1))
    rest = Counter((r[:4], None) for r in enough[percent * len(enough) // 100 :] + [r for r in out if not r[4]])
    return drawn + rest


@pytest.mark.parametrize("low, high, buckets", [(1, 1, 10_000), (1, 3, 97), (2, 2, 1000)])
def test_resample_is_the_plain_version(spark, docs, texts, low, high, buckets):
    aims = ["the quick brown fox", "token1 word1 token2", None, "", "日本語 fox fox"]
    bench = spark.createDataFrame([(k, a, "x") for k, a in enumerate(aims)], "item_id long, text string, score string")
    got = resample.resample(docs, bench, low, high, buckets, percent=60, min_words=3)
    assert Counter(((r["doc_id"], r["n_features"], r["weight"], r["score"]), r["rank"]) for r in got.collect()) == plain_resample(texts, aims, low, high, buckets, 60, 3)


def test_resample_of_nothing(spark, docs, no_docs, texts):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(no_docs, none).count() == 0
    got = resample.resample(docs, none, percent=100, min_words=1)
    assert Counter(((r["doc_id"], r["n_features"], r["weight"], r["score"]), r["rank"]) for r in got.collect()) == plain_resample(texts, [], 1, 1, 10_000, 100, 1)


def plain_search(rows, items, top):
    held = [(i, Counter(terms(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top], 1)]
    return Counter(out)


def searched(docs, bench, **more):
    table, stats = lexical.index(docs)
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(table, stats, bench, **more).collect())


@pytest.mark.parametrize("top, tile", [(50, 512), (2, 2), (1, 1)])
def test_search_is_the_plain_version(spark, docs, texts, top, tile, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 3)
    items = [(1, "Quick FOX, the lazy dog"), (2, "token7 word7 nothing"), (3, None), (4, ""), (5, "unheardof"), (6, "日本語 密码 é"), (7, "the the the"), (7, "the the the"), (None, "license mit")]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, rank int")
    assert searched(docs, bench, top=top, tile_size=tile) == plain_search(texts, items, top)


def test_search_among_many_copies_and_random_texts(spark):
    """A third of all rows are copies, whose equal scores lie at the last place."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, "copy of the same text w1 w2") if k % 3 == 0 else (k, " ".join(rng.choice(words, int(rng.integers(1, 40)), p=np.arange(60, 0, -1) / 1830))) for k in range(900)]
    items = [(k, " ".join(rng.choice(words, 8))) for k in range(12)] + [(12, "copy text"), (13, "w1 w2 copy same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert searched(df, spark.createDataFrame(items, "item_id long, text string"), top=20, tile_size=5) == plain_search(rows, items, 20)


def test_search_of_nothing(spark, docs, no_docs):
    bench = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert searched(no_docs, bench) == Counter() and searched(docs, bench.limit(0)) == Counter()
