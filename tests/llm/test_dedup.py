"""Near duplicates and decontamination against brute force."""

import random
import re
from itertools import combinations

import pytest

from strandql.llm import decontaminate, minhash


def shingles(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("k", [2, 5])
def test_odd_documents(docs, no_docs, texts, k):
    rows = minhash.near_duplicates(docs, k=k).collect()
    assert len(rows) == len(texts)
    want, sizes = brute(texts, k), {i: len(shingles(t, k)) for i, t in texts}
    for r in rows:
        assert r["component_id"] == want.get(r["doc_id"]) and r["n_shingles"] == sizes[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(no_docs, k=k).count() == 0


def test_chains_and_families(spark):
    """Families of edited copies, so that buckets hold several components, and chains that only link by neighbours."""
    random.seed(8)
    rows, n = [], 0
    for _ in range(12):
        text = [f"w{random.randrange(400)}" for _ in range(random.choice([6, 40, 90]))]
        for _ in range(random.choice([1, 8, 25])):
            for _ in range(random.choice([0, 1, 2, 6])):
                text[random.randrange(len(text))] = f"w{random.randrange(400)}"
            rows.append((n, " ".join(text)))
            n += 1
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, k=2).collect()}
    assert got == brute(rows, 2)


def test_hot_keys(spark, monkeypatch):
    """Large buckets, hubs of many members, and sets of many copies give the same components."""
    random.seed(9)
    base, rows = [f"w{random.randrange(300)}" for _ in range(80)], []
    for n in range(90):
        text = list(base)
        for _ in range(random.choice([0, 0, 3, 12, 20])):
            text[random.randrange(len(text))] = f"x{random.randrange(40)}"
        rows.append((n, " ".join(text)))
    rows += [(200 + k, rows[0][1]) for k in range(30)] + [(300 + k, "") for k in range(20)] + [(400, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2)
    for name, values in (("small chunks", {"CHUNK": 4, "SPLIT_PAIRS": 5, "SPLIT_COPIES": 5}), ("few shingles", {"CHUNK_SHINGLES": 300, "SPLIT_PAIRS": 5, "SPLIT_COPIES": 5})):
        with monkeypatch.context() as m:
            for key, value in values.items():
                m.setattr(minhash, key, value)
            got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, k=2).collect()}
        assert got == want, name


def test_components(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, b) for b in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    edges += [(random.randrange(300, 360), random.randrange(300, 360)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_decontamination(spark, docs, no_docs):
    item = " ".join(f"Term{i}" for i in range(30))
    swapped = " ".join("other" if i % 9 == 4 else f"term{i}" for i in range(30))
    part = " ".join(f"term{i}," for i in range(8, 22))
    rows = [(1, item), (1, item), (2, f"before {swapped} after"), (None, item), (3, None), (4, ""), (5, "p q r s t u"), (6, "term1 term2 term3"), (7, f"x y {part} z"), (8, " ".join(f"term{i} x" for i in range(30))), (9, "so a b it is"), (10, "ab A, B"), (11, "Zwölf"), (12, f"{item} {item} and {swapped}")]
    bench = spark.createDataFrame([(1, item, 0), (2, "Q r s, t u", 0), (3, None, 0), (4, "a b", 0), (1, item, 0), (5, "zwölf", 0), (6, " .,", 0)], "item_id long, text string, id int")
    found = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["contaminated"], tuple(r["items"])) for r in found} == {(1, True, (1,)), (2, True, (1,)), (None, True, (1,)), (3, False, ()), (4, False, ()), (5, True, (2,)), (6, False, ()), (7, True, (1,)), (8, False, ()), (9, True, (4,)), (10, True, (4,)), (11, True, (5,)), (12, True, (1,))}
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench).count() == docs.count()


def test_masks_leave_a_seed_in_every_overlap(spark):
    # (aligned words, words exchanged at most): what the rule counts for items of 13 and more, 12 and 11 words.
    cases = [(n, set(gone)) for n, most in ((13, 2), (12, 1), (11, 1), (10, 0)) for k in range(most + 1) for gone in combinations(range(n), k)]
    for n, gone in cases:
        assert any(not gone & {s + k for k in m} for m in decontaminate.MASKS for s in range(n - m[-1])), (n, gone)
    items = [(n, [f"i{n}w{k}" for k in range(n)]) for n in (11, 12, 13)]
    swaps = [(n, gone) for n, gone in cases if n > 10 and len(gone) == (2 if n == 13 else 1)]
    rows = [(k, n, "before " + " ".join("other" if j in gone else w for j, w in enumerate(dict(items)[n])) + " after") for k, (n, gone) in enumerate(swaps)]
    rows += [(len(rows), 11, " ".join(items[0][1][:10])), (len(rows) + 1, 11, "and " + " ".join(items[0][1][1:]))]
    found = decontaminate.hits(spark.createDataFrame(rows, "doc_id long, n long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")).collect()
    assert {(r["id"], r["item"]) for r in found} == {(k, n) for k, n, _ in rows}
