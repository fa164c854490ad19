"""Database generations, query tiles, the filter tool, random fields and matrix rows against plain versions."""

import struct
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandql.functions.residues import LETTERS
from strandql.operators import database, dp, fields, msa, redundancy, tiles
from strandql.params import ITERATIVE, PAIRWISE
from strandql.plans import search_queries
from strandql.sources import matrices


def entries(spark, rows):
    return spark.createDataFrame(rows, "kind string, name string, payload string")


def read(df):
    return {(r["kind"], r["name"]): (r["payload"], r["generation"]) for r in df.collect()}


def test_generations_write_what_changed_only(spark, tmp_path):
    d = str(tmp_path / "db")
    assert database.opened(spark, d).count() == 0 and database.generations(spark, d) == []
    assert database.build(spark, d, entries(spark, [("a3m", "x", "1"), ("a3m", "y", "2"), ("hhm", "x", "3"), ("a3m", "x", "1")])) == {"generation": 1, "written": 3, "entries": 3}
    gone = spark.createDataFrame([("hhm", "x"), ("a3m", "unknown")], "kind string, name string")
    out = database.build(spark, d, entries(spark, [("a3m", "x", "1"), ("a3m", "y", "new"), ("ca3m", "z", None)]), gone)
    assert out == {"generation": 2, "written": 2, "entries": 3}
    assert read(database.opened(spark, d)) == {("a3m", "x"): ("1", 1), ("a3m", "y"): ("new", 2), ("ca3m", "z"): ("", 2)}
    assert read(database.opened(spark, d, 1)) == {("a3m", "x"): ("1", 1), ("a3m", "y"): ("2", 1), ("hhm", "x"): ("3", 1)}


def test_a_build_that_ends_early_is_not_seen_and_two_at_once_conflict(spark, tmp_path, monkeypatch):
    d = str(tmp_path / "db")
    database.build(spark, d, entries(spark, [("a3m", "x", "1")]))
    commit = database._commit

    def stops(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(database, "_commit", stops)
    with pytest.raises(RuntimeError):
        database.build(spark, d, entries(spark, [("a3m", "x", "2")]))
    assert read(database.opened(spark, d)) == {("a3m", "x"): ("1", 1)}

    def late(spark_, folder, n):
        commit(spark_, folder, n)  # another build was faster
        commit(spark_, folder, n)

    monkeypatch.setattr(database, "_commit", late)
    with pytest.raises(Exception, match="(?i)exist"):
        database.build(spark, d, entries(spark, [("a3m", "x", "3")]))


def test_precedence_and_stale_entries(spark, tmp_path):
    d = str(tmp_path / "db")
    database.build(spark, d, entries(spark, [("a3m", "x", "1"), ("hhm", "x", "h"), ("a3m", "y", "2"), ("ca3m", "y", "c"), ("a3m", "z", "3"), ("cs219", "w", "s")]))
    first = database.by_precedence(database.opened(spark, d))
    assert {r["name"]: r["kind"] for r in first.collect()} == {"x": "hhm", "y": "ca3m", "z": "a3m"}
    database.build(spark, d, entries(spark, [("a3m", "x", "changed")]))
    assert sorted(r["name"] for r in database.stale(database.manifest(spark, d), "a3m", "hhm").collect()) == ["x", "y", "z"]
    database.build(spark, d, entries(spark, [("hhm", "x", "again")]))
    assert sorted(r["name"] for r in database.stale(database.manifest(spark, d), "a3m", "hhm").collect()) == ["y", "z"]


def test_searched_names_count_once(spark, tmp_path):
    d = str(tmp_path / "s")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert database.searched(spark, d, names("a", "b", "a", None), 1) == 2
    assert database.searched(spark, d, names("b", "c"), 2) == 3
    assert database.searched(spark, d, names("b", "c"), 2) == 3
    assert database.searched(spark, d, names(), 3) == 3


def test_tiles_keep_what_each_query_alone_keeps(spark):
    rng = np.random.default_rng(3)
    targets = [(k, rng.integers(1, 5, int(rng.integers(0, 60))).astype(np.uint8).tobytes()) for k in range(120)]
    queries = [(f"q{k}", rng.integers(1, 5, int(rng.integers(1, 30))).astype(np.uint8).tobytes()) for k in range(7)]
    shares = np.full(26, 1 / 26)
    table = lambda q: search_queries.byte_table(q, shares)
    params = replace(ITERATIVE, min_prefilter_hits=5, smax_thresh=18)
    got = tiles.prefilter(spark.createDataFrame(queries, "query string, states binary"), spark.createDataFrame(targets, "name int, states binary").repartition(6), table, params, size=3)
    want = set()
    for q, states in queries:
        seqs = [np.frombuffer(s, dtype=np.uint8) for _, s in targets]
        score = dp.ungapped(table(states), seqs, params.score_offset)
        rows = [(int(x) - int(np.floor(4 * (np.log2(len(states)) + np.log2(len(s))))), k, len(s)) for x, (k, _), s in zip(score, targets, seqs) if len(s)]
        rows.sort(reverse=True)
        want |= {(q, k, n, x) for place, (x, k, n) in enumerate(rows) if place < 5 or x > 18}
    assert {tuple(r) for r in got.select("query", "name", "t_len", "score").collect()} == want
    assert 35 < len(want) < 7 * 100
    assert {r["rank"] for r in tiles.best_hits(got, 2).collect()} == {1, 2}
    assert tiles.prefilter(spark.createDataFrame([], "query string, states binary"), spark.createDataFrame(targets, "name int, states binary"), table).count() == 0


def test_ungapped_is_the_best_run_of_a_diagonal():
    rng = np.random.default_rng(8)
    for n in (1, 2, 7, 30):
        table = rng.integers(30, 80, (n, 6)).astype(np.uint8)
        seqs = [rng.integers(0, 6, k).astype(np.uint8) for k in (0, 1, 5, 33, 64)]
        want = []
        for s in seqs:
            best = 0
            for d in range(-n, len(s)):
                run = 0
                for i in range(n):
                    if 0 <= i + d < len(s):
                        run = max(0, min(255, run + int(table[i, s[i + d]])) - 50)
                        best = max(best, run)
            want.append(best)
        assert dp.ungapped(table, seqs, 50).tolist() == want


def test_prefilter_of_the_flagship_prunes_most(spark):
    sf = "/root/testdata/sf0.001"
    kept = search_queries.batch_prefilter(spark, sf).count()
    assert kept < 0.3 * spark.read.parquet(f"{sf}/documents.parquet").count() * spark.read.parquet(f"{sf}/benchmark.parquet").count()


def test_filter_tool_is_its_three_filters(spark):
    rng = np.random.default_rng(4)
    rows = [(m, k, "".join(rng.choice(list("ARNDCUBJX--"), int(rng.integers(0, 30))))) for m in "abc" for k in range(12)] + [("d", 0, "---"), ("e", 1, "A")]
    df = spark.createDataFrame(rows, "msa string, k int, row string")
    scores = spark.createDataFrame([(a, b, float((3 * i + j) % 7 - 2)) for i, a in enumerate(LETTERS) for j, b in enumerate(LETTERS)], "a string, b string, s double")
    got = {(r["msa"], r["k"]): (r["nres"], r["columns"], r["differ"], round(r["score"], 6)) for r in msa.member_figures(df, scores).collect()}
    cells = msa.long_form(df, "msa", "k", "row").replace({"U": "C", "B": "D", "Z": "E"}, subset="r")
    cover = {(r["msa"], r["k"]): (r["nres"], r["columns"]) for r in msa.coverage(cells, 20).collect()}
    differ = {(r["msa"], r["k"]): r["differ"] for r in msa.query_identity(cells, 10).collect()}
    score = {(r["msa"], r["k"]): round(r["score"], 6) for r in msa.query_score(cells, scores, 0.0).collect()}
    assert got == {k: (*cover[k], differ[k], score.get(k, 0.0)) for k in cover}  # a residue that faces an ambiguous one scores nothing
    kept = msa.filter_tool(df, scores, 50, 30, 0.5).where("kept").collect()
    assert {r["msa"] for r in kept} >= {"a", "b", "c", "e"}


def test_random_field_by_matrices(spark):
    rng = np.random.default_rng(6)
    lines, want_w, want_b, want_e = [], [], [], []
    order = "CRNDAQEGHILKMFPSTWYV"
    for s in range(3):
        w, pc = rng.integers(-3000, 3000, (5, 20)), rng.integers(-2000, 2000, 20)
        lines += ["CrfState", f"NAME\tstate {s}", f"BIAS\t{-0.5 * s}", "LENG\t5", "ALPH\t20", "WEIGHTS\t" + "\t".join(order)]
        lines += [f"{k + 1}\t" + "\t".join(map(str, r)) for k, r in enumerate(w)] + ["PC\t" + "\t".join(map(str, pc)), "//"]
        want_w.append(w / 1000)
        want_b.append(-0.5 * s)
        e = np.exp(pc / 1000)
        want_e.append(e / e.sum())
    text = spark.createDataFrame([("f", k, x) for k, x in enumerate(["CRF", "SIZE\t3", "LENG\t5", *lines])], "file string, at int, line string")
    weights, bias, emits = (x.drop("file") for x in fields.read_states(text))
    assert weights.count() == 300 and bias.count() == 3 and emits.count() == 60
    counts = [("p", rng.random((9, 20))), ("q", rng.random((2, 20)))]
    rows = [(h, i + 1, order[a], float(c[i, a])) for h, c in counts for i in range(len(c)) for a in range(20)]
    pc = fields.pseudocounts(fields.state_posteriors(fields.window_scores(spark.createDataFrame(rows, "hmm string, i int, r string, c double"), weights, bias)), emits)
    got = {(r["hmm"], r["i"], r["r"]): r["pc"] for r in pc.collect()}
    for h, c in counts:
        for i in range(len(c)):
            z = np.array([b + sum((w[d + 2] * c[i + d]).sum() for d in range(-2, 3) if 0 <= i + d < len(c)) for w, b in zip(want_w, want_b)])
            p = np.exp(z - z.max())
            out = (p / p.sum()) @ np.array(want_e)
            assert np.allclose([got[h, i + 1, a] for a in order], out / out.sum())
    same = fields.admixed(spark.createDataFrame([("p", 1, "A", 1.0)], "hmm string, i int, r string, p double"), pc.where("hmm = 'p' and i = 1"), 0.25)
    assert abs(sum(r["p"] for r in same.collect()) - 1) < 1e-9


def test_matrix_rows_read_back(spark):
    rng = np.random.default_rng(9)
    cells = {("q", t, 1, kind, int(i), int(j)): float(p) for t in "ab" for kind in ("backward", "posterior") for i, j, p in zip(rng.integers(1, 6, 40), rng.integers(1, 300, 40), rng.random(40))}
    cells |= {("q", "a", 1, "posterior", 9, j): p for j, p in zip(range(250, 260), [1.0, 0.5, 1e-9, 0.999, 0.25, 0.1, 0.0, 0.7, 0.01, 1e-4])}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "query string, target string, irep int, kind string, i int, j int, p double")
    made = matrices.runs(df)
    back = {(r["query"], r["target"], r["irep"], r["kind"], r["i"], r["j"]): r["p"] for r in matrices.cells_of(made).collect()}
    assert back.keys() == cells.keys()
    assert all(abs(back[k] - v) <= max(2**-15.9, 0.045 * v) for k, v in cells.items())
    hits = spark.createDataFrame([("q", "a", 1, 1, 50.5, 70, 1.0, 1.05, "first", -1.25), ("q", "a", 1, 2, 60.5, 70, 1.0, 1.05, "again", -1.25), ("q", "b", 1, 3, 19.9, 70, 1.0, 1.0, "weak", 0.0), ("q", "c", 1, 4, 99.0, 70, 1.2, 1.0, "off", 0.0), ("q", "d", 1, 5, 99.0, 70, 1.0, 1.0, "bare", 2.0)], "query string, target string, irep int, number int, probab double, t_len int, forward double, backward double, name string, similarity double")
    entries_ = {r["target"]: bytes(r["entry"]) for r in matrices.written(matrices.printable(hits), matrices.matrices(made)).collect()}
    assert set(entries_) == {"a", "d"}
    assert entries_["d"] == b"bare\0" + struct.pack("<HBh", 70, 99, 20) + b"\0" * 6
    b, at = entries_["a"], 6
    assert b[:6] == b"again\0" and struct.unpack_from("<HBh", b, at) == (70, 60, -13)
    at, seen = at + 5, {}
    for kind in ("backward", "forward", "posterior"):
        while True:
            i = struct.unpack_from("<H", b, at)[0]
            at += 2
            if not i:
                break
            j = struct.unpack_from("<H", b, at)[0]
            at += 2
            own = sorted(k[5] for k in cells if k[:5] == ("q", "a", 1, kind, i) and k[5] >= j)
            n = next((x for x in range(len(own)) if own[x] != j + x), len(own))
            seen |= {(kind, i, j + x): b[at + x] for x in range(n)}
            assert b[at + n] == 0
            at += n + 1
    assert at == len(b) and seen.keys() == {k[3:] for k in cells if k[1] == "a"}


def test_template_net_by_hand(spark):
    from math import exp

    from strandql.operators import ranking

    rows = [("q", t, float(7 * t), 0.5 * t, 3.0 * t, 5 * t, 0.1 * t, 40) for t in range(12)] + [("r", 0, 0.0, 0.0, 0.0, 0, 0.0, 0)]
    df = spark.createDataFrame(rows, "query string, target int, score double, score_ss double, sum_probs double, matched_cols int, similarity double, q_len int")
    logistic = lambda z: 1 / (1 + exp(-z))
    hidden, output, bias = ranking.SIMILARITY_NET
    want = {}
    for q, t, s, ss, p, c, m, n in rows:
        x = [s, ss, p / max(1, n), s / max(1, c), m]
        want[q, t] = logistic(bias + sum(o * logistic(b + sum(a * v for a, v in zip(w, x))) for (w, b), o in zip(hidden, output)))
    got = {(r["query"], r["target"]): r["predicted"] for r in ranking.predicted_similarity(df).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    best = [(r["query"], r["rank"], r["target"]) for r in ranking.ranked_templates(df, 2).orderBy("query", "rank").collect()]
    order = sorted(range(12), key=lambda t: (-round(want["q", t], 6), t))
    assert best == [("q", 1, order[0]), ("q", 2, order[1]), ("r", 1, 0)]


def cover_plain(gains, limit=None):
    """Greedy turns of one query's cells {(target, i): p}."""
    best, out = {}, []
    while limit is None or len(out) < limit:
        sums = {}
        for (t, i), p in gains.items():
            sums[t] = sums.get(t, 0.0) + np.expm1(max(0.0, p - best.get(i, 0.0)))
        top = min(((-round(g, 9), t) for t, g in sums.items()), default=(0, None))
        if top[0] >= 0:
            return out
        out.append(top[1])
        for (t, i), p in gains.items():
            if t == top[1]:
                best[i] = max(best.get(i, 0.0), p)
    return out


@pytest.mark.parametrize("limit", [None, 2, 1])
def test_greedy_cover(spark, limit):
    """Ties, repeated cells, a query of most rows, nulls and values of zero."""
    rng = np.random.default_rng(9)
    rows = [("hot", int(t), int(i), float(p)) for t, i, p in zip(rng.integers(0, 12, 300), rng.integers(0, 40, 300), rng.integers(0, 5, 300) / 4)]
    rows += [("tie", t, i, 0.5) for t in (3, 1, 2) for i in (1, 2)] + [("one", 7, 1, 0.25), ("none", 1, 1, 0.0), (None, 1, 1, 0.5), ("one", None, 1, 0.9), ("one", 8, None, 0.9), ("one", 8, 1, None)]
    got = redundancy.greedy_cover(spark.createDataFrame(rows, "query string, target int, i int, p double"), limit=limit).collect()
    want = []
    for query in ("hot", "tie", "one"):
        cells = {}
        for q, t, i, p in rows:
            if q == query and None not in (t, i, p):
                cells[t, i] = max(p, cells.get((t, i), 0.0))
        want += [(query, t, turn + 1) for turn, t in enumerate(cover_plain(cells, limit))]
    assert sorted(map(tuple, got)) == sorted(want)
    assert not redundancy.greedy_cover(spark.createDataFrame([], "query string, target int, i int, p double")).collect()


def test_matrices_of_posteriors(spark):
    """Pairs to bytes and back: a cell's probability is that of the alignment, to a sixteenth power of two."""
    rng, null = np.random.default_rng(2), np.full(4, 0.25)
    rows = [(k, 5, rng.dirichlet(np.full(4, 0.3), n).tolist(), rng.dirichlet(np.full(4, 0.3), m).tolist()) for k, (n, m) in enumerate([(12, 9), (30, 25), (3, 3)])]
    found = dp.align_join(spark.createDataFrame(rows, "query int, target int, q array<array<double>>, t array<array<double>>"), null, PAIRWISE, realign=True, least=0.01)
    runs = matrices.runs(found.select("query", "target", "irep", F.lit("posterior").alias("kind"), F.inline("cells")))
    got = {(r["query"], r["i"], r["j"]): r["p"] for r in matrices.cells_of(runs).collect()}
    for query, _, q, t in rows:
        post, _ = dp.posterior(dp.Profile(q), dp.Profile(t), null, PAIRWISE.shift)
        own = {(query, i, j): p for i, j, p in dp.sparse(post, 0.01)}
        assert own and own == {k: pytest.approx(v, rel=0.03) for k, v in got.items() if k[0] == query}
    lengths = {r["query"]: len(r["matrix"]) for r in matrices.matrices(runs).collect()}
    sizes = {}
    for r in runs.collect():
        sizes[r["query"]] = sizes.get(r["query"], 2) + 5 + r["n"]
    assert lengths == sizes
