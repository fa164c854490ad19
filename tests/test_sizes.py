"""Cases that larger tables brought up."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandql.functions import evd
from strandql.operators import dp, hits, maps, msa, redundancy
from strandql.plans import build_queries, msa_queries, search_queries

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_p_of_one_is_the_worst_score(spark):
    p = evd.p_value(F.lit(-3.7), F.lit(1.0), F.lit(0.0))
    log_p = evd.log_p_value(F.lit(-3.7), F.lit(1.0), F.lit(0.0))
    score = evd.score_of_p(log_p, p, F.lit(1.0), F.lit(-3.7), F.lit(0.0))
    got = spark.range(1).select(p.alias("p"), score.alias("s"), evd.probability(score).alias("prob")).first()
    assert (got["p"], got["s"], got["prob"]) == (1.0, np.inf, 0.0)


def test_paging_keeps_ties_and_ranks_infinity_last(spark):
    rows = [("q", t, f, s, 90.0, 0.1) for t, f, s in (("a", 1, 1.0), ("b", 2, 2.0), ("c", 2, 2.0), ("d", 3, float("inf")), ("e", 4, 3.0))]
    df = spark.createDataFrame(rows, "query string, target string, file int, score_aass double, probab double, eval double")
    got = hits.paged(df, 2, 10, 20.0, 1.0).orderBy("line").collect()
    assert [r["line"] for r in got] == [1, 2, 3, 4, 5]
    assert [r["target"] for r in got][0::4] == ["a", "d"] and {r["target"] for r in got} == set("abcde")


@pytest.mark.parametrize("long", [1023, 1100, 5000])
def test_prefilters_over_the_ends_of_pieces(long):
    rng = np.random.default_rng(long)
    table = rng.integers(20, 60, (40, 6)).astype(np.uint8)
    table[np.arange(40), np.arange(40) % 6] = 70
    best = (np.arange(40) % 6).astype(np.uint8)
    target = rng.integers(0, 6, long).astype(np.uint8)
    for at in (0, 1000, long - 40):
        t = target.copy()
        t[at : at + 40] = best[: len(t[at : at + 40])]
        gap = np.concatenate([t[: at + 20], np.full(3, 5, dtype=np.uint8), t[at + 20 :]])
        assert dp.ungapped(table, [t, t[:7]], 50)[0] == dp.ungapped(table, [t[at : at + 40]], 50)[0]
        assert dp.gapped(table, [gap, t[:0]], 50, 20, 4)[0] == dp.gapped(table, [gap[max(0, at - 200) : at + 243]], 50, 20, 4)[0]
    pieces, owner = dp._pieces([target, target[:10]], 39)
    assert len(pieces) > 1 and max(map(len, pieces)) < 1100 and owner.tolist().count(1) == 1


@pytest.mark.parametrize("query", [msa_queries.query_score, msa_queries.query_identity])
def test_a_member_beside_the_first_makes_no_row_a_cell(spark, query):
    assert "Generate" not in planned(query(spark, SF))


def test_the_first_member_has_a_column(spark):
    rows = spark.createDataFrame([("m", 0, ""), ("m", 1, "ACD"), ("m", 2, "ACE"), ("n", 0, "JA"), ("n", 1, "A")], "msa string, k int, row string")
    score = spark.createDataFrame([("A", "A", 4.0), ("C", "C", 4.0), ("D", "E", -1.0), ("D", "D", 4.0)], "a string, b string, s double")
    got = {(r["msa"], r["k"]): r["score"] for r in msa.scored_by_query(rows, score, 0.0).collect()}
    assert got == {("m", 1): 12.0, ("m", 2): 7.0, ("n", 0): 4.0}  # n's second member faces an ambiguous residue alone


def test_filter_tool_walks_outside_the_engines_lambdas(spark):
    assert "lambda" not in planned(build_queries.filter_tool(spark, SF))


@pytest.mark.parametrize("residues, want", [("ACDé", "AC--Dé-"), ("ACD", "AC--D-"), ("", "---"), (None, None)])
def test_extraction_of_odd_sequences(spark, residues, want):
    df = spark.createDataFrame([(residues, [(2, -2), (2, -1)])], "residues string, b array<struct<m:int,g:int>>")
    back = df.select(msa.extract(F.col("b"), F.col("residues")).alias("x"))
    assert back.first()["x"] == want and "aggregate(" not in planned(back)


def test_members_hold_no_more_than_their_columns():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ACDEFGHIKL"), n)) for n in [100_000] + [20] * 4000]
    tracemalloc.start()
    m = redundancy.Members.of(texts)
    kept = redundancy.keep_diverse(m, 90, 90, len(m) + 1, np.where(np.arange(len(m)) == 0, 2, 1))
    redundancy.neff_of(m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept[0] and peak < 200e6  # the matrix of all columns has 400 MB


def test_bits_lose_no_similar_member(monkeypatch):
    rng = np.random.default_rng(7)
    base = "".join(rng.choice(list("ACDEFGHIKL-"), 3000))
    change = lambda share: "".join(rng.choice(list("MNPQ-")) if rng.random() < share else c for c in base)
    m = redundancy.Members.of([base] + [change(x) for x in np.linspace(0, 0.4, 80)])
    keep = np.where(np.arange(len(m)) == 0, 2, 1)
    got = {}
    for many in (2, 10_000):
        monkeypatch.setattr(redundancy, "MANY_KEPT", many)
        got[many] = [redundancy.keep_diverse(m, t, t, len(m) + 1, keep).tolist() for t in (60, 80, 90)]
    assert got[2] == got[10_000] and not all(got[2][2])
    assert redundancy.keep_diverse(m, 90, 90, len(m) + 1, keep, enough=3).sum() == 4


def test_parts_of_one_name_are_aligned_once(spark, monkeypatch):
    join, seen = dp.align_join, []
    monkeypatch.setattr(dp, "align_join", lambda pairs, *a, **b: seen.append(pairs.count()) or join(pairs, *a, **b))
    got = search_queries.posterior_matrices(spark, SF)
    part = spark.read.parquet(f"{SF}/part.parquet")
    assert seen == [5 * part.select("p_name").distinct().count()]
    assert got.select("query", "target", "irep").distinct().count() == got.count() >= 5 * part.count()


def test_widths_of_inserts_are_found_by_place(spark):
    rows = spark.createDataFrame([("m", 0, "aAbbC-d"), ("m", 1, "ACcccC"), ("n", 0, ""), ("n", 1, "A.bA")], "msa string, k int, row string")
    got = {r["msa"]: list(r["widths"]) for r in maps.insert_widths(rows).collect()}
    assert got == {"m": [1, 2, 3, 1], "n": [0, 1, 0]}
    assert [r["row"] for r in maps.padded(rows).orderBy("msa", "k").collect()] == ["aAbbC...-d", ".A..CcccC.", "", "AbA"]
