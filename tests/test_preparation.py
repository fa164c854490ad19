"""Alignments to profiles, and the search from alignments to merged alignments, on planted families."""

from dataclasses import replace

import numpy as np
import pytest

from strandql.functions.residues import LETTERS
from strandql.operators import msa, preparation, profiles
from strandql.params import ITERATIVE

BACK = np.full(20, 0.05)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(a, b, 0.6 / 20 if a == b else 0.4 / 380) for a in LETTERS for b in LETTERS]
    return profiles.substitution_model(spark.createDataFrame(rows, "a string, b string, p double"))


def family(rng, seed, members, lower=False):
    out = []
    for _ in range(members):
        row = "".join(c if rng.random() > 0.15 else str(rng.choice(list(LETTERS))) for c in seed)
        at = int(rng.integers(5, len(seed) - 5))
        out.append(row[:at] + ("ac" if lower and rng.random() < 0.5 else "") + row[at:])
    return [seed, *out]


def test_a_search_finds_and_merges_its_family(spark, model):
    rng = np.random.default_rng(20)
    seeds = ["".join(rng.choice(list(LETTERS), 60)) for _ in range(12)]
    members = [(f"t{f}", k, f"t{f}_{k}", row) for f, s in enumerate(seeds) for k, row in enumerate(family(rng, s, 6, True))]
    own = [(f"q{f}", k, f"q{f}_{k}", row) for f in (0, 7) for k, row in enumerate(family(rng, seeds[f][4:50], 2))]
    own.append(("single", 0, "single", "".join(rng.choice(list(LETTERS), 40))))
    params = replace(ITERATIVE, rounds=3, min_prefilter_hits=3, e=1e-3)
    rows, found = preparation.searched_rounds(spark.createDataFrame(own, "query string, k int, name string, row string"), spark.createDataFrame(members, "msa string, k int, name string, row string"), model, params)
    got = rows.collect()
    assert {(r["query"], r["target"]) for r in found.where("first_round is not null").collect()} == {("q0", "t0"), ("q7", "t7")}
    by_query = {q: [r for r in got if r["query"] == q] for q in ("q0", "q7", "single")}
    assert len(by_query["single"]) == 1 and all(len(by_query[q]) == 10 for q in ("q0", "q7"))
    for q, f in (("q0", 0), ("q7", 7)):
        assert {sum(c.isupper() or c == "-" for c in r["row"]) for r in by_query[q]} == {46}
        seed = next(r["row"] for r in by_query[q] if r["name"] == f"t{f}_0")
        assert sum(a == b for a, b in zip("".join(c for c in seed if not c.islower()), seeds[f][4:50])) >= 43


def test_profiles_of_one_sequence_and_of_empty_columns(spark, model):
    rows = spark.createDataFrame([("one", 0, "ARXN"), ("gap", 0, "A-R"), ("gap", 1, "A-N"), ("none", 0, "")], "msa string, k int, row string")
    got = {r["name"]: r for r in preparation.prepared(rows, model, replace(ITERATIVE, pca=0.0)).collect()}
    one = np.array(got["one"]["p"])
    assert np.allclose(one[2], BACK) and np.allclose(one[[0, 1, 3]], np.eye(20)[[LETTERS.index(c) for c in "ARN"]])
    assert bytes(got["one"]["states"]) == bytes([LETTERS.index("A") + 1, LETTERS.index("R") + 1, 0, LETTERS.index("N") + 1]) and got["one"]["neff"] == 1
    gap = np.array(got["gap"]["p"])
    assert np.allclose(gap[1], BACK) and abs(gap[2, LETTERS.index("R")] - 0.5) < 1e-9 and len(got["none"]["p"]) == 0
    with_pseudo = np.array({r["name"]: r for r in preparation.prepared(rows, model).collect()}["one"]["p"])
    assert np.allclose(with_pseudo.sum(1), 1, atol=1e-6) and with_pseudo[0].min() > 0


def test_match_columns_of_short_single_rows(spark):
    rows = spark.createDataFrame([("short", 0, "ABcdefgh"), ("long", 0, "ABCDEFgh"), ("two", 0, "ABcd"), ("two", 1, "A-cc")], "msa string, k int, row string")
    got = {(r["msa"], r["k"]): r["row"] for r in preparation.match_rows(rows).collect()}
    assert got == {("short", 0): "ABCDEFGH", ("long", 0): "ABCDEF", ("two", 0): "AB", ("two", 1): "A-"}


def test_count_profiles(spark, model):
    rows = spark.createDataFrame([("a", 0, "AR"), ("a", 1, "AN"), ("a", 2, "AD")], "msa string, k int, row string")
    cols = preparation.column_profiles(rows, model)
    neff = {r["i"]: r["neff"] for r in cols.collect()}
    got = {r["i"]: sum(r["c"]) for r in preparation.count_profile(cols).collect()}
    assert got == pytest.approx(neff) and neff[1] == 1
    whole = {r["i"]: sum(r["c"]) for r in preparation.count_profile(cols, by_column=False).collect()}
    assert whole == pytest.approx(dict.fromkeys(neff, sum(neff.values()) / 2))


def test_a_published_matrix_is_read(spark):
    text = ["# a comment", "   A  R  N", "A  4 -1 -2", "R -1  5  0", "N -2  0  6"]
    scores = preparation.read_scores(spark.createDataFrame([(t,) for t in text], "value string"))
    assert {(r["a"], r["b"]): r["s"] for r in scores.collect()}[("R", "A")] == -1 and scores.count() == 9
    back = spark.createDataFrame([("A", 0.5), ("R", 0.3), ("N", 0.2)], "r string, f double")
    joint = {(r["a"], r["b"]): r["p"] for r in preparation.joint_of_scores(scores, back).collect()}
    raw = {("A", "A"): 0.25 * 4, ("A", "R"): 0.15 * 2**-0.5, ("N", "N"): 0.04 * 8}
    assert abs(sum(joint.values()) - 1) < 1e-9 and all(abs(joint[k] / joint["A", "A"] - v / raw["A", "A"]) < 1e-9 for k, v in raw.items())


def test_sinks(spark, model, tmp_path):
    rows = spark.createDataFrame([("a", 0, "first", "ARxN"), ("a", 1, "second", "AR-N"), ("b", 0, "third", "VV")], "msa string, k int, name string, row string")
    cols = preparation.column_profiles(preparation.match_rows(rows), model)
    texts = preparation.consensus_text(cols, model)
    preparation.write_consensus(texts, str(tmp_path / "cons"))
    preparation.write_consensus(texts, str(tmp_path / "cons"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "cons")).collect()]
    assert lines.count(">b_consensus") == 2 and "VV" in lines
    preparation.write_psi(rows, str(tmp_path / "psi"))
    assert [r["value"].split() for r in spark.read.text(str(tmp_path / "psi" / "alignment=a")).collect()] == [["first", "ARN"], ["second", "AR-N"]]
    hits = spark.createDataFrame([("q", n, e, p) for n, (e, p) in enumerate([(1e-9, 99.0), (1e-2, 50.0), (1.0, 10.0), (1e-4, 40.0), (2.0, 30.0), (9.0, 1.0)], 1)], "query string, line int, eval double, probab double")
    kept = preparation.realigned_selection(hits, replace(ITERATIVE, b=1, z=1, B=4, Z=4, p=20.0, E=5.0, realign_max=2))
    assert [r["line"] for r in kept.orderBy("line").collect()] == [1, 2, 4]
    assert msa.validate(preparation.match_rows(rows)).where("msa = 'b'").first()["most"] == 2
