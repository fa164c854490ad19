"""Store algebra, alignments, filters, formats and searches on small inputs."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandql.functions import evd, residues, strings
from strandql.operators import batch, context, hits, iterate, msa, ordered, profiles, redundancy, store
from strandql.params import ITERATIVE, PAIRWISE
from strandql.sources import alignments, profile_text, reports, store_files


def col(spark, value, f):
    return spark.range(1).select(f(F.lit(value)).alias("x")).first()["x"]


def test_params_are_frozen():
    with pytest.raises(Exception):
        ITERATIVE.rounds = 3
    assert PAIRWISE.alternatives == 1 and ITERATIVE.alternatives == 4


def test_residues(spark):
    want = {"A": 0, "v": 19, "U": 4, "B": 3, "Z": 6, "X": 20, "J": 20, "-": 21, ".": 21, " ": -1, "*": -2}
    for s, c in want.items():
        assert col(spark, s, residues.code) == c, s
    assert [col(spark, c, residues.letter) for c in (0, 19, 20, 21)] == ["A", "V", "X", "-"]
    assert col(spark, "a-C.", residues.as_match) == "A-C-" and col(spark, "A-c", residues.as_insert) == "a.c"
    assert col(spark, "G", residues.eight_to_three) == "H" and col(spark, "7", residues.confidence_code) == 8
    assert col(spark, "AC-de.F", residues.match_count) == 4


def test_strings(spark):
    assert col(spark, "ab-12x3", strings.first_int) == -12
    assert col(spark, "*", lambda c: strings.first_int(c, 5)) == 5
    assert col(spark, "UP20|ABC|104|471", strings.cluster_size) == 104
    assert col(spark, "/a.b/c.tar.gz", strings.without_extension) == "/a.b/c.tar" and col(spark, "/a.b/c", strings.extension) == ""
    assert col(spark, "c", strings.folder) == "./" and col(spark, "  one two", lambda c: strings.word(c, 2)) == "two"
    assert col(spark, ">x|ID7|y text", strings.short_id) == "ID7" and col(spark, "q_consensus z", strings.is_consensus)
    h = strings.hierarchy(F.lit("a.1.2.3"))
    assert tuple(spark.range(1).select(h["cl"], h["fold"], h["sfam"]).first()) == ("a", "a.1", "a.1.2")


def test_evd_branches(spark):
    f = lambda s: spark.range(1).select(evd.p_value(F.lit(s), F.lit(1.0), F.lit(0.0)), evd.log_p_value(F.lit(s), F.lit(1.0), F.lit(0.0))).first()
    for s in (-4.0, -2.5, 0.0, 9.9, 10.1, 50.0):
        p, lp = f(s)
        true = -np.expm1(-np.exp(-s))
        assert p == pytest.approx(true, rel=1e-4) and lp == pytest.approx(np.log(true) if true < 1 else -np.exp(-np.exp(-s)), rel=1e-4, abs=1e-12)
    probs = [spark.range(1).select(evd.probability(F.lit(-s))).first()[0] for s in (0.0, 10.0, 50.0, 201.0)]
    assert probs == sorted(probs) and probs[-1] == 100.0 and probs[0] >= 0


def test_running_sums(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 13).alias("v"))
    got = ordered.running(rows, ["k"], F.col("v"), "s").toPandas().sort_values("k")
    assert (got["s"].to_numpy() == got["v"].cumsum().to_numpy()).all()
    assert sorted(r["n"] for r in ordered.numbered(rows, ["k"], "n").collect()) == list(range(1, 1001))
    assert ordered.numbered(rows.limit(0), ["k"], "n").count() == 0


def test_store(spark):
    s = spark.createDataFrame([("b", "22"), ("a", "1"), ("c", None), ("a", "1")], "name string, payload string")
    names = spark.createDataFrame([("c",), ("z",)], "name string")
    assert [r["name"] for r in store.unlink(s, names).orderBy("name").collect()] == ["a", "a", "b"]  # the last entry too
    assert store.lookup(s, names).count() == 1 and store.duplicates(s).first()["n"] == 2
    assert [r["name"] for r in store.missing(s, names).collect()] == ["z"]
    assert {r["name"] for r in store.overhead(s, names).collect()} == {"a", "b"}
    assert store.large(spark.createDataFrame([("x",), ("x",), ("y",)], "c string"), "c", 5).first()["c"] == "x"


def test_store_files(spark, tmp_path):
    s = spark.createDataFrame([(f"n{i:03d}", f"payload {i}\nline" * (i % 5 + 1)) for i in range(50)], "name string, payload string")
    store_files.write_store(s, str(tmp_path))
    index = store_files.read_index(spark, f"{tmp_path}/index").toPandas().sort_values("offset")
    assert index["name"].tolist() == sorted(index["name"]) and (index["offset"].diff().dropna().to_numpy() == index["length"].to_numpy()[:-1]).all()
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "data").glob("part-*")))
    flat = tmp_path / "flat.data"
    flat.write_bytes(data)
    assert sorted(store_files.read_store(spark, str(flat), f"{tmp_path}/index").collect()) == sorted(s.collect())


ROWS = [("m", 0, "ACDE-FGH"), ("m", 1, "AC-EKFGH"), ("m", 2, "ACDE-FGH"), ("m", 3, "--WYWYWY"), ("m", 4, "--------"), ("n", 0, "AAAA"), ("o", 0, "")]


def test_alignment_figures(spark):
    rows = spark.createDataFrame(ROWS, "msa string, k int, row string")
    c = rows
    assert msa.long_form(rows, "msa", "k", "row").where("msa = 'm'").count() == 40
    w = msa.global_weights(c).toPandas()
    assert w.groupby("msa")["w"].sum().to_numpy() == pytest.approx([1, 1])
    assert w[(w.msa == "m") & (w.k == 3)]["w"].iloc[0] > w[(w.msa == "m") & (w.k == 0)]["w"].iloc[0]
    v = msa.frequency_vectors(c, msa.global_weights(c))
    f = msa.column_frequencies(v)
    assert f.groupBy("msa", "i").agg(F.sum("f").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    n = msa.effective_number(v).toPandas()["neff"]
    assert n.between(1, 20).all()
    ends = {(r["msa"], r["k"]): (r["first"], r["last"]) for r in msa.end_gaps(c).collect()}
    assert ends["m", 3] == (3, 8) and ("m", 4) not in ends
    assert msa.validate(rows).where("not valid").count() == 1
    empty = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("b", 1, True)], "msa string, k int, kept boolean")
    assert sorted((r["msa"], r["k"]) for r in msa.never_empty(empty).where("kept").collect()) == [("a", 1), ("b", 1)]


@pytest.mark.parametrize("row", ["", "A", "-", "AC--DE", "--A--", "A" * 300, "-" * 300, "A" * 130 + "-" * 260 + "C" * 127])
def test_compression_round_trip(spark, row):
    df = spark.createDataFrame([(row, row.replace("-", ""))], "row string, residues string").withColumn("b", msa.compress(F.col("row")))
    got = df.select(msa.extract(F.col("b"), F.col("residues")).alias("back"), "b").first()
    assert got["back"] == row and all(0 <= b["m"] <= 127 and -127 <= b["g"] <= 0 for b in got["b"])


def test_identity_filter(spark):
    rows = spark.createDataFrame(ROWS, "msa string, k int, row string")
    kept = {(r["msa"], r["k"]): r["kept"] for r in redundancy.identity_filter(rows, 90).collect()}
    assert kept["m", 0] and not kept["m", 2] and kept["m", 3]
    x = redundancy.codes(["ACDEF" * 4, "ACDEF" * 4, "ACDEW" * 4, "WWWWW" * 4])
    keep = np.array([2, 1, 1, 1])
    assert redundancy.keep_diverse(x, 90, 90, 99, keep).tolist() == [True, False, True, True]
    assert redundancy.keep_diverse(x, 70, 70, 99, keep).tolist() == [True, False, False, True]
    assert redundancy.neff_of(x[:2]) == 1.0
    assert redundancy.neff_filter(rows, 1.0).where("kept").count() >= 3


def test_display_filter_takes_every_percent(spark):
    base = "ACDEFGHIKL" * 10
    # Members that share 87, and one another's 74 or less, of 100 residues with the first.
    member = lambda a: base[:a] + "W" * 13 + base[a + 13 :]
    rows = spark.createDataFrame([("m", k, r) for k, r in enumerate([base, member(0), member(20), member(40)])], "msa string, k int, row string")
    x = redundancy.codes([base, member(0), member(20), member(40)])
    sizes = {t: int(redundancy.keep_diverse(x, t, t, 5, np.array([2, 1, 1, 1])).sum()) for t in range(10, 91)}
    for n in (1, 3, 4):
        want = max(t for t in sizes if all(sizes[u] <= n for u in range(10, t + 1)))
        kept = redundancy.most_dissimilar(rows, n, 89).where("kept").count()
        assert kept == sizes[min(want, 89)]
    assert redundancy.most_dissimilar(rows, 4, 89).where("kept").count() == 4
    assert redundancy.most_dissimilar(rows, 4, 88).where("kept").count() == sizes[88] == 4 > sizes[85]


def test_match_transitions_open_inserts(spark):
    rows = spark.createDataFrame([("m", 0, "ACDE"), ("m", 1, "AgCD-"), ("m", 2, "Ag-DEkk"), ("m", 3, "A-DE")], "msa string, k int, a3m string")
    c = rows.select("msa", "k", msa.without_inserts(F.col("a3m")).alias("row"))
    w = spark.createDataFrame([("m", 0, 0.4), ("m", 1, 0.3), ("m", 2, 0.2), ("m", 3, 0.1)], "msa string, k int, w double")
    got = {r["i"]: (r["mm"], r["mi"], r["md"]) for r in msa.match_transitions(c, w, msa.insert_runs(rows, "a3m")).collect()}
    assert got[1] == pytest.approx((0.4, 0.5, 0.1)) and got[2] == pytest.approx((1, 0, 0)) and got[3] == pytest.approx((1, 0, 0)) and got[4] == pytest.approx((0, 1, 0))
    plain = {r["i"]: (r["mm"], r["mi"], r["md"]) for r in msa.match_transitions(c, w).collect()}
    assert plain[1] == pytest.approx((0.7, 0, 0.3)) and set(plain) == {1, 2, 3}


def test_neff_filter_by_score(spark):
    texts = ["ACDEFGHIKL" * 2, "ACDEFGHIKL" * 2, "SCDEFGHIKL" * 2, "SSSSSGHIKL" * 2, "--WWWWWWWWWWWWWWWW--", "ACXEF--IKLACDEFGH-KL"]
    rows = spark.createDataFrame([("m", k, r) for k, r in enumerate(texts)], "msa string, k int, row string")
    letters = "ACDEFGHIKLMNPQRSTVWY"
    # A and S are alike: a member of S scores as well as an equal one.
    alike = spark.createDataFrame([(a, b, 4.0 if a == b or {a, b} == {"A", "S"} else -1.0) for a in letters for b in letters], "a string, b string, s double")
    table = np.zeros((26, 26))
    for r in alike.collect():
        table[ord(r["a"]) - 65, ord(r["b"]) - 65] = r["s"]
    c = msa.long_form(rows, "msa", "k", "row")
    want = {r["k"]: r["score"] / r["nres"] for r in msa.query_score(c, alike, 0.0).collect()}
    assert dict(enumerate(redundancy.query_scores(texts, table))) == pytest.approx(want)
    kept = {r["k"]: r["kept"] for r in redundancy.neff_filter(rows, 1.2, alike, max_id=95).collect()}
    assert kept[0] and not kept[1] and kept[2] and not kept[3] and not kept[4]


def test_trees():
    d = np.array([[0, 2, 6, 6], [2, 0, 6, 6], [6, 6, 0, 4], [6, 6, 4, 0]], dtype=float)
    assert redundancy.upgma(list("abcd"), d) == [(0, 1, 1.0), (2, 3, 2.0), (4, 5, 3.0)]
    joins = redundancy.neighbour_joining(list("abcd"), d)
    assert sum(x + y for _, _, x, y in joins) == pytest.approx(10 - 1, abs=2)


def test_paging_rules(spark):
    rows = [("q", f"t{i}", i, float(i), p, e) for i, (p, e) in enumerate([(90.0, 0.1), (10.0, 9.0), (80.0, 0.1), (80.0, 9.0), (80.0, 0.1), (5.0, 0.1), (99.0, 0.1)])]
    df = spark.createDataFrame(rows, "query string, target string, file int, score_aass double, probab double, eval double")
    lines = [(r["target"], r["line"]) for r in hits.paged(df, 2, 10, 20.0, 1.0).orderBy("line").collect()]
    assert lines == [("t0", 1), ("t1", 2), ("t2", 3), ("t4", 4)]  # t3 is skipped, t5 ends the list
    assert hits.paged(df, 2, 3, 20.0, 1.0).count() == 3
    assert hits.best_per_target(df.unionByName(df)).count() == 7


def test_floor(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([5, 9, 9, 1, 7])], "n int, s int")
    assert {r["n"] for r in hits.floor_top_k(df, "s", "n", 1, 8).collect()} == {1, 2}
    assert {r["n"] for r in hits.floor_top_k(df, "s", "n", 4, 100).collect()} == {0, 1, 2, 4}
    assert hits.floor_top_k(df.limit(0), "s", "n", 4, 1).count() == 0
    e = spark.createDataFrame([(0, 999.5), (1, 1000.4), (2, 1000.0), (3, 1000.9), (4, 2000.0)], "n int, e double")
    assert [r["n"] for r in hits.floor_by_evalue(e, "e", "n", 1, 1000.0, 100).orderBy("rank").collect()] == [0]
    assert hits.excluded_ranges("1-33, 97-168,5") == [(1, 33), (97, 168), (5, 5)]


def test_formats(spark):
    text = "#title\n>q one\nACDE\n>q again\nWWWW\n>aa_x\nA\n>ss_pred\nHHHH\n>b two\nA-dD\nE\n"
    got = alignments.parse_fasta(text)
    assert [(r[0], r[2], r[4]) for r in got] == [("q", "ACDE", False), ("ss_pred", "HHHH", True), ("b", "A-dDE", False)]
    a3m = ["ACDE", "AxyC-E", "-CDEz"]
    a2m = alignments.to_a2m(a3m)
    assert len(set(map(len, a2m))) == 1 and alignments.to_a3m(a2m) == a3m
    for kind in ("fas", "clu", "sto", "psi"):
        out = alignments.convert(["a", "b"], ["AC-DE", "A-CDE"], "fas", kind)
        kind_in = {"fas": "fas", "clu": "clustal", "sto": "stockholm", "psi": "psi"}[kind]
        assert [(r[0], r[2]) for r in alignments.parse(out, kind_in)] == [("a", "AC-DE"), ("b", "A-CDE")]
    assert alignments.match_by_gaps(["A-C", "A-C", "AGC"], 50) == ["A.C", "A.C", "AgC"]
    assert alignments.drop_gappy(["A-C", "A-C", "AGC"], 50) == ["AC", "AC", "AC"]
    with pytest.raises(ValueError):
        alignments.convert(["a", "b"], ["AC", "A"], "fas", "a3m")
    members = spark.createDataFrame([(1, k, n, s) for k, (n, s) in enumerate([("a", "AC-DE"), ("b", "A-CDE")])], "id int, k int, name string, seq string")
    assert alignments.converted(members, "fas", "a3m").first()["text"] == ">a\nACDE\n>b\nA-cDE\n"
    kinds = ["HMMER3/f", "HMMER2.0", "HHM 1.5", "NAME x", "#a", ">b", "CLUSTAL W", "?"]
    assert [col(spark, k, alignments.kind_of) for k in kinds] == ["hmmer3", "hmmer2", "profile", "profile", "a3m", "a3m", "clustal", "unknown"]


@pytest.mark.parametrize("path, row", [([(1, 1), (2, 2), (3, 3)], "MKL--"), ([(1, 1), (3, 2)], "M-K--"), ([(2, 1), (3, 3), (5, 4)], "-MkL-V"), ([(1, 1), (4, 3)], "MK-L-"), ([(1, 1), (2, 4)], "MklV---")])
def test_merge_by_path(path, row):
    assert alignments.merge_by_path(["ACDEF"], ["MKLV"], path) == [row]


def test_profile_text(spark):
    cols = [{"i": k, "letter": "A", "f": [0.5, 0.25, 0.25] + [0.0] * 17, "tr": [0.5, 0.25, 0.25, 1.0, 0.0, 0.5, 0.5], "neff_m": 2.5, "neff_i": 0.0, "neff_d": 1.0} for k in (1, 2)]
    row = {"name": "x", "longname": "x long", "fam": "a.1", "length": 2, "neff": 2.5, "evd_lambda": 0.5, "evd_mu": 3.0, "seqs": [{"name": "s", "seq": "AA"}], "null": [0.05] * 20, "cols": cols}
    back = profile_text.parse(profile_text.render_native(row))
    assert back["name"] == "x" and back["length"] == 2 and back["seqs"] == row["seqs"]
    assert np.allclose([c["f"] for c in back["cols"]], [c["f"] for c in cols], atol=1e-3) and np.allclose([c["tr"] for c in back["cols"]], [c["tr"] for c in cols], atol=1e-3)
    assert [c["neff_m"] for c in back["cols"]] == [2.5, 2.5]
    got = profile_text.profiles(spark.createDataFrame([(profile_text.render_native(row),)], "text string"))
    assert got.first()["fam"] == "a.1"
    assert "NAME  x long" in profile_text.rendered(got).first()["text"]


def test_report_round_trip(spark):
    path = [{"i": i, "j": i + 1, "state": "MM", "s": 1.0, "post": 0.9} for i in range(1, 5)] + [{"i": 5, "j": 5, "state": "DG", "s": 0.0, "post": 0.0}, {"i": 6, "j": 6, "state": "MM", "s": 2.0, "post": 0.5}]
    hit = {"line": 1, "target": "t1 x", "t_seq": "MACDEG", "t_len": 6, "probab": 99.5, "eval": 1e-5, "pval": 1e-8, "score": 55.5, "score_ss": 1.0, "path": path}
    text = reports.report_text("q", "ACDEFG", [hit])
    (got,) = reports.parse_report(text)
    assert got[:3] == ("q", 1, "t1") and got[8] == 5 and got[9:14] == (1, 6, 2, 6, 6) and got[14] == 100.0
    df = spark.createDataFrame([("q", "ACDEFG", *[hit[k] for k in hit])], "query string, q_seq string, line int, target string, t_seq string, t_len int, probab double, eval double, pval double, score double, score_ss double, path array<struct<i:int,j:int,state:string,s:double,post:double>>")
    assert reports.read_reports(reports.reports(df)).first()["t_end"] == 6
    assert reports.pairwise_rows(df).first()["row"] == "ACDE-G"


def test_context(spark):
    rng = np.random.default_rng(1)
    emits = rng.dirichlet(np.ones(20), size=5)
    lib = context.Library(np.log2(emits)[:, None, :], np.full(5, -np.log2(5)), emits)
    post = context.posteriors(emits, lib)
    assert np.allclose(post.sum(1), 1) and context.state_sequence(emits, lib)[0] in range(5)
    mixed = context.pseudocounts(emits, lib, 0.3)
    assert np.allclose(mixed.sum(1), 1)
    sharp = np.eye(20)[:4]
    assert context.profile_neff(context.to_neff(sharp, lib, 3.0)) == pytest.approx(3.0, abs=0.05)
    text = "".join(f"ContextProfile\nPRIOR {p}\nLOG T\n1 " + " ".join(str(round(-1000 * np.log2(x))) for x in e) + "\n//\n" for p, e in zip([0.2] * 5, emits))
    assert np.allclose(context.parse_library(text).emits, emits, atol=1e-3)


def test_translated_columns(spark):
    """Blocks give what whole profiles give, at any cut; columns that are missing or null count as nothing."""
    rng = np.random.default_rng(4)
    lib = context.Library(np.log2(rng.dirichlet(np.ones(5), size=(6, 3))), np.full(6, -np.log2(6)), rng.dirichlet(np.ones(5), size=6))
    profiles = {"long": rng.dirichlet(np.full(5, 0.4), 23), "one": rng.dirichlet(np.ones(5), 1), "gap": rng.dirichlet(np.full(5, 0.4), 12)}
    rows = [(name, i, x.tolist()) for name, p in profiles.items() for i, x in enumerate(p) if (name, i) != ("gap", 5)] + [("gap", 5, None)]
    profiles["gap"][5] = 0
    df = spark.createDataFrame(rows, "name string, i long, p array<double>")
    for block in (4, 7, 1024):
        got = {(r["name"], r["i"]): r["state"] for r in context.translated_columns(df, lib, block).collect()}
        assert got == {(name, i): int(s) for name, p in profiles.items() for i, s in enumerate(context.posteriors(p, lib).argmax(1)) if (name, i) != ("gap", 5)}
    texts = {r["name"]: bytes(r["states"]) for r in context.state_texts(context.translated_columns(df, lib, 4)).collect()}
    assert texts["long"] == context.state_sequence(profiles["long"], lib) and len(texts["gap"]) == 11
    assert not context.translated_columns(df.limit(0), lib).collect()


def test_iteration(spark):
    base = spark.createDataFrame([(i, float(i)) for i in range(10)], "target long, x double")

    def find(query):
        return base.select("target", F.lit(1).alias("irep"), F.abs(F.col("x") - query).alias("eval"))

    def take(query, new):
        return query + 2.0, 1.0, new.count()

    from dataclasses import replace

    s = iterate.Search(find, take, replace(ITERATIVE, rounds=3, e=1.5))
    got = {r["target"]: r["first_round"] for r in s.run(0.0, spark).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: None, 7: None, 8: None, 9: None}
    assert [r.new for r in s.rounds] == [2, 2, 2]


def test_batch(spark, tmp_path):
    s = spark.createDataFrame([("a", "x y"), ("b", None)], "name string, payload string")
    assert {r["name"]: r["payload"] for r in batch.apply_program(s, ["cat"]).collect()} == {"a": "x y", "b": ""}
    assert batch.map_entries(s, lambda p: p and p.upper()).collect() == [("a", "X Y")]
    assert batch.feed_program(s, ["cat"]) == 2
    batch.write_sinks(s, {"one": lambda d: d, "two": lambda d: d.select("name")}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/two").count() == 2


def test_models(spark):
    joint = spark.createDataFrame([(a, b, 3.0 if a == b else 1.0) for a in "ACD" for b in "ACD"], "a string, b string, p double")
    m = profiles.substitution_model(joint).toPandas()
    assert m["p"].sum() == pytest.approx(1) and m[m.a == m.b]["s"].gt(0).all() and m[m.a != m.b]["s"].lt(0).all()
    assert m.groupby("b")["r"].sum().to_numpy() == pytest.approx([1, 1, 1])
    row = {"hmm": 1, "length": 2, "m2m": 1.0, "m2i": 0.0, "m2d": 0.0, "i2m": 1.0, "i2i": 0.0, "d2m": 1.0, "d2d": 0.0, "neff_m": 2.0, "neff_i": 0.0, "neff_d": 0.0}
    tr = spark.createDataFrame(pd.DataFrame([row | {"i": i} for i in range(3)]))
    begin, mid, end = profiles.transition_pseudocounts(tr, f=1.0, g=1.0, h=1.0, i=1.0).orderBy("i").collect()
    assert sum(2 ** mid[c] for c in ("m2m", "m2i", "m2d")) == pytest.approx(1) and 2 ** mid["i2m"] + 2 ** mid["i2i"] == pytest.approx(1)
    assert 2 ** mid["m2d"] == pytest.approx(0.15 * 0.0286 / 2) and 2 ** mid["i2i"] == pytest.approx(0.75)
    assert begin["m2i"] is None and end["m2d"] is None and end["d2d"] is None and begin["m2m"] == end["m2m"] == 0
    scaled = profiles.transition_pseudocounts(tr, f=0.5).orderBy("i").collect()[1]
    assert scaled["m2d"] == pytest.approx(0.5 * mid["m2d"])  # f scales the log of m2d


def test_local_background_by_brute_force(spark):
    rng = np.random.default_rng(3)
    prior = {"A": 0.7, "C": 0.3}
    for n, reach in ((1, 3), (6, 3), (7, 3), (8, 3), (30, 3), (30, 0), (25, 12), (26, 12)):
        p = rng.uniform(0.01, 1, (n, 2))
        df = spark.createDataFrame([(1, i + 1, r, float(p[i, k])) for i in range(n) for k, r in enumerate("AC")], "hmm long, i long, r string, p double")
        got = {(r["i"], r["r"]): r["q"] for r in profiles.local_background(df, spark.createDataFrame(list(prior.items()), "r string, prior double"), reach).collect()}
        width = 2 * reach + 1
        for i in range(n):
            lo = 0 if n <= width else min(max(i - reach, 0), n - width)
            part = p[lo : lo + width]
            for k, r in enumerate("AC"):
                assert got[i + 1, r] == pytest.approx(p[i, k] / np.sqrt((part[:, k].sum() + 10 * prior[r]) / (len(part) + 10)))


def test_columns_of_large_alignments(spark, monkeypatch):
    """An alignment of more members than a task may hold is dealt over salts; the figures are the same, blocks and all."""
    import random

    random.seed(3)
    rows = [("m", k, "".join(random.choice("ACDEFGUBZX-JW") for _ in range(random.choice([0, 1, 255, 256, 257, 600])))) for k in range(40)] + [("n", 0, "ACD"), ("n", 1, "A-D")]
    df = spark.createDataFrame(rows, "msa string, k int, row string")
    figures = lambda: (
        {(r["msa"], r["k"]): r["w"] for r in msa.global_weights(df).collect()},
        {(r["msa"], r["i"], r["r"]): r["f"] for r in msa.column_frequencies(msa.frequency_vectors(df, df.selectExpr("msa", "k", "1.0 + k as w"))).collect()},
        {(r["msa"], r["i"]): r["gap_share"] for r in msa.by_gap_share(df.selectExpr("*", "1.0 + k as w")).collect()},
        {(r["msa"], r["i"]): r["dm"] for r in msa.delete_transitions(df, df.selectExpr("msa", "k", "1.0 + k as w")).collect()},
    )
    plain = figures()
    monkeypatch.setattr(msa, "SALT", 7)
    for a, b in zip(plain, figures()):
        assert a == pytest.approx(b)
    # against plain loops
    same = {"U": "C", "B": "D", "Z": "E"}
    cells, gaps = {}, {}
    for m, k, row in rows:
        ends = [i for i, c in enumerate(row) if c != "-"]
        for i, c in enumerate(row, 1):
            if c not in "-JOX":
                cells.setdefault((m, i), {}).setdefault(same.get(c, c), []).append(k)
            if ends and ends[0] < i <= ends[-1] + 1:
                gaps.setdefault((m, i), [0, 0])[c != "-"] += 1 + k
    assert plain[1] == pytest.approx({(m, i, r): sum(1 + k for k in ks) / sum(1 + k for other in col.values() for k in other) for (m, i), col in cells.items() for r, ks in col.items()})
    assert plain[2] == pytest.approx({key: 100 * g / (g + r) for key, (g, r) in gaps.items()})
    raw = {}
    for (m, i), col in cells.items():
        for ks in col.values():
            for k in ks:
                raw.setdefault((m, k), []).append(1 / (len(ks) * len(col)))
    raw = {key: sum(x) / (len(x) + 30) + 1e-6 for key, x in raw.items()}
    assert plain[0] == pytest.approx({key: x / sum(y for other, y in raw.items() if other[0] == key[0]) for key, x in raw.items()})


def test_codecs():
    from strandql.functions import codecs

    x = np.linspace(0, 1, 101)
    assert np.abs(codecs.from_8_bit(codecs.to_8_bit(x)) - x).max() < 0.03 and codecs.from_8_bit(codecs.to_8_bit([0.0, 1.0])).tolist() == [0.0, 1.0]
    assert np.allclose(codecs.from_16_bit(codecs.to_16_bit(x)), x, atol=1e-3)
    blocks = [(127, 0), (3, -5), (0, -127)]
    assert codecs.unpack_blocks(codecs.pack_blocks(70000, 12, blocks)) == (70000, 12, blocks)
    cells = [(1, 2, 0.5), (2, 3, 0.25), (4, 5, 1.0), (7, 1, 0.125)]
    back = codecs.unpack_matrix(codecs.pack_matrix(cells))
    assert sorted((i, j) for i, j, _ in back) == sorted((i, j) for i, j, _ in cells)


def test_local_weights():
    x = redundancy.codes(["ACDEFGHIKLMN", "ACDEFGHIKLMN", "WCDEFGHIKLMY", "----------MN"])
    cols = redundancy.local_columns(x)
    assert len(cols) == 12 and all(f.sum() == pytest.approx(1) and 1 <= n <= 20 for _, n, f in cols)
    assert cols[0][2][0] == pytest.approx(0.5, abs=0.15) and cols[1][2][2] == 1.0
    assert redundancy.henikoff(x).sum() == pytest.approx(1)


def test_compressed_members(spark):
    seqs = spark.createDataFrame([(1, "MMACDEFGH"), (2, "ACWW")], "entry int, residues string")
    members = spark.createDataFrame([("m", 0, 1, "AC--DE"), ("m", 1, 2, "--ACWW"), ("m", 2, 2, "QQQ---")], "msa string, k int, entry int, row string")
    c = msa.compressed_members(members, seqs)
    heads = spark.createDataFrame([(1, ">one"), (2, ">two")], "entry int, header string")
    got = sorted((r["k"], r["row"], r["header"]) for r in msa.extracted_members(c, seqs, heads).collect())
    assert got == [(0, "AC--DE", ">one"), (1, "--ACWW", ">two")]


def test_downstream(spark):
    from strandql.operators import ranking

    texts = ["MKHHHHHHAAAAAAAAAAAA", "MKV", "", None, "hhhh", "aEQKLISEEDLhhhhhhh" + "A" * 20, "H" * 30, "DYKDDDDKDYKDDDDK", "A" * 20 + "HHHHH"]
    tagged = spark.createDataFrame(list(enumerate(texts)), "k int, c string").select("k", ranking.tagged_columns(F.col("c"))).orderBy("k").collect()
    for (_, got), text in zip(tagged, texts):
        want = set()
        for pattern, reach in (("H{5,}", 8), ("EQKLISEEDL", 0), ("DYKDDDDK", 0)):
            for m in re.finditer(pattern, (text or "").upper()):
                want.update(range(max(0, m.start() - reach), min(len(text), m.end() + reach)))
        assert got == sorted(want)
    p = spark.createDataFrame([("a", "DYKDDDDKM", [[1.0, 0.0]] * 9)], "name string, consensus string, p array<array<double>>")
    assert ranking.neutral_tags(p, [0.5, 0.5]).first()["p"] == [[0.5, 0.5]] * 8 + [[1.0, 0.0]]
    net = ranking.ranking_net([F.lit(1.0), F.lit(2.0)], [([1.0, -1.0], 0.5)], [2.0], -1.0)
    z = 1 / (1 + np.exp(0.5))
    assert spark.range(1).select(net).first()[0] == pytest.approx(1 / (1 + np.exp(-(2 * z - 1))))
    h = spark.createDataFrame([("a", "b", 1, 5, 2, 6, 0.1, 1, 0.5), ("a", "a", 1, 5, 1, 5, 0.0, 2, 0.1)], "query string, target string, i1 int, i2 int, j1 int, j2 int, eval double, line int, pval double")
    assert sorted((r["query"], r["i1"]) for r in ranking.conjugate(h).collect()) == [("a", 1), ("b", 2)]
    assert ranking.chosen(h, index=[1], max_e=1.0).count() == 1
