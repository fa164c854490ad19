"""The pipeline against a brute-force version on the smallest tables."""

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from strandql.llm import quality_gbt
from strandql.llm.common import crc_bucket, read_table
from tests.llm.test_dedup import brute
from tests.llm.test_quality import brute_secrets

SF = "/root/testdata/sf0.001"


def contaminated(text, items):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    for item in items:
        for d in range(-len(item), len(w)):
            same = [w[d + j] == item[j] for j in range(len(item)) if 0 <= d + j < len(w)]
            if len(same) >= 11 and max(sum(same[k : k + 13]) for k in range(max(1, len(same) - 12))) >= 11:
                return True
    return False


def test_pipeline(spark):
    docs = read_table(spark, SF, "documents")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    forest = quality_gbt.train(docs, read_table(spark, SF, "labels"), where=crc_bucket("doc_id", 5) != 0)
    every = docs.collect()
    source, rows = {r["doc_id"]: r["source"] for r in every}, [(r["doc_id"], r["text"]) for r in every]
    rows = [r for r, s in zip(rows, forest.score(np.stack([quality_gbt.statistics(t) for _, t in rows]))) if s >= 0.3]
    group = brute(rows, 5)
    rows = [(i, t) for i, t in rows if group[i] == i]
    items = [[x for x in re.split(r"[\W_]+", r["text"].lower()) if x] for r in read_table(spark, SF, "benchmark").collect()]
    # Only documents that share words in a row with an item need the slow comparison.
    grams = {tuple(t[k : k + 3]) for t in items for k in range(len(t) - 2)}
    near = lambda t: any(tuple(w[k : k + 3]) in grams for w in [[x for x in re.split(r"[\W_]+", t.lower()) if x]] for k in range(len(w) - 2))
    rows = [(i, t) for i, t in rows if not (near(t) and contaminated(t, items))]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(out) == {i for i, _ in rows}
    verdict = dict(zip((r["doc_id"] for r in every), brute_secrets([(r["doc_id"], source[r["doc_id"]], r["text"]) for r in every])))  # over the corpus as read
    for i, t in rows:
        verdicts = verdict[i]
        ids = np.frombuffer(out[i]["token_ids"], dtype="<i4").tolist()
        text = library.decode(ids, skip_special_tokens=False)
        assert out[i]["decoded_equal"] and out[i]["n_tokens"] == len(ids) and ids == library.encode(text, add_special_tokens=False).ids
        spans = [v.split(":") for v in verdicts.split(",") if v.endswith(":live")]
        gone = {k for _, a, z, *_ in spans for k in range(int(a), int(z))}
        assert text == "".join("" if k in gone and k - 1 in gone else "<SECRET>" if k in gone else ch for k, ch in enumerate(t))


def test_stages_keep_columns(spark, docs, no_docs):
    stages = corpus_pipeline.STAGES
    assert len(stages) == 5
    for name, stage in stages[1:-1]:
        for d in (docs, no_docs):
            got = stage(spark, d, SF)
            assert got.columns == d.columns, name
            assert got.count() <= d.count()
    last = stages[-1][1](spark, no_docs, SF)
    assert last.count() == 0


def test_near_duplicates_of_odd_ids(spark, docs):
    """Different texts under one id are documents of their own; equal rows and near copies are one; rows without an id stay."""
    long = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(5, long, 0), (5, other, 0), (3, long, 0), (7, other, 0), (7, other, 0), (7, other, 1), (8, long + " end", 0), (None, long, 0), (9, "", 0), (9, None, 0), (9, None, 0), (10, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, df, SF).collect()), key=str)
    assert got == sorted([(3, long, 0), (7, other, 0), (7, other, 1), (None, long, 0), (9, "", 0), (9, None, 0), (10, "", 0)], key=str)


def test_pipeline_deletes_what_it_stored(spark):
    from strandql import session

    begun = len(session.made())
    out = corpus_pipeline.run(spark, SF)
    left = [f.rsplit("/", 1)[-1].rsplit("-", 1)[0] for f in session.made()[begun:]]
    assert set(left) <= {name for name, _ in corpus_pipeline.STAGES} and out.count() > 0
