"""Downstream selection: ranking nets, template hits as alignment rows, tag neutralisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Purification tags (of histidines, any five in a row), and how many columns on both sides go with them.
TAGS = [("HHHHH", 8), ("EQKLISEEDL", 0), ("DYKDDDDK", 0)]


def ranking_net(inputs: list[Column], hidden: list[tuple[list[float], float]], output: list[float], bias: float) -> Column:
    """A net of logistic hidden units and a logistic output, as one column expression. hidden: weights and bias of each unit."""
    logistic = lambda z: 1.0 / (1.0 + F.exp(-z))
    total = F.lit(float(bias))
    for (w, b), o in zip(hidden, output):
        z = F.lit(float(b))
        for x, v in zip(inputs, w):
            z = z + x * float(v)
        total = total + float(o) * logistic(z)
    return logistic(total)


# The published net that predicts a template's similarity from score, structure score, sum of probabilities over the query's length,
# score a column and similarity: weights and bias of each hidden unit, output weights, output bias.
SIMILARITY_NET = (
    [
        ([-3.129355e-04, -1.589077e-02, -2.161848e00, 2.226650e-01, -4.868254e-01], 2.849843e00),
        ([4.035841e-03, 8.064615e-02, -1.659731e01, 8.745763e-01, -1.147158e00], 2.111072e00),
        ([4.432926e-03, 4.485627e-02, 1.612531e01, -6.115551e00, -3.739336e00], -1.083691e01),
        ([8.667732e-02, 2.469719e-01, 3.679384e00, -8.063131e-01, -4.584766e00], -4.135554e00),
        ([-8.657036e-01, -3.492344e-01, -1.328472e-01, -5.744038e-01, 3.360329e-02], -4.120570e-01),
    ],
    [-7.531151e00, -9.724150e-01, -2.660009e00, 7.692027e-01, 1.438417e00],
    2.0,
)


def predicted_similarity(hits: DataFrame) -> DataFrame:
    """Hits (score, score_ss, sum_probs, matched_cols, similarity, q_len) with ``predicted``, to six places. An alignment without columns counts as
    one of one column."""
    cols, length = (F.greatest(F.lit(1), F.col(c)) for c in ("matched_cols", "q_len"))
    inputs = [F.col("score"), F.col("score_ss"), F.col("sum_probs") / length, F.col("score") / cols, F.col("similarity")]
    return hits.withColumn("predicted", F.round(ranking_net(inputs, *SIMILARITY_NET), 6))


def ranked_templates(hits: DataFrame, top: int = 10) -> DataFrame:
    """Each query's ``top`` templates by predicted similarity (ties: the lower target), numbered."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("predicted").desc(), "target"))
    return predicted_similarity(hits).withColumn("rank", place).where(F.col("rank") <= top)


def _around(text: Column, word: str, reach: int) -> Column:
    """Columns, from 0, of a word's occurrences in a text and of ``reach`` on both sides."""
    n = F.length(text)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), n - len(word))), lambda i: F.substring(text, i + 1, F.lit(len(word))) == word)
    return F.flatten(F.transform(starts, lambda i: F.sequence(F.greatest(F.lit(0), i - reach), F.least(n, i + len(word) + reach) - 1)))


def tagged_columns(consensus: Column, tags: Sequence[tuple[str, int]] = TAGS) -> Column:
    """Columns, from 0, of tags in a consensus, in either case, and of what stands close around them; null and empty: none."""
    text = F.upper(F.coalesce(consensus, F.lit("")))
    return F.array_sort(F.array_distinct(F.concat(*(_around(text, *tag) for tag in tags))))


def neutral_tags(profiles: DataFrame, background: list[float], name: str = "name", consensus: str = "consensus", cols: str = "p", tags: Sequence[tuple[str, int]] = TAGS) -> DataFrame:
    """Profiles (name, consensus, p: an array of columns) with the columns of tags set to the background."""
    marked = profiles.select(name, consensus, cols, tagged_columns(F.col(consensus), tags).alias("_tags"))
    even = F.array(*(F.lit(float(x)) for x in background))
    return marked.select(name, consensus, F.when(F.size("_tags") == 0, F.col(cols)).otherwise(F.transform(cols, lambda c, i: F.when(F.array_contains("_tags", i), even).otherwise(c))).alias(cols))


def conjugate(hits: DataFrame) -> DataFrame:
    """Hits and the same ones seen from the target: query and target, and their ranges, exchanged; self-hits go."""
    own = hits.where("query <> target")
    swap = {"query": "target", "target": "query", "i1": "j1", "i2": "j2", "j1": "i1", "j2": "i2"}
    turned = own.select(*(F.col(swap.get(c, c)).alias(c) for c in own.columns))
    return own.unionByName(turned).dropDuplicates(["query", "target", "i1", "j1"])


def chosen(hits: DataFrame, index: list[int] | None = None, max_p: float | None = None, max_e: float | None = None) -> DataFrame:
    """Hits by their number in the list, by P-value or by E-value."""
    out = hits if index is None else hits.where(F.col("line").isin(index))
    out = out if max_p is None else out.where(F.col("pval") <= max_p)
    return out if max_e is None else out.where(F.col("eval") <= max_e)
