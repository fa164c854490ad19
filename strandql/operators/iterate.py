"""Iterative search: search, take in significant new hits, rebuild the query, until nothing new is found."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandql.params import ITERATIVE, Params
from strandql.session import stored


@dataclass
class Round:
    """What one round found: all hits, and the counts that the stop rules read."""

    hits: DataFrame
    new: int
    neff: float
    members: int


@dataclass
class Search:
    """A fix-point search. ``find(query) -> hits`` (target, irep, eval, ...) and ``take(query, hits) -> (query, neff,
    members)`` are the caller's; each round's hits become a table in the session's checkpoint folder, and one small row
    of counts comes to the driver."""

    find: Callable
    take: Callable
    params: Params = ITERATIVE
    rounds: list[Round] = field(default_factory=list)

    def run(self, query, spark) -> DataFrame:
        """Hits of the last round, with the round in which each was first accepted."""
        seen = None
        for k in range(1, self.params.rounds + 1):
            found = self.find(query).withColumn("_key", F.concat_ws("__", F.col("target").cast("string"), F.col("irep").cast("string")))
            if seen is None:
                found = found.withColumn("first_round", F.when(F.col("eval") <= self.params.e, F.lit(k)))
            else:
                found = found.join(seen, "_key", "left").withColumn("first_round", F.coalesce("seen_round", F.when(F.col("eval") <= self.params.e, F.lit(k)))).drop("seen_round")
            hits = stored(found, "round")
            fresh = hits.where(F.col("first_round") == k)
            new = fresh.count()
            query, neff, members = self.take(query, fresh.drop("_key", "first_round")) if new else (query, 0.0, 0)
            self.rounds.append(Round(hits, new, neff, members))
            seen = hits.where(F.col("first_round").isNotNull()).select("_key", F.col("first_round").alias("seen_round"))
            if not new or neff > self.params.neff_max or members >= self.params.max_seq:
                break
        return self.rounds[-1].hits.drop("_key")


def premerged(find: Callable, take: Callable, query, hits: DataFrame, n: int):
    """The query after taking in the n best hits one after the other, each against what the ones before made of it."""
    for row in hits.orderBy("eval", "target").limit(n).collect():  # n is a small parameter
        again = find(query).where(F.col("target") == row["target"])
        query, _, _ = take(query, again)
    return query


def kept_paths(old: DataFrame, again: DataFrame) -> DataFrame:
    """Old hits with statistics of a rescoring, where there is one, and their own paths."""
    stats = [c for c in again.columns if c in old.columns and c not in ("query", "target", "irep", "path")]
    met = old.join(again.select("target", "irep", *(F.col(c).alias(f"_{c}") for c in stats)), ["target", "irep"], "left")
    return met.select(*(F.coalesce(f"_{c}", c).alias(c) if c in stats else F.col(c) for c in old.columns))
