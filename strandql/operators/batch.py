"""Maps over store entries: functions or external programs, and several sinks from one result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandql.session import stored, swept


def map_entries(entries: DataFrame, f: Callable[[str], str | None]) -> DataFrame:
    """Entries with their payloads mapped; entries that map to None go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = [(n, f(p)) for n, p in zip(x["name"], x["payload"])]
            yield pd.DataFrame([r for r in out if r[1] is not None], columns=["name", "payload"])

    return entries.select("name", "payload").mapInPandas(run, "name string, payload string")


def apply_program(entries: DataFrame, command: list[str], timeout: float = 600.0) -> DataFrame:
    """Entries fed to a program each: name, its standard output and exit status."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import subprocess

        for x in frames:
            out = []
            for name, payload in zip(x["name"], x["payload"]):
                p = subprocess.run(command, input=payload or "", capture_output=True, text=True, timeout=timeout)
                out.append((name, p.stdout, p.returncode))
            yield pd.DataFrame(out, columns=["name", "payload", "status"])

    return entries.select("name", "payload").mapInPandas(run, "name string, payload string, status int")


def feed_program(entries: DataFrame, command: list[str]) -> int:
    """Entries fed one after the other to one program for each partition, output not kept; returns how many. A program that fails
    fails its task, and so the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import subprocess

        n, p = 0, subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.DEVNULL, text=True)
        for x in frames:
            for payload in x["payload"]:
                p.stdin.write(payload or "")
                n += 1
        p.stdin.close()
        if p.wait():
            raise RuntimeError(f"{command[0]} ended with status {p.returncode}")
        yield pd.DataFrame({"n": [n]})

    return entries.select("payload").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_sinks(df: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], folder: str) -> None:
    """Several sinks from one result, which is computed once and read as a table, so that lost executors cost nothing."""
    with swept(df.sparkSession):
        df = stored(df, "sinks")
        for name, make in sinks.items():
            make(df).write.parquet(f"{folder}/{name}")
