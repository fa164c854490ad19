"""Search reports as text: summary list, alignment blocks, and reading them back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIT = "query string, no int, target string, probab double, eval double, pval double, score double, score_ss double, cols int, q_start int, q_end int, t_start int, t_end int, t_len int, identities double, similarity double, sum_probs double"
_ROW = re.compile(r"^\s*(\d+)\s(.{30})\s+([\d.]+)\s+(\S+)\s+(\S+)\s+(-?[\d.]+)\s+(-?[\d.]+)\s+(\d+)\s+(\d+)-(\d+)\s+(\d+)-(\d+)\s*\((\d+)\)")
_DETAIL = re.compile(r"Probab=\S+\s+E-value=\S+\s+Score=\S+\s+Aligned_cols=\d+\s+Identities=([\d.]+)%\s+Similarity=(-?[\d.]+)\s+Sum_probs=([\d.]+)")
#: Column score marks from worst to best, and their lower bounds.
MARKS = [(-1.5, "="), (-0.5, "-"), (0.5, "."), (1.5, "+")]


def mark(score: float) -> str:
    """The symbol of a column score."""
    out = MARKS[0][1]
    for bound, symbol in MARKS:
        if score > bound:
            out = symbol
    return "|" if score > 1.5 else out


def parse_report(text: str) -> list[tuple]:
    """Hits of a report: the summary list, with what the alignment blocks add."""
    query, rows, extra, no = "", {}, {}, None
    for line in text.splitlines():
        if line.startswith("Query "):
            query = line.split()[1] if len(line.split()) > 1 else ""
        elif line.startswith("No ") and line[3:].strip().isdigit():
            no = int(line[3:])
        elif (m := _DETAIL.search(line)) and no is not None:
            extra[no] = tuple(map(float, m.groups()))
        elif (m := _ROW.match(line)) and no is None:
            g = m.groups()
            rows[int(g[0])] = (query, int(g[0]), g[1].split()[0] if g[1].split() else "", *map(float, g[2:7]), *map(int, g[7:13]))
    return [(*r, *extra.get(k, (None, None, None))) for k, r in sorted(rows.items())]


def read_reports(texts: DataFrame, text_col: str = "text") -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([r for t in f[text_col] for r in parse_report(t or "")], columns=[c.split()[0] for c in HIT.split(", ")])

    return texts.select(text_col).mapInPandas(run, HIT)


def alignment_block(q_name: str, q_row: str, t_name: str, t_row: str, marks: str, q_from: int, t_from: int, width: int = 80) -> str:
    """A wrapped alignment of two rows of equal length."""
    out, q_at, t_at = [], q_from, t_from
    for k in range(0, len(q_row), width):
        a, b, m = q_row[k : k + width], t_row[k : k + width], marks[k : k + width]
        na, nb = len(a.replace("-", "")), len(b.replace("-", ""))
        out.append(f"Q {q_name[:14]:<14} {q_at:>4} {a} {q_at + na - 1:>4}\n{'':<21} {m}\nT {t_name[:14]:<14} {t_at:>4} {b} {t_at + nb - 1:>4}\n")
        q_at, t_at = q_at + na, t_at + nb
    return "\n".join(out)


def report_text(query: str, q_seq: str, hits: list[dict]) -> str:
    """A whole report of a query's numbered hits (target, t_seq, t_len, probab, eval, pval, score, score_ss, path)."""
    head = [f"Query         {query}", f"Match_columns {len(q_seq)}", "", " No Hit                             Prob E-value P-value  Score    SS Cols Query HMM  Template HMM"]
    lines, blocks = [], []
    for h in hits:
        mm = [s for s in h["path"] if s["state"] == "MM"]
        if not mm:
            continue
        a, b = (mm[0]["i"], mm[-1]["i"]), (mm[0]["j"], mm[-1]["j"])
        lines.append(f"{h['line']:>3} {h['target'][:30]:<30} {h['probab']:5.1f} {h['eval']:7.2G} {h['pval']:7.2G} {h['score']:6.1f} {h['score_ss']:5.1f} {len(mm):>4} {a[0]:>4}-{a[1]:<4} {b[0]:>4}-{b[1]:<4}({h['t_len']})")
        q_row = "".join(q_seq[s["i"] - 1] if s["state"] in ("MM", "DG", "MI") else "-" for s in h["path"])
        t_row = "".join(h["t_seq"][s["j"] - 1] if s["state"] in ("MM", "GD", "IM") else "-" for s in h["path"])
        marks = "".join(mark(s["s"]) if s["state"] == "MM" else " " for s in h["path"])
        same = sum(q_seq[s["i"] - 1] == h["t_seq"][s["j"] - 1] for s in mm)
        detail = f"Probab={h['probab']:.2f}  E-value={h['eval']:.2G}  Score={h['score']:.2f}  Aligned_cols={len(mm)}  Identities={100 * same / len(mm):.0f}%  Similarity={sum(s['s'] for s in mm) / len(mm):.3f}  Sum_probs={sum(s['post'] for s in mm):.1f}"
        blocks.append(f"No {h['line']}\n>{h['target']}\n{detail}\n\n" + alignment_block(query, q_row, h["target"], t_row, marks, h["path"][0]["i"], h["path"][0]["j"]))
    return "\n".join([*head, *lines, "", *blocks, "Done!", ""])


def reports(hits: DataFrame) -> DataFrame:
    """One report a query (query, text) of hits with query, q_seq, and the fields of report_text. A query's list is paged
    before, so it is bounded."""
    kind = dict(hits.dtypes)["query"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("line")
        return pd.DataFrame({"query": [f["query"].iloc[0]], "text": [report_text(str(f["query"].iloc[0]), f["q_seq"].iloc[0], f.to_dict("records"))]})

    return hits.groupBy("query").applyInPandas(run, f"query {kind}, text string")


def pairwise_rows(hits: DataFrame) -> DataFrame:
    """Both rows of each hit's alignment in A3M style: query gaps as lower-case inserts of the target (query, target, row)."""
    step = lambda s: (
        F.when(s["state"] == "MM", F.substring(F.col("t_seq"), s["j"], F.lit(1))).when(s["state"].isin("GD", "IM"), F.lower(F.substring(F.col("t_seq"), s["j"], F.lit(1)))).otherwise("-")
    )
    return hits.select("query", "target", F.array_join(F.transform("path", step), "").alias("row"))
