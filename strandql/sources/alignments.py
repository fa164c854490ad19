"""Sequence and alignment texts: FASTA, A2M, A3M, Clustal, Stockholm, PSI; sniffing, reading, writing, conversion."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "name string, header string, seq string, k int, special boolean"
#: Names of rows that hold structure, not residues.
SPECIAL = ("ss_dssp", "sa_dssp", "ss_pred", "ss_conf")


def kind_of(first_line: Column) -> Column:
    """Format of a profile or alignment text by its first line."""
    return (
        F.when(first_line.startswith("HMMER3"), "hmmer3").when(first_line.startswith("HMMER"), "hmmer2").when(first_line.startswith("HH") | first_line.startswith("NAME"), "profile")
        .when(first_line.startswith("# STOCKHOLM"), "stockholm").when(first_line.startswith("CLUSTAL"), "clustal").when(first_line.startswith("#") | first_line.startswith(">"), "a3m").otherwise("unknown")
    )


def parse_fasta(text: str) -> list[tuple[str, str, str, int, bool]]:
    """Records of a FASTA, A2M or A3M text: title lines (#) and ``>aa_`` rows are left out; of equal names the first stays."""
    out, seen = [], set()
    for part in re.split(r"^>", "\n" + text if text.startswith(">") else text, flags=re.M)[1:]:
        header, _, body = part.partition("\n")
        name = header.split()[0].lstrip("@") if header.split() else ""
        if name.startswith("aa_") or name in seen:
            continue
        seen.add(name)
        out.append((name, header, re.sub(r"\s", "", body.split("\n#", 1)[0]), len(out), name.split()[0].startswith(SPECIAL) if name else False))
    return out


def parse_blocks(text: str, kind: str) -> list[tuple[str, str, str, int, bool]]:
    """Records of an interleaved alignment: the pieces of each name in turn."""
    rows: dict[str, list[str]] = {}
    for line in text.splitlines():
        if kind == "clustal" and (line.startswith("CLUSTAL") or line[:1].isspace()) or line.startswith(("#", "//")) or not line.strip():
            continue
        parts = line.split()
        if len(parts) >= 2:
            rows.setdefault(parts[0], []).append(parts[1])
    return [(n, n, "".join(p), k, n.startswith(SPECIAL)) for k, (n, p) in enumerate(rows.items())]


def parse(text: str, kind: str) -> list[tuple[str, str, str, int, bool]]:
    return parse_blocks(text, kind) if kind in ("clustal", "stockholm", "psi") else parse_fasta(text)


def records(texts: DataFrame, kind: str = "fas", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Records of whole texts (id, name, header, seq, k, special)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *r) for i, t in zip(f[id_col], f[text_col]) for r in parse(t or "", kind)]
            yield pd.DataFrame(rows, columns=[id_col, "name", "header", "seq", "k", "special"])

    return texts.select(id_col, text_col).mapInPandas(run, f"{id_col} {dict(texts.dtypes)[id_col]}, {RECORD}")


def read(spark: SparkSession, path: str, kind: str = "fas") -> DataFrame:
    """Records of every alignment file below a path; a file is the unit of work."""
    return records(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("id"), F.col("value").alias("text")), kind)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Records of large FASTA files, split between records, so that one file is read by many tasks (id, header, seq)."""
    parts = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    return parts.where(F.trim("value") != "").select(F.regexp_extract(text, r"^(\S*)", 1).alias("name"), F.substring_index(text, "\n", 1).alias("header"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


# ---- conversion --------------------------------------------------------------------------------------------


def slots(row: str) -> list[str]:
    """An A3M row as insert runs before, between and after its match symbols."""
    return re.split(r"[A-Z-]", row.replace(".", ""))


def to_a2m(rows: list[str]) -> list[str]:
    """A3M rows with dots so that all inserts line up."""
    cut = [slots(r) for r in rows]
    if len({len(c) for c in cut}) > 1:
        raise ValueError("rows have different numbers of match columns")
    widths = [max(len(c[i]) for c in cut) for i in range(len(cut[0]))] if cut else []
    out = []
    for row, c in zip(rows, cut):
        match = re.findall(r"[A-Z-]", row)
        out.append("".join(ins.ljust(w, ".") + m for ins, w, m in zip(c, widths, [*match, ""])))
    return out


def to_a3m(rows: list[str]) -> list[str]:
    return [r.replace(".", "") for r in rows]


def match_by_first(rows: list[str]) -> list[str]:
    """Aligned rows with the columns of the first row's gaps as inserts."""
    keep = [c not in "-." for c in rows[0]]
    return ["".join(c.upper() if k and c not in "-." else "-" if k else c.lower().replace("-", ".") for c, k in zip(r, keep)) for r in rows]


def match_by_gaps(rows: list[str], percent: float) -> list[str]:
    """Aligned rows with the columns of ``percent`` gaps or more as inserts; all gaps count."""
    share = [100.0 * sum(r[i] in "-." for r in rows) / len(rows) for i in range(len(rows[0]))]
    return ["".join((c.upper() if c not in "-." else "-") if s < percent else (c.lower() if c not in "-." else ".") for c, s in zip(r, share)) for r in rows]


def convert(names: list[str], rows: list[str], source: str, target: str, match: str | float = "first") -> str:
    """An alignment's text in another format. source: fas, a2m, a3m, sto, psi, clu; target: those and ufas."""
    aligned = to_a2m(rows) if source == "a3m" else [r if source == "a2m" else r.upper().replace(".", "-") for r in rows]
    if len({len(r) for r in aligned}) > 1:
        raise ValueError("rows have different lengths")
    marked = aligned if source in ("a2m", "a3m") else match_by_first(aligned) if match == "first" else match_by_gaps(aligned, float(match))
    flat = [r.upper().replace(".", "-") for r in aligned]
    if target == "a3m":
        body = to_a3m(marked)
    elif target == "a2m":
        body = marked
    elif target == "ufas":
        body = [r.replace("-", "") for r in flat]
    else:
        body = flat
    if target in ("a3m", "a2m", "fas", "ufas"):
        return "".join(f">{n}\n{r}\n" for n, r in zip(names, body))
    width = max(map(len, names), default=0) + 2
    lines = "".join(f"{n:<{width}}{r}\n" for n, r in zip(names, body))
    return {"psi": lines, "clu": "CLUSTAL\n\n" + lines, "sto": "# STOCKHOLM 1.0\n\n" + lines + "//\n"}[target]


def drop_gappy(rows: list[str], percent: float) -> list[str]:
    """Aligned rows without columns of ``percent`` gaps or more."""
    keep = [100.0 * sum(r[i] in "-." for r in rows) / len(rows) < percent for i in range(len(rows[0]))]
    return ["".join(c for c, k in zip(r, keep) if k) for r in rows]


def converted(members: DataFrame, source: str, target: str, match: str | float = "first", id_col: str = "id") -> DataFrame:
    """The text of each alignment (id, text) of members (id, k, name, seq). An alignment is the unit of work."""
    kind = dict(members.dtypes)[id_col]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k", kind="stable")
        return pd.DataFrame({id_col: [f[id_col].iloc[0]], "text": [convert(f["name"].tolist(), f["seq"].tolist(), source, target, match)]})

    return members.select(id_col, "k", "name", "seq").groupBy(id_col).applyInPandas(run, f"{id_col} {kind}, text string")


def merge_by_path(query_rows: list[str], target_rows: list[str], path: list[tuple[int, int]]) -> list[str]:
    """Target rows (A3M) in the frame of a query of as many match columns as ``query_rows`` have: residues of aligned
    columns as matches, all others between them as inserts, query columns without a partner as gaps."""
    width = len(re.findall(r"[A-Z-]", query_rows[0]))
    out = []
    for row in target_rows:
        match, ins = re.findall(r"[A-Z-]", row), slots(row)
        parts, last_i, last_j = [], 0, None
        for i, j in path:
            between = ""
            if last_j is not None:
                between = ins[last_j] + "".join(match[x - 1].lower().replace("-", "") + ins[x] for x in range(last_j + 1, j))
            gap = i - last_i - 1
            if between and gap:  # residues beside skipped query columns fill them from the left, the rest are inserts
                fill = min(gap, len(between))
                parts.append(between[:fill].upper() + "-" * (gap - fill) + between[fill:])
            else:
                parts.append(between + "-" * gap)
            parts.append(match[j - 1])
            last_i, last_j = i, j
        out.append("".join(parts) + "-" * (width - last_i))
    return out


def remove_redundant_inserts(row: Column) -> Column:
    return F.regexp_replace(row, "[a-z.]", "")


def write_a3m(members: DataFrame, path: str, id_col: str = "id") -> None:
    """A3M texts, one row for each alignment; parts are written in parallel."""
    body = members.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "name", "seq"))), lambda m: F.concat(F.lit(">"), m["name"], F.lit("\n"), m["seq"])), "\n").alias("text"))
    body.write.parquet(path)
