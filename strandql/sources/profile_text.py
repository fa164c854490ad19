"""Profile texts: the native column format (read and write) and the two HMMER formats (read), as rows of columns."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log2

import pandas as pd
from pyspark.sql import DataFrame

# Order of residues in files, names of transitions, scale of the native format.
FILE_ORDER = "ACDEFGHIKLMNPQRSTVWY"
TRANSITIONS = ("m2m", "m2i", "m2d", "i2m", "i2i", "d2m", "d2d")
SCALE, NEFF_SCALE = 1000, 1000
COLUMNS = "array<struct<i:int,letter:string,f:array<double>,tr:array<double>,neff_m:double,neff_i:double,neff_d:double>>"
SCHEMA = f"name string, longname string, fam string, length int, neff double, evd_lambda double, evd_mu double, seqs array<struct<name:string,seq:string>>, null array<double>, cols {COLUMNS}"


def _p(token: str) -> float:
    """A probability written as -1000 log2 p; ``*`` is 0."""
    return 0.0 if token == "*" else 2.0 ** (-int(token) / SCALE)


def _t(p: float) -> str:
    return "*" if p <= 0 else str(round(-SCALE * log2(p)))


def parse_native(text: str) -> dict:
    """One native profile as a row of SCHEMA."""
    out = {"name": "", "longname": "", "fam": "", "length": 0, "neff": 1.0, "evd_lambda": None, "evd_mu": None, "seqs": [], "null": None, "cols": []}
    lines = iter(text.splitlines())
    for line in lines:
        key, _, rest = line.partition(" ")
        rest = rest.strip()
        if key == "NAME":
            out["longname"], out["name"] = rest, rest.split()[0] if rest else ""
        elif key == "FAM":
            out["fam"] = rest
        elif key == "LENG":
            out["length"] = int(rest.split()[0])
        elif key == "NEFF":
            out["neff"] = float(rest.split()[0])
        elif key == "EVD":
            out["evd_lambda"], out["evd_mu"] = map(float, rest.split()[:2])
        elif key == "SEQ":
            for line in lines:
                if line.startswith("#"):
                    break
                if line.startswith(">"):
                    out["seqs"].append({"name": line[1:].split()[0] if line[1:].split() else "", "seq": ""})
                elif out["seqs"]:
                    out["seqs"][-1]["seq"] += line.strip()
        elif key == "NULL":
            out["null"] = [_p(x) for x in rest.split()[:20]]
        elif key == "HMM":
            next(lines, None)
            next(lines, None)
            break
    for line in lines:
        part = line.split()
        if line.startswith("//"):
            break
        if len(part) < 22:
            continue
        tr = next(lines, "").split()
        out["cols"].append({
            "i": int(part[1]), "letter": part[0], "f": [_p(x) for x in part[2:22]], "tr": [_p(x) for x in tr[:7]],
            **{f"neff_{c}": int(x) / NEFF_SCALE if x != "*" else 0.0 for c, x in zip("mid", tr[7:10])},
        })
    return out


def render_native(row: dict) -> str:
    """A row of SCHEMA as a native profile."""
    head = [f"NAME  {row['longname'] or row['name']}", f"FAM   {row['fam'] or ''}", f"LENG  {len(row['cols'])} match states, {len(row['cols'])} columns in multiple alignment", f"NEFF  {row['neff']:.1f}"]
    if row.get("evd_lambda") is not None:
        head.append(f"EVD   {row['evd_lambda']:.4f}  {row['evd_mu']:.4f}")
    body = ["SEQ", *(f">{s['name']}\n{s['seq']}" for s in (row["seqs"] if row["seqs"] is not None else ())), "#", "NULL   " + "\t".join(_t(x) for x in (row["null"] if row["null"] is not None else [0.05] * 20))]
    body += ["HMM    " + "\t".join(FILE_ORDER), "       " + "\t".join(t.upper().replace("2", "->") for t in TRANSITIONS), "       0\t*\t*\t0\t*\t0\t*\t*\t*\t*"]
    for k, c in enumerate(row["cols"], 1):
        body.append(f"{c['letter']} {k:<4} " + "\t".join(map(_t, c["f"])) + f"\t{k}")
        body.append("       " + "\t".join([*map(_t, c["tr"]), *(str(round(NEFF_SCALE * c[f"neff_{x}"])) for x in "mid")]) + "\n")
    return "\n".join(["HHM 1.5", *head, *body, "//", ""])


def parse_hmmer3(text: str) -> dict:
    """A HMMER3 model: values are -ln p, transitions after each match column; Neff of every column is 10."""
    out = {"name": "", "longname": "", "fam": "", "length": 0, "neff": 10.0, "evd_lambda": None, "evd_mu": None, "seqs": [], "null": None, "cols": []}
    p = lambda x: 0.0 if x == "*" else exp(-float(x))
    lines = iter(text.splitlines())
    for line in lines:
        key, _, rest = line.partition(" ")
        if key == "NAME":
            out["name"] = out["longname"] = rest.strip()
        elif key == "ACC":
            out["fam"] = rest.strip()
        elif key == "LENG":
            out["length"] = int(rest)
        elif key == "HMM":
            next(lines, None)
            break
    for line in lines:
        part = line.split()
        if line.startswith("//"):
            break
        if part and part[0].isdigit() and len(part) >= 21:
            next(lines, None)
            m2m, m2i, m2d, i2m, i2i, d2m, d2d = (p(x) for x in next(lines, "").split()[:7])
            out["cols"].append({"i": int(part[0]), "letter": part[22].upper() if len(part) > 22 else "x", "f": [p(x) for x in part[1:21]], "tr": [m2m, m2i, m2d, i2m, i2i, d2m, d2d], "neff_m": 10.0, "neff_i": 10.0, "neff_d": 10.0})
    return out


def parse_hmmer2(text: str) -> dict:
    """A HMMER2 model: log-odds in thousandths of bits over the NULE line, transitions in thousandths of bits."""
    out = {"name": "", "longname": "", "fam": "", "length": 0, "neff": 10.0, "evd_lambda": None, "evd_mu": None, "seqs": [], "null": [0.05] * 20, "cols": []}
    t = lambda x: 0.0 if x == "*" else 2.0 ** (int(x) / 1000)
    lines = iter(text.splitlines())
    for line in lines:
        key, _, rest = line.partition(" ")
        if key == "NAME":
            out["name"] = out["longname"] = rest.strip()
        elif key == "ACC":
            out["fam"] = rest.strip()
        elif key == "LENG":
            out["length"] = int(rest)
        elif key == "NULE":
            out["null"] = [0.05 * t(x) for x in rest.split()[:20]]
        elif key == "EVD":
            out["evd_mu"], out["evd_lambda"] = map(float, rest.split()[:2])
        elif key == "HMM":
            next(lines, None)
            next(lines, None)
            break
    for line in lines:
        part = line.split()
        if line.startswith("//"):
            break
        if part and part[0].isdigit() and len(part) >= 21:
            next(lines, None)
            tr = [t(x) for x in next(lines, "").split()[1:8]]
            out["cols"].append({"i": int(part[0]), "letter": "x", "f": [n * t(x) for n, x in zip(out["null"], part[1:21])], "tr": (tr + [0.0] * 7)[:7], "neff_m": 10.0, "neff_i": 10.0, "neff_d": 10.0})
    return out


def parse(text: str) -> dict:
    return parse_hmmer3(text) if text.startswith("HMMER3") else parse_hmmer2(text) if text.startswith("HMMER") else parse_native(text)


def profiles(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Profiles of whole texts, the format by the first line."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([parse(t) for t in f[text_col] if t])

    return texts.select(text_col).mapInPandas(run, SCHEMA)


def rendered(rows: DataFrame) -> DataFrame:
    """name and native text of profiles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(r["name"], render_native(r)) for r in f.to_dict("records")], columns=["name", "text"])

    return rows.mapInPandas(run, "name string, text string")
