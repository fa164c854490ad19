"""Alignments in long form: one row for each residue (or gap) of each member at each column.

Rows are (msa, k, i, r): alignment, member, column from 1, symbol. Long form is a narrow generator over the row texts
and stays inside code generation.

Figures of columns take row texts (msa, k, row). These are cut into blocks of BLOCK columns, and the blocks of an alignment
meet by (msa, block): that moves a byte a cell. Residues are then counted where they lie, a batch of blocks at a time in
numpy, and a block's counts are one vector; nothing else moves but sums. The members of a large alignment are dealt over several salts, whose
vectors are added up, so no task holds more than SALT members of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandql.functions.residues import LETTERS, SAME, as_row
from strandql.session import few


def long_form(rows: DataFrame, msa: str, k: str, row: str) -> DataFrame:
    """(msa, k, i, r) of row texts."""
    cells = rows.select(F.col(msa).alias("msa"), F.col(k).alias("k"), F.split(F.col(row), "").alias("_cells"))
    return cells.select("msa", "k", F.posexplode("_cells").alias("_i", "r")).where("r <> ''").select("msa", "k", (F.col("_i") + 1).cast("long").alias("i"), "r")


#: Columns of a block, and members of an alignment that a task may hold of it.
BLOCK, SALT = 256, 50_000


def large_alignments(rows: DataFrame) -> DataFrame | None:
    """(msa, salts) of the alignments of more than SALT members; None if there is none."""
    many = rows.groupBy("msa").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts")).where("salts > 1")
    return few(many) if many.limit(1).count() else None


def blocks(rows: DataFrame, large: DataFrame | None, *more: str) -> DataFrame:
    """(msa, b, salt, k, seg, end gaps of the row, columns named in more) of row texts; seg ends with the symbol that
    follows its block. Letters that stand for another residue are that residue. Partitioned by alignment, block and salt."""
    row = F.translate("row", "".join(SAME), "".join(SAME.values()))
    at = rows.select("msa", "k", *more, F.regexp_extract_all(row, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("segs"), (F.length(row) - F.length(F.ltrim(row, F.lit("-"))) + 1).alias("first"), F.length(F.rtrim(row, F.lit("-"))).alias("last"))
    at = at.withColumn("segs", F.transform("segs", lambda x, j: F.concat(x, F.coalesce(F.substring(F.get("segs", j + 1), 1, 1), F.lit("")))))
    at = at.withColumn("salt", F.lit(0)) if large is None else at.join(large, "msa", "left").withColumn("salt", F.pmod(F.xxhash64("k"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return at.select("msa", "salt", "k", *more, "first", "last", F.posexplode_outer("segs").alias("b", "seg")).where("seg is not null").repartition("msa", "b", "salt")


def block_cells(blocks_: DataFrame, *more: str) -> DataFrame:
    """(msa, b, salt, j, r, next, i, first, last, k, columns named in more) of blocks: one row a cell, j its place in the block."""
    cells = blocks_.select("msa", "b", "salt", "k", "first", "last", *more, F.split("seg", "").alias("cells"))
    out = cells.select("*", F.posexplode("cells").alias("j", "r")).where(f"j < {BLOCK} and r <> ''")
    return out.select("msa", "b", "salt", "k", "first", "last", *more, "j", "r", F.get("cells", F.col("j") + 1).alias("next"), (F.col("b") * BLOCK + F.col("j") + 1).cast("long").alias("i"))


#: Byte to place in LETTERS, 20 for everything else.
_PLACE = np.full(256, 20, dtype=np.int64)
_PLACE[[ord(c) for c in LETTERS]] = np.arange(20)


def _places(segs: list[str]) -> np.ndarray:
    """Block texts as a matrix of places in LETTERS; what lies beyond a text's end is no residue."""
    raw = b"".join(s.encode("latin-1", "replace")[:BLOCK].ljust(BLOCK, b"-") for s in segs)
    return _PLACE[np.frombuffer(raw, dtype=np.uint8).reshape(len(segs), BLOCK)]


def _groups(b: pa.RecordBatch) -> tuple[np.ndarray, list[tuple]]:
    """For rows that are sorted by (msa, b, salt): the number of each row's group, and the groups' keys."""
    keys, number = [], np.empty(b.num_rows, dtype=np.int64)
    for k, key in enumerate(zip(*(b.column(c).to_pylist() for c in ("msa", "b", "salt")))):
        if not keys or key != keys[-1]:
            keys.append(key)
        number[k] = len(keys) - 1
    return number, keys


def _counted(blocks_: DataFrame, large: DataFrame | None, weight: str | None = None) -> DataFrame:
    """(msa, b, v): how often each residue stands in each column of a block, or the sum of weights, as one vector of BLOCK times 20 numbers.
    A task adds up the blocks that it holds in numpy, one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(keys: list[tuple], sums: np.ndarray) -> pa.RecordBatch:
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * (BLOCK * 20)), pa.array(sums.ravel()))
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], kind), pa.array([k[1] for k in keys], pa.int32()), flat], names=["msa", "b", "v"])

        last, held, kind = None, None, pa.string()
        for b in batches:
            kind = b.column("msa").type
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                number, keys = _groups(part)
                place = _places(part.column("seg").to_pylist())
                real = place < 20
                index = ((number[:, None] * BLOCK + np.arange(BLOCK)) * 20 + place)[real]
                w = None if weight is None else np.repeat(part.column("w").to_numpy(), BLOCK)[real.ravel()]
                sums = np.bincount(index, w, minlength=len(keys) * BLOCK * 20).astype(np.float64).reshape(len(keys), -1)
                if last is not None:
                    if keys[0] == last:
                        sums[0] += held
                    else:
                        yield rows([last], held[None])
                if len(keys) > 1:
                    yield rows(keys[:-1], sums[:-1])
                last, held = keys[-1], sums[-1]
        if last is not None:
            yield rows([last], held[None])

    cols = [F.col("msa"), F.col("b"), F.col("salt"), F.col("seg"), *([F.col(weight).cast("double").alias("w")] if weight else [])]
    out = blocks_.select(*cols, "k").sortWithinPartitions("msa", "b", "salt", "k").drop("k").mapInArrow(run, f"msa {dict(blocks_.dtypes)['msa']}, b int, v array<double>")
    if large is None:
        return out
    # The salts of a block: few, each of thousands of members.
    several = F.aggregate(F.slice("vs", F.lit(2), F.size("vs")), F.get("vs", F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return out.groupBy("msa", "b").agg(F.collect_list("v").alias("vs")).select("msa", "b", several.alias("v"))


def text_rows(df: DataFrame, msa: Column, k: Column, text: Column) -> DataFrame:
    return df.select(msa.alias("msa"), k.alias("k"), as_row(F.coalesce(text, F.lit(""))).alias("row"))


def validate(rows: DataFrame) -> DataFrame:
    """For each alignment: members, least and most match columns, whether all agree."""
    match = F.length(F.regexp_replace("row", "[^A-Z-]", "")).cast("long")
    out = rows.groupBy("msa").agg(F.count("*").alias("members"), F.min(match).alias("least"), F.max(match).alias("most"))
    return out.withColumn("valid", (F.col("least") == F.col("most")) & (F.col("least") > 0))


def by_gap_share(rows: DataFrame, percent: int = 50) -> DataFrame:
    """Match columns by their weighted share of gaps, end gaps left out: (msa, i, gap_share, is_match).
    rows: (msa, k, row, w). A member counts from its first to its last residue."""
    large = large_alignments(rows)
    inside = block_cells(blocks(rows, large, "w"), "w").where("i between first and last")
    gap, keys = F.sum(F.when(F.col("r") == "-", F.col("w")).otherwise(0.0)), ["msa", "b", "j"]
    out = inside.groupBy(*keys, "salt").agg(gap.alias("gap"), F.sum("w").alias("all"))
    if large is not None:
        out = out.groupBy(*keys).agg(F.sum("gap").alias("gap"), F.sum("all").alias("all"))
    out = out.select("msa", _column(), (100.0 * F.col("gap") / F.col("all")).alias("gap_share"))
    return out.withColumn("is_match", F.col("gap_share") <= percent)


def _column() -> Column:
    return (F.col("b") * BLOCK + F.col("j") + 1).cast("long").alias("i")


def first_member(cells: DataFrame) -> DataFrame:
    """The symbols (msa, i, q) of each alignment's first member, its query."""
    first = cells.groupBy("msa").agg(F.min("k").alias("k"))
    return cells.join(first, ["msa", "k"], "left_semi").select("msa", "i", F.col("r").alias("q"))


def by_first(cells: DataFrame) -> DataFrame:
    """Match columns by the first member: the columns where it has a residue (msa, i)."""
    first = cells.groupBy("msa").agg(F.min("k").alias("k"))
    return cells.where("r <> '-'").join(first, ["msa", "k"], "left_semi").select("msa", "i")


def end_gaps(rows: DataFrame) -> DataFrame:
    """First and last residue column, and the number of residues, of each member (msa, k, first, last, nres), from its text."""
    row = F.col("row")
    first = F.length(row) - F.length(F.ltrim(row, F.lit("-"))) + 1
    out = rows.select("msa", "k", first.cast("long").alias("first"), F.length(F.rtrim(row, F.lit("-"))).cast("long").alias("last"), F.length(F.replace(row, F.lit("-"), F.lit(""))).cast("long").alias("nres"))
    return out.where("nres > 0")


def insert_runs(rows: DataFrame, row: str) -> DataFrame:
    """Runs of lower-case residues after each match column of an A3M row: (msa, k, after, n) where n > 0."""
    parts = F.regexp_extract_all(F.concat(F.lit("-"), F.col(row)), F.lit("([A-Z-][^A-Z-]*)"), F.lit(0))
    runs = rows.select("msa", "k", F.posexplode(parts).alias("after", "part"))
    return runs.select("msa", "k", F.col("after").cast("long").alias("after"), F.length(F.regexp_replace("part", "[^a-z]", "")).cast("long").alias("n")).where("n > 0")


def shrink(cells: DataFrame, kept: DataFrame) -> DataFrame:
    """Cells of the kept members (msa, k)."""
    return cells.join(kept.select("msa", "k"), ["msa", "k"], "left_semi")


def without_inserts(row: Column) -> Column:
    return F.regexp_replace(row, "[a-z.]", "")


def merge_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of two alignments of the same match columns, b's after a's where the header is new: (msa, header, row)."""
    return a.unionByName(b.join(a.select("msa", "header"), ["msa", "header"], "left_anti"))


def rearranged(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Members in the order of a list (msa, header, pos)."""
    return rows.join(order, ["msa", "header"])


def subrange(row: Column, start: int, end: int) -> Column:
    """Match columns start to end of an A3M row with the inserts between them."""
    parts = F.regexp_extract_all(row, F.lit("([A-Z-][a-z.]*)"), F.lit(0))
    cut = F.slice(parts, start, end - start + 1)
    return F.regexp_replace(F.array_join(cut, ""), "[a-z.]*$", "")


# ---- compression: a member as runs of residues and of gaps against its full sequence -----------------------

LONGEST = 127


def compress(row: Column) -> Column:
    """Blocks of an alignment row as an array of (matches, gaps): residues, then deleted columns as a negative number.
    Runs are cut at LONGEST."""
    parts = F.regexp_extract_all(row, F.lit(f"([^-]{{0,{LONGEST}}}-{{1,{LONGEST}}}|[^-]{{1,{LONGEST}}})"), F.lit(0))
    residues = lambda x: F.length(F.rtrim(x, F.lit("-")))
    return F.transform(parts, lambda x: F.struct(residues(x).cast("int").alias("m"), (residues(x) - F.length(x)).cast("int").alias("g")))


def compressed_text(row: Column) -> Column:
    """The blocks as text, ``matches:gaps`` joined by blanks."""
    return F.array_join(F.transform(compress(row), lambda b: F.concat_ws(":", b["m"].cast("string"), b["g"].cast("string"))), " ")


def _extracted(blocks: pa.Array, residues: pa.Array) -> pa.Array:
    parts = blocks.flatten()
    m, g = (np.asarray(parts.field(x).fill_null(0), dtype=np.int64) for x in ("m", "g"))
    ends = np.cumsum(np.nan_to_num(np.asarray(pa.compute.list_value_length(blocks).fill_null(0)))).astype(np.int64)
    out, begin = [], 0
    for known, end, text in zip(blocks.is_valid().to_pylist(), ends.tolist(), residues.to_pylist()):
        runs = np.stack([m[begin:end], -g[begin:end]], 1).ravel()
        begin = end
        if not known or text is None:
            out.append(None)
            continue
        kind = "latin-1" if text.isascii() else "utf-32-le"
        symbols = np.frombuffer(text.encode(kind), dtype=np.uint8 if kind == "latin-1" else np.uint32)
        real = np.repeat(np.tile([True, False], len(runs) // 2), runs)
        # Residues that the sequence lacks leave their places out.
        places = np.cumsum(real)
        row = np.full(len(real), ord("-"), dtype=symbols.dtype)
        if len(places) and places[-1] > len(symbols):
            row, real = row[~real | (places <= len(symbols))], real[~real | (places <= len(symbols))]
        row[real] = symbols[: np.count_nonzero(real)]
        out.append(row.tobytes().decode(kind))
    return pa.array(out, pa.string())


def extract(blocks: Column, residues: Column) -> Column:
    """The alignment row of blocks and the residues without gaps, in one walk along both: a row costs its length, however many blocks it has."""
    return F.arrow_udf(_extracted, "string")(blocks, residues)


def compressed_members(members: DataFrame, sequences: DataFrame) -> DataFrame:
    """Members (msa, k, entry, row) as blocks against their full sequences (entry, residues): (msa, k, entry, start, blocks),
    start the place, from 1, of the member's residues in its sequence. Members without such a place are left out."""
    met = members.join(sequences, "entry").withColumn("start", F.instr("residues", F.replace(upper_row(F.col("row")), F.lit("-"), F.lit("")))).where("start > 0")
    return met.select("msa", "k", "entry", "start", compress(F.col("row")).alias("blocks"))


def extracted_members(compressed: DataFrame, sequences: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Members rebuilt from blocks and sequences, and their headers (entry, header): an equi-join on the entry."""
    met = compressed.join(sequences, "entry")
    if headers is not None:
        met = met.join(headers, "entry")
    row = extract(F.col("blocks"), F.expr("substring(residues, start)"))
    return met.select("msa", "k", "entry", row.alias("row"), *(["header"] if headers is not None else []))


def upper_row(row: Column) -> Column:
    return F.translate(row, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


# ---- profile figures ---------------------------------------------------------------------------------------


def residue_cells(cells: DataFrame) -> DataFrame:
    """Cells that hold one of the 20 residues."""
    return cells.where("r <> '-' and r not in ('J', 'O', 'X')").withColumn("r", F.translate("r", "UBZ", "CDE"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each member gets from the columns of each of its blocks, and its residues there. Rows come sorted; a block's
    table (side 0) before its members."""
    share = None
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            side, member, n = part.column("side").to_numpy(), np.zeros(part.num_rows), np.zeros(part.num_rows, dtype=np.int64)
            ends = [*np.flatnonzero(side == 0).tolist(), part.num_rows]
            begin = 0
            for k, end in enumerate(ends):
                if end > begin:
                    place = _places(part.column("seg").slice(begin, end - begin).to_pylist())
                    member[begin:end] = share[np.arange(BLOCK), place].sum(1)
                    n[begin:end] = (place < 20).sum(1)
                if end < part.num_rows:
                    count = np.asarray(part.column("v")[end].values.to_numpy()).reshape(BLOCK, 20)
                    kinds = (count > 0).sum(1, keepdims=True)
                    # A symbol that is no residue gets nothing.
                    share = np.concatenate([np.divide(1.0, count * kinds, out=np.zeros_like(count), where=count > 0), np.zeros((BLOCK, 1))], 1)
                begin = end + 1
            own = pa.array(side == 1)
            yield pa.RecordBatch.from_arrays([part.column("msa").filter(own), part.column("k").filter(own), pa.array(member).filter(own), pa.array(n).filter(own)], names=["msa", "k", "s", "nres"])


def global_weights(rows: DataFrame, pseudo: int = 30) -> DataFrame:
    """Henikoff weights (msa, k, w), normalised to 1 within an alignment: a member gets 1 / (members with its residue *
    residues of the column * (its length + pseudo)) from each column. A member without residues has none."""
    large = large_alignments(rows)
    own = blocks(rows, large)
    tables = _counted(own, large)
    # The table of a block stands before its members in each of its salts.
    every = F.lit(0) if large is None else F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    tables = (tables if large is None else tables.join(large, "msa", "left")).select("msa", "b", every.alias("salt"), F.lit(0).alias("side"), F.lit(None).cast(dict(rows.dtypes)["k"]).alias("k"), F.lit("").alias("seg"), "v")
    met = tables.unionByName(own.select("msa", "b", "salt", F.lit(1).alias("side"), "k", "seg", F.lit(None).cast("array<double>").alias("v")))
    share = met.repartition("msa", "b", "salt").sortWithinPartitions("msa", "b", "salt", "side", "k").mapInArrow(_shared, f"msa {dict(rows.dtypes)['msa']}, k {dict(rows.dtypes)['k']}, s double, nres long").where("nres > 0")
    share = share.groupBy("msa", "k").agg(F.sum("s").alias("s"), F.sum("nres").alias("nres"))
    raw = share.select("msa", "k", (F.col("s") / (F.col("nres") + pseudo) + 1e-6).alias("raw"))
    total = raw.groupBy("msa").agg(F.sum("raw").alias("total"))
    return raw.join(total, "msa").select("msa", "k", (F.col("raw") / F.col("total")).alias("w"))


def frequency_vectors(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted residue frequencies of each column that has a residue, in the order of LETTERS (msa, i, f: array).
    The weights meet the row texts, not their cells."""
    large = large_alignments(rows)
    summed = _counted(blocks(rows.join(weights, ["msa", "k"]), large, "w"), large, "w")
    return summed.mapInArrow(_columns, f"msa {dict(rows.dtypes)['msa']}, i long, f array<double>")


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shares of the residues in each column of a block that has one."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            v = np.asarray(part.column("v").flatten().to_numpy()).reshape(-1, 20)
            total = v.sum(1)
            real = np.flatnonzero(total > 0)
            block, place = np.divmod(real, BLOCK)
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(real) + 1, dtype=np.int32) * 20), pa.array((v[real] / total[real, None]).ravel()))
            i = part.column("b").to_numpy().astype(np.int64)[block] * BLOCK + place + 1
            yield pa.RecordBatch.from_arrays([part.column("msa").take(pa.array(block)), pa.array(i), f], names=["msa", "i", "f"])


def column_frequencies(vectors: DataFrame) -> DataFrame:
    """Frequency vectors in long form (msa, i, r, f), residues that occur."""
    named = F.filter(F.transform("f", lambda x, a: F.struct(F.substring(F.lit(LETTERS), a + 1, F.lit(1)).alias("r"), x.alias("f"))), lambda x: x["f"] > 0)
    return vectors.select("msa", "i", F.inline(named))


def _followed(rows: DataFrame, weights: DataFrame, at: Column, large: DataFrame | None) -> DataFrame:
    """Cells within members' ends with their weights and what follows: (msa, b, salt, j, i, k, r, next, w)."""
    cells = block_cells(blocks(rows.join(weights, ["msa", "k"]), large, "w"), "w").where("i between first and last")
    return cells.withColumn("next", F.when(F.col("i") < F.col("last"), F.col("next"))).where(at)


def _shares(cells: DataFrame, **parts: Column) -> DataFrame:
    """Weighted shares of a column's cells (msa, i, one column each)."""
    keys = ["msa", "b", "j"]
    out = cells.groupBy(*keys, "salt").agg(F.sum("w").alias("_all"), *(F.sum(F.when(c, F.col("w")).otherwise(0.0)).alias(name) for name, c in parts.items()))
    out = out.groupBy(*keys).agg(F.sum("_all").alias("_all"), *(F.sum(name).alias(name) for name in parts))
    return out.select("msa", _column(), *((F.col(name) / F.col("_all")).alias(name) for name in parts))


def match_transitions(rows: DataFrame, weights: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Weighted shares of a residue followed by a residue, by an insert, or by a gap (msa, i, mm, mi, md), within members'
    ends. runs: (msa, k, after, n), the inserts; one after a residue counts whatever column follows it."""
    inside = _followed(rows, weights, F.col("r") != "-", large_alignments(rows))
    if runs is None:
        inside = inside.withColumn("opens", F.lit(False))
    else:
        opened = runs.where("n > 0").select("msa", "k", F.col("after").alias("i")).distinct().withColumn("opens", F.lit(True))
        inside = inside.join(opened, ["msa", "k", "i"], "left").withColumn("opens", F.coalesce("opens", F.lit(False)))
    shares = _shares(inside.where("opens or next is not null"), mm=~F.col("opens") & (F.col("next") != "-"), mi=F.col("opens"))
    return shares.withColumn("md", 1 - F.col("mm") - F.col("mi"))


def delete_transitions(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted shares of a gap followed by a residue, or by a gap (msa, i, dm, dd), within members' ends."""
    inside = _followed(rows, weights, (F.col("r") == "-") & F.col("next").isNotNull(), large_alignments(rows))
    return _shares(inside, dm=F.col("next") != "-").withColumn("dd", 1 - F.col("dm"))


def insert_transitions(runs: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted shares of an inserted residue followed by a match, or by another insert (msa, after, im, ii).
    runs: (msa, k, after, n)."""
    out = runs.join(weights, ["msa", "k"]).groupBy("msa", "after").agg((F.sum("w") / F.sum(F.col("w") * F.col("n"))).alias("im"))
    return out.withColumn("ii", 1 - F.col("im"))


def _entropy() -> Column:
    return F.aggregate("f", F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def _pairs() -> Column:
    return 1.0 / F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x)


def effective_number(vectors: DataFrame) -> DataFrame:
    """Two to the entropy of each column (msa, i, neff)."""
    return vectors.select("msa", "i", F.pow(F.lit(2.0), _entropy()).alias("neff"))


def alignment_neff(columns: DataFrame) -> DataFrame:
    """Mean of the columns' numbers (msa, neff)."""
    return columns.groupBy("msa").agg(F.avg("neff").alias("neff"))


def pairs_neff(vectors: DataFrame) -> DataFrame:
    """Effective number by the sum of pairs: 1 / sum of squared frequencies (msa, i, neff)."""
    return vectors.select("msa", "i", _pairs().alias("neff"))


def _prior_vector(prior: DataFrame) -> Column:
    """A prior (r, prior) of the 20 residues as a vector."""
    known = {r["r"]: r["prior"] for r in prior.collect()}  # 20 rows
    return F.array(*(F.lit(float(known.get(a, 0.0))) for a in LETTERS))


def alignment_numbers(vectors: DataFrame) -> DataFrame:
    """Both effective numbers of each alignment in one pass (msa, neff, pairs)."""
    both = vectors.select("msa", F.pow(F.lit(2.0), _entropy()).alias("neff"), _pairs().alias("pairs"))
    return both.groupBy("msa").agg(F.avg("neff").alias("neff"), F.avg("pairs").alias("pairs"))


def background(vectors: DataFrame, prior: DataFrame, share: float = 100.0) -> DataFrame:
    """Mean residue distribution (msa, r, pav): column frequencies and share * prior / neff, normalised; neff is the
    mean of the columns' numbers."""
    at = vectors.select("msa", "f", F.pow(F.lit(2.0), _entropy()).alias("neff"))
    sums = at.groupBy("msa").agg(F.avg("neff").alias("neff"), *(F.sum(F.get("f", F.lit(k))).alias(f"_{a}") for k, a in enumerate(LETTERS)))
    raw = sums.select("msa", F.zip_with(F.array(*(f"_{a}" for a in LETTERS)), _prior_vector(prior), lambda s, q: s + share * q / F.col("neff")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return raw.withColumn("n", total).select("msa", F.inline(F.transform("v", lambda x, a: F.struct(F.substring(F.lit(LETTERS), a + 1, F.lit(1)).alias("r"), (x / F.col("n")).alias("pav")))))


def consensus(vectors: DataFrame, prior: DataFrame) -> DataFrame:
    """Per column the residue of largest excess over the prior: upper case above 0.6, lower above 0.4, else x (msa, i, c)."""
    gains = F.zip_with("f", _prior_vector(prior), lambda x, q: F.struct(x.alias("f"), (x - q).alias("gain")))
    named = F.transform(gains, lambda g, a: F.struct(g["gain"].alias("gain"), F.substring(F.lit(LETTERS), a + 1, F.lit(1)).alias("r"), g["f"].alias("f")))
    best = vectors.select("msa", "i", F.array_max(F.filter(named, lambda g: g["f"] > 0)).alias("b"))
    return best.select("msa", "i", F.when(F.col("b.f") > 0.6, F.col("b.r")).when(F.col("b.f") > 0.4, F.lower("b.r")).otherwise("x").alias("c"))


def coverage(cells: DataFrame, percent: int) -> DataFrame:
    """Members of which at least percent of the alignment's columns hold a residue (msa, k, nres, columns, kept)."""
    width = cells.groupBy("msa").agg(F.max("i").alias("columns"))
    own = residue_cells(cells).groupBy("msa", "k").agg(F.count("*").alias("nres"))
    return own.join(width, "msa").withColumn("kept", 100 * F.col("nres") >= percent * F.col("columns"))


def query_identity(cells: DataFrame, percent: int) -> DataFrame:
    """Members by their share of residues that differ from the first member's (msa, k, nres, differ, kept)."""
    own = residue_cells(cells)
    query = residue_cells(first_member(cells).withColumnRenamed("q", "r")).withColumnRenamed("r", "q")
    both = own.join(query, ["msa", "i"], "left").groupBy("msa", "k").agg(F.count("*").alias("nres"), F.count_if(F.col("q").isNull() | (F.col("q") != F.col("r"))).alias("differ"))
    limit = F.floor((0.9999 - 0.01 * percent) * F.col("nres") + 0.9999)
    return both.withColumn("kept", F.col("differ") < limit)


def query_score(cells: DataFrame, scores: DataFrame, least: float, gap_open: float = 6.0, gap_extend: float = 1.0) -> DataFrame:
    """Members by their score a residue against the first one (msa, k, nres, score, kept). scores: (a, b, s). Affine
    gaps on either side between a member's first and last residue; other residues score 0 and hold runs."""
    ends = cells.where("r <> '-'").groupBy("msa", "k").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    query = first_member(cells)
    met = cells.join(ends, ["msa", "k"]).where("i between first and last").join(query, ["msa", "i"], "left").withColumn("q", F.coalesce("q", F.lit("-")))
    real = lambda c: ~F.col(c).isin("-", "J", "O", "X")
    met = met.withColumn("state", F.when(real("r") & real("q"), "m").when(real("r") & (F.col("q") == "-"), "q").when((F.col("r") == "-") & real("q"), "k")).where("state is not null")
    along = Window.partitionBy("msa", "k").orderBy("i")
    opened = F.when(F.lag("state").over(along) == F.col("state"), gap_extend).otherwise(gap_open)
    met = met.withColumn("cost", F.when(F.col("state") != "m", opened)).join(few(scores), (F.col("r") == F.col("b")) & (F.col("q") == F.col("a")) & (F.col("state") == "m"), "left")
    nres = residue_cells(cells).groupBy("msa", "k").agg(F.count("*").alias("nres"))
    out = met.groupBy("msa", "k").agg(F.sum(F.coalesce("s", F.lit(0.0)) - F.coalesce("cost", F.lit(0.0))).alias("score")).join(nres, ["msa", "k"])
    return out.withColumn("kept", F.col("score") >= least * F.col("nres"))


def never_empty(kept: DataFrame) -> DataFrame:
    """(msa, k, kept) with an alignment's first member put back where none is kept."""
    any_kept = Window.partitionBy("msa")
    first = F.min("k").over(any_kept) == F.col("k")
    return kept.withColumn("kept", F.col("kept") | (~F.bool_or("kept").over(any_kept) & first))


# ---- the filter tool: all figures of a member in one pass ---------------------------------------------------


def with_first(rows: DataFrame) -> DataFrame:
    """rows with ``q``, the row of each alignment's first member that has a column, as far as their own one goes, and ``columns``, the
    alignment's width."""
    first = rows.groupBy("msa").agg(F.expr("min_by(row, k) filter (where row <> '')").alias("q"), F.max(F.length("row")).cast("long").alias("columns"))
    return rows.join(few(first), "msa").withColumn("q", F.substring("q", F.lit(1), F.length("row")))


#: Kinds of a pair of symbols: residues on both sides, a gap in the first row, a gap in the member; by (first's place, member's), of which 21 is a gap.
_KIND = np.zeros((22, 22), dtype=np.uint8)
_KIND[:20, :20], _KIND[21, :20], _KIND[:20, 21] = 1, 2, 3


def member_figures(rows: DataFrame, scores: DataFrame | None = None, gap_open: float = 6.0, gap_extend: float = 1.0, texts: bool = True) -> DataFrame:
    """(msa, k, row if texts, columns, nres, differ, score, faced) of members with a residue: what ``coverage``, ``query_identity`` and ``query_score`` look
    at, in one walk along a member's row beside the first one's. scores: (a, b, s) of the 20 residues; faced: pairs of symbols that a
    score looks at. No row is made for a cell, and rows don't move: only the first ones do."""
    table, scored = np.zeros((22, 22)), scores is not None
    for r in scores.collect() if scored else []:  # 400 rows
        if r["a"] in LETTERS and r["b"] in LETTERS:
            table[LETTERS.index(r["a"]), LETTERS.index(r["b"])] = float(r["s"])
    place = _PLACE.astype(np.uint8)
    place[ord("-")] = 21
    for a, b in SAME.items():
        place[ord(a)] = place[ord(b)]

    def walked(own: str, first: str) -> tuple[int, int, float, int]:
        # From the first to the last residue; what lies outside counts for nothing.
        inner = own.strip("-")
        lead = len(own) - len(own.lstrip("-"))
        a = place[np.frombuffer(inner.encode("latin-1", "replace"), dtype=np.uint8)]
        b = place[np.frombuffer(first[lead : lead + len(inner)].ljust(len(inner), "-").encode("latin-1", "replace"), dtype=np.uint8)]
        real = a < 20
        nres = np.count_nonzero(real)
        kind = _KIND[b, a]
        both = kind == 1
        same = np.count_nonzero(both & (a == b))
        seen = kind[kind > 0]
        gaps = seen > 1
        longer = np.count_nonzero(gaps[1:] & (seen[1:] == seen[:-1]))
        gain = table[b[both], a[both]].sum() if scored else 0.0
        return nres, nres - same, float(gain - gap_open * (np.count_nonzero(gaps) - longer) - gap_extend * longer), len(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [walked(x, y or "") for x, y in zip(b.column("row").to_pylist(), b.column("q").to_pylist())]
            nres, differ, score, faced = zip(*got) if got else ((),) * 4
            more = [pa.array(nres, pa.int64()), pa.array(differ, pa.int64()), pa.array(score, pa.float64()), pa.array(faced, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *more], names=[*own, "nres", "differ", "score", "faced"])

    kinds, own = dict(rows.dtypes) | {"columns": "long"}, ["msa", "k", *["row"] * texts, "columns"]
    met = with_first(rows.select("msa", "k", "row")).select("msa", "k", "row", "columns", "q")
    return met.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in own) + ", nres long, differ long, score double, faced long").where("nres > 0")


def near_query(rows: DataFrame, percent: int) -> DataFrame:
    """``query_identity`` of row texts (msa, k, row): (msa, k, nres, differ, kept)."""
    limit = F.floor((0.9999 - 0.01 * percent) * F.col("nres") + 0.9999)
    return member_figures(rows, texts=False).select("msa", "k", "nres", "differ", (F.col("differ") < limit).alias("kept"))


def scored_by_query(rows: DataFrame, scores: DataFrame, least: float, gap_open: float = 6.0, gap_extend: float = 1.0) -> DataFrame:
    """``query_score`` of row texts (msa, k, row): (msa, k, score, nres, kept)."""
    out = member_figures(rows, scores, gap_open, gap_extend, texts=False).where("faced > 0")
    return out.select("msa", "k", "score", "nres", (F.col("score") >= least * F.col("nres")).alias("kept"))


def filter_tool(rows: DataFrame, scores: DataFrame, percent: int = 0, qid: int = 0, qsc: float = -20.0, texts: bool = True) -> DataFrame:
    """Every member with a residue that meets more than ambiguous ones, its figures and whether coverage, identity and score with the first
    member all pass (msa, k, row if texts, columns, nres, differ, score, kept); an alignment's first such member stays where none
    does. ``redundancy.identity_filter`` goes over what is kept."""
    out = member_figures(rows, scores, texts=texts).where("faced > 0").drop("faced")
    near = F.col("differ") < F.floor((0.9999 - 0.01 * qid) * F.col("nres") + 0.9999)
    out = out.withColumn("kept", (100 * F.col("nres") >= percent * F.col("columns")) & near & (F.col("score") >= qsc * F.col("nres")))
    return never_empty(out)
