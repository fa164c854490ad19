"""Secret scans by corpus-wide ownership frequency, in DataFrame operations alone.

Patterns propose candidates, whose values are hashed and aggregated over the whole corpus by distinct owners and
repositories: a value that more than MAX_OWNERS owners or more than MAX_REPOS repositories hold is a copied example, any
other looks live. Spans of three kinds (assign, access, hex) are always reported, with that verdict; of the further
kinds (pem, url, opaque) live ones that no reported span covers are added. Only live spans are redacted.

Positions are code points, the end exclusive. They come from the lengths of the matches and of the gaps between
them, summed along each text, so no row is larger than a text and no step is quadratic in its matches.

A private key is a span from its first mark to its last, whatever headers, escapes or quotes it has; its value is its body alone.

Null and empty texts have no spans; repeated rows get equal spans; a null owner or repository counts as one owner or
repository of its own; an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandql.llm.common import stored, swept, text_of

_PRIVATE = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_BEGIN = rf"-----BEGIN {_PRIVATE}"
#: Kinds in their order, each with its pattern, the group that holds the value, and the least lengths of match and value.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 0, 6),
    # Runs are taken whole, so their least length may stand in the pattern: shorter ones hold no match either way.
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, 0),
    ("hex", r"[0-9a-f]{24,}", 0, 24, 0),
    # Every run is taken whole, however long; none can begin twice at the same character, so matching stays linear. A key goes from its first mark
    # to its last, over headers, line ends that are escaped, and quotes; its value is the body without all these.
    ("pem", rf"{_BEGIN}(?:(?:\\[nr]|\s){{0,8}}[A-Za-z][A-Za-z-]{{1,30}}: ?[^\n\\]*){{0,8}}([A-Za-z0-9+/=\s\\\"',]*)(?:-----END {_PRIVATE})?", 1, 0, 24),
    ("url", r"(?:(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*)?://[^\s:/@]*:([^\s:/@]{6,})@", 1, 0, 0),
    ("opaque", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}", 0, 0, 0),
]
BASE = ("assign", "access", "hex")
#: A text without this has no span of any kind.
ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|-----BEGIN |://[^\s:/@]*:[^\s:/@]{6,}@|""" + KINDS[5][1]
#: A value is live while at most so many owners and at most so many repositories hold it; beyond either it is a copied example.
MAX_OWNERS, MAX_REPOS = 2, 20
#: Rows of a value from which on its counts are broadcast, and how many such values a broadcast may hold.
HOT_ROWS, BROADCAST_VALUES = 10_000, 1_000_000


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Array of (gap before a match, match, value); after the last match a gap alone."""
    p = F.lit(pattern)
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("match"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """Every match of every pattern, one row each, with the lengths from which its place follows."""
    docs = df.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), text_of(text_col).alias("text"))
    docs = docs.where(F.col("text").rlike(ANY))
    kinds = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(name).alias("kind"), F.lit(size).alias("least"), F.lit(value).alias("least_value"), _matches(F.col("text"), p, g).alias("found")) for k, (name, p, g, size, value) in enumerate(KINDS)))
    rows = docs.select("id", F.xxhash64("text").alias("fp"), "owner", "repo", F.inline(kinds))
    rows = rows.select("id", "fp", "owner", "repo", "rank", "kind", "least", "least_value", F.posexplode("found").alias("i", "m")).where(F.col("m.match").isNotNull())
    size, value = F.length("m.match"), F.when(F.col("kind") == "pem", F.regexp_replace("m.value", r"\\[nr]|[^A-Za-z0-9+/=]", "")).otherwise(F.col("m.value"))
    kept = (size >= F.col("least")) & (F.length(value) >= F.col("least_value"))
    return rows.select("id", "fp", "owner", "repo", "rank", "kind", "i", F.length("m.gap").alias("gap"), size.alias("size"), F.when(kept, F.sha2(value.cast("binary"), 256)).alias("value"))


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each value, and its rows; pre-aggregated by owner, so a hot value stays small."""
    pairs = found.where(F.col("value").isNotNull()).groupBy("value", "owner", "repo").agg(F.count("*").alias("rows"))
    owners = pairs.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("rows").alias("rows"))
    return owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("rows").alias("rows"))


def _owned(placed: DataFrame, own: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """placed with owners and repos of its values. A value of many rows would be one key of the join: such values, of
    which there are at most rows / hot_rows, are broadcast, and the rest joins by a shuffle without them."""
    hot = own.where(F.col("rows") >= hot_rows)
    count = hot.limit(BROADCAST_VALUES + 1).count()
    own = own.drop("rows")
    if not 0 < count <= BROADCAST_VALUES:
        return placed.join(own, "value", "left")
    hot = F.broadcast(hot.drop("rows").withColumn("_hot", F.lit(True)))
    met = placed.join(hot, "value", "left")
    cold = met.where(F.col("_hot").isNull()).drop("owners", "repos", "_hot").join(own, "value", "left")
    return met.where("_hot").drop("_hot").unionByName(cold)


def spans(df: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, corpus: DataFrame | None = None, **columns: str) -> DataFrame:
    """id, fp (hash of the text), rank, kind, start, end, owners, repos, live: the reported spans of each text, as a stored table.
    corpus: the documents over which ownership is counted, where df is only what is left of them; a value that it lacks has one owner.
    columns: id_col, text_col, owner_col, repo_col."""
    with swept(df.sparkSession) as kept:
        found = stored(candidates(df, **columns), "secret-candidates")
        own = stored(ownership(found if corpus is None else candidates(corpus, **columns)), "secret-owners")
        one = found.groupBy("id", "fp", "rank", "kind", "i").agg(F.first("gap").alias("gap"), F.first("size").alias("size"), F.first("value").alias("value"))  # repeated rows are equal
        along = Window.partitionBy("id", "fp", "kind").orderBy("i")
        placed = one.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along)).withColumn("start", F.col("end") - F.col("size")).where(F.col("value").isNotNull())
        is_base = F.col("kind").isin(*BASE)
        one_ = F.lit(1).cast("long")
        owned = _owned(placed, own).withColumns({"owners": F.coalesce("owners", one_), "repos": F.coalesce("repos", one_)})
        seen = owned.withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).where(is_base | F.col("live"))
        cover = Window.partitionBy("id", "fp").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
        seen = seen.withColumn("covered", F.max(F.when(is_base, F.col("end"))).over(cover))
        out = seen.where(is_base | F.col("covered").isNull() | (F.col("covered") < F.col("end"))).select("id", "fp", "rank", "kind", "start", "end", "owners", "repos", "live")
        kept.append(out := stored(out, "secret-spans"))
    return out


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """id and ``found``, the array of spans (start, rank, kind, end, owners, repos, live) in order, of every row of df."""
    got = spans(df, max_owners, max_repos, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_col=repo_col)
    by_text = got.groupBy("id", "fp").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end", "owners", "repos", "live"))).alias("found"))
    docs = df.select(F.col(id_col).alias("own_id"), F.xxhash64(text_of(text_col)).alias("own_fp"))
    on = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_fp") == F.col("fp"))
    return docs.join(by_text, on, "left").select(F.col("own_id").alias(id_col), F.coalesce("found", F.array().cast(by_text.schema["found"].dataType)).alias("found"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, sha256 of the base spans, all spans as text, how many of them look live, and each span's
    verdict as text: kind:start:end:owners:repos:live or copied."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    live = F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live")
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), s["owners"].cast("string"), s["repos"].cast("string"), F.when(s["live"], "live").otherwise("copied"))
    verdicts = F.array_join(F.transform("found", said), ",").alias("verdicts")
    return scanned.select(id_col, *(count(k) for k in BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), live, verdicts)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mark: str = "<SECRET>", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, corpus: DataFrame | None = None) -> DataFrame:
    """df with every live span of its texts replaced by mark, copied examples and other rows and columns as they are.
    corpus: the documents over which ownership is counted, if not df.

    Texts without a candidate never move; the others meet their spans by id and hash of the text.
    """
    odd = F.coalesce(F.col(text_col).rlike(ANY), F.lit(False))
    got = spans(df, max_owners, max_repos, corpus, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_col=repo_col).where("live")
    # Spans that overlap become one: a span begins a new island where it starts beyond all ends before it.
    before = Window.partitionBy("id", "fp").orderBy("start", "end", "rank").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("id", "fp").orderBy("start", "end", "rank").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")
    islands = got.withColumn("opens", opens).withColumn("island", F.sum("opens").over(along)).groupBy("id", "fp", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = islands.groupBy("id", "fp").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts")).select(F.col("id").alias("_secret_id"), F.col("fp").alias("_secret_fp"), F.col("cuts").alias("_secret_cuts"))
    text, cut = F.col(text_col), F.col("_secret_cuts")
    kept = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda c: c["end"])), F.concat(F.transform(cut, lambda c: c["start"]), F.array(F.length(text).cast("long"))), lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int")))
    on = F.col(id_col).eqNullSafe(F.col("_secret_id")) & (F.xxhash64(text_of(text_col)) == F.col("_secret_fp"))
    met = df.where(odd).join(cuts, on, "left")
    changed = met.withColumn(text_col, F.when(cut.isNull(), text).otherwise(F.array_join(kept, mark))).select(*df.columns)
    return df.where(~odd).unionByName(changed)
