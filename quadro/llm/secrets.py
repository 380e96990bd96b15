"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Patterns give candidates. Each candidate's value is hashed, and the hashes are counted
over the corpus by distinct repositories and owners. A value that many owners hold is
a widely copied example; one that few hold, and that looks live, belongs to its owner.

Base kinds (assign, access, hex) always stay, with their counts beside them. The scan
adds spans of kind `owned`: tokens of 20 or more characters with digits and letters of
both cases, outside every base span, whose value at most MAX_OWNERS owners hold.

Offsets come from the texts between matches: a match starts after all gaps and matches
before it. They count code points.

Defined cases: a null text is empty and has no spans; a null owner or repository counts
as one of its own; a text of any length is scanned whole; rows that repeat are scanned
each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadro.llm.common import stage, text_of

# The base kinds in their order, then the added one.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: kind: pattern, group that holds the value, its least length, what else it must hold.
KINDS = {
    "assign": (ASSIGN, 2, 6, ()),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, ()),
    "hex": (r"[0-9a-f]{24,}", 0, 24, ()),
    "owned": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20, ("[0-9]", "[a-z]", "[A-Z]")),
}
BASE = ("assign", "access", "hex")
MAX_OWNERS = 2


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, gap before, length, value hash or null if it fails), with a last
    element for the text after the last match."""
    pattern, group, least, holds = KINDS[kind]
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def one(z: Column) -> Column:
        good = F.length(z["value"]) >= least
        for x in holds:
            good = good & z["value"].rlike(x)
        return F.struct(
            F.lit(list(KINDS).index(kind)).alias("kind"), F.length(z["gap"]).alias("gap"), F.length(z["all"]).alias("len"),
            F.when(good, F.sha2(z["value"], 256)).alias("value"))

    return F.when(text.rlike(pattern), F.filter(F.transform(zipped, one), lambda x: x["len"].isNotNull())).otherwise(F.array())


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows: _row and doc_id of each row of docs; spans: _row, owner, repository, kind, start, end, value)."""
    d = docs.select("doc_id", F.col(owner).alias("owner"), F.col(repository).alias("repository"), text_of("text").alias("text"))
    found = [_matches(F.col("text"), k).alias(k) for k in KINDS]
    scanned = stage(d.select("doc_id", "owner", "repository", *found).withColumn("_row", F.monotonically_increasing_id()), "scanned")
    flat = scanned.where(" or ".join(f"size({k}) > 0" for k in KINDS)).select("_row", "owner", "repository", F.posexplode(F.concat(*KINDS)).alias("i", "m"))
    flat = flat.select("_row", "owner", "repository", "i", "m.*")
    order = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("len")).over(order)
    spans = flat.select("_row", "owner", "repository", "kind", (end - F.col("len")).alias("start"), end.alias("end"), "value").where("value is not null")
    return scanned.select("_row", "doc_id"), spans


def ownership(spans: DataFrame) -> DataFrame:
    """value, n_owners, n_repositories over the corpus."""
    return (
        spans.select("value", "owner", "repository").distinct()
        .groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))
    )


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """doc_id, spans (array of kind, start, end, base, n_owners, n_repositories, copied;
    by start, then kind): one row for each row of docs."""
    rows, spans = candidates(docs, owner, repository)
    spans = stage(spans, "spans")
    known = spans.join(ownership(spans), "value").withColumn("copied", F.col("n_owners") > max_owners)
    base = len(BASE)
    # An added span overlaps a base one if one that begins no later ends after its start, or the next one begins before its end.
    near = Window.partitionBy("_row").orderBy("start")
    of_base = lambda c: F.when(F.col("kind") < base, F.col(c))
    known = known.where((F.col("kind") < base) | ~F.col("copied")).withColumns({
        "ended": F.max(of_base("end")).over(near.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "next": F.min(of_base("start")).over(near.rangeBetween(1, Window.unboundedFollowing))})
    overlaps = F.coalesce(F.col("ended") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    listed = known.where((F.col("kind") < base) | ~overlaps).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repositories", "copied"))).alias("all"))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform("all", lambda s: F.struct(
        names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["kind"] < base).alias("base"),
        s["n_owners"].alias("n_owners"), s["n_repositories"].alias("n_repositories"), s["copied"].alias("copied")))
    out = rows.join(listed.select("_row", named.alias("spans")), "_row", "left")
    return out.select("doc_id", F.coalesce("spans", F.array()).alias("spans"))
