"""Merkle fixity audit of WARC archives (DataFrame functions only).

Pages become WARC resource records. A record goes to the archive file
page_id div PER_FILE; rows without page_id go to files of negative number by a hash of url
and content. Every replica numbers and measures what it holds itself: within a file, in
order of page_id, the records' lengths add up to offsets.

Each record is hashed. The records of FAN neighbouring page_ids are an ordered offset
range: its node hashes their digests, lengths and offsets, counted from the range's
start, so that a loss before it changes nothing in it. The ranges of a file are hashed
into one node, FAN neighbouring files likewise, up to one root. Only digests move; texts
never do.

audit() compares two such trees from their roots downwards. A level reads only the
children of nodes that differ, so an intact replica costs one comparison. In ranges that
differ records meet by page_id and url: equal digests are intact, what is left on both
sides is changed, on one side missing or added.

Defined cases: null url or html count as empty; rows that repeat a page_id are one slot,
compared as a multiset, and repeats of one content are hashed FAN at a time; a row without
page_id whose content changes is one missing and one added; an empty table has no nodes,
and two of them agree; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadro.llm.common import stage, text_of

PER_FILE, FAN, SPARE_FILES = 512, 64, 4096


def record(url: Column, html: Column) -> Column:
    """The text of a WARC resource record."""
    body = text_of(html)
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), text_of(url), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, stored: Callable[[Column], Column] = lambda r: r) -> DataFrame:
    """file_no, seq, page_id, url, nth (of equal ones), start, length, digest of every record held.

    stored: what a replica holds of a record (null: nothing), over the columns of pages.
    """
    d = pages.select("page_id", "url", stored(record(F.col("url"), F.col("html"))).alias("record")).where("record is not null")
    d = d.select("page_id", text_of("url").alias("url"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    spare = -1 - F.pmod(F.xxhash64("url", "digest"), F.lit(SPARE_FILES))
    d = d.withColumn("file_no", F.coalesce(F.floor(F.col("page_id") / PER_FILE), spare))
    order = Window.partitionBy("file_no").orderBy("page_id", "url", "digest")
    equal = Window.partitionBy("file_no", "page_id", "url", "digest").orderBy("length")
    upto = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumns({"seq": F.row_number().over(order).cast("long") - 1, "nth": F.row_number().over(equal).cast("long") - 1, "start": upto - F.col("length")})
    return d.select("file_no", "seq", "page_id", "url", "nth", "start", "length", "digest")


def _range(file_no: str = "file_no") -> Column:
    """The lowest node over a record: its file, the FAN page_ids and the FAN equal ones that it is among."""
    slot = F.coalesce(F.pmod("page_id", F.lit(PER_FILE)), F.pmod(F.xxhash64("url", "digest"), F.lit(PER_FILE)))
    return F.struct(F.col(file_no).alias("file_no"), F.floor(slot / FAN).alias("part"), F.floor(F.col("nth") / FAN).alias("block"))


def shape(*replicas: DataFrame) -> tuple[int, int, int]:
    """The largest nth and the lowest and highest file: what a tree's height depends on."""
    found = [r.agg(F.max("nth"), F.min("file_no"), F.max("file_no")).first() for r in replicas]
    nth, low, high = zip(*([x or 0 for x in f] for f in found), strict=True)
    return max(nth), min(low), max(high)


def tree(records: DataFrame, of: tuple[int, int, int] | None = None) -> list[DataFrame]:
    """Levels from offset ranges to the root: node, parent, digest. of: shape() of all replicas to compare."""
    none, (most, low, high) = F.lit(0).cast("long"), of or shape(records)
    hashed = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"]), ","), 256)
    # Offsets within a range: from its first record's.
    relative = F.transform("held", lambda x: F.concat_ws(":", x["start"] - F.get("held", F.lit(0))["start"], x["length"], x["digest"]))
    level = records.groupBy(_range().alias("node")).agg(F.array_sort(F.collect_list(F.struct("start", "length", "digest"))).alias("held"))
    level = level.select("node", F.sha2(F.array_join(relative, ","), 256).alias("digest"))
    levels: list[DataFrame] = []

    def up(level: DataFrame, parent: Column) -> DataFrame:
        levels.append(stage(level.withColumn("parent", parent), "nodes"))
        return levels[-1].groupBy(F.col("parent").alias("node")).agg(hashed.alias("digest"))

    while most >= FAN:  # equal records: FAN blocks at a time
        most //= FAN
        level = up(level, F.struct("node.file_no", "node.part", F.floor(F.col("node.block") / FAN).alias("block")))
    level = up(level, F.struct("node.file_no", none.alias("part"), none.alias("block")))
    while (low, high) not in ((0, 0), (-1, -1), (-1, 0)):  # files: FAN at a time, to the root
        low, high = low // FAN, high // FAN
        level = up(level, F.struct(F.floor(F.col("node.file_no") / FAN).alias("file_no"), none.alias("part"), none.alias("block")))
    up(level, F.col("node"))
    return levels


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """file_no, page_id, url, digest, nth, status (changed, missing, added) of the records that
    differ; digest and nth are those of records (of replica, if added)."""
    of = shape(records, replica)
    suspects: DataFrame | None = None
    for a, b in zip(reversed(tree(records, of)), reversed(tree(replica, of)), strict=True):
        if suspects is not None:
            a, b = (x.join(suspects, x["parent"] == suspects["bad"], "left_semi") for x in (a, b))
        b = b.select(F.col("node").alias("other"), F.col("digest").alias("held"))
        both = a.join(b, F.col("node") == F.col("other"), "full").where(~F.col("digest").eqNullSafe(F.col("held")))
        suspects = stage(both.select(F.coalesce("node", "other").alias("bad")), "suspects")
    near = lambda d: d.select("file_no", "page_id", "url", "digest", "nth").join(suspects, _range() == F.col("bad"), "left_semi")
    one, two = near(records), near(replica).withColumnsRenamed({c: f"r_{c}" for c in ("file_no", "page_id", "url", "digest", "nth")})
    same = lambda d, e: (d["page_id"].eqNullSafe(e["r_page_id"])) & (d["url"] == e["r_url"])
    equal = same(one, two) & (one["digest"] == two["r_digest"]) & (one["nth"] == two["r_nth"])
    place = lambda p: F.row_number().over(Window.partitionBy(f"{p}file_no", f"{p}page_id", f"{p}url").orderBy(f"{p}digest", f"{p}nth"))
    lost, found = one.join(two, equal, "left_anti").withColumn("place", place("")), two.join(one, equal, "left_anti").withColumn("r_place", place("r_"))
    d = lost.join(found, same(lost, found) & (lost["place"] == found["r_place"]) & lost["page_id"].isNotNull(), "full")
    status = F.when(F.col("r_digest").isNull(), "missing").when(F.col("digest").isNull(), "added").otherwise("changed")
    return d.select(*[F.coalesce(F.col(c), F.col(f"r_{c}")).alias(c) if c != "page_id" else F.when(F.col("digest").isNotNull(), F.col(c)).otherwise(F.col(f"r_{c}")).alias(c) for c in ("file_no", "page_id", "url", "digest", "nth")], status.alias("status"))
