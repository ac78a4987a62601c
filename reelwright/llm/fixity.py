"""Fixity audit of WARC archives by Merkle trees.

A record is hashed; a manifest row holds its offset, length and hash. The archive is cut into ranges
of ``RANGE_BYTES`` of offsets. A leaf of the tree is the hash of the rows of one range in order of
offset; above, a node is the hash of its ``FANOUT`` children in order, up to one root. Every record
has a header, so a range holds a bounded number of records, and no node a larger group than that.

Two replicas are compared root first. Only if the roots differ, the children of nodes that differ
are compared, level by level, and only the records of leaves that differ are compared one by one.
Records are told apart by offset, as an archive's index addresses them; a replica keeps its offsets
when it loses a record or part of one.

Offsets of a new archive come from running totals over the order of id and hash, dealt into ranges;
no task sees all records.

Defined results: null url and null html are written as empty; a null id is ordered first and
written as an empty record id. Equal rows are records of their own, one after the other. Two records
of one manifest at the same offset are both compared, and a row that one manifest holds more often than the other is damage
as often as it is in excess. Empty manifests have no root, which differs
from any root. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.llm.ordering import with_starts
from reelwright.session import written

RANGE_BYTES = 1 << 16
FANOUT_BITS = 4
DATE = "2024-01-01T00:00:00Z"


def warc_record(page_id: Column, url: Column, html: Column, stored: Column | None = None) -> Column:
    """A WARC resource record; ``stored`` stands for what a damaged copy holds after the header."""
    body = F.coalesce(html, F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(header, F.concat(body, F.lit("\r\n\r\n")) if stored is None else stored)


def sealed(record: Column, name: str = "") -> list[Column]:
    """Length and hash of a record, as columns with the given prefix."""
    raw = record.cast("binary")
    return [F.octet_length(raw).cast("long").alias(f"{name}length"), F.sha2(raw, 256).alias(f"{name}digest")]


def laid_out(records: DataFrame, id_col: str) -> DataFrame:
    """Narrow rows (id, length, digest, ...) with the ``offset`` of each in one archive."""
    return with_starts(records, [id_col, "digest"], "length").withColumnRenamed("start", "offset")


def leaves(manifest: DataFrame) -> DataFrame:
    """(node, hash): one leaf per range of offsets."""
    ranged = manifest.select(F.floor(F.col("offset") / RANGE_BYTES).alias("node"), "offset", "length", "digest")
    rows = F.sort_array(F.collect_list(F.struct("offset", "length", "digest")))
    line = F.transform(rows, lambda r: F.concat_ws(" ", r["offset"], r["length"], r["digest"]))
    return ranged.groupBy("node").agg(F.sha2(F.array_join(line, "\n"), 256).alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    """(node, hash) one level up."""
    rows = F.sort_array(F.collect_list(F.struct("node", "hash")))
    line = F.transform(rows, lambda r: F.concat_ws(" ", r["node"], r["hash"]))
    return nodes.groupBy(F.shiftright("node", FANOUT_BITS).alias("node")).agg(
        F.sha2(F.array_join(line, "\n"), 256).alias("hash"))


def tree(manifest: DataFrame, last_offset: int) -> list[DataFrame]:
    """Levels from the leaves to the root of an archive whose records begin at ``last_offset`` at most."""
    levels = [written(leaves(manifest), "leaves")]
    top = last_offset // RANGE_BYTES
    while top > 0:
        levels.append(written(parents(levels[-1]), "nodes"))
        top >>= FANOUT_BITS
    return levels


def root(levels: list[DataFrame]) -> str | None:
    row = levels[-1].select("hash").first()
    return row["hash"] if row else None


def differing(left: list[DataFrame], right: list[DataFrame]) -> DataFrame | None:
    """(node) of the leaves that differ, found from the roots down; None if the roots agree."""
    if root(left) == root(right):
        return None
    wrong = None
    for a, b in zip(reversed(left), reversed(right)):
        if wrong is not None:
            a, b = (side.join(wrong, F.shiftright("node", FANOUT_BITS) == F.col("parent"), "left_semi") for side in (a, b))
        met = a.withColumnRenamed("hash", "one").join(b.withColumnRenamed("hash", "other"), "node", "full")
        wrong = met.where(~F.col("one").eqNullSafe(F.col("other"))).select(F.col("node").alias("parent"))
    return wrong.withColumnRenamed("parent", "node")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(offset, kind, length, digest, found_length, found_digest): records in which a replica differs.

    ``kind`` is changed, missing (from the replica) or extra. Inputs have offset, length and digest. Where several records
    differ at one offset, they are paired in order of length and digest; those over are missing or extra.
    """
    names = ["offset", "length", "digest"]
    one, other = (written(side.select(*names), "manifest") for side in (primary, replica))
    last = one.select("offset").union(other.select("offset")).agg(F.max("offset")).first()[0] or 0
    wrong = differing(tree(one, last), tree(other, last))
    if wrong is None:
        wrong = one.select(F.col("offset").alias("node")).where(F.lit(False))
    wrong = written(wrong, "wrong-leaves")

    def inside(side: DataFrame) -> DataFrame:
        return side.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES)).join(wrong, "node", "left_semi").drop("node")

    held = inside(one).withColumn("n", F.lit(1)).union(inside(other).withColumn("n", F.lit(-1)))
    excess = held.groupBy(*names).agg(F.sum("n").alias("n")).where("n <> 0")
    each = excess.select(*names, (F.col("n") > 0).alias("ours"), F.explode(F.sequence(F.lit(1), F.abs("n")))).drop("col")
    paired = each.withColumn("place", F.row_number().over(Window.partitionBy("offset", "ours").orderBy("length", "digest")))
    a_only = paired.where("ours").drop("ours")
    b_only = paired.where("not ours").select(
        "offset", "place", F.col("length").alias("found_length"), F.col("digest").alias("found_digest"))
    kind = F.when(F.col("found_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return a_only.join(b_only, ["offset", "place"], "full").select(
        "offset", kind.alias("kind"), "length", "digest", "found_length", "found_digest")


def trial_copies(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An archive of the pages and a copy of it, both damaged by a rule on the page ids, as manifests; the page of each offset.

    Of 200 classes of ids (by the MD5 of the id as text), the copy holds class 7 with a changed first
    character, holds class 77 cut in half, and has lost class 123; the archive has lost class 187.
    """
    page, body = F.col("page_id"), F.coalesce("html", F.lit(""))
    group = F.coalesce(F.conv(F.substring(F.md5(page.cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % 200, F.lit(-1))
    changed = F.concat(F.lit("~"), F.expr("substring(coalesce(html, ''), 2)"), F.lit("\r\n\r\n"))
    cut = F.expr("substring(coalesce(html, ''), 1, cast(floor(length(coalesce(html, '')) / 2) as int))")
    sound = warc_record(page, F.col("url"), F.col("html"))
    # Only damaged records are hashed a second time.
    damaged = F.when(group == 7, warc_record(page, F.col("url"), body, changed)).when(
        group == 77, warc_record(page, F.col("url"), body, cut))
    rows = pages.select("page_id", group.alias("group"), *sealed(sound), *sealed(damaged, "found_"))
    placed = written(laid_out(rows, "page_id"), "archive")
    archive = placed.where("group <> 187").select("offset", "length", "digest")
    copy = placed.where("group <> 123").select(
        "offset", F.coalesce("found_length", "length").alias("length"), F.coalesce("found_digest", "digest").alias("digest"))
    return archive, copy, placed.select("offset", "page_id")


def audited_pages(pages: DataFrame) -> DataFrame:
    """The audit of ``trial_copies``, with the page of each damaged record."""
    archive, copy, places = trial_copies(pages)
    # Written, so that its size is known: a short list of damage is sent to the places, not the places shuffled.
    found = written(audit(archive, copy), "damage")
    return found.join(places, "offset").select(
        "page_id", "offset", "kind", "length", "digest", "found_length", "found_digest")


#: DuckDB: the damage that ``trial_copies`` does, from the rule.
FIXITY_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
         || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS head,
         chr(13) || chr(10) || chr(13) || chr(10) AS tail
  FROM pages),
r AS (SELECT *, head || body || tail AS record, sha256(head || body || tail) AS digest FROM p),
o AS (
  SELECT *, strlen(record) AS length, coalesce(sum(strlen(record)) OVER (ORDER BY page_id NULLS FIRST, digest
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r),
g AS (SELECT *, coalesce(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 6) AS INTEGER) % 200, -1) AS grp FROM o)
SELECT page_id, CAST(off AS BIGINT) AS "offset",
       CASE grp WHEN 123 THEN 'missing' WHEN 187 THEN 'extra' ELSE 'changed' END AS kind,
       CASE WHEN grp <> 187 THEN length END AS length, CASE WHEN grp <> 187 THEN digest END AS digest,
       CASE WHEN grp = 123 THEN NULL ELSE coalesce(strlen(bad), length) END AS found_length,
       CASE WHEN grp = 123 THEN NULL ELSE coalesce(sha256(bad), digest) END AS found_digest
FROM (SELECT *, CASE grp WHEN 7 THEN head || '~' || substr(body, 2) || tail
                         WHEN 77 THEN head || substr(body, 1, length(body) // 2) END AS bad FROM g)
WHERE grp IN (7, 77, 123, 187) AND (bad IS NULL OR bad <> record)
"""
