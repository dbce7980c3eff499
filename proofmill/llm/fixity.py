"""WARC archives of pages, and a Merkle audit that finds where two replicas of an archive differ.

1. Pages are laid out in archives of a fixed number of records, each with its offset and length in bytes.
2. Each record has a leaf hash. Leaves are hashed by ranges of offsets, ranges by larger ranges up to the archive, and archives by groups up
   to one root. Each replica has a tree of its own, made from its own manifest alone; only the shape of both must be agreed on.
3. The roots are compared; below a pair of nodes that differ, and only there, the children are compared, down to records. Equal roots end the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import Scratch, clean_names, partitions, table

PER_ARCHIVE = 256
#: Bytes of the smallest range of offsets, and children of a node above it.
RANGE, FAN = 1 << 16, 16
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
READ = "archive string, offset long, length long, warc_type string, record_id string, target_uri string, body binary, whole boolean, digest string"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as a WARC record, without the two line ends that close it."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("urn:none")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    )


def layout(pages: DataFrame, scratch: Scratch, name: str, per_archive: int = PER_ARCHIVE, with_record: bool = False) -> DataFrame:
    """A row for each page: archive, offset, length, page_id, digest (SHA-256 of the record) and, if asked for, record.

    Records stand in order of page_id (none first), url and digest; each archive holds `per_archive` of them. Null url or html: an
    empty one. Repeated rows are records of their own. Ranges of the order are dealt out evenly, whatever ids repeat, and only
    their sizes meet in one task.
    """
    spark, c = pages.sparkSession, F.col
    base = clean_names(pages, ["page_id", "url", "html"]).select(c("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), record(c("page_id"), c("url"), c("html")).alias("record"))
    base = base.select("page_id", "url", F.sha2("record", 256).alias("digest"), (F.octet_length("record") + len(END)).cast("long").alias("length"), *(["record"] if with_record else []))
    order = ["page_id", "url", "digest", "tie"]
    ranged = base.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order)
    ranged = scratch.stage(ranged.withColumn("part", F.spark_partition_id()), f"{name}_ranged")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    ranked = ranged.withColumn("rank", rank).join(F.broadcast(sizes), "part").withColumn("rank", (c("rank") + c("before")).cast("long"))
    ranked = ranked.withColumn("archive", F.floor(c("rank") / per_archive).cast("long"))
    offset = F.coalesce(F.sum("length").over(W.partitionBy("archive").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return ranked.select("archive", offset.alias("offset"), "length", "page_id", "digest", *(["record"] if with_record else []))


def write_archives(pages: DataFrame, path: str, per_archive: int = PER_ARCHIVE) -> None:
    """WARC files under path, one in each folder archive=N, records in order of their offsets."""
    scratch = Scratch(pages.sparkSession)
    rows = layout(pages, scratch, "write", per_archive, with_record=True)
    rows = rows.repartition("archive").sortWithinPartitions("archive", "offset").select("archive", F.col("record").alias("value"))
    rows.write.partitionBy("archive").option("lineSep", END).text(path)
    scratch.close()


def _headers(block: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def split_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, bool]]:
    """(offset, length, headers, body, whole) of each record; after damage, reading goes on at the next record that begins."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            after = data.find(b"\r\n\r\nWARC/", at)
            end = len(data) if after < 0 else after + 4
            yield at, end - at, {}, data[at:end], False
            at = end
            continue
        top = data.find(b"\r\n\r\n", at)
        fields = _headers(data[at : top if top >= 0 else len(data)])
        size = fields.get("content-length", "")
        end = top + 4 + int(size) if top >= 0 and size.isdecimal() else -1
        whole = 0 <= end <= len(data) - 4 and data[end : end + 4] == b"\r\n\r\n"
        if not whole:
            after = data.find(b"\r\n\r\nWARC/", at)
            end = len(data) - 4 if after < 0 else after
        end = min(end + 4, len(data)) if end >= at else len(data)
        yield at, end - at, fields, data[top + 4 : end - 4] if top >= 0 else b"", whole
        at = end


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the uncompressed WARC files under path: READ. The digest is that of the record without its closing line ends, as in layout(); of
    a damaged record, that of all its bytes. An archive is read whole, so it must fit in a task (2 GB at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, raw = [], data.as_py()
                for offset, length, fields, body, whole in split_records(raw):
                    rows.append((name, offset, length, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), body, whole, hashlib.sha256(raw[offset : offset + length - len(END)] if whole else raw[offset : offset + length]).hexdigest()))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "length", "warc_type", "record_id", "target_uri", "body", "whole", "digest"])


def manifest_of(archives: DataFrame) -> DataFrame:
    """archive, offset, length and digest of records read by read_archives(), as layout() has them. The archive's number is that of its folder archive=N, or a hash of its path."""
    number = F.regexp_extract("archive", "archive=([0-9]+)", 1)
    return archives.select(F.when(number != "", number.cast("long")).otherwise(F.xxhash64("archive")).alias("archive"), "offset", "length", "digest")


def levels(archives: int, size: int) -> list[tuple[int, int]]:
    """For each level above the records: archives and bytes of offsets in a node; 0 bytes: the whole archive."""
    out, span = [(1, RANGE)], RANGE
    while span < size:
        span *= FAN
        out.append((1, span))
    out[-1] = (1, 0) if size <= span else out[-1]
    group = 1
    while group < archives:
        group *= FAN
        out.append((group, 0))
    return out


def _at(level: tuple[int, int]) -> list[Column]:
    group, span = level
    range_ = F.floor(F.col("offset") / span) * span if span else F.lit(0)
    return [(F.floor(F.col("archive") / group) * group).cast("long").alias("archive"), range_.cast("long").alias("offset")]


def tree(manifest: DataFrame, shape: list[tuple[int, int]], scratch: Scratch, name: str) -> list[DataFrame]:
    """The nodes of one replica's tree by level, records first, each a table: archive and offset (the first below the node) and its hash.

    Rows that repeat a place are one leaf, whose hash comes from the least and the greatest of them and their number.
    """
    at = ["archive", "offset"]
    leaf = F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256)
    leaves = manifest.select(*at, leaf.alias("h")).groupBy(*at).agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n"))
    out = [scratch.stage(leaves.select(*at, F.when(F.col("n") == 1, F.col("a")).otherwise(F.sha2(F.concat_ws(":", "a", "b", "n"), 256)).alias("h")), f"{name}_0")]
    for k, level in enumerate(shape, 1):
        below = out[-1].select(*_at(level), F.struct("archive", "offset", "h").alias("child"))
        whole = F.array_join(F.transform(F.array_sort(F.collect_list("child")), lambda x: F.concat_ws(":", x["archive"], x["offset"], x["h"])), "\n")
        out.append(scratch.stage(below.groupBy(*at).agg(F.sha2(whole, 256).alias("h")), f"{name}_{k}", tidy=False))
    return out


def descend(left: list[DataFrame], right: list[DataFrame], shape: list[tuple[int, int]], scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """archive and offset of the records in which two trees of one shape differ, and how many pairs of nodes were compared at each level, from the roots on."""
    c, at = F.col, ["archive", "offset"]
    seen: list[int] = []
    bad = None
    for k in range(len(shape), -1, -1):
        sides = []
        for nodes, h in ((left[k], "lh"), (right[k], "rh")):
            here = nodes.select(*at, c("h").alias(h))
            if bad is not None:
                a, o = _at(shape[k])
                far = bad.agg(F.min("archive"), F.max("archive")).first()
                group = shape[k][0]
                here = here.where((c("archive") >= far[0]) & (c("archive") < far[1] + group)).withColumns({"na": a, "no": o})  # the bounds reach the scan
                here = here.join(bad.select(c("archive").alias("pa"), c("offset").alias("po")), (c("na") == c("pa")) & (c("no") == c("po")), "left_semi").select(*at, h)
            sides.append(here)
        both = scratch.stage(sides[0].join(sides[1], at, "full"), f"compared_{k}", tidy=False)
        seen.append(both.count())
        bad = both.where(~c("lh").eqNullSafe(c("rh"))).select(*at)
        if bad.isEmpty():
            break
    return bad, seen


def shape_of(*manifests: DataFrame) -> list[tuple[int, int]]:
    """The shape that trees of all these manifests can have."""
    far = [m.agg(F.max("archive").alias("a"), F.max("offset").alias("o")).first() for m in manifests]
    return levels(max([f["a"] or 0 for f in far]) + 1, max([f["o"] or 0 for f in far]) + 1)


def audit(left: DataFrame, right: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each record in which two manifests (archive long, offset, length, digest, and others in left) differ.

    archive, offset, length, digest, replica_length, replica_digest, moved_to and kind: `changed` (another record stands at that offset), `missing`
    (none does), `moved` (the record stands at the offset moved_to, in a place that also differs), `extra` (only the replica has a record there).
    Manifests that are equal, or both empty, give no rows. Null archives or offsets are ignored.
    """
    c, at = F.col, ["archive", "offset"]
    left, right = (m.where(c("archive").isNotNull() & c("offset").isNotNull()) for m in (left, right))
    shape = shape_of(left, right)
    bad, _ = descend(tree(left, shape, scratch, "left_tree"), tree(right, shape, scratch, "right_tree"), shape, scratch)
    wrong = bad.join(left, at, "left").join(right.select(*at, c("length").alias("replica_length"), c("digest").alias("replica_digest")), at, "left")
    wrong = scratch.stage(wrong, "wrong")
    there = wrong.where("replica_digest is not null").groupBy("archive", c("replica_digest").alias("digest")).agg(F.min("offset").alias("moved_to"))
    here = wrong.where("digest is not null").select("archive", c("digest").alias("replica_digest")).distinct()
    lost = wrong.where("digest is not null").join(there, ["archive", "digest"], "left")
    kind = F.when(c("moved_to").isNotNull(), "moved").when(c("replica_digest").isNotNull(), "changed").otherwise("missing")
    extra = wrong.where("digest is null").join(here, ["archive", "replica_digest"], "left_anti").withColumns({"moved_to": F.lit(None).cast("long"), "kind": F.lit("extra")})
    return lost.withColumn("kind", kind).unionByName(extra)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages in which a byte of one page in 23 is another one."""
    flipped = F.concat(F.lit("#"), F.expr("substring(html, 2)"))
    return pages.withColumn("html", F.when((F.col("page_id") % 23 == 5) & (F.length("html") > 0), flipped).otherwise(F.col("html")))


def without_tails(manifest: DataFrame, every: int = 4, records: int = 3) -> DataFrame:
    """A replica's manifest in which each fourth archive has lost its last records."""
    left = F.count("*").over(W.partitionBy("archive").orderBy(F.desc("offset")).rowsBetween(W.unboundedPreceding, W.currentRow))
    return manifest.withColumn("left", left).where((F.col("archive") % every != 0) | (F.col("left") > records)).drop("left")


def compare(pages: DataFrame, replica: Callable[[DataFrame], DataFrame] = damaged, lose: Callable[[DataFrame], DataFrame] = without_tails) -> DataFrame:
    """The audit of pages against a replica of them: audit()'s columns and page_id."""
    scratch = Scratch(pages.sparkSession)
    left = scratch.stage(layout(pages, scratch, "pages"), "left")
    right = scratch.stage(lose(layout(replica(pages), scratch, "replica")).drop("page_id"), "right")
    scratch.drop("pages_ranged", "replica_ranged")
    return audit(left, right, scratch)


def op8_fixity(spark, sf_dir: str) -> DataFrame:
    found = compare(table(spark, sf_dir, "pages"))
    return found.select("page_id", "archive", "offset", "length", "digest", "replica_digest", "kind")


OP8_SQL = f"""
WITH said AS (
  SELECT page_id, url, html, CASE WHEN page_id % 23 = 5 AND length(html) > 0 THEN '#' || substr(html, 2) ELSE html END AS other FROM pages),
made AS (
  SELECT page_id, url, other IS DISTINCT FROM html AS flipped,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
      || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) AS head, html, other FROM said),
hashed AS (SELECT page_id, url, flipped, sha256(head || html) AS digest, sha256(head || other) AS replica_digest, strlen(head || html) + 4 AS length FROM made),
ranked AS (SELECT *, (row_number() OVER (ORDER BY page_id, url, digest) - 1) // {PER_ARCHIVE} AS archive FROM hashed),
placed AS (
  SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id, url, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    count(*) OVER (PARTITION BY archive ORDER BY page_id DESC, url DESC, digest DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back FROM ranked)
SELECT page_id, CAST(archive AS BIGINT) AS archive, "offset", CAST(length AS BIGINT) AS length, digest,
  CASE WHEN archive % 4 = 0 AND back <= 3 THEN NULL ELSE replica_digest END AS replica_digest,
  CASE WHEN archive % 4 = 0 AND back <= 3 THEN 'missing' ELSE 'changed' END AS kind
FROM placed WHERE flipped OR (archive % 4 = 0 AND back <= 3)
"""
