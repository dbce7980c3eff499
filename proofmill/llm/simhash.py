"""Document fingerprints: SimHash over weighted word pairs, and search within a Hamming radius by block tables.

Everything is DataFrame expressions. A term is a word with the word before it; its weight is the word's length
(1 to 16). Each of 128 bits is set where the weights of the terms whose hash has the bit outweigh the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import Scratch, clean_names, partitions, table, words

BITS = 128
#: Turns in which documents meet their next ones.
TURNS = 4
#: Both halves of a long count: bit i in the low half, bit i + 32 in the high half.
_PAIR = 0x100000001


def terms(text: Column) -> Column:
    """array<struct<h long, w int>>: a hash for each word and the word before it, weighted by the word's length."""
    ws = words(text)
    hashed = F.transform(ws, lambda w: F.struct(F.xxhash64(w).alias("h"), F.least(F.length(w), F.lit(16)).alias("w")))
    return F.zip_with(hashed, F.concat(F.array(F.lit(0).cast("long")), hashed["h"]), lambda a, b: F.when(a.isNotNull(), F.struct(F.xxhash64(b, a["h"]).alias("h"), a["w"].alias("w"))))


def _bits(sums: list[Column], total: Column) -> Column:
    """A long from 32 pairs of vote sums."""
    out = F.lit(0).cast("long")
    for i, s in enumerate(sums):
        low, high = s.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(s, 32)
        out = out.bitwiseOR(F.when(low * 2 > total, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        out = out.bitwiseOR(F.when(high * 2 > total, F.lit((1 << (i + 32)) - (1 << 64) * (i == 31))).otherwise(F.lit(0)).cast("long"))
    return out


def fingerprints(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, f0 and f1 (the 128 bits as longs), for each row; keys must tell the rows apart. Texts without words, and null texts, get 0."""
    exploded = df.select(*keys, F.explode_outer(F.filter(terms(F.col(text)), lambda t: t.isNotNull())).alias("t"))
    h = exploded.select(*keys, F.col("t.h").alias("h"), F.xxhash64("t.h", F.lit(1)).alias("g"), F.col("t.w").cast("long").alias("w"))
    votes = [F.sum(F.shiftrightunsigned(c, i).bitwiseAND(F.lit(_PAIR)) * F.col("w")).alias(f"{c}{i}") for c in "hg" for i in range(32)]
    sums = h.groupBy(*keys).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("total"), *votes)
    return sums.select(*keys, *[_bits([F.coalesce(F.col(f"{c}{i}"), F.lit(0)) for i in range(32)], F.col("total")).alias(n) for c, n in (("h", "f0"), ("g", "f1"))])


def as_text(f0: Column, f1: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.lit(1.0) - distance(a0, a1, b0, b1) / F.lit(float(BITS))


def within(queries: DataFrame, fps: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs (q0, q1, f0, f1, distance) of a distinct query fingerprint and a distinct fingerprint within the radius.

    The 128 bits are cut into radius + 1 blocks; fingerprints within the radius agree in one of them at least.
    Each table holds one block as its key, so a block that is too common for one task is split like any skewed join.
    Equal fingerprints are one row on either side: copies never multiply.
    """
    blocks = radius + 1
    if not 1 <= blocks <= 16:
        raise ValueError("radius must be from 0 to 15")
    cuts = [BITS * k // blocks for k in range(blocks + 1)]

    def part(k: int) -> Column:
        """Bits cuts[k] to cuts[k + 1] of the fingerprint, hashed to a key."""
        def mask(low: int, high: int) -> int:
            m = sum(1 << i for i in range(max(low, 0), min(high, 64)))
            return m - (1 << 64) if m >> 63 else m
        return F.xxhash64(F.lit(k), F.col("f0").bitwiseAND(F.lit(mask(cuts[k], cuts[k + 1])).cast("long")), F.col("f1").bitwiseAND(F.lit(mask(cuts[k] - 64, cuts[k + 1] - 64)).cast("long")))

    def tables(df: DataFrame) -> DataFrame:
        return df.select("f0", "f1").distinct().select("f0", "f1", F.explode(F.array(*[part(k) for k in range(blocks)])).alias("block"))

    q = tables(queries).withColumnsRenamed({"f0": "q0", "f1": "q1"})
    far = distance(F.col("q0"), F.col("q1"), F.col("f0"), F.col("f1"))
    return q.join(tables(fps), "block").where(far <= radius).select("q0", "q1", "f0", "f1", far.alias("distance")).distinct()


def next_ids(spark, ids: DataFrame, scratch: Scratch, key: str = "doc_id") -> DataFrame:
    """key and next_id, the next larger key (after the largest: the smallest), for distinct keys.

    Keys are dealt out by ranges; each range looks ahead within itself, its last key at the first key of the next range.
    Only one row per range meets in one task.
    """
    ranged = scratch.stage(ids.repartitionByRange(partitions(spark), key).withColumn("part", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("part").agg(F.min(key).alias("first"))
    after = firsts.select("part", F.lead("first").over(W.orderBy("part")).alias("after"), F.min("first").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("least"))
    look = F.lead(key).over(W.partitionBy("part").orderBy(key))
    return ranged.withColumn("ahead", look).join(F.broadcast(after), "part").select(*ids.columns, F.coalesce("ahead", "after", "least").alias("next_id"))


def fingerprint_documents(docs: DataFrame, radius: int = 3) -> DataFrame:
    """A row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within.

    A document's edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the
    next document by ascending doc_id (after the last: the first). n_within counts, for documents whose id is divisible
    by 50, the documents within the radius, the document itself included; it is null for others.
    Null text: empty. Null doc_id: no next document, so that the edited text only loses its end, and near_next is null. Empty table: no rows. Other columns are not read.
    Rows that repeat a doc_id are fingerprinted each; as a next document, the least of their texts counts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = clean_names(docs, ["doc_id", "text"]).withColumn("text", F.coalesce("text", F.lit("")))
    known = base.where(F.col("doc_id").isNotNull())
    ids = known.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 4)).alias("need"))
    ahead = scratch.stage(next_ids(spark, ids, scratch), "ahead")
    before = ahead.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), "need")

    def dealt(df: DataFrame, k: int) -> DataFrame:
        return df.where(F.pmod(F.xxhash64("doc_id"), F.lit(TURNS)) == k)

    # texts are joined in turns, so that the shuffle files of one turn only lie beside what is staged; by merging at any size, as heads grow with the corpus
    heads = []
    for k in range(TURNS):
        found = dealt(known, k).hint("merge").join(dealt(before, k), "doc_id").select(F.col("before").alias("doc_id"), F.expr("substring(text, 1, cast(need as int))").alias("head"))
        heads.append(scratch.stage(found, f"heads{k}"))
    heads = reduce(DataFrame.union, heads)
    rows = []
    for k in range(TURNS):
        both = dealt(known, k).hint("merge").join(dealt(heads, k).groupBy("doc_id").agg(F.min("head").alias("head")), "doc_id", "left")
        if not k:
            both = both.unionByName(base.where(F.col("doc_id").isNull()).withColumn("head", F.lit(None).cast("string")))
        # rows are numbered once and written: a task that ran again could number them otherwise, and the votes of two documents would be mixed
        rows.append(scratch.stage(both.select((F.monotonically_increasing_id() * TURNS + k).alias("row"), "doc_id", "text", "head"), f"rows{k}"))
    scratch.drop(*[f"heads{k}" for k in range(TURNS)])
    both = reduce(DataFrame.union, rows)
    n = F.length("text")
    both = both.select("row", "doc_id", n.cast("long").alias("n_chars"), "text", F.expr("concat(substring(text, 1, cast(length(text) - length(text) div 4 as int)), coalesce(substring(head, 1, cast(length(text) div 4 as int)), ''))").alias("edited"))
    kinds = both.select("row", "doc_id", "n_chars", F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("text"), F.lit(None).cast("string").alias("sha")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"), F.sha2("edited", 256).alias("sha")))))
    fps = fingerprints(kinds, ["row", "doc_id", "n_chars", "kind", "sha"])
    pick = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c)))
    fps = fps.groupBy("row", "doc_id", "n_chars").agg(pick("sha", 1).alias("edited_sha256"), pick("f0", 0).alias("f0"), pick("f1", 0).alias("f1"), pick("f0", 1).alias("e0"), pick("f1", 1).alias("e1"))
    fps = scratch.stage(fps.drop("row"), "fingerprints")
    scratch.drop("ranges", *[f"rows{k}" for k in range(TURNS)])
    nexts = fps.groupBy(F.col("doc_id").alias("next_id")).agg(F.min_by(F.struct("f0", "f1"), F.struct("f0", "f1")).alias("n"))
    nexts = ahead.select("doc_id", "next_id").join(nexts, "next_id").select("doc_id", F.col("n.f0").alias("n0"), F.col("n.f1").alias("n1"))
    queries = fps.where(F.col("doc_id") % 50 == 0)
    counts = fps.groupBy("f0", "f1").agg(F.count("*").alias("n"))
    found = within(queries, fps, radius).join(counts, ["f0", "f1"]).groupBy("q0", "q1").agg(F.sum("n").alias("n_within"))
    found = queries.join(found.withColumnsRenamed({"q0": "f0", "q1": "f1"}), ["f0", "f1"]).groupBy("doc_id").agg(F.max("n_within").alias("n_within"))
    c = F.col
    return fps.join(nexts, "doc_id", "left").join(found, "doc_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", as_text(c("f0"), c("f1")).alias("fingerprint"), as_text(c("e0"), c("e1")).alias("edited_fingerprint"),
        likeness(c("f0"), c("f1"), c("e0"), c("e1")).alias("near_edited"), likeness(c("f0"), c("f1"), c("n0"), c("n1")).alias("near_next"), "n_within",
    )


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
