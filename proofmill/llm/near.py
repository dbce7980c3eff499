"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning of candidates, exact verification of the rest.

Documents with equal shingle sets are one class. Classes that share a band are candidates. To avoid all pairs of a
band's group, its least and its greatest class are first compared with all others; where that leaves more than one
component in a group, blocks of the group are compared across its components within tasks, and only links leave them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import mix, runs, word_hashes
from .util import Scratch, clean_names, fresh, table, text_bytes, text_slices

HASHES, BATCH = 125, 25
#: Signatures of members that meet outside their components are compared on more hashes: many such pairs lie just below the threshold.
MORE_HASHES, MORE_BATCH = 512, 64
#: Classes, and bytes of text, in a block of a group.
BLOCK, BLOCK_BYTES = 512, 16 << 20


def bands(percent: int, miss: float = 1e-4) -> tuple[int, int]:
    """Rows of a band, and bands: as many rows as keep the chance that a pair at the threshold shares no band under `miss`."""
    t = percent / 100
    best = 1
    for r in range(1, HASHES + 1):
        if (1 - t**r) ** (HASHES // r) <= miss:
            best = r
    return best, HASHES // best


def least_matches(percent: int, miss: float = 1e-6, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """After each batch of hashes: the fewest matches at which a similarity at the threshold is still likelier than `miss`.

    From a uniform prior, the similarity after m matches of n is Beta(m + 1, n - m + 1); it is at least t with the
    chance that a binomial of n + 1 trials at t is at most m.
    """
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def likely(a: np.ndarray, b: np.ndarray, least: list[int], batch: int = BATCH) -> np.ndarray:
    """Which pairs of rows of two signature arrays pass all batches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, m in enumerate(least):
        part = slice(k * batch, (k + 1) * batch)
        matches = matches + (a[alive, part] == b[alive, part]).sum(1)
        ok = matches >= m
        alive, matches = alive[ok], matches[ok]
        if not len(alive):
            break
    return alive


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """For each text of the batch, the sorted distinct hashes of its k-word shingles."""
    raw, offsets = text_bytes(batch.column("text"))
    hashes, _, _, at = word_hashes(raw, offsets)
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(runs(hashes[low:high], k))


def _functions(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), draw.integers(0, 1 << 63, n, dtype=np.uint64)


_FIRST, _MORE = _functions(7, HASHES), _functions(19, MORE_HASHES)


def signature(s: np.ndarray, functions: tuple[np.ndarray, np.ndarray] = _FIRST) -> np.ndarray:
    a, b = functions
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(s), 4096):
        np.minimum(out, (a[:, None] * s[None, low : low + 4096] + b[:, None]).min(1), out=out)
    return out >> np.uint64(24)


def sketch(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, mark (of the text), n (shingles), f0 and f1 (of the set), sig (16 bits a hash) and bands; the last four null without shingles."""
    rows, count = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            n, f0, f1, sigs, keys = [], [], [], [], []
            for s in shingle_sets(batch, k):
                n.append(len(s))
                if not len(s):
                    for x in (f0, f1, sigs, keys):
                        x.append(None)
                    continue
                f0.append(int(mix(s).sum().view(np.int64)))
                f1.append(int(np.bitwise_xor.reduce(mix(s * np.uint64(0xA0761D6478BD642F))).view(np.int64)))
                sig = signature(s)
                sigs.append(sig.astype("<u2").tobytes())
                cells = sig[: rows * count].reshape(count, rows)
                key = np.arange(1, count + 1, dtype=np.uint64)
                for j in range(rows):
                    key = mix(key * np.uint64(0xD6E8FEB86659FD93) + cells[:, j])
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(f0, pa.int64()), pa.array(f1, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "mark", "n", "f0", "f1", "sig", "bands"])

    base = clean_names(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return base.mapInArrow(run, "doc_id long, mark long, n long, f0 long, f1 long, sig binary, bands array<long>")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), HASHES)


def prune(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids whose signatures and sizes leave the threshold likely."""
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            rows = np.flatnonzero(np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent)
            sa, sb = _signatures(batch.column("sa")), _signatures(batch.column("sb"))
            rows = rows[likely(sa[rows], sb[rows], least)]
            yield batch.select(["a", "b"]).take(pa.array(rows))

    left = classes.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    right = classes.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def texts_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id and text of the classes with these ids."""
    wanted = classes.join(ids.distinct(), "id").select("id", "mark")
    base = clean_names(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"), "text")
    return scratch.stage(base.join(wanted, ["id", "mark"]).groupBy("id").agg(F.any_value("text").alias("text")), f"{name}_texts")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets of hashes reach the threshold."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    texts = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), classes, docs, scratch, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in text_slices(text_slices(iter([big]), "ta"), "tb"):
                left = batch.select(["ta"]).rename_columns(["text"])
                right = batch.select(["tb"]).rename_columns(["text"])
                good = [row for row, (x, y) in enumerate(zip(shingle_sets(left, k), shingle_sets(right, k), strict=True)) if alike(x, y, percent)]
                yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return scratch.stage(both.mapInArrow(run, "a long, b long"), f"{name}_links")


def _across(groups: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) across components, within groups(key, id, component).

    The members outside a group's largest component meet all members: blocks of either side, each pair of blocks in
    a task's hands at a time, with their texts. A pair is compared in the first band that it shares; what passes the signatures is confirmed on full sets there and then,
    so that only links leave a task, however many pairs come near the threshold.
    """
    least, more = least_matches(percent), least_matches(percent, 1e-6, MORE_HASHES, MORE_BATCH)
    parts = groups.groupBy("key", "component").agg(F.count("*").alias("m"))
    parts = parts.groupBy("key").agg(F.sum("m").alias("all"), F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("most")).where("all > most")
    members = scratch.stage(groups.join(parts.select("key", "main"), "key").withColumn("other", F.col("component") != F.col("main")), "members")
    texts = texts_of(members.select("id"), classes, docs, scratch, "members")
    known = texts.join(classes.select("id", "n", "sig", "bands"), "id")
    weight = F.octet_length("text")
    sized = members.join(texts.select("id", weight.alias("w")), "id")
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_BYTES)).cast("int")
    mine = F.when(F.col("other"), 1).otherwise(0)
    sizes = sized.groupBy("key").agg(blocks(F.sum(mine), F.sum(mine * F.col("w"))).alias("others"), blocks(F.count("*"), F.sum("w")).alias("alls"))
    side = members.join(sizes, "key").select("key", "id", "component", "other", "others", "alls")
    right = side.select("key", "id", "component", "other", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("i"), F.pmod(F.xxhash64("id"), F.col("alls")).cast("int").alias("j"))
    left = side.where("other").select("key", "id", "component", "other", F.lit(True).alias("left"), F.pmod(F.xxhash64("id", F.lit(3)), F.col("others")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"))
    rows = left.union(right).join(known, "id")

    def compare(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(group).combine_chunks()
        is_left, other = (t.column(c).to_numpy() for c in ("left", "other"))
        key, ids, comp, n = (t.column(c).to_numpy() for c in ("key", "id", "component", "n"))
        sig = _signatures(t.column("sig"))
        bands_ = np.stack(t.column("bands").to_numpy(zero_copy_only=False))
        text = t.column("text")
        sets: dict[int, np.ndarray] = {}
        far: dict[int, np.ndarray] = {}

        def ready(row: int) -> np.ndarray:
            if row not in sets:
                sets[row] = next(shingle_sets(pa.RecordBatch.from_arrays([pa.array([text[row].as_py()], pa.string())], names=["text"]), k))
                far[row] = signature(sets[row], _MORE).astype("<u2")
            return far[row]

        l, r = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        out_a, out_b = [], []
        for x in l.tolist():
            ok = r[(comp[r] != comp[x]) & (np.minimum(n[r], n[x]) * 100 >= np.maximum(n[r], n[x]) * percent) & (~other[r] | (ids[x] < ids[r]))]
            ok = ok[likely(np.broadcast_to(sig[x], (len(ok), HASHES)), sig[ok], least)]
            if len(ok):
                first = (bands_[ok] == bands_[x]).argmax(1)
                ok = ok[bands_[ok, first] == key[x]]
            if not len(ok):
                continue
            mine = ready(x)
            theirs = np.stack([ready(y) for y in ok.tolist()])
            ok = ok[likely(np.broadcast_to(mine, theirs.shape), theirs, more, MORE_BATCH)]
            for y in ok.tolist():
                if alike(sets[x], sets[y], percent):
                    out_a.append(min(ids[x], ids[y]))
                    out_b.append(max(ids[x], ids[y]))
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if now is not None and tuple(place[:, low]) != now:
                    yield compare(held)
                    held = []
                now = tuple(place[:, low])
                held.append(batch.slice(low, high - low))
        if held:
            yield compare(held)

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = dealt.select("key", "i", "j", "id", "component", "other", "left", "n", "sig", "bands", "text").mapInArrow(run, "a long, b long")
    return scratch.stage(found, "second_links")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the least doc_id reachable over links) and kept.

    A document's set holds its distinct k-word shingles, lower-cased by A-Z; with fewer words, the whole sequence as one.
    Links join sets with 100 * shared >= percent * union. Null or blank text: no shingles, linked with nothing.
    Rows that repeat a doc_id are one document as far as links go. Null doc_id: n_shingles alone counts, component_id is null and kept true.
    Empty table: no rows. Other columns are not read.
    """
    return _groups(docs, k, percent).drop("mark")


def _groups(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """near_groups() with a hash of each row's text as `mark`."""
    spark, c = docs.sparkSession, F.col
    scratch = Scratch(spark)
    each = scratch.stage(sketch(docs, k, percent), "each")
    known = each.where(c("doc_id").isNotNull() & (c("n") > 0))
    classes = known.groupBy("f0", "f1").agg(F.min(F.struct("doc_id", "mark", "n", "sig", "bands")).alias("m"), F.count("*").alias("copies"))
    classes = scratch.stage(classes.select(c("m.doc_id").alias("id"), "m.mark", "m.n", "f0", "f1", "copies", "m.sig", "m.bands"), "classes")
    rows = scratch.stage(classes.select("id", F.explode("bands").alias("key")), "rows")
    ends = scratch.stage(rows.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("m")).where("most > least"), "ends")
    shared = scratch.stage(rows.join(ends, "key").select("key", "id", "least", "most", "m"), "shared")
    first = shared.select(c("least").alias("a"), c("id").alias("b")).where("a < b").union(shared.select(c("id").alias("a"), c("most").alias("b")).where("a < b"))
    first = scratch.stage(first.distinct(), "first")
    first = scratch.stage(prune(first, classes, percent), "likely1")
    links = verify(first, classes, docs, k, percent, scratch, "first")
    found = components(links, scratch, "early")
    inner = shared.where("m > 2").join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    more = _across(scratch.stage(inner, "inner"), classes, docs, k, percent, scratch)
    found = components(links.union(more), scratch, "final")

    # a node is a class's least document; a repeated doc_id can stand for more than one class
    named = classes.join(found.withColumnRenamed("node", "id"), "id", "left").where((c("copies") > 1) | c("component").isNotNull()).select("f0", "f1", F.coalesce("component", "id").alias("component"))
    named = scratch.stage(named, "named")
    scratch.drop("classes", "rows", "ends", "shared", "first", "likely1", "inner", "members", "first_texts", "members_texts")
    out = each.select("doc_id", "mark", "n", "f0", "f1").join(named, ["f0", "f1"], "left")
    component = F.when(c("n") > 0, F.coalesce("component", "doc_id")).otherwise(c("doc_id"))
    return out.select("doc_id", "mark", c("n").alias("n_shingles"), F.when(c("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(c("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, of rows that repeat this id that with the least hash of its text, and one of its rows.

    Documents without a word (null, empty or blank text) and rows without id all stay, repeated or not. Empty table: no rows. All columns are kept, whatever their names.
    """
    c = F.col
    found = Scratch(docs.sparkSession).stage(_groups(docs, k, percent).where("n_shingles > 0 and doc_id is not null"), "decided")
    # a row for each document and text; where an id repeats, only one text of its group stays
    texts = found.groupBy("doc_id", "mark").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    chosen = texts.where(c("doc_id") == c("component_id")).groupBy("component_id").agg(F.min("mark").alias("chosen"))
    later = texts.join(chosen, "component_id", "left").where((c("doc_id") != c("component_id")) | (c("mark") != c("chosen")))
    gone_id, gone_mark = fresh(docs, "gone_id", "gone_mark")
    gone = later.select(c("doc_id").alias(gone_id), c("mark").alias(gone_mark))
    same = lambda df, a, b: (df["doc_id"].cast("long") == c(a)) & (F.xxhash64(df["text"]) == c(b))
    kept = docs.join(gone, same(docs, gone_id, gone_mark), "left_anti")
    again = texts.where("n > 1").select(c("doc_id").alias(gone_id), c("mark").alias(gone_mark))
    if again.isEmpty():
        return kept
    once = kept.join(again, same(kept, gone_id, gone_mark), "left_anti")
    copies = kept.join(again, same(kept, gone_id, gone_mark)).dropDuplicates([gone_id, gone_mark])
    return once.unionByName(copies.select(*[copies[n] for n in docs.columns]))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), k=3, percent=85)
