"""Benchmark decontamination: fuzzy copies of benchmark items inside whole documents.

Texts are compared as bytes, lower-cased (A-Z and Latin letters with accents), with runs of blanks as one space. An item of L bytes is found where a part
of a document is within k = L // 10 edits of it.

1. Windows. An item is cut into k + 2 segments; k edits leave two of them whole at least. So item-sized windows are placed
   wherever the first bytes of two segments stand at places that fit together, which loses none within k edits.
2. Random-walk embedding: a walk repeats or passes each byte as shared random bits say, which turns
   edit distance into Hamming distance. Tables of sampled positions keep a window if it agrees with its item on all of a table's
   positions; there are as many tables as the target recall asks for at k edits.
3. Windows that are kept are verified by exact edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import _BLANK, _LOWER, mix
from .util import clean_names, fresh, table, text_bytes, text_slices

SEED = 8
#: Bytes of item text that one pass over the documents looks for.
BLOCK_BYTES = 4 << 20
FOUND = "doc_id long, item_id long, distance int, start_byte long, end_byte long"
#: With a hash of the text in which the item was found.
MARKED = FOUND + ", mark long"


def normal(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as compared, where each text starts in them, and where each byte came from."""
    blank = _BLANK[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[offsets[:-1][offsets[:-1] < len(raw)]] = True
    at = np.flatnonzero(keep)
    out = np.where(blank[at], np.uint8(32), _LOWER[raw[at]])
    capital = np.zeros(len(out), bool)  # of Latin letters with accents, which take two bytes
    capital[1:] = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
    out[capital] += 32
    return out, np.searchsorted(at, offsets), at


def edits(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edits between the item and any part of the text, and the first end of such a part. Bit-parallel over the item."""
    if (whole := text.find(item)) >= 0:
        return 0, whole + len(item)
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, ch in enumerate(item):
        peq[ch] = peq.get(ch, 0) | 1 << i
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, ch in enumerate(text, 1):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Walks:
    """Embeddings of rows of bytes by shared random walks, at sampled steps only."""

    def __init__(self, longest: int, walks: int = 4, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.steps = 3 * longest
        self.bits = draw.integers(0, 2, (walks, self.steps, 256), dtype=np.uint8)

    def embed(self, rows: np.ndarray, sizes: np.ndarray, walk: int, steps: int) -> np.ndarray:
        """rows: bytes with zeros behind; each step writes the byte at hand and goes on if the bit says so."""
        n = len(rows)
        out, at, every = np.zeros((n, steps), np.uint8), np.zeros(n, np.int64), np.arange(n)
        padded = np.hstack([rows, np.zeros((n, 1), np.uint8)])
        for j in range(steps):
            ch = padded[every, np.minimum(at, rows.shape[1])]
            out[:, j] = ch
            at += self.bits[walk, j][ch] & (at < sizes)
        return out


class Items:
    """A block of items, with their seeds and their tables."""

    def __init__(self, ids: list[int], texts: list[bytes], rate: float = 0.1, recall: float = 0.999):
        self.ids, self.texts = ids, texts
        self.k = [max(0, min(int(len(t) * rate), len(t) // SEED - 2)) for t in texts]
        self.whole = [i for i, t in enumerate(texts) if len(t) < 2 * SEED]  # too short for two seeds: found as they are
        seeds, owner, offset, several = [], [], [], []
        for i, t in enumerate(texts):
            if len(t) < 2 * SEED:
                continue
            parts, kept = self.k[i] + 2, {}
            for s in range(parts):
                o = len(t) * s // parts
                # where an item repeats itself, segments of one text that stand close together count as one, which is enough for a window
                if (last := kept.get(t[o : o + SEED])) is not None and o - offset[last] <= self.k[i] // 4:
                    several[last] = True
                    continue
                kept[t[o : o + SEED]] = len(offset)
                seeds.append(t[o : o + SEED])
                owner.append(i)
                offset.append(o)
                several.append(False)
        code = mix(np.frombuffer(b"".join(seeds), "<u8").copy()) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.code, self.owner, self.offset, self.several = code[order], np.array(owner, np.int64)[order], np.array(offset, np.int64)[order], np.array(several, bool)[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.code >> np.uint64(44)).astype(np.int64)] = True
        longest = max([len(t) + k for t, k in zip(texts, self.k, strict=True)], default=1)
        self.longest = min(longest, 4096)
        self.walks = Walks(self.longest)
        self._tables(recall)

    def _tables(self, recall: float) -> None:
        """How many tables of two positions each the recall takes, from all items that allow edits, with k random edits each.

        Items are taken by classes of size, since a few edits of a short one and many of a long one agree in different measure;
        the class that agrees least decides. Items without edits, and items over `longest` bytes, are verified directly and need no table.
        """
        draw = np.random.default_rng(3)
        classes: dict[int, list[int]] = {}
        for i in range(len(self.texts)):
            if self.k[i] and len(self.texts[i]) <= self.longest:
                classes.setdefault(min(len(self.texts[i]), self.longest).bit_length(), []).append(i)
        lows = []
        for own in classes.values():
            agree = []
            for low in range(0, len(own), 256):
                part = own[low : low + 256]
                sizes = np.array([min(len(self.texts[i]), self.longest) for i in part] * 2)
                rows = np.zeros((2 * len(part), int(sizes.max())), np.uint8)
                for r, i in enumerate(part):
                    t = bytearray(self.texts[i])
                    for _ in range(self.k[i]):
                        p, what = int(draw.integers(0, max(1, len(t)))), draw.integers(0, 3)
                        if what == 0:
                            t[p : p + 1] = bytes([int(draw.integers(97, 123))])
                        elif what == 1:
                            t.insert(p, int(draw.integers(97, 123)))
                        elif len(t) > 1:
                            del t[p]
                    for at, x in ((r, self.texts[i]), (len(part) + r, bytes(t))):
                        y = np.frombuffer(x, np.uint8)[: sizes[r]]
                        rows[at, : len(y)] = y
                for w in range(len(self.walks.bits)):
                    e = self.walks.embed(rows, sizes, w, int(2 * sizes.max()))
                    same = e[: len(part)] == e[len(part) :]
                    agree += [float(same[r, : 2 * sizes[r]].mean()) for r in range(len(part))]
            lows.append(min(agree))
        low = min(0.999, max(0.1, min(lows))) if lows else 0.5
        self.tables = max(8, math.ceil(math.log(1 - recall) / math.log(1 - low**2)))
        self.positions = np.random.default_rng(5).random((self.tables, 2))

    def passes(self, windows: list[bytes], owners: list[int]) -> np.ndarray:
        """Which windows share a table with their item, or belong to an item that goes without tables: one that allows no edits, or one too long to be sampled whole."""
        done = np.array([not self.k[o] or len(self.texts[o]) > self.longest for o in owners], bool)
        rest = np.flatnonzero(~done)
        done[rest] = self._meets([windows[r] for r in rest], [owners[r] for r in rest])
        return done

    def _meets(self, windows: list[bytes], owners: list[int]) -> np.ndarray:
        n, ok = len(windows), np.zeros(len(windows), bool)
        for low in range(0, n, 256):
            part, own = windows[low : low + 256], owners[low : low + 256]
            rows = np.zeros((2 * len(part), self.longest), np.uint8)
            sizes = np.array([min(len(self.texts[o]), self.longest) for o in own] * 2)
            for r, x in enumerate([*part, *(self.texts[o] for o in own)]):
                s = sizes[r]
                y = np.frombuffer(x, np.uint8)[:s]
                rows[r, : len(y)] = y
            walks = len(self.walks.bits)
            for w in range(walks):
                e = self.walks.embed(rows, sizes, w, int(2 * sizes.max()))
                same = e[: len(part)] == e[len(part) :]
                for t in range(w, self.tables, walks):
                    at = (self.positions[t][None] * 2 * sizes[: len(part), None]).astype(np.int64)
                    ok[low : low + len(part)] |= same[np.arange(len(part)), at[:, 0]] & same[np.arange(len(part)), at[:, 1]]
        return ok


def _windows(b: np.ndarray, at: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(text, item, start): where two segments of an item stand as they would within its edits."""
    if len(b) < SEED or not len(items.code):
        return []
    v = np.zeros(len(b) - SEED + 1, np.uint64)
    for j in range(SEED):
        v |= b[j : len(b) - SEED + 1 + j].astype(np.uint64) << np.uint64(8 * j)
    v = mix(v)
    hit = np.flatnonzero(items.filter[(v >> np.uint64(44)).astype(np.int64)])
    low, high = np.searchsorted(items.code, v[hit], side="left"), np.searchsorted(items.code, v[hit], side="right")
    many = high - low
    pos = np.repeat(hit, many)
    which = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    owner, offset, several = items.owner[which], items.offset[which], items.several[which]
    doc = np.searchsorted(at, pos, side="right") - 1
    start = pos - offset
    order = np.lexsort((start, owner, doc))
    doc, owner, offset, start, several = doc[order], owner[order], offset[order], start[order], several[order]
    k = np.array(items.k)
    out: list[tuple[int, int, int]] = []
    near = np.zeros(len(doc), bool)
    near[1:] = (doc[1:] == doc[:-1]) & (owner[1:] == owner[:-1]) & (start[1:] - start[:-1] <= k[owner[1:]])
    edges = np.append(np.flatnonzero(~near), len(doc))
    sizes = np.diff(edges)
    told = np.add.reduceat(several, edges[:-1]) > 0 if len(doc) else np.zeros(0, bool)
    some = (sizes > 1) | told
    for low_, high_, alone in zip(edges[:-1][some].tolist(), edges[1:][some].tolist(), told[some].tolist(), strict=True):
        if not alone and offset[low_:high_].min() == offset[low_:high_].max():
            continue
        # runs of close starts may be long in repetitive text: one window for each stretch of k
        own, reach, r = start[low_:high_], int(k[owner[low_]]), low_
        while r < high_:
            end = int(np.searchsorted(own, start[r] + reach, side="right")) + low_
            first = r + int(np.argmin(offset[r:end]))
            out.append((int(doc[r]), int(owner[r]), int(start[first])))
            r = int(np.searchsorted(own, start[r] + max(1, reach), side="right")) + low_
    return out


def find(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, recall: float = 0.999) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, distance (edits), start_byte and end_byte of the best place.

    Offsets are bytes of the text in UTF-8. Null or blank texts and items match nothing; null doc_id or item_id: ignored. Items under 16 bytes
    are found only as they are. A repeated item_id counts once, with the least text; rows that repeat a doc_id give a row each, but for equal rows.
    Empty tables: no rows. Other columns are not read. The benchmark is looked for in blocks of BLOCK_BYTES, so that it may be of any size.
    """
    return _found(docs, benchmark, rate, recall).where("doc_id is not null").drop("mark").distinct()


def _found(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, recall: float = 0.999) -> DataFrame:
    """find() with `mark`, for rows without id too."""
    spark = docs.sparkSession
    source = clean_names(docs, ["doc_id", "text"]).where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    listed = clean_names(benchmark, ["item_id", "text"]).where(F.col("item_id").isNotNull() & F.col("text").rlike("[^\\x20\\x09-\\x0D]")).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))

    def passed(items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches, most=2 << 20):
                raw, offsets = text_bytes(batch.column("text"))
                b, at, origin = normal(raw, offsets)
                ids, out = list(range(batch.num_rows)), []
                found = _windows(b, at, items)
                spots = []
                for d, i, s in found:
                    low, high = int(at[d]), int(at[d + 1])
                    spots.append((max(low, s), min(high, s + len(items.texts[i]))))
                ok = items.passes([b[x:y].tobytes() for x, y in spots], [i for _, i, _ in found])
                exact: set[tuple[int, int]] = set()
                for r in np.flatnonzero(ok).tolist():
                    d, i, s = found[r]
                    t, k = items.texts[i], items.k[i]
                    low, high = max(int(at[d]), s - 2 * k), min(int(at[d + 1]), s + len(t) + 2 * k)
                    if high - low < len(t) - k or (int(ids[d]), items.ids[i]) in exact:
                        continue
                    n, end = edits(t, part := b[low:high].tobytes())
                    if not n:
                        exact.add((int(ids[d]), items.ids[i]))
                    if n <= k:
                        back = edits(t[::-1], part[:end][::-1])[1]
                        out.append((int(ids[d]), items.ids[i], n, int(origin[low + end - back] - offsets[d]), int(origin[low + end - 1] + 1 - offsets[d])))
                for i in items.whole:
                    t = items.texts[i]
                    for d in range(batch.num_rows):
                        whole = b[at[d] : at[d + 1]].tobytes()
                        if (p := f" {' '.join(whole.decode(errors='replace').split(' '))} ".encode().find(b" " + t + b" ")) >= 0:
                            o = min(int(at[d]) + p, int(at[d + 1]) - 1)
                            out.append((int(ids[d]), items.ids[i], 0, int(origin[o] - offsets[d]), int(origin[min(o + len(t), int(at[d + 1])) - 1] + 1 - offsets[d])))
                best: dict[tuple[int, int], tuple] = {}
                for row in out:
                    if (key := row[:2]) not in best or row[2:] < best[key][2:]:
                        best[key] = row
                if best:
                    row, *rest = [pa.array(c, t) for c, t in zip(zip(*best.values(), strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), *rest, batch.column("mark").take(row)], names=["doc_id", "item_id", "distance", "start_byte", "end_byte", "mark"])

        return source.mapInArrow(run, MARKED)

    out, ids, texts, size = None, [], [], 0
    for row in listed.orderBy("item_id").toLocalIterator():
        data = row["text"].encode()
        b, _, _ = normal(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        ids.append(row["item_id"])
        texts.append(b.tobytes().strip())
        size += len(b)
        if size >= BLOCK_BYTES:
            part = passed(Items(ids, texts, rate, recall))
            out, ids, texts, size = (part if out is None else out.union(part)), [], [], 0
    if ids or out is None:
        part = passed(Items(ids, texts, rate, recall)) if ids else spark.createDataFrame([], MARKED)
        out = part if out is None else out.union(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found; each row is judged by its own text, whatever ids repeat.

    Null and empty texts, and all documents where the benchmark is empty, stay. Rows without id are judged like others. Empty table: no rows. All columns are kept, whatever their names.
    """
    gone_id, gone_mark = fresh(docs, "gone_id", "gone_mark")
    gone = _found(docs, benchmark).select(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs["text"]) == F.col(gone_mark)), "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
