"""Substring dedup: passages that documents share, exactly or nearly, by collinear chains of k-mer seeds.

1. Seeds: runs of K words whose hash is low, one in RATE, whatever stands around them; where WINDOW runs in a row have none, the least of each window.
   So a shared run is a seed in both texts or in neither, and every stretch of K + WINDOW - 1 shared words has a seed.
2. Each seed is joined with its first document, not with all others: rows grow with the corpus, whatever the size of a group.
3. For each pair of documents, a Fenwick tree over positions chains ordered matches, with a cost for the words between them.
4. Chains are aligned on the words of both texts: gaps by longest common subsequence, ends by extension with a drop limit.
5. The first document of a seed need not hold the passage. So, outside of the passages found so far, seeds are joined with their last document, and the long
   runs of words that start at them with the first document of the whole run; what that gives is chained and aligned too.
6. Neither need hold it. So, of two seeds near each other, one of them outside of the passages found, all documents that have both are compared, in blocks, by the words
   around them; only what may be a passage leaves, and is aligned, until nothing is left to try.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, within
from .hashing import mix, powers, runs, word_hashes
from .util import Scratch, clean_names, fresh, table, text_bytes, text_slices

K, RATE, WINDOW = 5, 6, 12
MIN_WORDS, LIKENESS = 50, 0.8
#: Rows of two seeds, on either side, that meet in one task.
BLOCK = 1024
#: Seeds that a chain has at least, and how many words apart its first and last one start.
LEAST, SPREAD = 2, 12
GAP_COST, MAX_GAP = 0.02, 40
CHAIN = "a long, b long, pa array<int>, pb array<int>"
FOUND = "doc_id long, source_id long, start_char long, end_char long, source_start long, source_end long, n_words long, n_matched long"
#: A passage, its first and last word (exclusive) in doc_id, and a hash of that text.
SPANS = FOUND + ", first int, last int, mark long"
_INVERSE = np.uint64(pow(int(powers(2)[1]), -1, 1 << 64))
_LOW = np.uint64((1 << 64) // RATE)


def chosen(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the seeds among the word hashes of a batch of texts (text k has those from at[k] to at[k + 1]), and a hash for each."""
    n = len(hashes) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    r = runs(hashes, K)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = text[:n] == text[K - 1 :]  # runs within one text
    low = np.flatnonzero((r < _LOW) & whole)
    ends = np.concatenate([at[:-1] - 1, np.maximum(at[:-1], at[1:] - K + 1)])  # before the first run of each text, and behind its last one
    edges = np.sort(np.concatenate([low, ends]), kind="stable")
    wide = np.flatnonzero(np.diff(edges) > WINDOW)
    begin, end = edges[wide] + 1, edges[wide + 1]
    broken = np.concatenate([[0], np.cumsum(~whole)])
    inside = broken[begin] == broken[end]
    begin, n_windows = begin[inside], (end - begin)[inside] - WINDOW + 1
    starts = np.repeat(begin - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(n_windows.sum())
    least, which = r[starts], starts.copy()
    for j in range(1, WINDOW):
        value = r[starts + j]
        less = value < least
        least[less], which[less] = value[less], starts[less] + j
    places = np.unique(np.concatenate([low, which]))
    return places, r[places]


def long_runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, by sums of powers, for long runs."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(n)[:n], dtype=np.uint64)])
    back = np.full(n - k + 1, _INVERSE, np.uint64)
    back[0] = 1
    return mix((total[k:] - total[:-k]) * np.multiply.accumulate(back))


def run_size(min_words: int) -> int:
    """Words of the runs that start at seeds: a passage of min_words has one, since one of its first WINDOW words starts a seed."""
    return max(K, min_words - WINDOW + 1)


def seeds(docs: DataFrame, min_words: int) -> DataFrame:
    """seed, doc_id, pos (the word it starts at) and run (a hash of run_size() words from there), of documents with enough words.

    run is null where the text ends before, and where the text has had the run before: a text that repeats itself has each run once.
    """
    size = run_size(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, _, _, at = word_hashes(*text_bytes(batch.column("text")))
            places, r = chosen(hashes, at)
            text = np.searchsorted(at, places, side="right") - 1
            enough = np.diff(at)[text] >= min_words
            places, r, text = places[enough], r[enough], text[enough]
            fits = np.flatnonzero(places + size <= at[text + 1])
            runs_ = np.zeros(len(places), np.int64)
            runs_[fits] = long_runs(hashes, size)[places[fits]].view(np.int64)
            own = runs_[fits].view(np.uint64) ^ mix(text[fits].astype(np.uint64) + np.uint64(1))
            first = fits[np.unique(own, return_index=True)[1]]
            none = np.ones(len(places), bool)
            none[first] = False
            yield pa.RecordBatch.from_arrays([pa.array(r.view(np.int64)), pa.array(batch.column("doc_id").to_numpy()[text]), pa.array((places - at[text]).astype(np.int32)), pa.array(runs_, mask=none)], names=["seed", "doc_id", "pos", "run"])

    return docs.mapInArrow(run, "seed long, doc_id long, pos int, run long")


class Fenwick:
    """Greatest value, and whose it is, over a prefix of places."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """Over the places before i."""
        out = (0.0, -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chains(pa_: np.ndarray, pb: np.ndarray, cost: float = GAP_COST) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chains of matches that rise in both documents, best first, each cut where more than MAX_GAP words lie between.

    Matches that follow each other on one diagonal are merged first. A chain's score is the words its matches cover less
    cost for each word of the gaps on either side; the tree holds score + cost * (ends on both sides), so that the best
    chain to go on from is a prefix maximum.
    """
    order = np.lexsort((pa_, pb))
    pa_, pb = pa_[order].astype(np.int64), pb[order].astype(np.int64)
    new = np.ones(len(pa_), bool)
    new[1:] = ((pa_ - pb)[1:] != (pa_ - pb)[:-1]) | (pb[1:] - pb[:-1] > WINDOW + K)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(pa_)) - 1
    a0, b0, a1, b1 = pa_[at], pb[at], pa_[last] + K, pb[last] + K
    if len(at) == 1:
        return [(pa_, pb)]
    places = np.unique(np.concatenate([a0, a1 - K + 1]))
    rank_start, rank_end = np.searchsorted(places, a0).tolist(), np.searchsorted(places, a1 - K + 1).tolist()
    events = np.lexsort((np.tile(np.arange(len(at)), 2), np.repeat([1, 0], len(at)), np.concatenate([b0, b1 - K + 1]))).tolist()
    a0, b0, a1, b1 = a0.tolist(), b0.tolist(), a1.tolist(), b1.tolist()
    tree = Fenwick(len(places))
    score, back = [float(high - low) for low, high in zip(b0, b1, strict=True)], [-1] * len(at)
    for i in events:
        if i < len(at):
            value, j = tree.upto(rank_start[i] + 1)
            gain = value - cost * float(a0[i] + b0[i])
            if j >= 0 and gain > 0:
                score[i], back[i] = score[i] + gain, j
        else:
            i -= len(at)
            tree.put(rank_end[i], (score[i] + cost * (a1[i] + b1[i]), i))
    used, picked = [False] * len(at), []
    for i in np.argsort(-np.array(score), kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            picked.append(chain[::-1])
    out = []
    for chain in picked:
        part: list[int] = []
        for i in chain:
            if part and (a0[i] - a1[part[-1]] > MAX_GAP or b0[i] - b1[part[-1]] > MAX_GAP):
                out.append(part)
                part = []
            part.append(i)
        out.append(part)
    at, last = at.tolist(), last.tolist()
    return [(np.concatenate([pa_[at[i] : last[i] + 1] for i in p]), np.concatenate([pb[at[i] : last[i] + 1] for i in p])) for p in out]


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence of two short runs of words: a row of its table is one integer, whose bits are 0 where the length goes up."""
    if not len(x) or not len(y):
        return 0
    places: dict[int, int] = {}
    for j, v in enumerate(y.tolist()):
        places[v] = places.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x.tolist():
        if v in places:
            up = row & places[v]
            row = ((row + up) | (row - up)) & full
    return len(y) - row.bit_count()


def extend(x: np.ndarray, y: np.ndarray, drop: float = 8.0) -> tuple[int, int]:
    """How far two runs go on together from their starts: words, and how many of them match. Stops where the score falls `drop` below its best."""
    n = min(len(x), len(y))
    best = (0, 0)
    step, start = 64, 0
    value, top, hits = 0.0, 0.0, 0
    while start < n:
        same = x[start : start + step][: n - start] == y[start : start + step][: n - start]
        for k, ok in enumerate(same.tolist(), start + 1):
            hits += ok
            value += 1.0 if ok else -2.0
            if value > top:
                top, best = value, (k, hits)
            if value < top - drop:
                return best
        start += step
    return best


def align(x: np.ndarray, y: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> tuple[int, int, int, int, int]:
    """First and last word (exclusive) in both texts, and matched words, of a chain of matches between word hashes x and y."""
    matched, ea, eb = 0, int(pa_[0]), int(pb[0])
    for i, j in zip(pa_.tolist(), pb.tolist(), strict=True):
        if i >= ea and j >= eb:
            matched += common(x[ea:i], y[eb:j]) + K
        else:  # overlaps what is matched already
            over = max(ea - i, eb - j)
            matched += max(0, K - over)
        ea, eb = max(ea, i + K), max(eb, j + K)
    sa, sb = int(pa_[0]), int(pb[0])
    more, hits = extend(x[:sa][::-1], y[:sb][::-1])
    sa, sb, matched = sa - more, sb - more, matched + hits
    more, hits = extend(x[ea:], y[eb:])
    return sa, ea + more, sb, eb + more, matched + hits


def passages(x: np.ndarray, y: np.ndarray, pa_: np.ndarray, pb: np.ndarray, min_words: int, likeness: float, least: int) -> list[tuple[int, int, int, int, int]]:
    """What align() gives for a chain; for its matches alone if their ends are too unlike; for the parts on both sides of its widest gap if all of it is."""
    out, todo = [], [(pa_, pb)]
    while todo:
        p, q = todo.pop()
        ends = (int(p[0]), int(p[-1]) + K), (int(q[0]), int(q[-1]) + K)
        for a0, b0, u, v in ((0, 0, x, y), (ends[0][0], ends[1][0], x[slice(*ends[0])], y[slice(*ends[1])])):
            sa, ta, sb, tb, hits = align(u, v, p - a0, q - b0)
            if tb - sb >= min_words and hits >= likeness * max(ta - sa, tb - sb):
                out.append((sa + a0, ta + a0, sb + b0, tb + b0, hits))
                break
        else:
            if len(p) > least:
                wide = np.maximum(np.diff(p), np.diff(q)) + np.abs(np.diff(p) - np.diff(q))
                at = int(wide.argmax()) + 1
                todo += [(p[low:high], q[low:high]) for low, high in ((0, at), (at, len(p))) if high - low >= least]
    return out


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], names: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Rows of longs that are sorted by some columns, a group at a time: (its key, an array of the named columns)."""
    held: list[np.ndarray] = []
    now: tuple[int, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, t = (np.stack([batch.column(c).to_numpy().astype(np.int64) for c in some]) for some in (by, names))
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), t.shape[1]]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[:, low].tolist())
            if now is not None and key != now:
                yield now, np.hstack(held)
                held = []
            now = key
            held.append(t[:, low:high])
    if now is not None:
        yield now, np.hstack(held)


def _texts(base: DataFrame, wanted: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """doc_id and the least text of the wanted documents."""
    wanted = scratch.stage(wanted, f"{name}_wanted", tidy=False)
    asked = scratch.stage(bitmap(wanted.select(F.xxhash64("doc_id").alias("key"))), f"{name}_asked", tidy=False).scalar()
    some = base.select("*", asked.alias("asked")).where(within(F.col("asked"), F.xxhash64("doc_id"))).drop("asked")  # only texts that may be wanted are shuffled
    return scratch.stage(some.join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), f"{name}_texts")


def confirmed(matches: DataFrame, base: DataFrame, scratch: Scratch, name: str, min_words: int, likeness: float) -> DataFrame:
    """The passages of matches (a, b, pa, pb): chained for each pair of documents, then aligned on their texts."""
    c = F.col

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (a, b), (x, y) in _runs(batches, ("a", "b"), ("pa", "pb")):
            if len(x) < LEAST or y.max() - y.min() < SPREAD:
                continue
            for p, q in chains(x, y):
                if len(p) >= LEAST and q[-1] - q[0] >= SPREAD:
                    out.append((a, b, p.astype(np.int32), q.astype(np.int32)))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], names=["a", "b", "pa", "pb"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], names=["a", "b", "pa", "pb"])

    rows = matches.repartition("a", "b").sortWithinPartitions("a", "b", "pb", "pa").mapInArrow(chain, CHAIN)
    rows = scratch.stage(rows, f"{name}_chains")
    wanted = rows.select(c("a").alias("doc_id")).union(rows.select(c("b").alias("doc_id"))).distinct()
    texts = _texts(base, wanted, scratch, name)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in text_slices(text_slices(iter([big]), "ta"), "tb"):
                (_, one_a, which_a), (_, one_b, which_b) = (np.unique(batch.column(n).to_numpy(), return_index=True, return_inverse=True) for n in "ab")  # each text once
                raw_a, off_a = text_bytes(batch.column("ta").take(pa.array(one_a)))
                raw_b, off_b = text_bytes(batch.column("tb").take(pa.array(one_b)))
                ha, fa, ea, na = word_hashes(raw_a, off_a)
                hb, fb, eb, nb = word_hashes(raw_b, off_b)
                out = []
                for r, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                    i, j = int(which_a[r]), int(which_b[r])
                    x, y = ha[na[i] : na[i + 1]], hb[nb[j] : nb[j + 1]]
                    p, q = np.array(batch.column("pa")[r].as_py()), np.array(batch.column("pb")[r].as_py())
                    if p.max() + K > len(x) or q.max() + K > len(y):
                        continue
                    for sa, ta, sb, tb, hits in passages(x, y, p, q, min_words, likeness, LEAST):
                        chars = lambda raw, low, high: int(((raw[low:high] & 0xC0) != 0x80).sum())
                        b0, b1, a0, a1 = fb[nb[j] + sb], eb[nb[j] + tb - 1], fa[na[i] + sa], ea[na[i] + ta - 1]
                        c0, s0 = chars(raw_b, off_b[j], b0), chars(raw_a, off_a[i], a0)
                        out.append((b, a, c0, c0 + chars(raw_b, b0, b1), s0, s0 + chars(raw_a, a0, a1), tb - sb, hits, sb, tb, batch.column("mark")[r].as_py()))
                if out:
                    kinds = [pa.int64()] * 8 + [pa.int32()] * 2 + [pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SPANS.split(", ")])

    both = rows.join(texts.select(c("doc_id").alias("b"), c("text").alias("tb"), F.xxhash64("text").alias("mark")), "b").join(texts.select(c("doc_id").alias("a"), c("text").alias("ta")), "a")
    out = scratch.stage(both.mapInArrow(aligned, SPANS).distinct(), name)
    scratch.drop(f"{name}_chains", f"{name}_texts", f"{name}_wanted", f"{name}_asked")
    return out


def reaches(min_words: int, likeness: float) -> tuple[int, int, int]:
    """Most words between two seeds in the later and in the earlier document, and words of context on either side, that twos() and meet() look at.

    A chain shorter than min_words is judged by its first and last seed; a longer one has seeds that are min_words - K to far words apart.
    """
    far = max(min_words, K + SPREAD) + MAX_GAP
    return far, int(far / likeness) + WINDOW, max(1, min_words - K - SPREAD)


def twos(rows: DataFrame, least: int, most: int, later: bool) -> DataFrame:
    """Two seeds of a document that stand from least to most words apart, the first place of each two: two (a hash of both), doc_id, where they start, and each one's key.

    rows: doc_id, pos, last, key, head; where last is not 0, a passage that has been found, from pos to there. head: the document is the first of the seed.
    later: one seed at least stands outside of all passages found. Otherwise: the document is not the first of both, since then the first round has met it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (doc,), (pos, last, key, head) in _runs(batches, ("doc_id",), ("pos", "last", "key", "head")):
            order = np.flatnonzero(last == 0)
            order = order[np.argsort(pos[order], kind="stable")]
            p, k, h = pos[order], key[order].view(np.uint64), head[order] > 0
            if later:
                for at in np.flatnonzero(last).tolist():
                    h[(p >= pos[at]) & (p + K <= last[at])] = True
            if h.all():
                continue
            low, high = np.searchsorted(p, p + least), np.searchsorted(p, p + most, side="right")
            own = []
            for start in range(0, len(p), 1 << 14):
                n = np.maximum(high - low, 0)[start : start + (1 << 14)]
                i = np.repeat(np.arange(start, start + len(n)), n)
                j = low[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                keep = ~(h[i] & h[j])
                i, j = i[keep], j[keep]
                two = mix(mix(k[i]) + k[j]).view(np.int64)
                own.append(np.stack([two, np.full(len(i), doc), p[i], p[j], k[i].view(np.int64), k[j].view(np.int64)])[:, np.unique(two, return_index=True)[1]])
            rows_ = np.hstack(own)
            held.append(rows_[:, np.unique(rows_[0], return_index=True)[1]])
            size += held[-1].shape[1]
            if size > 50000:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(np.hstack(held), kinds, strict=True)], schema=kinds)
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(np.hstack(held), kinds, strict=True)], schema=kinds)

    kinds = pa.schema([("two", pa.int64()), ("doc_id", pa.int64()), ("pi", pa.int32()), ("pj", pa.int32()), ("ki", pa.int64()), ("kj", pa.int64())])
    return rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "two long, doc_id long, pi int, pj int, ki long, kj long")


def contexts(places: DataFrame, base: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """places (two, doc_id, pi, pj, later) with hashes of 32 bits of the words before, from the first to the end of the second seed, and behind."""
    held = places.groupBy("doc_id").agg(F.collect_list(F.struct("two", "pi", "pj", "later")).alias("places"))
    both = _texts(base, places.select("doc_id").distinct(), scratch, "others").join(held, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, _, _, at = word_hashes(*text_bytes(batch.column("text")))
            short = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(2)  # 0 and 1 stand for words beyond a text
            lists = batch.column("places")
            off = np.asarray(lists.offsets)
            flat = lists.values
            two, pi, pj, later = (flat.field(n).to_numpy(zero_copy_only=False) for n in range(4))
            out = []
            for t, doc in enumerate(batch.column("doc_id").to_pylist()):
                ws = short[at[t] : at[t + 1]]
                for r in range(off[t], off[t + 1]):
                    i, j = int(pi[r]), int(pj[r]) + K
                    if j <= len(ws):
                        out.append((two[r], doc, i, bool(later[r]), ws[max(0, i - width) : i][::-1].tobytes(), ws[i:j].tobytes(), ws[j : j + width].tobytes()))
                        if len(out) == 5000:
                            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, v, strict=True)) for v in out], schema=kinds)
                            out = []
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, v, strict=True)) for v in out], schema=kinds)

    kinds = pa.schema([("two", pa.int64()), ("doc_id", pa.int64()), ("pi", pa.int32()), ("later", pa.bool_()), ("before", pa.binary()), ("mid", pa.binary()), ("behind", pa.binary())])
    return both.mapInArrow(run, "two long, doc_id long, pi int, later boolean, before binary, mid binary, behind binary")


def extents(x: np.ndarray, ys: np.ndarray, drop: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """extend() of one run of words with each row of ys: words and matches. What has not ended within the row counts as a whole."""
    same = ys == x
    value = np.cumsum(np.where(same, 1, -2), 1)
    hits = np.cumsum(same, 1)
    over = value < np.maximum.accumulate(np.maximum(value, 0), 1) - drop
    ended = over.any(1)
    value = np.where(np.arange(ys.shape[1]) < np.where(ended, over.argmax(1), ys.shape[1])[:, None], value, 0)
    at = np.where(ended, value.argmax(1), ys.shape[1] - 1)
    some = ~ended | (value.max(1) > 0)
    return np.where(some, at + 1, 0), np.where(some, hits[np.arange(len(ys)), at], 0)


def meet(early: list[tuple], late: list[tuple], most: int, width: int, min_words: int, likeness: float) -> Iterator[tuple[int, int | None, list[int], list[int]]]:
    """(b, a, matches in a, in b) of late rows (doc, pi, before, mid, behind, tried) with the `most` earliest of early rows (the same without tried, one for each context) that may share a passage around the two seeds.

    (b, None, [], []) follows where early rows are left that have not been looked at.
    """

    def matrix(texts: list[bytes], fill: int) -> np.ndarray:
        out = np.full((len(texts), width), fill, np.uint32)
        for k, t in enumerate(texts):
            out[k, : len(t) // 4] = np.frombuffer(t, np.uint32)
        return out

    early = sorted(early)
    docs = [e[0] for e in early]
    before, behind, sizes = matrix([e[2] for e in early], 0), matrix([e[4] for e in early], 0), np.array([len(e[3]) // 4 for e in early])
    like: dict[tuple, list[tuple]] = {}
    for row in late:
        like.setdefault(row[2:5], []).append(row)
    for (x, mid, z), rows in like.items():
        nb, hb = extents(matrix([x], 1)[0], before)
        nz, hz = extents(matrix([z], 1)[0], behind)
        b = np.frombuffer(mid, np.uint32)
        more = nb + nz
        least = 0.9 * likeness * (np.maximum(sizes, len(b)) + more)
        may = np.flatnonzero((len(b) + more >= min_words) & (np.minimum(sizes, len(b)) + more >= least)).tolist()
        known: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}

        def matches(k: int) -> tuple[np.ndarray, np.ndarray] | None:
            a = np.frombuffer(early[k][3], np.uint32)
            if early[k][3] != mid:
                need = least[k] - hb[k] - hz[k] - 2 * K
                if np.isin(b[K:-K], a[K:-K]).sum() < need or common(a[K:-K], b[K:-K]) < need:
                    return None
            _, one, two = np.intersect1d(runs(a.astype(np.uint64), K), runs(b.astype(np.uint64), K), return_indices=True)
            return np.append(one, [0, len(a) - K]), np.append(two, [0, len(b) - K])

        for doc, pi, _, _, _, tried in sorted(rows, key=lambda r: r[:2]):
            left = most
            for k in may:
                if docs[k] >= doc:
                    break
                if not left:
                    yield doc, None, [], []
                    break
                if docs[k] in tried:
                    continue
                if k not in known:
                    known[k] = matches(k)
                if known[k] is not None:
                    yield doc, docs[k], (known[k][0] + early[k][1]).tolist(), (known[k][1] + pi).tolist()
                    left -= 1


def others(rest: DataFrame, out: DataFrame, base: DataFrame, scratch: Scratch, min_words: int, likeness: float) -> DataFrame:
    """The passages out, and those with any other earlier document: of two seeds, of which one stands outside of passages found, all documents that have both meet.

    Documents with the same words around them are one class, by its first document. All classes of two seeds are compared, in blocks of about BLOCK; the first
    one that may share a passage leaves, and is aligned. This goes on with sixteen times as many, without what has been tried or found, for the rows that have classes left to look at, until nothing is left to try.
    """
    c, turn = F.col, 0
    far, wide, width = reaches(min_words, likeness)
    key = F.xxhash64("a", "pa").alias("key")
    seeds_ = rest.select("doc_id", "pos", F.lit(0).alias("last"), key, (c("doc_id") == c("a")).cast("int").alias("head"))
    found = out.select("doc_id", c("first").alias("pos"), "last", F.lit(0).cast("long").alias("key"), F.lit(0).alias("head")).distinct()
    late = scratch.stage(twos(seeds_.where("head = 0").union(found), SPREAD, far, True), "late")
    if late.isEmpty():
        return out
    keys = late.select(c("ki").alias("key")).union(late.select("kj")).distinct()
    early = twos(seeds_.join(keys, "key", "left_semi").select(seeds_.columns), 1, wide, False).drop("ki", "kj")
    early = scratch.stage(early.join(late.select("two").distinct(), "two", "left_semi"), "early")
    ends = early.groupBy("two").agg(F.min("doc_id").alias("least"))
    late = scratch.stage(late.drop("ki", "kj").join(ends, "two").where(c("doc_id") > c("least")).drop("least"), "later")
    ends = late.groupBy("two").agg(F.max("doc_id").alias("most"))
    early = early.join(ends, "two").where(c("doc_id") < c("most")).drop("most")
    places = scratch.stage(late.withColumn("later", F.lit(True)).unionByName(early.withColumn("later", F.lit(False))), "places")
    scratch.drop("late", "early")
    rows = scratch.stage(contexts(places, base, scratch, width), "contexts")
    scratch.drop("places", "later", "others_wanted", "others_asked", "others_texts")
    around = ["before", "mid", "behind"]
    classes = rows.where("not later").groupBy("two", *around).agg(F.min(F.struct("doc_id", "pi")).alias("f")).select("two", "f.doc_id", "f.pi", *around, F.pmod(F.xxhash64(*around), F.lit(1 << 20)).alias("deal"))
    classes = scratch.stage(classes, "classes")
    late = rows.where("later").select("two", "doc_id", "pi", (c("pi") + F.octet_length("mid") / 4 - K).cast("int").alias("pj"), *around)
    late = late.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    blocks = lambda df, name: df.groupBy("two").agg(F.ceil(F.count("*") / BLOCK).alias(name))
    tried = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])
        for batch in batches:
            for r in zip(*(batch.column(n).to_pylist() for n in ("two", "x", "y", "late", "doc_id", "pi", "before", "mid", "behind", "tried")), strict=True):
                if r[:3] != now:
                    yield from answer(now, *sides)
                    now, sides = r[:3], ([], [])
                sides[r[3]].append((*r[4:9], set(r[9] or ())) if r[3] else r[4:9])
        yield from answer(now, *sides)

    def answer(now: tuple | None, early: list[tuple], late: list[tuple]) -> Iterator[pa.RecordBatch]:
        if early and late:
            got = [(None if v[1] is not None else now[0], *v) for v in meet(early, late, 16**turn, width, min_words, likeness)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=["two", "b", "a", "pa", "pb"])

    while True:
        n = scratch.stage(blocks(classes, "nx").join(blocks(late, "ny"), "two"), f"blocks{turn}", tidy=False)
        asked = late.withColumn("tried", F.lit(None).cast("array<long>")) if tried is None else late.join(tried.groupBy(c("b").alias("doc_id")).agg(F.collect_set("a").alias("tried")), "doc_id", "left")
        cells = lambda df, own, other, own_n, other_n: df.join(n, "two").select("two", (c("deal") % c(own_n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), c(other_n) - 1)).alias(other), "late", "doc_id", "pi", *around, "tried")
        both = cells(classes.withColumn("late", F.lit(0)).withColumn("tried", F.lit(None).cast("array<long>")), "x", "y", "nx", "ny").unionByName(cells(asked.withColumn("late", F.lit(1)), "y", "x", "ny", "nx"))
        pairs = both.repartition("two", "x", "y").sortWithinPartitions("two", "x", "y").mapInArrow(run, "two long, b long, a long, pa array<int>, pb array<int>")
        both = scratch.stage(pairs.distinct(), f"pairs{turn}")
        pairs, more = both.where("two is null").drop("two"), both.where("two is not null").select("two", c("b").alias("doc_id")).distinct()
        if pairs.isEmpty():
            break
        matches = pairs.select("a", "b", F.inline(F.arrays_zip("pa", "pb"))).distinct()
        name = f"others{turn}"
        again = scratch.stage(_new(confirmed(matches, base, scratch, name, min_words, likeness), out), f"{name}_new")
        out = scratch.stage(out.union(again), f"spans{turn}")
        seen = pairs.select("a", "b").distinct()
        tried = scratch.stage(seen if tried is None else tried.union(seen), f"tried{turn}", tidy=False)
        closed = again.select(c("doc_id").alias("s_id"), "first", "last").distinct()
        late = scratch.stage(late.join(closed, (c("doc_id") == c("s_id")) & (c("pi") >= c("first")) & (c("pj") + K <= c("last")), "left_anti").join(more, ["two", "doc_id"], "left_semi").select(late.columns), f"late{turn}")
        turn += 1
    return out


def repeated(docs: DataFrame, min_words: int = MIN_WORDS, likeness: float = LIKENESS) -> DataFrame:
    """A row for each passage of min_words or more that a document shares with one of a smaller id.

    doc_id, source_id, the span in characters in both texts, its words in doc_id and how many are matched; at least `likeness` of
    the longer side's words match. Null, empty or short texts share nothing; null doc_id: ignored. Of rows that repeat a doc_id the least text is aligned,
    and they share nothing with each other. A passage repeated within one document is not reported for that. Empty table: no rows. Other columns are not read.
    All documents that share two seeds meet, whatever their number. What may be lost: a passage with changed words, if too few of its words stand together for two seeds (the README has the measured recall); and, where
    the first documents of its seeds and runs do not hold it, a passage each two of whose seeds stand in one of the texts before, with other words around them.
    """
    return _spans(docs, min_words, likeness).select(*[x.split()[0] for x in FOUND.split(", ")]).distinct()


def _spans(docs: DataFrame, min_words: int, likeness: float) -> DataFrame:
    spark, c = docs.sparkSession, F.col
    scratch = Scratch(spark)
    base = clean_names(docs, ["doc_id", "text"]).where(c("doc_id").isNotNull() & c("text").isNotNull()).select(c("doc_id").cast("long").alias("doc_id"), "text")
    found = scratch.stage(seeds(base, min_words), "seeds")
    ends = found.groupBy("seed").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.max(F.struct("doc_id", "pos")).alias("l")).where(c("l.doc_id") > c("f.doc_id"))
    ends = scratch.stage(ends.select("seed", c("f.doc_id").alias("a"), c("f.pos").alias("pa"), c("l.doc_id").alias("z"), c("l.pos").alias("pz")), "ends")
    rest = scratch.stage(found.join(ends, "seed").drop("seed"), "rest")
    scratch.drop("seeds", "ends")
    out = confirmed(rest.where(c("doc_id") > c("a")).select("a", c("doc_id").alias("b"), "pa", c("pos").alias("pb")), base, scratch, "round0", min_words, likeness)

    # seeds whose runs do not stand in a passage that has been found
    size = run_size(min_words)
    spans = out.select(c("doc_id").alias("s_id"), "first", "last").distinct()
    open_ = rest.join(spans, (c("doc_id") == c("s_id")) & (c("pos") >= c("first")) & (c("pos") + size <= c("last")), "left_anti")
    open_ = scratch.stage(open_.where("doc_id > a").select("doc_id", "pos", "run", "z", "pz"), "open")
    to_last = open_.where("doc_id < z").select(c("doc_id").alias("a"), c("z").alias("b"), c("pos").alias("pa"), c("pz").alias("pb"))
    firsts = rest.where("run is not null").groupBy("run").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.max("doc_id").alias("last")).where(c("last") > c("f.doc_id"))
    firsts = scratch.stage(firsts.select("run", c("f.doc_id").alias("a"), c("f.pos").alias("pa")), "firsts")
    exact = open_.join(firsts, "run").where("doc_id > a").select("a", c("doc_id").alias("b"), F.inline(F.array(*[F.struct((c("pa") + o).alias("pa"), (c("pos") + o).alias("pb")) for o in (0, size - K)])))
    more = to_last.union(exact)
    again = _new(confirmed(more, base, scratch, "round1", min_words, likeness), out)
    out = scratch.stage(out.union(again), "spans")
    scratch.drop("open", "firsts", "round0", "round1")
    out = others(rest, out, base, scratch, min_words, likeness)
    scratch.drop("rest")
    return out


def _new(rows: DataFrame, old: DataFrame) -> DataFrame:
    """The rows that no old one of the same documents holds in both texts."""
    o = old.select(*[F.col(n).alias(f"o_{n}") for n in ("doc_id", "source_id", "start_char", "end_char", "source_start", "source_end")])
    same = (F.col("doc_id") == F.col("o_doc_id")) & (F.col("source_id") == F.col("o_source_id"))
    inside = (F.col("start_char") >= F.col("o_start_char")) & (F.col("end_char") <= F.col("o_end_char")) & (F.col("source_start") >= F.col("o_source_start")) & (F.col("source_end") <= F.col("o_source_end"))
    return rows.join(o, same & inside, "left_anti")


def without(docs: DataFrame, min_words: int = MIN_WORDS, likeness: float = LIKENESS) -> DataFrame:
    """The documents with every repeated passage cut out of the later document; n_chars, if there, follows.

    Null and empty texts and rows without id stay as they are. Of rows that repeat a doc_id, those with the least text are cut. Empty table: no rows.
    All columns are kept, whatever their names.
    """
    spans, cut_id, cut_mark = fresh(docs, "spans", "cut_id", "cut_mark")
    found = _spans(docs, min_words, likeness).groupBy(F.col("doc_id").alias(cut_id), F.col("mark").alias(cut_mark))
    found = found.agg(F.sort_array(F.collect_set(F.struct(F.col("start_char").alias("s"), F.col("end_char").alias("e")))).alias(spans))
    both = docs.join(found, (docs["doc_id"] == F.col(cut_id)) & (F.xxhash64(docs["text"]) == F.col(cut_mark)), "left")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    cut = F.aggregate(spans, start, lambda acc, s: F.struct(F.concat(acc["kept"], docs["text"].substr((acc["at"] + 1).cast("int"), F.greatest(F.lit(0).cast("long"), s["s"] - acc["at"]).cast("int"))).alias("kept"), F.greatest(acc["at"], s["e"]).alias("at")))
    text = F.when(F.col(spans).isNull(), docs["text"]).otherwise(F.concat(cut["kept"], docs["text"].substr((cut["at"] + 1).cast("int"), F.length(docs["text"]))))
    return both.select(*[text.alias(n) if n == "text" else F.length(text).cast(docs.schema[n].dataType).alias(n) if n == "n_chars" else docs[n] for n in docs.columns])


def op5_passages(spark, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))
