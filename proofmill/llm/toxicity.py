"""Toxicity: a chain of linear models, one for each category, in order.

Each model sees statistics of the whole text, marked words, and the probabilities of the categories before it. While
later models are trained, those probabilities are out-of-fold: no row's own label has shaped them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import stems, word_hashes
from .linear import fit, sigmoid
from .statistics import NAMES, features
from .util import Scratch, clean_names, table, text_bytes, text_slices

#: Labelled rows that models are fitted on, at most, and words that they know.
ROWS, MARKED, FOLDS = 12000, 200, 3
TURNS = 2
#: Bytes of a word's beginnings that are marked words of their own, for families of words.
STEMS = (3, 4, 5, 6)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of their beginnings, and the text of each."""
    hashes, first, end, at = word_hashes(raw, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    parts = list(stems(raw, first, end, STEMS))
    return np.concatenate([hashes, *[h for _, h in parts]]), np.concatenate([doc, *[doc[w] for w, _ in parts]])


def categories(labels: DataFrame) -> list[str]:
    """The label columns in their order, but for the id: earlier ones inform later ones. A column named toxic comes last."""
    names = [n for n, t in labels.dtypes if n != "doc_id" and t in ("int", "bigint", "smallint", "tinyint", "boolean")]
    return sorted(names, key=lambda n: n == "toxic")


def marked_words(both: DataFrame, names: list[str], scratch: Scratch, most: int = MARKED) -> np.ndarray:
    """Hashes of the words whose presence tells most about any category, over all labelled documents (text and categories): a fixed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=2 << 20):
            hashes, doc = _words(*text_bytes(batch.column("text")))
            word, inverse = np.unique(hashes, return_inverse=True)
            once = np.unique(inverse.astype(np.int64) * batch.num_rows + doc)
            which, doc = once // batch.num_rows, once % batch.num_rows
            cols = [np.bincount(which, minlength=len(word))]
            for n in names:
                y = batch.column(n).to_numpy(zero_copy_only=False)
                cols.append(np.bincount(which, y[doc] == 1, len(word)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *[pa.array(x.astype(np.int64)) for x in cols]], names=["word", "n", *names])

    totals = both.agg(F.count("*").alias("n"), *[F.sum(n).cast("long").alias(n) for n in names]).first()
    counts = both.select("text", *names).mapInArrow(run, "word long, n long, " + ", ".join(f"`{n}` long" for n in names)).groupBy("word").agg(*[F.sum(n).alias(n) for n in ("n", *names)])
    counts = scratch.stage(counts.where("n >= 5"), "counts")
    picked: set[int] = set()
    for name in names:
        p = (totals[name] or 0) / max(1, totals["n"])
        if 0 < p < 1:
            z = F.abs(F.col(name) - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p) + 1.0)
            share = most // len(names)
            picked |= {r["word"] for r in counts.orderBy(z.desc(), "word").limit(share).collect()}
    return np.sort(np.array(sorted(picked), np.int64).view(np.uint64)) if picked else np.zeros(0, np.uint64)


def inputs(batch: pa.RecordBatch, words: np.ndarray) -> np.ndarray:
    """Statistics, then for each marked word the logarithm of 1 + its occurrences."""
    raw, offsets = text_bytes(batch.column("text"))
    hashes, doc = _words(raw, offsets)
    x = np.zeros((batch.num_rows, len(words)), np.float32)
    if len(words):
        some = np.zeros(1 << 16, bool)
        some[(words >> np.uint64(48)).astype(np.int64)] = True
        maybe = some[(hashes >> np.uint64(48)).astype(np.int64)]
        hashes, doc = hashes[maybe], doc[maybe]
        place = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        hit = words[place] == hashes
        np.add.at(x, (doc[hit], place[hit]), 1)
    return np.hstack([features(raw, offsets).astype(np.float32), np.log1p(x)])


class Chain:
    """Models fitted on rows x and labels y (NaN: not known), folds by row."""

    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.names, d = names, len(NAMES)
        self.center, self.scale = x[:, :d].mean(0), x[:, :d].std(0) + 1e-6
        x = self._scaled(x)
        self.models: list[tuple[np.ndarray, np.ndarray]] = []
        for j in range(len(names)):
            known = ~np.isnan(y[:, j])
            oof = np.full(len(x), 0.5, np.float32)
            for f in range(FOLDS):
                train, rest = known & (fold != f), fold == f
                if train.any():
                    w, b = fit(x[train], y[train, j], l2=1e-4, rounds=250)
                    oof[rest] = sigmoid(x[rest] @ w + b)[:, 0]
            self.models.append(fit(x[known], y[known, j], l2=1e-4, rounds=250) if known.any() else (np.zeros((x.shape[1], 1), np.float32), np.zeros(1, np.float32)))
            x = np.hstack([x, self._told(oof)[:, None]])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        d = len(self.center)
        return np.hstack([np.clip((x[:, :d] - self.center) / self.scale, -5, 5) * 0.3, x[:, d:]]).astype(np.float32)

    @staticmethod
    def _told(p: np.ndarray) -> np.ndarray:
        return (p - 0.5).astype(np.float32)

    def predict(self, x: np.ndarray) -> np.ndarray:
        x, out = self._scaled(x), []
        for w, b in self.models:
            p = sigmoid(x @ w + b)[:, 0]
            out.append(p)
            x = np.hstack([x, self._told(p)[:, None]])
        return np.stack(out, 1)


def classify(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """A row for each document: doc_id, p_<category> for each category of labels, and <category> int (1 if that is 0.5 or more).

    Null text: empty, classified like others. Null labels are not learned from; of a repeated label row the greatest counts.
    Without any labelled document all probabilities are 0.5 and all categories 0. Models are fitted on at most `rows` labelled documents,
    chosen by a hash of their ids; the marked words come from all of them.
    """
    spark, c = docs.sparkSession, F.col
    names = categories(labels)
    known = clean_names(labels, ["doc_id", *names]).where(c("doc_id").isNotNull()).groupBy(c("doc_id").cast("long").alias("doc_id")).agg(*[F.max(c(n).cast("int")).alias(n) for n in names])
    base = clean_names(docs, ["doc_id", "text"]).select(c("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scratch = Scratch(spark)
    both = None  # labelled documents: joined once, a part of the ids at a time, so that a part's shuffle files go before the next; labels grow with the corpus, so they are never broadcast
    for turn in range(TURNS):
        own = base.where(F.pmod(F.xxhash64("doc_id"), F.lit(TURNS)) == turn).join(known.hint("merge"), "doc_id").select("doc_id", *names, "text")
        own = scratch.stage(own, f"labelled{turn}")
        both = own if both is None else both.union(own)
    words = marked_words(both, names, scratch)
    total = known.count()
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = both.where(pick < min(1.0, 1.2 * (rows + 100) / max(1, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            x = inputs(batch, words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(n) for n in names], pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], names=["doc_id", *names, "x"])

    schema = ", ".join(["doc_id long", *[f"`{n}` int" for n in names], "x binary"])
    got = some.mapInArrow(run, schema).withColumn("f", F.crc32(c("doc_id").cast("string")) % FOLDS)
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).collect()
    scratch.close()
    chain = None
    if got:
        x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), "<f4").reshape(len(got), -1)
        y = np.array([[np.nan if r[n] is None else r[n] for n in names] for r in got], float)
        chain = Chain(names, x, y, np.array([r["f"] for r in got]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            p = chain.predict(inputs(batch, words)) if chain else np.full((batch.num_rows, len(names)), 0.5)
            cols = [pa.array(p[:, j].astype(float)) for j in range(len(names))]
            flags = [pa.array(((p[:, j] >= 0.5) & (chain is not None)).astype(np.int32)) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, *flags], names=["doc_id", *[f"p_{n}" for n in names], *names])

    return base.mapInArrow(predict, ", ".join(["doc_id long", *[f"`p_{n}` double" for n in names], *[f"`{n}` int" for n in names]]))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """The categories that labels has: junk (quality 0), then toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    out = classify(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", F.col("p_toxic").alias("score"), F.col("toxic").alias("predicted"), "p_junk", "junk")
