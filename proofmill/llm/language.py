"""Language ID by error-correcting output codes over byte n-grams.

Each language has a codeword; a linear classifier over hashed n-grams predicts each bit; the language whose codeword
loses least, bits weighted by how well they did on that language, is chosen. A choice that is not clear is flagged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .linear import fit
from .quality import held_out
from .util import clean_names, fresh, table, text_bytes, text_slices

SIZE = 4096
#: Rows of each language that are learned from, at most.
ROWS_PER_LANGUAGE = 500
#: Languages that are learned, at most (those with most rows), and rows over all of them: what the driver holds is bounded, however many values `lang` has.
LANGUAGES, ROWS = 400, 20_000
#: Parts of the rows, each left out once, for the weights of the bits.
FOLDS = 2
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def vectors(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the square roots of its n-grams' shares (of 1 to 3 bytes; what is no letter counts as a space)."""
    n = len(offsets) - 1
    b = _FOLD[raw].astype(np.uint32)
    out = np.zeros((n, SIZE), np.float32)
    grams = [b * np.uint32(2654435761)]
    if len(b) > 1:
        grams.append((b[:-1] * np.uint32(65599) + b[1:] + np.uint32(1 << 20)) * np.uint32(2246822519))
    if len(b) > 2:
        grams.append(((b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:] + np.uint32(1 << 21)) * np.uint32(3266489917))
    grams = [(g >> np.uint32(20)).astype(np.int64) for g in grams]
    for i in range(n):
        low, high = int(offsets[i]), int(offsets[i + 1])
        for k, g in enumerate(grams):
            if high - k > low:
                out[i] += np.bincount(g[low : high - k], minlength=SIZE)
    total = out.sum(1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def has_letter(texts: pa.Array) -> np.ndarray:
    raw, offsets = text_bytes(texts)
    ascii_letter = (raw >= 65) & (raw <= 122) & (_FOLD[raw] != 32)
    upto = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = upto[offsets[1:]] > upto[offsets[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(ch.isalpha() for ch in texts[i].as_py() or "")
    return out


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: all splits of up to 5 languages, else the best of some random draws, by least distance."""
    if n <= 5:
        bits = [[1] + [1 if m >> k & 1 else -1 for k in range(n - 1)] for m in range((1 << (n - 1)) - 1)]
        return np.array(bits, np.float32).T.reshape(n, -1)
    draw, best, most = np.random.default_rng(5), None, -1
    for _ in range(50):
        c = draw.choice([-1.0, 1.0], (n, 10 * math.ceil(math.log2(n)))).astype(np.float32)
        c = c[:, np.abs(c.sum(0)) < n]
        if (least := int(((c @ c.T - c.shape[1] * np.eye(n)).max() - c.shape[1]) / -2)) > most:
            best, most = c, least
    return best


class Codes:
    """Linear bits and, for each language, weights of the bits: how often they are right on its rows while a part that holds the row is left out."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        self.scale = 8.0
        fold = np.zeros(len(y), np.int64)
        for k in range(len(languages)):
            fold[y == k] = np.arange((y == k).sum()) % FOLDS
        right = np.zeros((len(y), self.code.shape[1]), bool)
        for f in range(FOLDS):
            if (fold != f).any():
                self._fit(x[fold != f], y[fold != f], 60)
                right[fold == f] = np.sign(self.margins(x[fold == f])) == self.code[y[fold == f]]
        self._fit(x, y)
        self.weight = np.stack([right[y == k].mean(0) for k in range(len(languages))])
        self.weight = (self.weight + 1e-3) / (self.weight + 1e-3).sum(1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 200) -> None:
        self.w, self.b = fit(x * self.scale, (self.code[y] > 0).astype(np.float32), l2=3e-4, rounds=rounds)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return (x * self.scale) @ self.w + self.b

    def losses(self, x: np.ndarray) -> np.ndarray:
        m = self.margins(x)
        return (np.logaddexp(0, -m[:, None, :] * self.code[None]) * self.weight[None]).sum(2)


def learn(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, modulus: int = 4, remainder: int = 2) -> Codes | None:
    """Codes from at most `rows` texts of each of the LANGUAGES commonest languages, and about ROWS over all, chosen by a hash of their ids; None without a labelled text."""
    base = clean_names(docs, ["doc_id", "text", "lang"]).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    base = base.where(~held_out(F.col("doc_id"), modulus, remainder))
    counts = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    rows = min(rows, max(20, ROWS // max(1, len(counts))))
    if not counts:
        return None
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, min(1.0, 1.5 * (rows + 20) / n)) for k, n in counts.items()], "lang string, share double")
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = base.join(F.broadcast(share), "lang").where(pick < F.col("share"))
    ids = some.select("doc_id", "lang").withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("k") <= rows)
    chosen = some.join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=1 << 20):
            x = vectors(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])

    got = chosen.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, x binary").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["lang"], bytes(r["x"])))
    languages = sorted({r["lang"] for r in got})
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), "<f2").reshape(len(got), SIZE).astype(np.float32)
    return Codes(languages, x, np.array([languages.index(r["lang"]) for r in got]))


def predict(docs: DataFrame, model: Codes | None, unclear: float = 0.5) -> DataFrame:
    """doc_id, mark (a hash of the text), lang_pred, score, ambiguous and `lettered` for each document; see identify()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=1 << 20):
            known = has_letter(batch.column("text"))
            pred = np.full(batch.num_rows, "und", object)
            score, unsure = np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            if model is not None:
                raw, offsets = text_bytes(batch.column("text"))
                for low in range(0, batch.num_rows, 512):
                    part = offsets[low : low + 513]
                    loss = model.losses(vectors(raw[part[0] : part[-1]], part - part[0])) if model.code.shape[1] else np.zeros((len(part) - 1, len(model.languages)))
                    p = np.exp(-6 * (loss - loss.min(1, keepdims=True)))
                    p /= p.sum(1, keepdims=True)
                    rows = slice(low, low + len(part) - 1)
                    pred[rows] = np.array(model.languages, object)[p.argmax(1)]
                    score[rows], unsure[rows] = p.max(1), p.max(1) < unclear
                pred[~known], score[~known], unsure[~known] = "und", 0.0, True
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(unsure), pa.array(known)], names=["doc_id", "mark", "lang_pred", "score", "ambiguous", "lettered"])

    base = clean_names(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return base.mapInArrow(run, "doc_id long, mark long, lang_pred string, score double, ambiguous boolean, lettered boolean")


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score (0 to 1) and ambiguous.

    Null text, and text without a letter: und, score 0. Without any labelled text all are und. With one language, that one is
    predicted. Null doc_id: predicted, never learned from. A repeated row is predicted each time.
    """
    out = predict(docs, learn(docs, modulus=modulus, remainder=remainder))
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents with a letter whose language is clear; where no language could be learned, all with a letter.

    Null, empty and letterless texts go. Each row is judged by its own text, whatever ids repeat; rows without id are judged like others.
    Empty table: no rows. All columns are kept, whatever their names.
    """
    model = learn(docs)
    gone_id, gone_mark = fresh(docs, "gone_id", "gone_mark")
    bad = predict(docs, model).where(~F.col("lettered") | (F.col("ambiguous") if model is not None else F.lit(False)))
    gone = bad.select(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark)).distinct()
    return docs.where(docs["text"].isNotNull()).join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs["text"]) == F.col(gone_mark)), "left_anti")


def op6_language(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
