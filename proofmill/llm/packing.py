"""Packing documents into training sequences: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most `size` ids. The histogram of piece lengths has at most `size` bins, whatever the
corpus; the driver packs its bins, longest first, each onto the packs that are shortest (that have most room), keeping for each packing pattern
only a count. Pieces then find their place in a pattern by their length and their rank among the pieces of that length.
"""

from __future__ import annotations

import base64
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import Scratch, clean_names, partitions, table

END = 0  # the id that closes a document
#: Parts of one length's pieces, at most: so the counts by length and part are at most `size` times as many rows.
SALTS = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """The ids that tokenizers gives for a byte-level BPE file.

    The same vocabulary as a rank file lies beside it; its library gives the same ids about six times as fast, with the
    special token's string read as that token. Without a rank file, tokenizers itself is used.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={"<|endoftext|>": len(merges)})
        else:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(docs: DataFrame, size: int, vocabulary: str) -> DataFrame:
    """Pieces of at most `size` ids: whole runs of `size` first, then what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    out.append((doc_id.as_py(), start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return clean_names(docs, ["doc_id", "text"]).mapInArrow(run, PIECES)


def pack_histogram(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for all pieces: (length, first rank, how many, first sequence, offset), and the number of sequences.

    A pattern is a run of sequences that hold the same lengths. Bins are placed longest first; each goes onto the
    pattern with most room that fits, or opens new sequences. A pattern that is only partly used splits in two, so a
    bin adds two patterns at most for each level of filling: the number of patterns depends on `size`, not on the corpus.
    """
    places: list[tuple[int, int, int, int, int]] = []
    room: list[tuple[int, int, int]] = []  # (-free, first sequence, how many), largest free first
    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            if room and -room[0][0] >= length:
                free, first, many = heapq.heappop(room)
                free = -free
                if many > left:
                    heapq.heappush(room, (-free, first + left, many - left))
                    many = left
            else:
                free, first, many = size, sequences, left
                sequences += many
            places.append((length, rank, many, first, size - free))
            if free > length:
                heapq.heappush(room, (length - free, first, many))
            left, rank = left - many, rank + many
    return places, sequences


def pack(docs: DataFrame, size: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text: a piece with the closing id alone. Null doc_id: packed like others. Rows that repeat a doc_id are packed each. Empty table: no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    vocabulary = vocabulary or default_vocabulary()
    pieces = scratch.stage(cut(docs, size, vocabulary), "pieces")
    # ranks within a length: salted, since one length may hold a large part of all pieces
    salts = min(max(partitions(spark), 2), SALTS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    each = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = scratch.stage(each.select("length", "salt", "n", before.alias("before")), "counts")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    places, _ = pack_histogram(counts, size)
    by_length: dict[int, np.ndarray] = {}
    for length, rank, _, first, offset in places:
        by_length.setdefault(length, []).append((rank, first, offset))  # type: ignore[attr-defined]
    by_length = {k: np.array(v, np.int64) for k, v in by_length.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                at = by_length[int(x)]
                hit = at[np.searchsorted(at[:, 0], rank[rows], side="right") - 1]
                sequence[rows], offset[rows] = hit[:, 1] + rank[rows] - hit[:, 0], hit[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    number = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("number", number).join(each.select("length", "salt", "before"), ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("number") + F.col("before")).cast("long").alias("rank"))
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
