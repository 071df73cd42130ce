"""Best-fit packing of token sequences, certified by dual-feasible functions.

Pieces of documents are dealt over partitions of bounded size, by a number of
their own, so that equal documents don't meet, and packed there by best-fit
decreasing.  A lower bound on a partition's bins from dual-feasible functions
certifies a partition whose bin count meets it.  Partitions with a gap keep
their full bins, exchange the pieces of the others and pack them again, in ever
fewer partitions, until all are certified, a round saves no bin or one partition
is left.  Each sequence says how it ended: certified by its partition's bound,
full, or neither.

Defined cases: a null text is empty and gives one piece, the separator; only a
document longer than a sequence is cut, however long it is; repeated documents
are packed each by itself, and so are rows without doc_id; of pieces of equal
length any may come first; an empty table packs to no rows; other columns of
documents don't matter, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from ..storage import written
from .tokens import tokenizer_of, vocabulary

CAPACITY = 2048
SEPARATOR = 0
#: Pieces that one task packs, about.
PARTITION_PIECES = 40_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Tokenised documents, each followed by the separator, cut into pieces of at most capacity tokens."""
    path = path or vocabulary()

    def run(batches):
        tokenizer = tokenizer_of(path)
        for batch in batches:
            for texts in textops.chunks(batch.column("text")):
                ids, to = tokenizer.encode(texts)
                doc = batch.column("doc_id").slice(texts.first, len(texts))
                n = np.diff(to) + 1
                n_pieces = -(-n // capacity)
                total = int(n_pieces.sum())
                owner = np.repeat(np.arange(len(texts)), n_pieces)
                piece = np.arange(total) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(n[owner] - start, capacity)
                flat = np.insert(ids, to[1:], np.uint32(separator)).astype("<u4")
                begin = to[:-1][owner] + owner + start
                crc = [zlib.crc32(flat[a : a + m]) for a, m in zip(begin.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, into the fullest bin that still has room."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, n = 0, 0  # a bit for each amount of room that some bin has
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            b, left, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - left
        if left > size:
            if not room[left - size]:
                open_rooms |= 1 << (left - size)
            room[left - size].append(b)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most that dual-feasible functions prove about the number of bins.

    Two families: u_k rounds a share x to floor((k + 1) x) / k unless (k + 1) x
    is whole; f_a counts pieces over capacity - a as whole, drops those under a
    and leaves the others.
    """
    return lower_bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def lower_bound_of(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """lower_bound() of count[n] pieces of length n."""
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, 21):
        scaled = size * (k + 1)
        whole = scaled % capacity == 0
        value = np.where(whole, size * k, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    n_from = np.cumsum(count[::-1])[::-1]
    mass = np.concatenate([[0], np.cumsum(count * size)])
    a = np.arange(1, capacity // 2 + 1)
    big = np.where(capacity - a + 1 <= capacity, n_from[np.minimum(capacity - a + 1, capacity)], 0)
    middle = mass[capacity - a + 1] - mass[a]
    return max(best, int((big + -(-middle // capacity)).max()))


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        used = np.bincount(bins, weights=lengths).astype(np.int64)
        certified = len(used) <= lower_bound(lengths, capacity)
        full = used[bins] == capacity
        ended = np.where(certified, "certified", np.where(full, "full", "open"))
        return pdf.assign(doc_id=pdf["doc_id"].astype("Int64"), sequence_id=int(pdf["part"].iloc[0]) * (1 << 32) + bins, offset=offsets, ended=ended).drop(columns="part")

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """The pieces with sequence_id, offset and ended (certified, full or open); items has the columns of pieces()."""
    schema = PIECES + ", row long, sequence_id long, offset long, ended string"
    todo = written(items.withColumn("row", F.monotonically_increasing_id()), "pieces")
    n = todo.count()
    done: DataFrame | None = None
    turn = number = 0
    before = None
    while True:
        parts = max(1, -(-n // partition_pieces))
        dealt = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)) + F.lit(number)
        number += parts  # sequence ids of each round are others
        packed = written(todo.withColumn("part", dealt).groupBy("part").applyInPandas(_pack(capacity), schema), f"packed-{turn}")
        again = packed.where("ended = 'open'")
        n, bins = again.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        last = parts == 1 or not n or before is not None and bins >= before
        kept = packed if last else packed.where("ended <> 'open'")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        before, turn, todo = bins, turn + 1, again.select(*todo.columns)
    return done.drop("row")


def bound_of(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """How many sequences there are, and how many the bound proves that any packing of all pieces needs: from the counts of lengths alone."""
    rows = packed.groupBy("length").agg(F.count("*")).collect()  # capacity rows at most
    count = np.zeros(capacity + 1, np.int64)
    for length, n in rows:
        count[length] = n
    return packed.where("offset = 0").count(), lower_bound_of(count, capacity)
