"""Sum-of-squares packing of documents into sequences of bounded length.

A document is its token ids plus an end id. One longer than the capacity is
cut into pieces of full length, the first piece taking the remainder; nothing
else is cut. Full pieces are sequences of their own. Every other piece goes
where it makes the sum over residual gaps of (number of open sequences with
that gap) squared smallest: into an open sequence, or a new one. Pieces come
longest first; equal choices take the tighter gap.

Texts are tokenised once, and only one narrow row per piece (length, checksum)
is kept and shuffled. Packing runs in groups of about ``group_pieces`` pieces
drawn by hash, so that no source or length meets in one group; a group holds
enough pieces that its last open sequences hardly count. An empty or null text
is a document of the end id alone; an empty table gives no rows; repeated rows
are packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import bounded_batches, materialize, releasing
from kestrel.llm.tokens import Encoder, encoded, frequent_pieces

_PIECES = "doc_id {id}, rid long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, placed in the given order."""
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)  # of open bins by gap; gap 0 and a fresh bin do not count
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        # Change of the sum, over 2 and less 1/2, for bins of gap s, s + 1, ..., capacity (a new one).
        change = count[:capacity - s + 1] - count[s:] + 0.5
        change[0] = -count[s]
        change[count[s:] == 0] = np.inf
        change[capacity - s] = count[capacity - s] if s < capacity else -0.5
        gap = s + int(change.argmin())
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_by_gap[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_by_gap[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, rid, piece, start, length, ids_crc32 (unsigned, little-endian 32-bit ids)."""

    known = frequent_pieces(docs, tokenizer, text_col)

    @releasing
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer, known.value)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(encoded(batch["text"], encoder)):
                data = memoryview(np.append(ids, np.uint32(end_id)).astype("<u4")).cast("B")
                at = 0
                for p, n in enumerate(cut_lengths(len(ids) + 1, capacity)):
                    doc.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * at:4 * (at + n)]))
                    at += n
            rows = batch[["doc_id", "rid"]].iloc[doc].reset_index(drop=True)
            yield rows.assign(piece=piece, start=start, length=length, ids_crc32=crc)

    bounded_batches()
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
                        F.col(text_col).alias("text"))
            .mapInPandas(pieces, _PIECES.format(id=kind)))


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = 200_000) -> DataFrame:
    """``pieces`` (a written table, with ``rid``, ``piece``, ``length``) with sequence_id and offset."""
    full = pieces.filter(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = pieces.filter(F.col("length") < capacity)
    groups = small.count() // group_pieces + 1

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "rid", "piece"], ascending=[False, True, True])
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=rows["pack_group"].astype("int64") * (1 << 32) + bins, offset=offsets).drop(
            columns="pack_group")

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    packed = (small.withColumn("pack_group", F.pmod(F.xxhash64("rid", "piece"), F.lit(groups)).cast("int"))
              .groupBy("pack_group").applyInPandas(place, out))
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048,
                   id_col: str = "doc_id", text_col: str = "text", group_pieces: int = 200_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs``."""
    pieces = materialize(cut_documents(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    return pack(pieces, capacity, group_pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
