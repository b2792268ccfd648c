"""Token-id files: blocks of an adaptive context-mixing range coder.

A block holds whole documents: a header, their doc_ids and id counts, and the
coded ids. It is coded with a model that starts empty in every block and is
protected by checksums, so blocks are read on their own and in any order.

Coding. The ids of a block lie in lanes side by side, and one step codes the
next id of every lane, so that numpy does the work of all lanes at once. The
probability of an id mixes three predictions: the id that last followed the
two ids before (order 2, hashed), the id that last followed the id before
(order 1), and the id frequencies so far (order 0). The mixing weights are
learnt: they are the hit rates, so far, of the order-2 and order-1 predictions
given how often either was right before. Each lane has a 64-bit range coder
that gives out 32-bit words (a carry is added to the words before at the end); after a step the model learns the step's ids. The decoder repeats the
same steps.

File layout. A corpus is a Parquet table with one block a row (part, block,
n_ids, data), written by Spark's committer, so that any store and a retried
task are safe; ``part`` and ``block`` ascend with doc_id (null first, ties by
a text hash). Block bytes, little-endian:
``KTK2``, vocabulary u32, documents u32, ids u64, lanes u32, crc32 of the ids
u32, then per document id i64, null flag u8 and count u64, per lane the number of
words u32, the words u32, and the crc32 of all that u32.
A null or empty text is a document of the end id alone; an empty table gives a
table without rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.common import bounded_batches, materialize, releasing
from kestrel.llm.tokens import Encoder, encoded, frequent_pieces

MAGIC = b"KTK2"
_HEAD = struct.Struct("<4sIIQII")
BLOCK_IDS = 2_000_000
MOST_LANES = 4096
LEAST_STEPS = 256          # a lane of fewer ids would cost more than it saves
MIX = 1 << 12              # sum of the mixing weights
ORDER0 = 1 << 18           # sum of the order-0 frequencies
BITS2 = 20                 # of the hash of the two ids before
HITS_ALL = 200_000         # beyond so many ids, the hits of every fourth step are counted
_SHIFT = np.uint64(30)     # MIX * ORDER0 = 2 ** 30: intervals are 32-bit numbers
_WORD = np.uint64(32)
_WORD_END = np.uint64(1 << 32)
_HASH2, _HASH1 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
# An entry of the order-2 and order-1 tables is an id and how often in a row it was right (up to 7).
_RUN = np.uint32(7)
_RUN_BITS = np.uint32(3)
_ONE = np.uint32(1)


class Model:
    """Shared adaptive model of a block's lanes."""

    def __init__(self, vocabulary: int):
        self.vocabulary = vocabulary
        self.seen = np.zeros(vocabulary, np.int64)
        self.total = self.steps = 0
        self.recent: list[np.ndarray] = []  # ids that the frequencies do not count yet
        self.last1 = np.zeros(vocabulary, np.uint32)
        self.last2 = np.zeros(1 << BITS2, np.uint32)
        self.hits = np.tile(np.array([1, 1, 2], np.int64), (64, 1))
        self.weigh_at = 0
        self._count()
        self._weigh()

    def _count(self) -> None:
        """Order-0 frequencies, renewed whenever a quarter more ids (at most 200,000) have been seen."""
        if self.recent:
            self.seen += np.bincount(np.concatenate(self.recent), minlength=self.vocabulary)
            self.recent = []
        freq = 1 + self.seen * (ORDER0 - self.vocabulary) // max(1, self.total)
        freq[self.seen.argmax()] += ORDER0 - int(freq.sum())
        self.freq, self.upto = freq.astype(np.uint32), (np.cumsum(freq) - freq).astype(np.uint32)
        self.held = None  # the id of each of the ORDER0 frequency units, laid out by a decoder only
        self.refresh_at = self.total + min(200_000, self.total // 4 + 1000)

    def _weigh(self) -> None:
        """Weights of order 2, 1 and 0, renewed whenever a tenth more ids (at most 20,000) have been seen."""
        weights = 1 + (MIX - 3) * self.hits // self.hits.sum(axis=1, keepdims=True)
        weights[:, 2] += MIX - weights.sum(axis=1)
        # What order 2 and 1 add to their ids, and what each frequency unit counts.
        self.weights = [w.astype(np.uint32) for w in (weights[:, 0] * ORDER0, weights[:, 1] * ORDER0, weights[:, 2])]
        self.weigh_at = self.total + min(20_000, self.total // 10 + 1000)

    def predict(self, two: np.ndarray, one: np.ndarray) -> None:
        """Predicted ids of order 2 and 1, and the weights of order 2, 1 and 0, for each lane."""
        self.slot = ((two * _HASH2 ^ one * _HASH1) * _HASH2 >> np.uint32(32 - BITS2)).astype(np.intp)
        self.one = one.astype(np.intp)
        entry2, entry1 = self.last2.take(self.slot), self.last1.take(self.one)
        self.p2, self.p1 = entry2 >> _RUN_BITS, entry1 >> _RUN_BITS
        self.run2, self.run1 = entry2 & _RUN, entry1 & _RUN
        self.kind = (self.run2 << _RUN_BITS | self.run1).astype(np.intp)
        self.w2, self.w1, self.w0 = [w.take(self.kind) for w in self.weights]

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each lane's id, of 2 ** 30 in all."""
        self.hit2, self.hit1 = ids == self.p2, ids == self.p1
        at = ids.astype(np.intp)
        start, size = self.upto.take(at), self.freq.take(at)
        start *= self.w0
        size *= self.w0
        size += self.w2 * self.hit2
        size += self.w1 * self.hit1
        start += self.w2 * (self.p2 < ids)
        start += self.w1 * (self.p1 < ids)
        return start, size

    def find(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals hold the places, and the starts and sizes of these."""
        p2, p1 = self.p2.astype(np.intp), self.p1.astype(np.intp)
        start2, start1 = self.upto.take(p2), self.upto.take(p1)
        size2, size1 = self.freq.take(p2), self.freq.take(p1)
        for x in (start2, start1, size2, size1):
            x *= self.w0
        start2 += self.w1 * (self.p1 < self.p2)
        start1 += self.w2 * (self.p2 < self.p1)
        same = self.p1 == self.p2
        size2 += self.w2
        size2 += self.w1 * same
        size1 += self.w1
        size1 += self.w2 * same
        self.hit2, self.hit1 = place - start2 < size2, place - start1 < size1  # a place before it: far beyond, without a sign
        ids = np.where(self.hit2, self.p2, self.p1)
        start, size = np.where(self.hit2, start2, start1), np.where(self.hit2, size2, size1)
        # Neither: what the two add to the ids behind them is taken off.
        miss = (~(self.hit2 | self.hit1)).nonzero()[0]
        place, w0 = place.take(miss), self.w0.take(miss)
        added = self.w2.take(miss) * (place >= start2.take(miss))
        added += self.w1.take(miss) * (place >= start1.take(miss))
        if self.held is None:
            self.held = np.repeat(np.arange(self.vocabulary, dtype=np.uint32), self.freq)
        found = self.held.take((place - added) // w0)
        ids[miss], start[miss], size[miss] = found, self.upto.take(found) * w0 + added, self.freq.take(found) * w0
        return ids, start, size

    def learn(self, ids: np.ndarray) -> None:
        """Take in the ids last given to :meth:`interval` or got from :meth:`find`."""
        if self.total < HITS_ALL or not self.steps % 4:
            outcome = self.hit2.view(np.uint8) * np.uint8(2) | self.hit1.view(np.uint8)
            seen = np.bincount(self.kind << 2 | outcome, minlength=256).reshape(64, 4)
            self.hits[:, 0] += seen[:, 2] + seen[:, 3]
            self.hits[:, 1] += seen[:, 1]
            self.hits[:, 2] += seen[:, 0]
        self.steps += 1
        entry = ids << _RUN_BITS
        for last, at, run, hit in ((self.last2, self.slot, self.run2, self.hit2), (self.last1, self.one, self.run1, self.hit1)):
            run += _ONE
            run -= run >> _RUN_BITS
            run *= hit
            run |= entry
            last[at] = run
        self.recent.append(ids)
        self.total += len(ids)
        if self.total >= self.refresh_at:
            self._count()
        if self.total >= self.weigh_at:
            self._weigh()


def _shape(n: int) -> tuple[int, int]:
    """(lanes, steps) for ``n`` ids; only the last lane may be shorter."""
    steps = max(LEAST_STEPS, -(-n // MOST_LANES))
    return -(-n // steps), steps


def _carry(words: np.ndarray, over: np.ndarray) -> None:
    """Add one to the word before each of ``over``, and on to those before where a word is full (32 bits in uint64)."""
    while len(over):
        np.add.at(words, over - 1, np.uint64(1))
        over = np.flatnonzero(words >> _WORD)
        words[over] -= _WORD_END


def code(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(words per lane, words of all lanes one after the other) of the coded ids."""
    lanes, steps = _shape(len(ids))
    table = np.zeros(lanes * steps, np.uint32)
    table[:len(ids)] = ids
    table = np.ascontiguousarray(table.reshape(lanes, steps).T)
    last = len(ids) - (lanes - 1) * steps  # ids of the last lane
    model = Model(vocabulary)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0), np.uint64)
    one = two = np.zeros(lanes, np.uint32)
    of, words = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint32)]
    given = np.zeros(lanes, np.int64)  # words
    carried, before = [], []           # lanes with a carry, and their words until then
    for t in range(steps if lanes else 0):
        n = lanes if t < last else lanes - 1
        if not n:
            break
        x = table[t, :n]
        model.predict(two[:n], one[:n])
        start, size = model.interval(x)
        unit = span[:n] >> _SHIFT
        start = start * unit
        np.multiply(size, unit, out=span[:n])
        low[:n] += start
        over = (low[:n] < start).nonzero()[0]
        carried.append(over)
        before.append(given.take(over))
        at = (span[:n] < _WORD_END).nonzero()[0]
        lo = low.take(at)
        of.append(at.astype(np.uint16))
        words.append((lo >> _WORD).astype(np.uint32))
        low[at] = lo << _WORD
        span[at] <<= _WORD
        given[at] += 1
        two, one = one, x
        model.learn(x)
    for part in (low >> _WORD, low):  # the rest of each coder
        of.append(np.arange(lanes, dtype=np.uint16))
        words.append(part.astype(np.uint32))
    of = np.concatenate(of)
    per_lane = np.bincount(of, minlength=lanes)
    words = np.concatenate(words)[np.argsort(of, kind="stable")].astype(np.uint64)
    if carried:
        _carry(words, (np.cumsum(per_lane) - per_lane)[np.concatenate(carried)] + np.concatenate(before))
    return per_lane.astype(np.uint32), words.astype(np.uint32)


def decode(per_lane: np.ndarray, words: np.ndarray, n_ids: int, vocabulary: int) -> np.ndarray:
    """The ids that :func:`code` was given."""
    lanes, steps = _shape(n_ids)
    if lanes != len(per_lane):
        raise ValueError("number of lanes does not fit the number of ids")
    last = n_ids - (lanes - 1) * steps
    words = np.concatenate([words, np.zeros(2, np.uint32)])
    at = np.cumsum(per_lane, dtype=np.int64) - per_lane
    model = Model(vocabulary)
    span = np.full(lanes, ~np.uint64(0), np.uint64)
    rest = words[at].astype(np.uint64) << _WORD | words[at + 1]  # the coded value less the coder's low end
    at += 2
    table = np.zeros((steps, lanes), np.uint32)
    one = two = np.zeros(lanes, np.uint32)
    for t in range(steps if lanes else 0):
        n = lanes if t < last else lanes - 1
        if not n:
            break
        model.predict(two[:n], one[:n])
        unit = span[:n] >> _SHIFT
        x, start, size = model.find((rest[:n] // unit).astype(np.uint32))
        table[t, :n] = x
        rest[:n] -= start * unit
        np.multiply(size, unit, out=span[:n])
        k = (span[:n] < _WORD_END).nonzero()[0]
        next_word = at.take(k)
        rest[k] = rest.take(k) << _WORD | words.take(next_word, mode="clip")
        span[k] <<= _WORD
        at[k] = next_word + 1
        two, one = one, x
        model.learn(x)
    return table.T.reshape(-1)[:n_ids]


def write_block(docs: list[tuple[int | None, np.ndarray]], vocabulary: int) -> bytes:
    """One block of documents (doc_id, ids)."""
    ids = np.concatenate([x for _, x in docs]).astype("<u4")
    per_lane, words = code(ids, vocabulary)
    body = b"".join((
        _HEAD.pack(MAGIC, vocabulary, len(docs), len(ids), len(per_lane), zlib.crc32(ids.tobytes())),
        np.array([d or 0 for d, _ in docs], "<i8").tobytes(), np.array([d is None for d, _ in docs], "u1").tobytes(),
        np.array([len(x) for _, x in docs], "<u8").tobytes(), per_lane.astype("<u4").tobytes(), words.astype("<u4").tobytes()))
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    """The documents of a block; an error if any checksum is wrong."""
    body = data[:-4]
    if data[:4] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(body):
        raise ValueError("damaged token block")
    _, vocabulary, n, n_ids, lanes, check = _HEAD.unpack_from(body)
    at = _HEAD.size
    parts = []
    for kind, count in (("<i8", n), ("u1", n), ("<u8", n), ("<u4", lanes)):
        parts.append(np.frombuffer(body, kind, count, at))
        at += parts[-1].nbytes
    doc_ids, null, counts, per_lane = parts
    ids = decode(per_lane, np.frombuffer(body, "<u4", offset=at), n_ids, vocabulary)
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("token block does not decode to its ids")
    cuts = np.cumsum(counts.astype(np.int64))[:-1]
    return [(None if z else int(d), x) for d, z, x in zip(doc_ids, null, np.split(ids, cuts), strict=True)]


def write_corpus(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int = 2,
                 block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write them to ``path`` in ascending order of doc_id."""

    known = frequent_pieces(docs, tokenizer, text_col)

    @releasing
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int | None, np.ndarray]] = []
        size = number = 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "block": [number], "n_ids": [size], "data": [write_block(held, vocabulary)]})

        part, encoder = 0, Encoder(tokenizer, known.value)
        for batch in batches:
            for doc, slice_no, ids in zip(batch["doc_id"].astype(object), batch["part"], encoded(batch["text"], encoder),
                                          strict=True):
                part = int(slice_no)
                held.append((None if pd.isna(doc) else int(doc), np.append(ids, np.uint32(end_id))))
                size += len(ids) + 1
                if size >= block_ids:
                    yield row()
                    held, size, number = [], 0, number + 1
        if held:
            yield row()

    bounded_batches()
    order = ["doc_id", F.xxhash64("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    (rows.mapInPandas(blocks, "part int, block int, n_ids long, data binary")
     .write.option("parquet.block.size", 16 << 20).parquet(path))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files at ``path``: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (unsigned, of the ids as little-endian 32-bit integers)."""

    @releasing
    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, block, data in zip(batch["part"], batch["block"], batch["data"], strict=True):
                docs = read_block(data)
                n = np.array([len(x) for _, x in docs], np.int64)
                yield pd.DataFrame({
                    "doc_id": pd.array([d for d, _ in docs], "Int64"), "part": part, "block": block,
                    "inside": np.cumsum(n) - n, "n_tokens": n,
                    "ids_crc32": [zlib.crc32(x.astype("<u4", copy=False)) for _, x in docs]})

    files = spark.read.schema("part int, block int, n_ids long, data binary").parquet(path)
    # Ids before each part (one row per part) and, inside it, before each block.
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("before_part"))
    starts = files.select("part", "block", F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("block")), F.lit(0))
                          .alias("before_block")).join(parts, "part")
    rows = files.select("part", "block", "data").mapInPandas(
        documents, "doc_id long, part int, block int, inside long, n_tokens long, ids_crc32 long")
    return rows.join(materialize(starts, "block-starts"), ["part", "block"]).select(
        "doc_id", (F.col("before_part") + F.col("before_block") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
