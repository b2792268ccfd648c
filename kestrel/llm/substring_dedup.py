"""Repeated word windows, found by fixed-block anchors.

Words are runs of anything but blank and the characters U+0009 to U+000D. Every
window of ``window`` consecutive words whose word sequence also starts anywhere
else, in another document or the same, is a repeat; the words that repeats
cover are removed. Windows are judged on the input.

1. Reference blocks: the non-overlapping blocks of ``(window + 1) // 2`` words
   of each document. Every window holds at least one of its own document's
   blocks whole, the first of which is the window's anchor.
2. Index and probes: the blocks' hashes are the index, and the hashes of all
   rolling windows of a block's length probe it. A block whose words start
   only once in the whole input is no anchor of a repeat.
3. Extension: every window around a block that was hit is compared, by a
   128-bit hash of its words, with the extensions of all other hits. Windows
   that agree are repeats, and runs of them are the maximal exact repeats.

Documents are gathered into chunks of about ``chunk_bytes`` of text (a longer
document is one of its own), one row each, and a chunk's hashes go into ``parts``
hash ranges: one row per (chunk, range) with sorted, distinct hashes as
bytes. A range is answered by one bit per block (or window) asked, so that a
passage of a million copies sends one hash per chunk to its range, never a row
per copy, and no pairs are made. Ranges grow in number with the input. The
answers, a bit per block, are one string of bytes per chunk. They are broadcast while their checked size is at most
``broadcast_bytes``, and meet the chunks by a shuffle beyond it, where the answers are hashed and no chunk is sorted.

Step 2 keeps 32 bits of a hash inside its range: a chance agreement there only
makes a window an extension that step 3 refuses. In step 3 different word
sequences pass for equal only if both 64-bit hashes agree.

Defined results: null, empty and shorter texts have no windows and lose
nothing (null has no words and keeps an empty text); copies and repeated rows
are repeats of each other; an empty table gives no rows. Other columns are
ignored. Memory: one chunk, or one hash range, per task; a row group of the chunks' table holds few of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from kestrel.llm.common import materialize, releasing, small_batches

CHUNK_BYTES = 2 << 20
ROW_GROUP_BYTES = 16 << 20  # so that a writer and a reader hold few chunks at once
ARROW_BYTES = 4 << 20      # of chunks handed to a Python task at once
RANGE_BYTES = 16 << 20     # of text for each hash range
BROADCAST_BYTES = 32 << 20
_PIECE = 4 << 20
_SPACE = re.compile(rb"[ \t-\r]")
# Odd multipliers of the rolling hashes.
_BLOCK_M, _WINDOW_M, _SECOND_M = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of some megabytes, cut at white space."""
    at = 0
    while len(text) - at > _PIECE:
        gap = _SPACE.search(text, at + _PIECE)
        if gap is None:
            break
        yield text[at:gap.start()]
        at = gap.start()
    yield text[at:] if at else text


def word_hashes(text: bytes) -> np.ndarray:
    parts = []
    for piece in pieces(text):
        words = piece.split()
        parts.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def rolling(values: np.ndarray, length: int, multiplier: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every run of ``length`` values."""
    if len(values) < length:
        return np.empty(0, np.uint64)
    m = np.uint64(multiplier)
    powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(values) - 1, m))])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * powers, dtype=np.uint64)])
    back = np.uint64(pow(multiplier, -1, 1 << 64))
    n = len(values) - length + 1
    inverse = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, back))])
    return (sums[length:] - sums[:n]) * inverse


def _mixed(x: np.ndarray) -> np.ndarray:
    """A second hash of each word from its first."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _answer(part: int, flags: np.ndarray) -> bytes:
    """The answer of a hash range to a chunk, which several can follow: the range and a bit per question."""
    return part.to_bytes(4, "little") + _bits(flags)


def _answered(answers: bytes | None, cuts: list[int]) -> np.ndarray:
    """The flags of all ranges of a chunk; ``cuts``: where the questions of each range begin."""
    out = np.zeros(cuts[-1], bool)
    at = 0
    while answers and at < len(answers):
        part = int.from_bytes(answers[at:at + 4], "little")
        n = cuts[part + 1] - cuts[part]
        end = at + 4 + (n + 7) // 8
        out[cuts[part]:cuts[part + 1]] = _flags(answers[at + 4:end], n)
        at = end
    return out


def _sorted_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    return among[np.minimum(at, len(among) - 1)] == values


def _distinct(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and whether each occurs twice or more."""
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])[:len(ordered)]
    at = np.flatnonzero(first)
    return ordered[at], np.diff(np.append(at, len(ordered))) > 1


class Chunk:
    """Word hashes of a chunk's documents, laid end to end."""

    def __init__(self, texts: pa.Array, window: int, parts: int):
        self.window, self.block, self.parts = window, (window + 1) // 2, parts
        each = [word_hashes(t.as_buffer().to_pybytes()) if t.is_valid else np.empty(0, np.uint64)
                for t in texts.cast(pa.large_binary())]
        self.counts = np.array([len(x) for x in each], np.int64)
        # Shorter documents have no window: they are left out.
        self.long = np.flatnonzero(self.counts >= window)
        self.words = np.concatenate([each[k] for k in self.long]) if len(self.long) else np.empty(0, np.uint64)
        n = self.counts[self.long]
        self.starts = np.cumsum(n) - n
        self.place = np.arange(len(self.words)) - np.repeat(self.starts, n)
        self.left = np.repeat(n, n) - self.place           # words from here to the end of the document
        hashes = rolling(self.words, self.block, _BLOCK_M)
        whole = self.left[:len(hashes)] >= self.block
        keys = ((hashes >> _HALF) % np.uint64(parts) << _HALF) | (hashes & _LOW)
        self.probe_keys, self.probe_twice = _distinct(np.sort(keys[whole]))
        self.blocks = np.flatnonzero(whole & (self.place[:len(hashes)] % self.block == 0))
        self.block_keys = keys[self.blocks]
        self.index_keys = _distinct(np.sort(self.block_keys))[0]

    def _cuts(self, keys: np.ndarray) -> list[int]:
        return np.searchsorted(keys, np.arange(self.parts + 1, dtype=np.uint64) << _HALF).tolist()

    def probes(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(range, probes, which of them start twice here, blocks) for every range."""
        a, b = self._cuts(self.probe_keys), self._cuts(self.index_keys)
        low, blocks = (self.probe_keys & _LOW).astype("<u4"), (self.index_keys & _LOW).astype("<u4")
        for p in range(self.parts):
            if a[p] < a[p + 1]:
                yield (p, low[a[p]:a[p + 1]].tobytes(), _bits(self.probe_twice[a[p]:a[p + 1]]), blocks[b[p]:b[p + 1]].tobytes())

    def extend(self, answers: bytes | None) -> None:
        """The windows whose anchor block was hit, with their two hashes; answers: a bit per block."""
        hit = _answered(answers, self._cuts(self.index_keys))
        struck = np.zeros(len(self.words), bool)
        struck[self.blocks] = _sorted_in(self.block_keys, self.index_keys[hit])
        here = np.flatnonzero(self.left >= self.window)
        place = self.place[here]
        anchor = here - place + -(-place // self.block) * self.block
        self.open = here[struck[anchor]]
        h1, h2 = np.empty(0, np.uint64), np.empty(0, np.uint64)
        if len(self.open):
            h1 = rolling(self.words, self.window, _WINDOW_M)[self.open]
            h2 = rolling(_mixed(self.words), self.window, _SECOND_M)[self.open]
        part = (h1 >> _HALF) % np.uint64(self.parts)
        order = np.lexsort((h2, h1, part))
        h1, h2, part = h1[order], h2[order], part[order]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])[:len(h1)]
        at = np.flatnonzero(new)
        self.twice = np.diff(np.append(at, len(h1))) > 1
        self.pairs = np.stack([h1[at], h2[at]], axis=1)
        self.pair_cuts = np.searchsorted(part[at], np.arange(self.parts + 1)).tolist()
        self.which = np.empty(len(order), np.int64)         # of each open window, its distinct pair
        self.which[order] = np.cumsum(new) - 1

    def extensions(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(range, hash pairs, which of them start twice here)."""
        for p, (a, b) in enumerate(zip(self.pair_cuts, self.pair_cuts[1:], strict=False)):
            if a < b:
                yield p, self.pairs[a:b].astype("<u8").tobytes(), _bits(self.twice[a:b])

    def covered(self, answers: bytes | None) -> np.ndarray:
        """Whether each word lies in a repeat; answers: a bit per hash pair."""
        again = _answered(answers, self.pair_cuts)
        at = self.open[again[self.which]]
        edge = np.zeros(len(self.words) + self.window + 1, np.int64)
        edge[at] += 1
        edge[at + self.window] -= 1
        return np.cumsum(edge)[:len(self.words)] > 0


def _answer_probes(table: pa.Table) -> pa.Table:
    """Of one hash range: per chunk a bit for each of its blocks whose words start anywhere else."""
    probes = [np.frombuffer(b.as_buffer(), "<u4") for b in table["probes"]]
    twice = [p[_flags(b.as_py(), len(p))] for p, b in zip(probes, table["twice"], strict=True)]
    ordered = np.sort(np.concatenate(probes))
    repeated = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], *twice]))
    chunk, bits = [], []
    for c, p, b in zip(table["chunk"].to_pylist(), table["part"].to_pylist(), table["blocks"], strict=True):
        hit = _sorted_in(np.frombuffer(b.as_buffer(), "<u4"), repeated)
        if hit.any():
            chunk.append(c)
            bits.append(_answer(p, hit))
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "bits": pa.array(bits, pa.binary())})


def _answer_extensions(table: pa.Table) -> pa.Table:
    """Of one hash range: per chunk a bit for each of its hash pairs that starts anywhere else."""
    pairs = [np.frombuffer(b.as_buffer(), "<u8").reshape(-1, 2) for b in table["pairs"]]
    sizes = [len(p) for p in pairs]
    twice = np.concatenate([_flags(b.as_py(), n) for b, n in zip(table["twice"], sizes, strict=True)])
    first, second = np.concatenate([p[:, 0] for p in pairs]), np.concatenate([p[:, 1] for p in pairs])
    order = np.lexsort((second, first))
    first = first[order]
    new = np.concatenate([[True], first[1:] != first[:-1]])
    del first
    second = second[order]
    new[1:] |= second[1:] != second[:-1]
    del second
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(order)))
    again = (times > 1) | np.logical_or.reduceat(twice[order], at)
    flags = np.empty(len(order), bool)
    flags[order] = np.repeat(again, times)
    chunk, bits = [], []
    for c, p, f in zip(table["chunk"].to_pylist(), table["part"].to_pylist(), np.split(flags, np.cumsum(sizes)[:-1]), strict=True):
        if f.any():
            chunk.append(c)
            bits.append(_answer(p, f))
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "bits": pa.array(bits, pa.binary())})


def _chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """One row per chunk: chunk, ids, texts."""
    kind = docs.schema[id_col].dataType

    @releasing
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, task = 0, None

        def row() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            lists = {"chunk": pa.array([first])}
            for name in ("ids", "texts"):
                values = whole[name].chunk(0) if whole[name].num_chunks else whole[name].combine_chunks()
                lists[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_pydict(lists)

        for batch in batches:
            lengths = batch["length"].to_pylist()
            at = 0
            for k, n in enumerate(lengths):
                if not held and at == k:
                    first = batch["rid"][k].as_py()
                size += n + 16
                if size >= chunk_bytes:
                    held.append(batch.slice(at, k + 1 - at).select(["ids", "texts"]))
                    yield row()
                    held, size, at = [], 0, k + 1
            if at < batch.num_rows:
                held.append(batch.slice(at).select(["ids", "texts"]))
        if held:
            yield row()

    rows = docs.select(F.col(f"`{id_col}`").alias("ids"), F.col(f"`{text_col}`").alias("texts"),
                       F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).alias("length"),
                       F.monotonically_increasing_id().alias("rid"))
    return rows.mapInArrow(gather, f"chunk long, ids array<{kind.simpleString()}>, texts array<string>")


def _met(chunks: DataFrame, answers: DataFrame, name: str, broadcast_bytes: int) -> DataFrame:
    """``chunks`` with the answers of each, laid end to end; small ones (a checked size) are broadcast."""
    size, found = answers.agg(F.sum(F.octet_length("bits")), F.count_distinct("chunk")).first()
    rows = answers.groupBy(F.col("chunk").alias("of")).agg(F.listagg("bits").alias(name))
    # Else hashed, not merged: a merge would sort the chunks, megabytes each.
    rows = rows.hint("broadcast" if (size or 0) + 64 * found <= broadcast_bytes else "shuffle_hash")
    return chunks.join(rows, F.col("chunk") == F.col("of"), "left").drop("of")


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text",
                   chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES,
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (removed words, flat start, end, ...), kept (the
    words that stay, joined by one blank)."""
    small_batches(docs.sparkSession, ARROW_BYTES)
    chunks = materialize(_chunked(docs, id_col, text_col, chunk_bytes), "chunks", row_group=ROW_GROUP_BYTES,
                         group_rows=max(1, ROW_GROUP_BYTES // chunk_bytes))
    size = chunks.agg(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda s, t: s + F.coalesce(F.octet_length(t), F.lit(0))))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // range_bytes + 1)
    kind = docs.schema[id_col].dataType.simpleString()

    @releasing
    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, chunk in enumerate(batch["chunk"].to_pylist()):
                rows = list(Chunk(batch["texts"][k].values, window, parts).probes())
                if rows:
                    part, keys, twice, blocks = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([chunk] * len(rows), pa.int64()), "part": pa.array(part, pa.int32()),
                        "probes": pa.array(keys, pa.binary()), "twice": pa.array(twice, pa.binary()),
                        "blocks": pa.array(blocks, pa.binary())})

    asked = chunks.select("chunk", "texts").mapInArrow(
        probes, "chunk long, part int, probes binary, twice binary, blocks binary")
    hits = materialize(asked.groupBy("part").applyInArrow(_answer_probes, "chunk long, bits binary"), "block-hits")
    struck = _met(chunks, hits, "hits", broadcast_bytes)

    @releasing
    def extensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, chunk in enumerate(batch["chunk"].to_pylist()):
                found = Chunk(batch["texts"][k].values, window, parts)
                found.extend(batch["hits"][k].as_py())
                rows = list(found.extensions())
                if rows:
                    part, pairs, twice = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([chunk] * len(rows), pa.int64()), "part": pa.array(part, pa.int32()),
                        "pairs": pa.array(pairs, pa.binary()), "twice": pa.array(twice, pa.binary())})

    wide = struck.filter(F.col("hits").isNotNull()).select("chunk", "texts", "hits").mapInArrow(
        extensions, "chunk long, part int, pairs binary, twice binary")
    repeats = materialize(wide.groupBy("part").applyInArrow(_answer_extensions, "chunk long, bits binary"), "repeats")

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                texts = batch["texts"][k].values
                found = Chunk(texts, window, parts)
                found.extend(batch["hits"][k].as_py())
                gone = found.covered(batch["repeats"][k].as_py())
                at = dict(zip(found.long.tolist(), found.starts.tolist(), strict=True))
                ids, counts = batch["ids"][k].values, found.counts
                removed, spans, kept, first, held = [], [], [], 0, 0
                for d, text in enumerate(texts.cast(pa.large_binary())):
                    words = text.as_py().split() if text.is_valid else []
                    lost = gone[at[d]:at[d] + len(words)] if d in at else np.zeros(0, bool)
                    removed.append(int(lost.sum()))
                    if removed[-1]:
                        spans.append(np.flatnonzero(np.diff(np.concatenate([[0], lost.view(np.int8), [0]]))))
                        words = compress(words, ~lost)
                    else:
                        spans.append(np.empty(0, np.int64))
                    kept.append(b" ".join(words))
                    held += len(kept[-1])
                    if held >= _PIECE or d == len(counts) - 1:
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": ids.slice(first, d + 1 - first), "n_words": pa.array(counts[first:d + 1]),
                            "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())),
                            "kept": pa.array(kept, pa.binary()).cast(pa.string())})
                        removed, spans, kept, first, held = [], [], [], d + 1, 0

    done = _met(struck, repeats, "repeats", broadcast_bytes)
    return done.select("chunk", "ids", "texts", "hits", "repeats").mapInArrow(
        cut, f"doc_id {kind}, n_words long, n_removed long, spans array<long>, kept string")
