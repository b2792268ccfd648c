"""SimHash near-dedup by a binary trie self-join over 64-bit fingerprints.

Fingerprint: lower-case A-Z, split into words at ASCII white space, hash every
run of ``shingle`` words (XXH64, seed 42; fewer words: the whole sequence), set
a bit where more than half of the hashes have it. No words (also a null or
empty text): fingerprint zero, linked like any other.

Links: two fingerprints at ``max_bits`` or fewer differing bits. Equal
fingerprints are one trie leaf, so copies are never expanded into pairs.

The trie is dealt out over tasks by exact roots. The 64 bits are cut into
blocks; fingerprints that differ in at most ``max_bits`` bits agree in at least
``blocks - max_bits`` whole blocks, so for every choice of that many blocks the
chosen bits form the top of one trie, below which the error budget is still
whole. A root with more than ``node_rows`` fingerprints is dealt out further,
as pairs of its nodes some levels below whose prefixes are within the budget.
Inside a task the tries of many roots are walked together: node pairs go down a
level, collect a differing bit where they part, and are dropped once over the
budget. Only a spanning forest of the links found leaves a task, so a large
group of near copies gives as many rows as it has members, not as pairs.
Memory in a task: its rows plus ``FRONTIER`` node pairs per trie level.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kestrel.llm.common import bounded_batches, materialize, releasing
from kestrel.llm.components import connected_components

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
FRONTIER = 100_000
ROWS_AT_ONCE = 200_000


def simhash(text: str | None, shingle: int) -> int:
    """Fingerprint of one text as an unsigned integer."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends.tolist()][:max(1, len(words) - shingle + 1)]
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    count = np.zeros(64, np.int64)
    step = 1 << 15
    for i in range(0, len(starts), step):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], 42)
                      for a, b in zip(starts[i:i + step], stops[i:i + step], strict=True)], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """Fingerprint column (the unsigned value's bits in a signed long)."""

    @pandas_udf("long")
    @releasing
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64))

    bounded_batches()
    return of(text)


# -- trie self-join ----------------------------------------------------------

def _spans(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each block; widths differ by at most one."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def _gather(spans: list[tuple[int, int]], top: bool) -> str:
    """SQL: the bits of ``spans`` side by side, at the top or the bottom of a long."""
    at = 64 - sum(w for _, w in spans) if top else 0
    parts = []
    for lo, width in spans:
        mask = (1 << width) - 1 if width < 64 else -1
        parts.append(f"shiftleft(shiftrightunsigned(fp, {lo}) & {mask}L, {at})")
        at += width
    return " | ".join(parts) if parts else "0L"


def _rooted(fps: DataFrame, blocks: int, max_bits: int) -> DataFrame:
    """One row per fingerprint and choice of agreeing blocks: root (the chosen bits) and rest."""
    spans = _spans(blocks)
    rows = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        root = _gather([spans[i] for i in chosen], top=False)
        rest = _gather([s for i, s in enumerate(spans) if i not in chosen], top=True)
        rows.append(f"struct({n} AS choice, {root} AS root, {rest} AS rest)")
    return fps.select("fp", F.expr(f"inline(array({', '.join(rows)}))"))


def _blocks_for(rows: int, max_bits: int, node_rows: int) -> int:
    """Fewest blocks whose roots hold ``node_rows`` or fewer evenly spread fingerprints."""
    blocks = max_bits + 1
    while rows > node_rows << (64 // blocks * (blocks - max_bits)) and blocks < max_bits + 4:
        blocks += 1
    return blocks


def _pairs(alo, ahi, blo, bhi):
    """Index pairs of the ranges' products."""
    wide = bhi - blo
    sizes = (ahi - alo) * wide
    which = np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return alo[which] + nth // wide[which], blo[which] + nth % wide[which]


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the components of i and j in ``label`` (roots point to themselves)."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _walk(fp: np.ndarray, rest: np.ndarray, ranges: np.ndarray, max_bits: int) -> np.ndarray:
    """Component label per row. ``ranges``: (alo, ahi, blo, bhi) of root pairs, equal ends for a self pair;
    rows of a range are sorted by ``rest``."""
    label = np.arange(len(fp))
    ones: dict[int, np.ndarray] = {}
    todo = [(0, *ranges, np.zeros(len(ranges[0]), np.int64))]
    while todo:
        level, alo, ahi, blo, bhi, err = todo.pop()
        if len(alo) > FRONTIER:
            todo += [(level, *(x[k:k + FRONTIER] for x in (alo, ahi, blo, bhi, err)))
                     for k in range(0, len(alo), FRONTIER)]
            continue
        # Small node pairs are compared directly.
        small = ((ahi - alo) * (bhi - blo) <= 64) | (level == 64)
        if small.any():
            i, j = _pairs(alo[small], ahi[small], blo[small], bhi[small])
            near = (np.bitwise_count(fp[i] ^ fp[j]) <= max_bits) & (i != j)
            _unite(label, i[near], j[near])
        alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if level not in ones:
            bit = (rest >> np.uint64(63 - level)) & np.uint64(1)
            ones[level] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        above = ones[level]
        amid, bmid = ahi - (above[ahi] - above[alo]), bhi - (above[bhi] - above[blo])
        selfish = (alo == blo) & (ahi == bhi)
        below = []
        for a, b, more, keep in (((alo, amid), (blo, bmid), 0, True), ((amid, ahi), (bmid, bhi), 0, True),
                                 ((alo, amid), (bmid, bhi), 1, True), ((amid, ahi), (blo, bmid), 1, ~selfish)):
            alive = (a[1] > a[0]) & (b[1] > b[0]) & (err + more <= max_bits) & keep
            below.append([x[alive] for x in (*a, *b, err + more)])
        todo.append((level + 1, *(np.concatenate(x) for x in zip(*below, strict=True))))
    return label


_UNIT = ["choice", "root", "low", "high"]


def _forest(max_bits: int):
    """mapInPandas body: rows sorted by unit, side and rest -> spanning links of each unit."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy().view(np.uint64)
        rest = rows["rest"].to_numpy().view(np.uint64)
        sides = rows[[*_UNIT, "side"]].to_numpy()
        new = np.flatnonzero(np.r_[True, (sides[1:] != sides[:-1]).any(axis=1)])
        lo, hi = new, np.r_[new[1:], len(rows)]
        low, high, side = sides[new, 2], sides[new, 3], sides[new, 4]
        same = low == high
        # A cross unit has its two sides next to each other.
        first = np.flatnonzero((side == 0) & ~same & np.r_[(sides[new[1:], :4] == sides[new[:-1], :4]).all(axis=1), False])
        a, b = np.r_[np.flatnonzero(same), first], np.r_[np.flatnonzero(same), first + 1]
        label = _walk(fp, rest, (lo[a], hi[a], lo[b], hi[b]), max_bits)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": fp[linked].view(np.int64), "b": fp[label[linked]].view(np.int64)})

    @releasing
    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < ROWS_AT_ONCE:
                continue
            rows = pd.concat(held, ignore_index=True)
            unit = rows[_UNIT].to_numpy()
            other = np.flatnonzero((unit != unit[-1]).any(axis=1))
            cut = other[-1] + 1 if len(other) else 0  # the last unit may go on
            if cut:
                yield links(rows.iloc[:cut])
            held, n = [rows.iloc[cut:]], len(rows) - cut
        if n:
            yield links(pd.concat(held, ignore_index=True))

    return body


def near_links(fps: DataFrame, max_bits: int = 4, node_rows: int = 4096, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that connect exactly what the links of all pairs connect.

    ``fps`` has one row per distinct fingerprint (``fp``)."""
    if not 0 <= max_bits < 16:
        raise ValueError("max_bits must be 0 to 15")
    blocks = blocks or _blocks_for(fps.count(), max_bits, node_rows)
    rows = _rooted(fps, blocks, max_bits)
    # Levels to go down below a crowded root, so that its nodes hold about node_rows.
    crowded = materialize(
        rows.groupBy("choice", "root").agg(F.count("*").alias("n")).filter(F.col("n") > node_rows)
        .select("choice", "root", F.ceil(F.log2(F.col("n") / node_rows)).cast("int").alias("depth")), "crowded")
    plain = rows.join(crowded, ["choice", "root"], "left_anti").select(
        "fp", "choice", "root", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"),
        F.lit(0).alias("side"), "rest")
    masks = F.filter(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, depth) - 1")),
                     lambda m: F.bit_count(m) <= max_bits)
    split = (
        rows.join(crowded, ["choice", "root"])
        .withColumn("prefix", F.expr("shiftrightunsigned(rest, 64 - depth)"))
        .withColumn("mask", F.explode(masks))
        .withColumn("other", F.col("prefix").bitwiseXOR(F.col("mask")))
        .select("fp", "choice", "root", F.least("prefix", "other").alias("low"),
                F.greatest("prefix", "other").alias("high"),
                (F.col("prefix") > F.col("other")).cast("int").alias("side"), "rest")
    )
    units = plain.unionByName(split).repartition(*_UNIT).sortWithinPartitions(
        *_UNIT, "side", F.expr("rest ^ (-9223372036854775807L - 1)"))  # unsigned order
    return units.mapInPandas(_forest(max_bits), "a long, b long")


def near_groups(rows: DataFrame, max_bits: int = 4, **trie) -> DataFrame:
    """``rows(doc_id, fp)`` with component_id: the smallest doc_id reachable by links.

    Null doc_ids are never the smallest; a component of null ids only has a
    null component_id."""
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(near_links(classes.select("fp"), max_bits, **trie))
    rooted = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialize(rooted.join(least, "root").select("fp", "component_id"), "components-by-fp")
    return rows.join(by_fp, "fp")


def find_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                         text_col: str = "text", **trie) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    rows = materialize(
        docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    return near_groups(rows, max_bits, **trie).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                         text_col: str = "text", **trie) -> DataFrame:
    """The rows of ``docs`` of which one per component stays, with all their columns.

    The row with the smallest doc_id stays (ties and null ids: then the
    smallest text hash); rows that tie in both all stay, so run the exact dedup
    first. Losers go by an anti-join that is broadcast only when small."""
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), text_hash.alias("text_hash"),
                                   fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    classes = rows.groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    classes = materialize(classes, "classes")
    roots = connected_components(near_links(classes.select("fp"), max_bits, **trie))
    rooted = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    winners = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("stays")), "root").select("fp", "stays")
    losers = materialize(
        rows.join(winners, "fp")
        .filter(~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash"))))
        .select("doc_id", "text_hash").distinct(), "near-losers")
    return docs.join(losers, docs[id_col].eqNullSafe(losers["doc_id"]) & (text_hash == losers["text_hash"]), "left_anti")
