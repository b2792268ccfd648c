"""Ranked lexical search with hashed max-sketches.

Terms are runs of 0-9, a-z (A-Z folded) and all characters from U+0080 on. The
score of a document for an item is the sum, over the item's distinct terms, of
the term's weight times its impact in the document,
``(10^9 * tf) div (1000 * tf + 8 * m)`` with ``m`` from the document's length;
weights and impacts are whole numbers, so scores are exact.

1. Statistics, in one pass: number of documents, of terms, and for each term
   of the items the number of documents that hold it. Every task counts for
   itself; Spark adds the counts.
2. Sketch: the impacts of all terms of a document are folded into an array by
   a hash of the term, keeping the maximum at each place. The array has 4 to 8
   places for each distinct term, so long documents are no fuller than short ones.
3. Bounds: for a batch of documents and all items at once, the sketch is looked
   up at the items' terms; an impact there is never below the term's own, so
   the weighted sum is an upper bound of the score.
4. Rescoring: per item, documents are rescored exactly in order of descending
   bound until the next bound is below the k-th best exact score so far, which
   carries on from batch to batch of a task. Equal bounds are still rescored,
   as a tie may be won by a smaller id.

Each task gives at most ``k`` documents an item, cut to ``k`` again in salted
groups before the last ranking. The items are dealt into blocks of checked
size, which are broadcast; every block is searched in all documents.

Defined results: null and empty texts have no terms and are never found, nor is
an item without terms; a repeated item is ranked once for each of its rows;
repeated documents are ranked each, a null id after all others. Documents of
score 0 are not returned, and an empty table gives no rows. Other columns are
ignored. Memory: a batch of documents and, for the longest text, its distinct terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.common import materialize, releasing, small_batches
from kestrel.llm.decontamination import words_of

CELLS = 1 << 22            # sketch places, or looked-up cells, held at once
DOCS_AT_ONCE = 512
FIRST_ROUND = 16           # documents an item in the first round of rescoring; doubled in each later one
SALTS = 64
_SCALE = 1_000_000_000


def term_weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


class Items:
    """A block of items: distinct terms, and the term numbers of each item laid end to end."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.terms: dict[bytes, int] = {}
        self.numbers, flat, ends = [], [], []
        for number, text in items:
            own = [self.terms.setdefault(w, len(self.terms)) for w in dict.fromkeys(words_of(text))]
            if own:
                self.numbers.append(number)
                flat += own
                ends.append(len(flat))
        self.flat = np.array(flat, np.int64)
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.hashes = np.array([crc32(t) for t in self.terms], np.int64)

    def weigh(self, n_docs: int, n_terms: int, holding: dict[bytes, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([term_weight(n_docs, holding.get(t, 0)) for t in self.terms], np.int64)


class Batch:
    """Impacts of all terms of some documents."""

    def __init__(self, texts: list[str | None], items: Items):
        self.rows, hashes, tf, sizes, lengths = [], [], [], [], []
        known = items.terms
        at, term, where = [], [], []
        held = 0
        for k, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            count = Counter(words)
            d = len(self.rows)
            for t in known.keys() & count.keys():
                at.append(d)
                term.append(known[t])
                where.append(count[t])
            hashes.append(np.fromiter(map(crc32, count), np.int64, len(count)))
            tf.append(np.fromiter(count.values(), np.int64, len(count)))
            sizes.append(len(count))
            lengths.append(len(words))
            self.rows.append(k)
            held += len(count)
        self.sizes = np.array(sizes, np.int64)
        lengths = np.array(lengths, np.int64)
        m = 100 - 90 + (90 * lengths * items.n_docs) // max(1, items.n_terms)
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.int64)
        tf = np.concatenate(tf) if tf else np.empty(0, np.int64)
        self.impact = (_SCALE * tf) // (1000 * tf + 8 * np.repeat(m, self.sizes))
        # Exact impacts of the items' terms, by document and term.
        at, where = np.array(at, np.int64), np.array(where, np.int64)
        keys = at * len(known) + np.array(term, np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.exact = ((_SCALE * where) // (1000 * where + 8 * m[at]))[order] if len(at) else np.empty(0, np.int64)

    def bounds(self, items: Items) -> np.ndarray:
        """Upper bounds, documents by items."""
        out = np.empty((len(self.rows), len(items.numbers)), np.int64)
        width = 1 << np.ceil(np.log2(np.maximum(4 * self.sizes, 64))).astype(np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        weights = items.weight[items.flat]
        for w in np.unique(width).tolist():
            docs = np.flatnonzero(width == w)
            places = items.hashes[items.flat] & (w - 1)
            step = max(1, CELLS // max(w, len(places)))
            for a in range(0, len(docs), step):
                some = docs[a:a + step]
                n = self.sizes[some]
                own = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                sketch = np.zeros(len(some) * w, np.int64)
                np.maximum.at(sketch, np.repeat(np.arange(len(some)) * w, n) + (self.hashes[own] & (w - 1)), self.impact[own])
                found = sketch.reshape(len(some), w)[:, places] * weights
                out[some] = np.add.reduceat(found, items.starts, axis=1)
        return out

    def scores(self, doc: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
        """Exact scores of pairs."""
        out = np.empty(len(doc), np.int64)
        n = items.ends[item] - items.starts[item]
        upto = np.concatenate([[0], np.cumsum(n)])
        a = 0
        while a < len(doc):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + CELLS, side="right")) - 1)
            k = n[a:b]
            offset = upto[a:b] - upto[a]
            term = items.flat[np.repeat(items.starts[item[a:b]] - offset, k) + np.arange(k.sum())]
            key = np.repeat(doc[a:b], k) * len(items.terms) + term
            place = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            value = np.where(self.keys[place] == key, self.exact[place], 0) * items.weight[term] if len(self.keys) else np.zeros(len(key), np.int64)
            out[a:b] = np.add.reduceat(value, offset)
            a = b
        return out


class Best:
    """The k best (score, id) of every item so far; ids as ranks, smaller is better."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.score = np.zeros((n_items, k), np.int64)
        self.doc = np.full((n_items, k), np.iinfo(np.int64).max)
        self.row = np.full((n_items, k), -1)

    def threshold(self) -> np.ndarray:
        """The score that a document must reach: the k-th best, at least 1."""
        return np.maximum(self.score[:, -1], 1)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, row: np.ndarray) -> None:
        use = score >= self.threshold()[item]
        if not use.any():
            return
        touched = np.unique(item[use])
        kept = np.repeat(touched, self.k)
        item = np.concatenate([kept, item[use]])
        score = np.concatenate([self.score[touched].ravel(), score[use]])
        doc = np.concatenate([self.doc[touched].ravel(), doc[use]])
        row = np.concatenate([self.row[touched].ravel(), row[use]])
        order = np.lexsort((row, doc, -score, item))
        item, score, doc, row = item[order], score[order], doc[order], row[order]
        start = np.searchsorted(item, touched)
        take = (start[:, None] + np.arange(self.k)).ravel()
        self.score[touched] = score[take].reshape(-1, self.k)
        self.doc[touched] = doc[take].reshape(-1, self.k)
        self.row[touched] = row[take].reshape(-1, self.k)


def search_batch(batch: Batch, items: Items, best: Best, doc_rank: np.ndarray, doc_row: np.ndarray) -> int:
    """Take the batch's documents into ``best``; the number of pairs that were rescored."""
    if not len(batch.rows):
        return 0
    bounds = batch.bounds(items)
    doc, item = np.nonzero(bounds >= best.threshold())
    value = bounds[doc, item]
    order = np.lexsort((-value, item))
    doc, item, value = doc[order], item[order], value[order]
    first = np.searchsorted(item, np.arange(len(items.numbers) + 1))
    place = np.arange(len(item)) - first[item]
    done, size, rescored = 0, FIRST_ROUND, 0
    while done < len(bounds):
        now = np.flatnonzero((place >= done) & (place < done + size) & (value >= best.threshold()[item]))
        if not len(now):  # bounds descend: nothing behind can reach the threshold either
            break
        score = batch.scores(doc[now], item[now], items)
        best.add(item[now], score, doc_rank[doc[now]], doc_row[doc[now]])
        rescored += len(now)
        done += size
        size *= 2
    return rescored


def item_blocks(queries: DataFrame, block_bytes: int, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    """(number, text) of the items, in blocks of checked size (a longer item is a block of its own)."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 64
    n = int((queries.agg(F.sum(size)).first()[0] or 0) // block_bytes) + 1
    while True:
        dealt = queries.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(n)))
        full = dealt.groupBy("block").agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
        if full.filter((F.col("bytes") > 2 * block_bytes) & (F.col("n") > 1)).isEmpty():
            break
        n *= 2
    for b in range(n):
        yield [(r["number"], r[text_col]) for r in dealt.filter(F.col("block") == b).select("number", text_col).collect()]


def collection_statistics(docs: DataFrame, items: Items) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, terms with repeats, and for each term of the items the documents that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(items.terms))

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, holding, n, total = shared.value, Counter(), 0, 0
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text.as_py())
                n += bool(words)
                total += len(words)
                holding.update(known.intersection(words))
        yield pa.RecordBatch.from_pydict({
            "term": pa.array([None, *holding], pa.binary()), "docs": pa.array([n, *holding.values()], pa.int64()),
            "terms": pa.array([total] + [0] * len(holding), pa.int64())})

    # One row per distinct term of the block, and one more.
    rows = docs.select("text").mapInArrow(count, "term binary, docs long, terms long").groupBy("term").agg(
        F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).collect()
    whole = next((r for r in rows if r["term"] is None), None)
    return (whole["docs"] if whole else 0, whole["terms"] if whole else 0,
            {bytes(r["term"]): r["docs"] for r in rows if r["term"] is not None})


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   query_id: str = "item_id", query_text: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of each item."""
    small_batches(docs.sparkSession)
    kind, query_kind = docs.schema[id_col].dataType, queries.schema[query_id].dataType
    asked = materialize(queries.select(F.col(f"`{query_id}`").alias("item_id"), F.col(f"`{query_text}`").alias("text"),
                                       F.monotonically_increasing_id().alias("number")), "items")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sc = docs.sparkSession.sparkContext
    found = None
    for block in item_blocks(asked.select("number", "text"), block_bytes, "text"):
        items = Items(block)
        if not items.numbers:
            continue
        items.weigh(*collection_statistics(rows, items))
        hits = materialize(rows.mapInArrow(_searcher(sc.broadcast(items), k), "number long, doc_id long, score long"), "hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "number long, doc_id long, score long")
    # A task gave at most k rows an item; groups of tasks cut them to k before the last ranking.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = Window.partitionBy("number", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).filter(F.col("rank") <= k)
    return found.join(asked.select("item_id", F.col("number").alias("of")), F.col("number") == F.col("of")).select(
        F.col("item_id").cast(query_kind), "rank", F.col("doc_id").cast(kind), "score")


def _searcher(shared, k: int):
    @releasing
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = Best(len(items.numbers), k)
        last = np.iinfo(np.int64).max - 1  # a null id comes after all others
        for whole in batches:
            ids = whole["doc_id"].to_pylist()
            for a in range(0, len(ids), DOCS_AT_ONCE):
                batch = Batch(whole["text"].slice(a, DOCS_AT_ONCE).to_pylist(), items)
                own = np.array([last if ids[a + r] is None else ids[a + r] for r in batch.rows], np.int64)
                null = np.array([ids[a + r] is None for r in batch.rows], np.int64)
                search_batch(batch, items, best, own, null)
        item, place = np.nonzero(best.score > 0)
        doc, null = best.doc[item, place], best.row[item, place]
        yield pa.RecordBatch.from_pydict({
            "number": pa.array(np.array(items.numbers, np.int64)[item]),
            "doc_id": pa.array(doc, mask=null == 1),
            "score": pa.array(best.score[item, place])})

    return search
