"""Benchmark decontamination with an FM-index per training shard.

Words are runs of 0-9, a-z (A-Z folded) and all characters from U+0080 on. A
phrase is a window of ``window`` consecutive words of a benchmark item (an item
of fewer words, but not none, is one phrase). Every batch of documents that a
task holds is a shard: its words are numbered by the benchmark's vocabulary,
the stretches that consist of vocabulary words and are as long as the shortest
phrase are laid end to end, and an FM-index is built over them: suffix array,
Burrows-Wheeler transform, wavelet tree, and suffix positions sampled at every
``SAMPLE``-th place and at the start of each stretch. (Words outside the
vocabulary cannot occur in a phrase, so they only separate stretches.) All
phrases are searched backward at once through wavelet-tree ranks, their
occurrences are located from the sampled positions, and the spans they cover
are merged per document.

The benchmark is dealt into blocks whose size is checked before they are
broadcast; every block is searched against every document. With one block (the
usual case) there is no shuffle at all; with more, only hits are shuffled. Null or empty texts have no words and no hits;
an empty benchmark leaves everything clean; copies and repeated rows are each
found. An item without an item_id takes part in the hits, not in item lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from kestrel.llm.common import bounded_batches, fresh, materialize, releasing

SAMPLE = 16
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("words", T.ArrayType(T.IntegerType())),
    T.StructField("chars", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Phrases:
    """The phrases of one benchmark block, as rows of word numbers (from 1)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found = owners.setdefault(tuple(ids[i:i + window]), set())
                if item is not None:
                    found.add(item)
        self.owners = owners
        self.rows = list(owners)
        self.length = np.array([len(r) for r in self.rows], np.int64)
        self.shortest = int(self.length.min()) if self.rows else 0
        width = int(self.length.max()) if self.rows else 0
        self.ids = np.zeros((len(self.rows), width), np.int64)
        for n, row in enumerate(self.rows):
            self.ids[n, width - len(row):] = row

    def numbered(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))


class FMIndex:
    """FM-index of a sequence of symbols from 1 on, in which 0 separates stretches.

    Each 0 sorts below all symbols and by its place, so no order reaches past it."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.n = n
        suffix = self._suffix_array(symbols)
        before = symbols[suffix - 1]
        before[suffix == 0] = 0
        top = int(symbols.max()) if n else 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self._wavelet(before, top)
        self.before = before
        marked = (suffix % SAMPLE == 0) | (before == 0)
        self.marked = marked
        self.rank_marked = np.cumsum(marked) - 1
        self.samples = suffix[marked]

    @staticmethod
    def _suffix_array(symbols: np.ndarray) -> np.ndarray:
        """Prefix doubling; a separator's rank is its own, so ranks part within the longest stretch."""
        stops = symbols == 0
        rank = np.where(stops, np.cumsum(stops) - 1, symbols + stops.sum())
        step = 1
        while True:
            n = len(rank)
            ahead = np.zeros(n, np.int64)
            ahead[:n - step] = rank[step:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + ahead
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])[:n]
            rank = np.empty(n, np.int64)
            rank[order] = new
            if not n or new[-1] == n - 1:
                return order
            step *= 2

    def _wavelet(self, symbols: np.ndarray, top: int) -> None:
        """Wavelet tree, one bit per level from the top, zeros of a level before ones on the next."""
        self.levels = []
        for bit in reversed(range(max(1, top.bit_length()))):
            ones = (symbols >> bit) & 1
            upto = np.concatenate([[0], np.cumsum(ones)])
            zeros = len(symbols) - int(upto[-1])
            self.levels.append((bit, upto, zeros))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        every = np.arange(top + 1)
        self.start = self._descend(every, np.zeros(top + 1, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, upto, zeros in self.levels:
            ones = upto[i]
            i = np.where((symbol >> bit) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``i`` of the transform."""
        return self._descend(symbol, i) - self.start[symbol]

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high): the suffix ranges of the phrases that occur."""
        which = np.arange(len(phrases.rows))
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        done = []
        top = len(self.first) - 2
        width = phrases.ids.shape[1]
        for k in range(width):
            symbol = phrases.ids[which, width - 1 - k]
            known = symbol <= top
            which, low, high, symbol = which[known], low[known], high[known], symbol[known]
            low = self.first[symbol] + self.rank(symbol, low)
            high = self.first[symbol] + self.rank(symbol, high)
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            ends = phrases.length[which] == k + 1
            done.append((which[ends], low[ends], high[ends]))
            which, low, high = which[~ends], low[~ends], high[~ends]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: step back until a sampled one, then count the steps."""
        place = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            here = self.marked[rows]
            place[todo[here]] = self.samples[self.rank_marked[rows[here]]] + steps
            todo, rows = todo[~here], rows[~here]
            symbol = self.before[rows]
            rows = self.first[symbol] + self.rank(symbol, rows)
            steps += 1
        return place


def _stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of vocabulary words of at least that length."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
    return [(a, b) for a, b in edge.reshape(-1, 2).tolist() if b - a >= least]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_shard(texts: list[str | None], phrases: Phrases) -> tuple[list[int], dict[int, tuple[list, set]]]:
    """Word counts of the texts; per text with hits its merged word spans and its items."""
    counts, parts, doc, at = [], [], [], []
    for k, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        if not phrases.rows or len(words) < phrases.shortest:
            continue
        ids = phrases.numbered(words)
        for a, b in _stretches(ids, phrases.shortest):
            parts += [ids[a:b], [0]]
            doc.append(np.full(b - a + 1, k))
            at.append(np.arange(a, b + 1))
    if not parts:
        return counts, {}
    doc, at = np.concatenate(doc), np.concatenate(at)
    index = FMIndex(np.concatenate(parts).astype(np.int64))
    which, low, high = index.search(phrases)
    n = high - low
    rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    place, which = index.locate(rows), np.repeat(which, n)
    hits: dict[int, tuple[list, set]] = {}
    for d, a, p in zip(doc[place].tolist(), at[place].tolist(), which.tolist(), strict=True):
        spans, items = hits.setdefault(d, ([], set()))
        spans.append((a, a + int(phrases.length[p])))
        items |= phrases.owners[phrases.rows[p]]
    return counts, {d: (merged(spans), items) for d, (spans, items) in hits.items()}


def _char_spans(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Code-point spans, flat, of word spans."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [x for a, b in spans for x in (places[a][0], places[b - 1][1])]


def _search_column(text: Column, block) -> Column:
    @pandas_udf(_RESULT)
    @releasing
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        phrases = block.value
        for texts in batches:
            texts = texts.tolist()
            counts, hits = search_shard(texts, phrases)
            rows = []
            for k, n in enumerate(counts):
                spans, items = hits.get(k, ((), ()))
                rows.append((n, [x for s in spans for x in s], _char_spans(texts[k], spans) if spans else [],
                             sorted(items)))
            yield pd.DataFrame(rows, columns=["n_words", "words", "chars", "items"])

    bounded_batches()
    return of(text)


@pandas_udf(_RESULT)
def _merge(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
    """One result of a document's results per block (a struct, and an array of further ones or null)."""
    def flat(lists):
        return [x for s in merged([(a, b) for x in lists for a, b in zip(x[::2], x[1::2], strict=True)]) for x in s]

    for one, many in batches:
        rows = []
        for n, words, chars, items, others in zip(one["n_words"], one["words"], one["chars"], one["items"], many, strict=True):
            others = [] if others is None else list(others)
            rows.append((n, flat([list(words), *(list(o["words"]) for o in others)]),
                         flat([list(chars), *(list(o["chars"]) for o in others)]),
                         sorted({*items, *(x for o in others for x in o["items"])})))
        yield pd.DataFrame(rows, columns=["n_words", "words", "chars", "items"])


def blocks_of(benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20, id_col: str = "item_id",
              text_col: str = "text") -> Iterator[Phrases]:
    """The benchmark in blocks of checked size (a longer item is a block of its own)."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).distinct()
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    n = int((rows.agg(F.sum(size)).first()[0] or 0) // block_bytes) + 1
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
        full = dealt.groupBy("block").agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
        if full.filter((F.col("bytes") > 2 * block_bytes) & (F.col("n") > 1)).isEmpty():
            break
        n *= 2
    for k in range(n):
        items = dealt.filter(F.col("block") == k).select("item", "text").collect()
        yield Phrases([(r.item, r.text) for r in items], window)


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str, window: int = 10, block_bytes: int = 8 << 20,
              text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``name``: struct of n_words, words and chars (merged spans of hit words and their
    code points, flat start, end, ...), items (item_ids as sorted strings)."""
    sc = docs.sparkSession.sparkContext
    blocks = blocks_of(benchmark, window, block_bytes)
    first, more = next(blocks), next(blocks, None)
    if more is None:
        return docs.withColumn(name, _search_column(F.col(text_col), sc.broadcast(first)))
    # Further blocks are searched one after the other in numbered rows; only their hits are kept and joined back.
    rid = fresh(docs, "row")
    rows = materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    hits = None
    for phrases in chain([more], blocks):
        found = rows.select(F.col(rid).alias("hit_row"), _search_column(F.col(text_col), sc.broadcast(phrases)).alias("hit"))
        found = materialize(found.filter(F.size("hit.words") > 0), "block-hits")
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("hit_row").agg(F.collect_list("hit").alias("hits"))  # at most one per block
    out = rows.withColumn(name, _search_column(F.col(text_col), sc.broadcast(first)))
    out = out.join(hits, out[rid] == hits["hit_row"], "left")
    return out.select(*[out[c] for c in docs.columns], _merge(out[name], hits["hits"]).alias(name))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, **blocks) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (code points, flat)."""
    rows = with_hits(docs.select("doc_id", "text"), benchmark, "found", window, **blocks)
    hit = F.aggregate(F.sequence(F.lit(0), F.size("found.words")), F.lit(0).cast("long"),
                      lambda s, i: s + F.coalesce(F.get(F.col("found.words"), i), F.lit(0))
                      * F.when(i % 2 == 0, -1).otherwise(1))
    return rows.select("doc_id", "found.n_words", hit.alias("n_hit"),
                       F.size("found.items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
                       (F.size("found.words") > 0).alias("contaminated"), F.col("found.chars").alias("spans"))


def cut_spans(text: str, flat: list[int]) -> str:
    """The text without the spans (code points, flat), its parts stripped and joined by line feeds."""
    edges = [0, *flat, len(text)]
    return "\n".join(p for p in (text[a:b].strip() for a, b in zip(edges[::2], edges[1::2], strict=True)) if p)


def _remaining_column(text: Column, block) -> Column:
    """The text without the block's passages (null: as it was), searched and cut again until none is left."""
    @pandas_udf(T.StringType())
    @releasing
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        phrases = block.value
        for batch in batches:
            texts, out = batch.tolist(), [None] * len(batch)
            todo = list(range(len(texts)))
            while todo:
                _, hits = search_shard([texts[k] for k in todo], phrases)
                for n, (spans, _) in hits.items():
                    k = todo[n]
                    out[k] = texts[k] = cut_spans(texts[k], _char_spans(texts[k], spans))
                todo = [todo[n] for n in hits]
            yield pd.Series(out, dtype=object)

    bounded_batches()
    return of(text)


@pandas_udf(T.StringType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut_spans(t, list(s)) if t is not None and len(s) else t for t, s in zip(texts, spans, strict=True)],
                     dtype=object)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
                         block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without the passages of the benchmark; columns as they were.

    The merged spans are cut out of the text and a line feed joins what is
    left; where that forms a phrase anew, it is searched and cut again until none is
    left. A document of which nothing is left goes; one without hits stays untouched.
    A benchmark of one block takes a single pass. With more blocks a round merges the spans of
    all blocks before it cuts, and only documents that were cut go into the next round."""
    blocks = blocks_of(benchmark, window, block_bytes)
    first, more = next(blocks), next(blocks, None)
    if more is None:
        left = fresh(docs, "left")
        one = docs.sparkSession.sparkContext.broadcast(first)
        rows = docs.withColumn(left, _remaining_column(F.col(text_col), one))
        return rows.filter(F.col(left).isNull() | (F.length(left) > 0)).withColumn(
            text_col, F.coalesce(F.col(left), F.col(text_col))).drop(left)
    found, clean, todo = fresh(docs, "found"), None, docs
    while True:
        rows = materialize(with_hits(todo, benchmark, found, window, block_bytes, text_col), "searched")
        hit = F.size(f"{found}.words") > 0
        untouched = rows.filter(~hit).drop(found)
        clean = untouched if clean is None else clean.unionByName(untouched)
        if rows.filter(hit).isEmpty():
            return clean
        cut = rows.withColumn(text_col, F.when(hit, _cut(F.col(text_col), F.col(f"{found}.chars"))))
        todo = cut.filter(hit & (F.length(text_col) > 0)).drop(found)
