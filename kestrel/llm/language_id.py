"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point and a
seed. A run of three characters (letters of the lower-cased text, with one
blank for anything between words) is bound into one vector: the letters'
vectors, shifted by their place, are multiplied. A text is the bundle (sum) of
its n-gram vectors, each weighted by the logarithm of its count, less the mean
profile of all languages; a language prototype is the normalised sum of its
training texts' unit vectors, less the same mean. A text gets the language
whose prototype has the largest cosine.

Prototypes are learnt from a bounded sample: of each language at most about
``per_language`` texts, chosen by a hash of the doc_id. Each task adds up its
own texts, so one vector per language and task is all that is shuffled.
Prediction is a column over whole texts, without a shuffle. A text that is
null or has no letter is ``und`` with score 0; so is every text if nothing was
learnt. Equal cosines go to the alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from kestrel.llm.common import bounded_batches

DIMENSIONS = 1024
SEED = 7
ROWS_AT_ONCE = 2048
TEXTS_AT_ONCE = 128
_BLANK = 32
_RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=4096)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    bits = np.random.default_rng([SEED, code]).integers(0, 2, dimensions, dtype=np.int8)
    return (2 * bits - 1).astype(np.int8)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct three-character runs (code points packed into one integer) and their counts; none without a letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    letter = _is_letter()[code]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.where(letter, code, _BLANK).astype(np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    code = np.concatenate([[_BLANK], code[keep], [_BLANK]])
    return np.unique((code[:-2] << 42) | (code[1:-1] << 21) | code[2:], return_counts=True)


def bound(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """One vector of +1 and -1 per n-gram: its letters' vectors, shifted by their place and multiplied."""
    out = None
    for place, shift in enumerate((42, 21, 0)):
        codes, at = np.unique((grams >> shift) & 0x1FFFFF, return_inverse=True)
        vectors = np.stack([np.roll(letter_vector(int(c), dimensions), 2 - place) for c in codes])[at]
        out = vectors if out is None else out * vectors
    return out


def bundles(texts: list[tuple[np.ndarray, np.ndarray]], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row per text: the sum of its n-grams' vectors, weighted by 1 + ln(count)."""
    grams = np.concatenate([g for g, _ in texts])
    row = np.repeat(np.arange(len(texts)), [len(g) for g, _ in texts])
    weight = (1 + np.log(np.concatenate([n for _, n in texts]))).astype(np.float32)
    order = np.argsort(grams, kind="stable")
    row, weight = row[order], weight[order]
    distinct, first = np.unique(grams[order], return_index=True)
    first = np.append(first, len(grams))
    out = np.zeros((len(texts), dimensions), np.float32)
    for i in range(0, len(distinct), ROWS_AT_ONCE):
        part = distinct[i:i + ROWS_AT_ONCE]
        lo, hi = first[i], first[i + len(part)]
        share = np.zeros((len(texts), len(part)), np.float32)
        share[row[lo:hi], np.repeat(np.arange(len(part)), np.diff(first[i:i + len(part) + 1]))] = weight[lo:hi]
        out += share @ bound(part, dimensions).astype(np.float32)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # one unit row per language
    mean: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        for at, vectors in _vectors(texts, len(self.mean)) if self.languages else ():
            cosine = unit(vectors - self.mean) @ self.prototypes.T
            for k, best, c in zip(at, cosine.argmax(axis=1).tolist(), cosine.max(axis=1).tolist(), strict=True):
                out[k] = (self.languages[best], min(1.0, max(0.0, c)))
        return out


def _vectors(texts: list[str | None], dimensions: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Unit vectors of the texts that have letters, some texts at a time, with their places."""
    for i in range(0, len(texts), TEXTS_AT_ONCE):
        grams = [(k, trigrams(t)) for k, t in enumerate(texts[i:i + TEXTS_AT_ONCE], i)]
        grams = [(k, g) for k, g in grams if len(g[0])]
        if grams:
            yield [k for k, _ in grams], unit(bundles([g for _, g in grams], dimensions))


def learn(docs: DataFrame, per_language: int = 4000, dimensions: int = DIMENSIONS, text_col: str = "text",
          lang_col: str = "lang", id_col: str = "doc_id") -> Profiles:
    """Profiles from ``docs``, which must already exclude what is held out. Rows without text or lang are left out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles([], np.zeros((0, dimensions)), np.zeros(dimensions))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].tolist()
            for at, vectors in _vectors(batch["text"].tolist(), dimensions):
                for k, v in zip(at, vectors, strict=True):
                    sums[langs[k]] = sums.get(langs[k], 0) + v.astype(np.float64)
        for lang, total in sums.items():
            yield pd.DataFrame({"lang": lang, "dim": np.arange(dimensions), "total": total})

    bounded_batches()
    sums = (rows.filter(part < share).select("lang", "text").mapInPandas(add_up, "lang string, dim int, total double")
            .groupBy("lang", "dim").agg(F.sum("total").alias("total")).toPandas())
    table = sums.pivot(index="lang", columns="dim", values="total").sort_index()
    own = unit(table.to_numpy()) if len(table) else np.zeros((0, dimensions))
    mean = own.mean(axis=0) if len(own) > 1 else np.zeros(dimensions)
    return Profiles(list(table.index), unit(own - mean), mean)


def identify(text: Column, profiles: Profiles) -> Column:
    """struct(lang, score) of each text; score is the cosine, 0 where negative."""

    @pandas_udf(_RESULT)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(profiles.predict(texts.tolist()), columns=["lang", "score"])

    bounded_batches()
    return of(text)
