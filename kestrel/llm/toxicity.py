"""Toxicity classifier with a counterfactual penalty.

Logistic regression on the distinct words of a text and on their beginnings,
so that endings not seen in training still count. A labelled text that names a
group is paired with the same text in which every identity term is swapped for
another of its kind; the squared change of the log-odds between the two is
penalised, so that the mere mention of a group cannot carry a verdict.

Training data is a bounded sample of labelled rows, chosen by a hash of the
doc_id (at most about ``per_label`` rows of either label; more changes little,
as the terms recur). Feature counts of the sample are a Spark aggregation; only
its telling features (see ``_telling``) reach the driver; the fewer rows a
feature is in, the larger its penalty (one row alone teaches nothing). The
intercept is set for equally many texts of either label (``share``) as far as
the model tells the training rows apart (less for very few rows); the rest is the share of toxic labels
(at most 0.45), which is also the score where nothing is telling. Scoring is a column over all texts:
no shuffle, and memory bounded by the model and a table of recent words. Null
and empty texts get the score of no evidence. Without labels of both kinds
the model scores what there is (0 without any label).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from kestrel.llm.common import bounded_batches, materialize, releasing
from kestrel.llm.decontamination import words_of

# Terms that only name a group, by kind; a swap stays within a kind and language.
IDENTITY_TERMS = (
    ("man", "woman", "boy", "girl"),
    ("men", "women", "boys", "girls"),
    ("male", "female", "transgender"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "indigenous"),
    ("african", "american", "european", "chinese", "indian", "mexican", "russian"),
    ("deaf", "blind", "disabled"),
    ("mann", "frau"), ("männer", "frauen"), ("christen", "muslime", "juden"),
    ("homme", "femme"), ("hommes", "femmes"), ("chrétiens", "musulmans", "juifs"),
    ("hombre", "mujer"), ("hombres", "mujeres"), ("cristianos", "musulmanes", "judíos"),
)
PREFIXES = (4, 5, 6)
KEPT_WORDS = 200_000
LEAST_HASHES = 16  # so many smallest feature hashes tell whether two training texts are (near) copies


def swaps(terms: tuple[tuple[str, ...], ...]) -> dict[bytes, bytes]:
    """Each term and the next one of its kind."""
    return {a.encode(): b.encode() for kind in terms for a, b in zip(kind, (*kind[1:], kind[0]), strict=True)}


def features_of(word: bytes) -> list[int]:
    """Hashes of the word and of its beginnings."""
    return [zlib.crc32(b"=" + word)] + [zlib.crc32(b"%d" % n + word[:n]) for n in PREFIXES if len(word) >= n]


def features(words: set[bytes]) -> list[int]:
    """One entry per distinct word that has the feature."""
    return [h for w in words for h in features_of(w)]


MOST_UNKNOWN = 0.45  # largest score where nothing is known of a text


@dataclass
class Model:
    intercept: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)

    def evidence(self, word: bytes) -> float:
        return sum(self.weights.get(h, 0.0) for h in features_of(word))


class _Evidence(dict):
    def __init__(self, model: Model):
        super().__init__()
        self._model = model

    def __missing__(self, word: bytes) -> float:
        value = self._model.evidence(word)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


class _Rows:
    """Sparse rows: feature counts, with the two products that training needs."""

    def __init__(self, rows: list[np.ndarray], columns: np.ndarray, values: list[np.ndarray] | None = None):
        self.n = len(rows)
        flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        value = np.concatenate([*values, np.zeros(0)]) if values else np.ones(len(flat))
        row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        at = np.searchsorted(columns, flat)
        known = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == flat) if len(columns) else at > 0
        self.row, self.at, self.value, self.width = row[known], at[known], value[known], len(columns)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * r[self.row], minlength=self.width)


def fit(rows: list[np.ndarray], swapped: list[np.ndarray | None], labels: np.ndarray, share: float = 0.5,
        fairness: float = 10.0, sparsity: float = 1e-5, rounds: int = 800, known: float | None = None) -> Model:
    """Sparse logistic regression; ``swapped`` has the counterfactual of a row or None.

    Accelerated proximal gradient on mean log-loss + fairness * mean squared
    change under a swap + a sum of absolute weights, each times sparsity or, if
    larger, 2 / its number of rows / the number of all rows. The intercept is
    set for ``share`` toxic texts; ``known`` is the share in all labels."""
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        only = min(max(float(labels.mean()) if len(labels) else 0.0, 1e-6), 1 - 1e-6)
        return Model(math.log(only / (1 - only)))
    known = min(float(labels.mean()) if known is None else known, MOST_UNKNOWN)
    unknown = math.log(known / (1 - known))
    columns = np.unique(np.concatenate(rows))
    if not len(columns):
        return Model(unknown)
    x = _Rows(rows, columns)
    paired = [(a, b) for a, b in zip(rows, swapped, strict=True) if b is not None]
    change = _Rows([np.concatenate(p) for p in paired], columns,
                   [np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in paired])
    n, m = len(labels), max(1, len(paired))
    v = np.random.default_rng(0).normal(size=len(columns))
    curve = 1.0
    for _ in range(20):  # largest curvature, for the step length
        u = x.back(x.times(v)) / (4 * n) + 2 * fairness * change.back(change.times(v)) / m
        curve = float(np.linalg.norm(u)) / max(float(np.linalg.norm(v)), 1e-12)
        v = u / max(curve, 1e-12)
        v /= max(float(np.linalg.norm(v)), 1e-12)
    step = 1 / (1.1 * curve + 0.5)
    seen = np.unique(x.row * np.int64(x.width) + x.at) % x.width  # a row counts once
    penalty = np.maximum(sparsity, 2 / np.maximum(np.bincount(seen, minlength=x.width), 1) / n)
    w = ahead = np.zeros(len(columns))
    b = b_ahead = math.log(labels.mean() / (1 - labels.mean()))
    t = 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x.times(ahead) + b_ahead, -30, 30))) - labels
        slope = x.back(error) / n + 2 * fairness * change.back(change.times(ahead)) / m
        new = ahead - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b_new = b_ahead - step * error.mean()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, b_ahead = new + (t - 1) / t_new * (new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = new, b_new, t_new
    b += math.log(share / (1 - share)) - math.log(labels.mean() / (1 - labels.mean()))
    called = x.times(w) + b >= math.log(share / (1 - share))
    apart = max(0.0, float(called[labels == 1].mean() - called[labels == 0].mean()))
    fewer = min(labels.sum(), n - labels.sum())
    apart *= fewer / (fewer + 2)  # a few rows are told apart by chance words too
    b = apart * b + (1 - apart) * unknown
    return Model(float(b), {int(h): float(x) for h, x in zip(columns, w, strict=True) if x})


def train(docs: DataFrame, labels: DataFrame, per_label: int = 6000, identity=IDENTITY_TERMS,
          fairness: float = 10.0) -> Model:
    """Fit on labelled rows (``labels``: doc_id, toxic; of several labels of a doc_id the largest counts).

    ``labels`` must already exclude the rows that are held out."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(math.log(1e-6))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    wanted = F.when(F.col("label") == 1, per_label / counts.get(1, 1)).otherwise(per_label / counts.get(0, 1))
    sample = known.filter(part < wanted)  # about 2 * per_label rows at most
    swap = swaps(identity)
    bounded_batches()

    @releasing
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [set(words_of(t)) for t in batch["text"]]
            other = [{swap.get(w, w) for w in ws} if not swap.keys().isdisjoint(ws) else None for ws in words]
            own = [features(ws) for ws in words]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].to_numpy(),
                "label": batch["label"].to_numpy(),
                "least": [str(sorted(set(f))[:LEAST_HASHES]) for f in own],
                "own": pd.Series(own, dtype=object),
                "other": pd.Series([features(ws) if ws is not None else None for ws in other], dtype=object),
            })

    # Texts of one label with the same smallest hashes are (near) copies; the one with the smallest doc_id (as text) counts, or
    # their chance words would look telling.
    rows = materialize(
        docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(F.broadcast(sample.withColumn("doc_id", F.col("doc_id").cast("string"))), "doc_id").select("doc_id", "text", "label")
        .mapInPandas(read, "doc_id string, label int, least string, own array<long>, other array<long>")
        .groupBy("least", "label").agg(F.min(F.struct("doc_id", "own", "other")).alias("one")).select("one.doc_id", "label", "one.own", "one.other"),
        "toxicity-sample")
    kept = np.array(sorted(r.h for r in _telling(rows).collect()), np.int64)

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in ("own", "other"):
                batch[name] = pd.Series([None if r is None else r[np.isin(r, kept)] for r in batch[name]], dtype=object)
            yield batch

    few = rows.mapInPandas(narrow, "doc_id string, label int, own array<long>, other array<long>").toPandas()
    few = few.sort_values(["doc_id", "label"], kind="stable")  # the same sums whatever the order of partitions
    return fit([np.asarray(r, np.int64) for r in few["own"]],
               [None if r is None else np.asarray(r, np.int64) for r in few["other"]],
               few["label"].to_numpy(), fairness=fairness, known=counts.get(1, 0) / sum(counts.values()))


def _telling(rows: DataFrame, least_z: float = 4.0) -> DataFrame:
    """Features (h) of which the rows are toxic more or less often than all rows, by ``least_z`` standard errors.

    Signed root of the likelihood ratio, which holds for few rows too: with one toxic row in a thousand, two rows are enough."""
    size = rows.agg(F.count("*").alias("n"), F.sum("label").alias("n1")).first()
    n, n1 = size.n, size.n1 or 0
    if not 0 < n1 < n:
        return rows.select(F.explode("own").alias("h")).limit(0)
    counted = rows.select("label", F.explode(F.array_distinct("own")).alias("h")).groupBy("h").agg(
        F.count("*").alias("c"), F.sum("label").alias("c1")).withColumn("c0", F.col("c") - F.col("c1"))

    def part(k, share):
        return F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (F.col("c") * share))).otherwise(0.0)

    # For features of most rows, the rows without it are as few: the spread of c1 is less by their share.
    ratio = 2 * (part("c1", n1 / n) + part("c0", 1 - n1 / n)) / F.greatest(1 - F.col("c") / n, F.lit(0.5 / n))
    return counted.filter(ratio >= least_z ** 2).select("h")


def score(text: Column, model: Model) -> Column:
    """Probability that the text is toxic."""

    @pandas_udf(T.DoubleType())
    @releasing
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        evidence = _Evidence(model)
        for texts in batches:
            odds = [model.intercept + math.fsum(map(evidence.__getitem__, set(words_of(t)))) for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(odds, np.float64), -700, 700))))

    bounded_batches()
    return of(text)
