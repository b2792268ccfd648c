"""Secret scan: base patterns plus a linear-chain conditional random field.

Base spans are the matches of three patterns (see ``BASE``), each leftmost and
non-overlapping, matches that are too short being dropped. The random field
tags every token of the text as secret-begin, secret-inside or outside and is
decoded by Viterbi; the spans it finds beside the base spans are added as kind
``crf``. Features of a token: its own shape (length, character classes, hex,
spread of characters), the words or shapes of three tokens before and one
after, and features of the whole file (density of ``=``, of line breaks, of
upper case).

The field is trained here, on a bounded sample: about half of ``sample_docs``
documents are drawn from those with a base match and half from the others, by a
hash of the text, so that rare matches are learnt too. Base matches, all of a
chosen document, are the weak labels, and seeded random secrets and look-alikes
(numbers, paths, addresses, versions) set between its words teach the forms that
no pattern has. Windows of tokens reach the driver, at most about
``sample_windows``, drawn by their hash if there are more.

Scanning is a column over whole texts, without a shuffle. Viterbi is exact: a
token whose evidence for outside beats any gain that its neighbours' labels
could bring is outside on every best path, so the chain is decoded between such
tokens, all pieces of a batch side by side. Offsets are code points, ends
exclusive. Null and empty texts have no spans; equal texts, in repeated rows or
not, have equal spans; very long texts are tagged whole, one at a time. Base
spans of several kinds at one place all stay, in the order listed; a span of the
field that meets a base span goes. Other columns of the table are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from kestrel.llm.common import bounded_batches, materialize

# Kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"(?ia)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
     2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
KINDS = [b[0] for b in BASE] + ["crf"]
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s+/.\-]+")
OUT, BEGIN, INSIDE = 0, 1, 2
PLACES = ("own", "l1", "l2", "l3", "r1")
KEPT_TOKENS = 200_000
TOKENS_AT_ONCE = 400_000
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Whether a text has a base match, for drawing the sample (Java and Python alike).
_ANY_BASE = (r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}|(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
             r"[A-Za-z0-9+/_.=-]{12}")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base matches, by start, then kind as listed."""
    out = []
    for kind, pattern, group, least in BASE:
        if kind == "assign" and "=" not in text and ":" not in text:
            continue
        if kind == "hex":
            pattern = _LONG_HEX  # a run of hex digits is matched whole, so this finds the same spans
        out += [(*m.span(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# -- features ----------------------------------------------------------------

def _bucket(x: float, *edges: float) -> int:
    return bisect_right(edges, x)


def _word_length(n: int) -> int:
    return _bucket(n, 4, 8, 12, 16, 24, 32)


def token_features(token: str) -> tuple[str, ...]:
    """What a token tells, of itself and as a neighbour."""
    n = len(token)
    if token.isalpha():
        case = "A" if token.isupper() else "a" if token.islower() else "Aa"
        word = (f"word={token.lower()}",) if n <= 12 else ()
        return (f"alpha={case}", f"len={_word_length(n)}", *word)
    digits = sum(c.isdigit() for c in token)
    upper = sum("A" <= c <= "Z" for c in token)
    lower = sum("a" <= c <= "z" for c in token)
    marks = n - digits - upper - lower
    if not digits and not upper and not lower:
        return (f"mark={token[:3]}",)
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "m" for c in token]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    spread = len(set(token)) / n
    return (
        f"len={_bucket(n, 4, 8, 12, 16, 20, 24, 32, 40, 64)}",
        f"mix={'d' if digits else ''}{'u' if upper else ''}{'l' if lower else ''}{'m' if marks else ''}",
        f"digits={_bucket(digits / n, .1, .3, .5, .9, 1)}",
        f"marks={_bucket(marks / n, .01, .1, .3)}",
        f"turns={_bucket(turns / n, .1, .25, .4)}&{_bucket(n, 12, 20)}",
        f"spread={_bucket(spread, .3, .5, .7)}&{_bucket(n, 12, 20)}",
        f"hex={re.fullmatch(r'[0-9a-fA-F]+', token) is not None}&{_bucket(n, 8, 16, 32)}",
        f"slash={'/' in token}&{'.' in token}",
    )


def file_features(text: str) -> tuple[str, ...]:
    """Densities over the whole text."""
    n = max(1, len(text))
    upper = sum(map(text.count, _LETTERS.upper())) / n
    return (f"file.eq={_bucket(1000 * text.count('=') / n, .1, 2, 10)}",
            f"file.lines={_bucket(1000 * text.count(chr(10)) / n, 1, 10, 30)}",
            f"file.upper={_bucket(upper, .1, .5)}")


# -- the field ---------------------------------------------------------------

@dataclass
class Field:
    """Weights by place and feature (three labels each), and transition scores."""

    weights: dict[str, np.ndarray]
    transition: np.ndarray

    def row(self, features: tuple[str, ...], place: str) -> np.ndarray:
        out = np.zeros(3)
        for f in features:
            w = self.weights.get(f"{place}|{f}")
            if w is not None:
                out += w
        return out


def _forward_backward(scores: np.ndarray, mask: np.ndarray, trans: np.ndarray):
    """Label marginals and expected transitions of padded chains (chains, steps, 3)."""
    def lse(x, axis):
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    n, steps, _ = scores.shape
    fwd = np.empty_like(scores)
    fwd[:, 0] = scores[:, 0]
    for t in range(1, steps):
        new = lse(fwd[:, t - 1, :, None] + trans, 1) + scores[:, t]
        fwd[:, t] = np.where(mask[:, t, None], new, fwd[:, t - 1])
    back = np.zeros_like(scores)
    for t in range(steps - 2, -1, -1):
        new = lse(trans + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(mask[:, t + 1, None], new, 0)
    z = lse(fwd[:, -1], 1)
    # Past a chain's end the forward scores are carried on, so the last column is the chain's end.
    node = np.exp(fwd + back - z[:, None, None]) * mask[:, :, None]
    pair = np.zeros((3, 3))
    for t in range(1, steps):
        p = np.exp(fwd[:, t - 1, :, None] + trans + (scores[:, t] + back[:, t])[:, None, :] - z[:, None, None])
        pair += (p * mask[:, t, None, None]).sum(axis=0)
    return node, pair


def token_chain(tokens: list[str], whole: tuple[str, ...]) -> list[list[str]]:
    """Feature names of every token of a stretch."""
    of = [token_features(t) for t in tokens]
    own = [f"own|{f}" for f in whole]
    return [[f"{p}|{f}" for p, k in zip(PLACES, (0, -1, -2, -3, 1), strict=True) if 0 <= t + k < len(of)
             for f in of[t + k]] + own for t in range(len(of))]


Window = tuple[list[str], list[int], tuple[str, ...]]  # tokens, labels, file features


def fit(windows: list[Window], epochs: int = 5, rate: float = 0.1, decay: float = 1e-4, batch: int = 64,
        least: int = 5) -> Field:
    """Penalised maximum likelihood by Adagrad, on features seen ``least`` times."""
    names: dict[str, int] = {}
    coded = [([np.array([names.setdefault(f, len(names)) for f in token], np.int64)
               for token in token_chain(tokens, whole)], np.array(labels)) for tokens, labels, whole in windows]
    flat = [f for chain, _ in coded for f in chain]
    seen = np.bincount(np.concatenate(flat), minlength=len(names)) if flat else np.zeros(0, np.int64)
    number = np.cumsum(seen >= least) - 1
    names = {f: int(number[k]) for f, k in names.items() if seen[k] >= least}
    coded = [([number[f[seen[f] >= least]] for f in chain], labels) for chain, labels in coded]
    weights, trans = np.zeros((len(names), 3)), np.zeros((3, 3))
    g_w, g_t = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        order = rng.permutation(len(coded))
        for i in range(0, len(order), batch):
            part = [coded[k] for k in order[i:i + batch]]
            steps = max(len(labels) for _, labels in part)
            chain = np.concatenate([np.full(len(f), c) for c, (tokens, _) in enumerate(part) for f in tokens])
            step = np.concatenate([np.full(len(f), t) for tokens, _ in part for t, f in enumerate(tokens)])
            flat = np.concatenate([f for tokens, _ in part for f in tokens])
            cell = chain * steps + step
            scores = np.stack([np.bincount(cell, weights[flat, y], minlength=len(part) * steps) for y in range(3)], 1)
            scores = scores.reshape(len(part), steps, 3)
            mask = np.arange(steps) < np.array([len(labels) for _, labels in part])[:, None]
            node, pair = _forward_backward(scores, mask, trans)
            for c, (_, labels) in enumerate(part):
                node[c, np.arange(len(labels)), labels] -= 1
                np.subtract.at(pair, (labels[:-1], labels[1:]), 1)
            slope = np.zeros_like(weights)
            np.add.at(slope, flat, node.reshape(-1, 3)[cell])
            touched = np.unique(flat)
            grad = slope[touched] / len(part) + decay * weights[touched]
            g_w[touched] += grad ** 2
            weights[touched] -= rate * grad / np.sqrt(g_w[touched])
            grad = pair / len(part) + decay * trans
            g_t += grad ** 2
            trans -= rate * grad / np.sqrt(g_t)
    return Field({name: weights[k] for name, k in names.items() if np.abs(weights[k]).max() > 1e-4}, trans)


def _decode(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of one long chain of token scores, by exact Viterbi on the stretches that are in doubt."""
    gain = (trans[:, None, 1:] + trans.T[None, :, 1:] - trans[:, None, :1] - trans.T[None, :, :1]).max(axis=(0, 1))
    doubt = (scores[:, 1:] + np.maximum(gain, 0) >= scores[:, :1]).any(axis=1)
    doubt[[0, -1]] = False  # padding
    labels = np.zeros(len(scores), np.int64)
    edge = np.flatnonzero(np.diff(doubt.astype(np.int8)))
    lo, hi = edge[::2] + 1, edge[1::2] + 1
    order = np.argsort(lo - hi, kind="stable")  # longest first: at each step the running ones are a prefix
    lo, length = lo[order], (hi - lo)[order]
    if not len(lo):
        return labels
    best = trans[OUT] + scores[lo]
    came = []
    for t in range(1, int(length[0])):
        n = int(np.searchsorted(-length, -t))
        step = best[:n, :, None] + trans
        came.append(step.argmax(axis=1))
        best[:n] = step.max(axis=1) + scores[lo[:n] + t]
    now = (best + trans[:, OUT]).argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        n = int(np.searchsorted(-length, -t))
        labels[lo[:n] + t] = now[:n]
        if t:
            now[:n] = came[t - 1][np.arange(n), now[:n]]
    return labels


class Scanner(dict):
    """Tags texts in batches; as a dict it maps a token to its row of scores, filled on demand."""

    def __init__(self, field: Field):
        super().__init__()
        self._field = field
        self._known = {f.split("|", 1)[1] for f in field.weights}
        self._rows: dict[tuple[str, ...], int] = {}
        self._plain: dict[tuple[bool, bool, int], int] = {}
        self._scores = [np.zeros((1024, 3)) for _ in PLACES]
        self._row(("pad",))

    def _row(self, features: tuple[str, ...]) -> int:
        row = self._rows.get(features)
        if row is None:
            row = self._rows[features] = len(self._rows)
            if row >= len(self._scores[0]):
                self._scores = [np.concatenate([s, np.zeros_like(s)]) for s in self._scores]
            for s, place in zip(self._scores, PLACES, strict=True):
                s[row] = self._field.row(features, place)
        return row

    def __missing__(self, token: str) -> int:
        # Words without weights of their own fall together, so there are few rows.
        if token.isalpha() and f"word={token.lower()}" not in self._known:
            kind = (token.islower(), token.isupper(), _word_length(len(token)))
            row = self._plain.get(kind)
            if row is None:
                row = self._plain[kind] = self._row(tuple(f for f in token_features(token) if f in self._known))
        else:
            row = self._row(tuple(f for f in token_features(token) if f in self._known))
        if len(self) < KEPT_TOKENS:
            self[token] = row
        return row

    def _tag(self, texts: list[str], tokens: list[list[str]]) -> list[np.ndarray]:
        gap = [0, 0, 0]
        flat = np.array([r for ts in tokens for r in (*gap, *map(self.__getitem__, ts))] + gap, np.int64)
        own, l1, l2, l3, r1 = self._scores
        scores = own[flat]
        for k, s in ((1, l1), (2, l2), (3, l3)):
            scores[k:] += s[flat[:-k]]
        scores[:-1] += r1[flat[1:]]
        at, cuts = 0, []
        for text, ts in zip(texts, tokens, strict=True):
            scores[at:at + 3] = (1e6, 0, 0)
            at += 3
            scores[at:at + len(ts)] += self._field.row(file_features(text), "own")
            cuts.append((at, at + len(ts)))
            at += len(ts)
        scores[at:] = (1e6, 0, 0)
        labels = _decode(scores, self._field.transition)
        return [labels[a:b] for a, b in cuts]

    def tagged(self, texts: list[str]) -> Iterator[list[tuple[int, int]]]:
        """Spans that the field tags, per text."""
        held, n = [], 0
        for text in [*texts, None]:
            if text is not None:
                held.append((text, _TOKEN.findall(text)))
                n += len(held[-1][1])
            if held and (text is None or n > TOKENS_AT_ONCE):
                for (t, _), labels in zip(held, self._tag(*map(list, zip(*held, strict=True))), strict=True):
                    yield _spans(t, labels) if labels.any() else []
                held, n = [], 0

    def scan(self, texts: list[str | None]) -> Iterator[tuple[list[Span], list[Span]]]:
        """(base spans, all spans) per text; a field span that meets a base span is left out."""
        texts = [t or "" for t in texts]
        for text, found in zip(texts, self.tagged(texts), strict=True):
            base = base_spans(text)
            more = [(a, b, "crf") for a, b in found if not any(a < e and s < b for s, e, _ in base)] if found else []
            yield base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _spans(text: str, labels: np.ndarray) -> list[tuple[int, int]]:
    """Spans of tagged tokens: a begin, or an inside after an outside, starts one."""
    out: list[tuple[int, int]] = []
    before = OUT
    for m, y in zip(_TOKEN.finditer(text), labels.tolist(), strict=True):
        if y == INSIDE and before != OUT:
            out[-1] = (out[-1][0], m.end())
        elif y != OUT:
            out.append(m.span())
        before = y
    return out


# -- training data -----------------------------------------------------------

_ALNUM = _LETTERS + _LETTERS.upper() + "0123456789"
_CUES = ("password is", "passwd:", "secret =", "token:", "api key", "apikey =", "bearer", "Authorization: Bearer",
         "access key:", "client_secret:", "private key", "auth_token =", "credential:", "pwd =", "pass:")
_LOOKALIKES = ("2024-05-17", "192.168.10.21", "v12.4.1", "user42@example.com", "https://example.com/a/b/c1.html",
               "/usr/local/lib/python3.13", "1,234,567.89", "a1b2c3d", "+49-30-1234567", "section 4.2.1", "token",
               "file_name_2.tar.gz", "ISBN-978-3-16-148410-0", "x86_64-unknown-linux-gnu", "RFC-2119", "10:45:12")


def _random_secret(rng) -> str:
    alphabet = (_ALNUM, _ALNUM + "+/", _ALNUM + "_-", "0123456789ABCDEF", "0123456789abcdef")[rng.integers(5)]
    body = "".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(14, 48)))
    return ("", "", "", "sk_live_", "ghp_", "xoxb-")[rng.integers(6)] + body


def training_windows(text: str, seed: int, side: int = 12, random_windows: int = 3) -> list[Window]:
    """Labelled token windows of one text: around its base matches, some elsewhere, some with inserted forms."""
    rng = np.random.default_rng([seed, len(text)])
    spans = [(m.start(2), m.end(2)) if kind == "assign" else m.span()
             for kind, pattern, group, least in BASE for m in pattern.finditer(text)
             if m.end(group) - m.start(group) >= least]
    places = [m.span() for m in _TOKEN.finditer(text)]
    tokens = [text[a:b] for a, b in places]
    starts, ends = np.array([a for a, _ in places], np.int64), np.array([b for _, b in places], np.int64)
    labels = np.zeros(len(tokens), np.int64)
    for a, b in sorted(spans):
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        labels[i:j] = INSIDE
        labels[i:i + 1] = BEGIN
    whole = file_features(text)
    out, centres = [], [int(i) for i in np.flatnonzero(labels == BEGIN)]
    centres += [int(i) for i in rng.integers(0, max(1, len(tokens)), random_windows)] if tokens else []
    for c in centres:
        a, b = max(0, c - side), c + side
        out.append((tokens[a:b], labels[a:b].tolist(), whole))
    if tokens:
        c = int(rng.integers(0, len(tokens)))
        a, b = max(0, c - side), c + side
        left, right = (tokens[a:c], labels[a:c].tolist()), (tokens[c:b], labels[c:b].tolist())
        secret = _TOKEN.findall(_random_secret(rng))
        cue = _TOKEN.findall(_CUES[rng.integers(len(_CUES))])
        quote = ['"'] if rng.integers(2) else []
        out.append(([*left[0], *cue, *quote, *secret, *quote, *right[0]],
                    left[1] + [OUT] * (len(cue) + len(quote)) + [BEGIN] + [INSIDE] * (len(secret) - 1)
                    + [OUT] * len(quote) + right[1], whole))
        other = _TOKEN.findall(_LOOKALIKES[rng.integers(len(_LOOKALIKES))])
        out.append(([*left[0], *other, *right[0]], left[1] + [OUT] * len(other) + right[1], whole))
    return out


def train(docs: DataFrame, sample_docs: int = 1000, text_col: str = "text", sample_windows: int = 20_000) -> Field:
    """Fit the field on windows of about ``sample_docs`` documents, half of them with a base match (all, if there are fewer)."""
    texts = docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL")
    has = F.col("text").rlike(_ANY_BASE)
    n = texts.agg(F.count_if(has).alias("with_base"), F.count_if(~has).alias("without")).first()
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    share = [min(1.0, sample_docs / 2 / max(1, k)) for k in (n.with_base, n.without)]

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [w for text in batch["text"] for w in training_windows(text, seed=11)]
            yield pd.DataFrame({name: pd.Series([list(w[k]) for w in rows], dtype=object)
                                for k, name in enumerate(("tokens", "labels", "whole"))})

    sample = texts.filter(part < max(share)).filter(part < F.when(has, share[0]).otherwise(share[1])).distinct()
    found = materialize(sample.mapInPandas(windows, "tokens array<string>, labels array<int>, whole array<string>"), "secret-windows")
    share = min(1.0, sample_windows / max(1, found.count()))
    rows = found.filter(F.pmod(F.xxhash64("tokens"), F.lit(1 << 30)) / float(1 << 30) < share).toPandas()
    rows = [(list(t), [int(x) for x in y], tuple(f))
            for t, y, f in zip(rows["tokens"], rows["labels"], rows["whole"], strict=True)]
    return fit(sorted(rows))


_RESULT = T.StructType([
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
    T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()),
])


def find_secrets(text: Column, field: Field) -> Column:
    """struct(n_assign, n_access, n_hex, base, spans) of each text; spans as kind:start:end, comma-joined."""

    def joined(spans: list[Span]) -> str:
        return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)

    @pandas_udf(_RESULT)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(field)
        for texts in batches:
            rows = [(*(sum(s[2] == k for s in base) for k in KINDS[:3]), joined(base), joined(every))
                    for base, every in scanner.scan(texts.tolist())]
            yield pd.DataFrame(rows, columns=_RESULT.names)

    bounded_batches()
    return of(text)
