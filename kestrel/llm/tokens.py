"""Token ids of whole texts with a public tokenizer file, inside Spark tasks.

Many texts are cut at once: the code points of all of them lie in one array, each has
a class (letter, number, blank, line feed, other), and the pre-tokens of a byte-level BPE
(``public_tokenizers.PATTERN``) begin where the classes say so. Arrow lists the distinct pre-tokens,
each is encoded once, and the ids of all texts are gathered by numpy. Texts with a
special string of the tokenizer, or with rare white space, go through the library uncut.

Pre-tokens recur. The most frequent words of a sample of the documents are encoded
once and shared with all tasks (:func:`frequent_pieces`); each task keeps the ids
of further pre-tokens in a bounded table of its own, which is emptied
when it is full and ends with the task. Both change only the speed: the BPE of every
pre-token is the tokenizers library's.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

KEPT_PIECES = 400_000
FREQUENT_PIECES = 100_000
SAMPLE_ROWS = 8_000         # about so many documents are sampled for the frequent pieces
LONGEST_KEPT = 48
CHARS_AT_ONCE = 4_000_000   # texts are cut together until they have so many code points
POINTS_AT_ONCE = 1 << 15    # looked up at a time, so that the indices stay in the cache
# White space beside blank and line feed, on some of which libraries differ: such a text is encoded uncut.
_RARE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85\u180e]")
_OTHER, _LETTER, _NUMBER, _FEED, _BLANK, _UNCUT = range(6)


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point, as the library's pattern and ``_RARE`` see it."""
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for kind, found in ((_LETTER, regex.finditer(r"\p{L}+", points)), (_NUMBER, regex.finditer(r"\p{N}+", points)),
                        (_UNCUT, _RARE.finditer(points))):
        for m in found:
            table[np.frombuffer(m.group().encode("utf-32-le"), "<u4")] = kind
    table[ord("\n")], table[ord(" ")] = _FEED, _BLANK
    return table


def _byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_ID_BYTES = [i.to_bytes(4, "little") for i in range(1 << 16)]  # a vocabulary of at most 65,536 ids


class _Parts(dict):
    """pre-token -> ids, as bytes; begins with those known and is filled on demand."""

    def __init__(self, model, known: dict[str, bytes]):
        super().__init__(known)
        self._bpe = model.tokenize

    def __missing__(self, part: str) -> bytes:
        # Printable ASCII characters but the blank stand for their own bytes.
        shown = (part.replace(" ", _LETTERS[32]) if part.isascii() and part.isprintable()
                 else part.encode().decode("latin-1").translate(_LETTERS))
        ids = b"".join([_ID_BYTES[t.id] for t in self._bpe(shown)])
        if len(part) <= LONGEST_KEPT:
            self[part] = ids
        return ids


def _starts(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a pre-token begins, by code point; ``first`` marks the first one of every text.

    The last of several white-space characters before a text goes on begins a pre-token; a blank there belongs
    to what follows it, a line feed does not. An apostrophe with nothing before it in its
    pre-token takes one of ``s t re ve m ll d`` from the letters behind it."""
    white = kinds >= _FEED
    starts = first.copy()
    starts[1:] |= kinds[1:] != kinds[:-1]
    after_white = np.zeros_like(starts)
    after_white[1:] = white[:-1] & ~first[1:]
    goes_on = np.zeros_like(starts)  # the next one is of the same text and no white space
    goes_on[:-1] = ~white[1:] & ~first[1:]
    starts &= ~white
    starts |= white & (~after_white | goes_on)
    joined = np.zeros_like(starts)   # to the blank before
    joined[1:] = (kinds[:-1] == _BLANK) & ~first[1:] & ~white[1:]
    starts &= ~joined
    at = np.flatnonzero(starts & (points == ord("'")))
    ends = np.append(first, [True, True, True])
    one, two = points.take(at + 1, mode="clip"), points.take(at + 2, mode="clip")
    has1 = ~ends[at + 1]
    has2 = has1 & ~ends[at + 2]
    short = has1 & np.isin(one, [ord(c) for c in "stmd"])
    long = has2 & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    starts[at[short | long] + 1] = False
    behind = np.concatenate([at[short] + 2, at[long] + 3])
    starts[behind[behind < len(starts)]] = True
    return starts


@functools.cache
def _library(path: str) -> tuple[Tokenizer, object, list[str]]:
    """The tokenizer of a file (read once per process), its model, and its special strings."""
    tok = Tokenizer.from_file(path)
    model = tok.model
    if hasattr(model, "_resize_cache"):  # pre-tokens are kept by the encoder
        model._resize_cache(0)
    return tok, model, [t.content for t in tok.get_added_tokens_decoder().values() if t.content]


class Encoder:
    """Ids of texts by a byte-level BPE file, as the library's ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, known: dict[str, bytes] | None = None):
        self._tok, self._model, self._special = _library(path)
        self._known = {f" {w}": ids for w, ids in (known or {}).items()}
        self._kept = _Parts(self._model, self._known)

    def encode(self, text: str) -> np.ndarray:
        """uint32 ids of the text."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """uint32 ids of each text in order."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= CHARS_AT_ONCE:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.zeros(0, "<u4")] * len(texts)
        cut = [k for k, t in enumerate(texts) if t]
        points = np.frombuffer("".join([texts[k] for k in cut]).encode("utf-32-le"), "<u4")
        if not len(points):
            return out
        ends = np.cumsum([len(texts[k]) for k in cut])
        first = np.zeros(len(points), bool)
        first[ends - [len(texts[k]) for k in cut]] = True
        kinds = np.concatenate([_classes().take(points[k:k + POINTS_AT_ONCE]) for k in range(0, len(points), POINTS_AT_ONCE)])
        uncut = {cut[i] for i in np.searchsorted(ends, np.flatnonzero(kinds == _UNCUT), "right").tolist()}
        uncut |= {k for k in cut if any(s in texts[k] for s in self._special)}
        if uncut:
            for k in uncut:
                out[k] = self._whole(texts[k])
            for k, ids in zip([k for k in cut if k not in uncut],
                              self._together([texts[k] for k in cut if k not in uncut]), strict=True):
                out[k] = ids
            return out
        ids, upto = self._cut(points, np.flatnonzero(_starts(points, kinds, first)), "".join([texts[k] for k in cut]).encode(), ends)
        for k, x in zip(cut, np.split(ids, upto[:-1]), strict=True):
            out[k] = x
        return out

    def _cut(self, points: np.ndarray, starts: np.ndarray, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, number of ids up to each text's end) of the texts whose UTF-8 is ``data``."""
        raw = np.frombuffer(data, np.uint8)
        at = starts if len(raw) == len(points) else np.flatnonzero((raw & 0xC0) != 0x80)[starts]
        offsets = np.append(at, len(raw)).astype(np.int32 if len(raw) < 1 << 31 else np.int64)
        kind = pa.StringArray if offsets.itemsize == 4 else pa.LargeStringArray
        parts = kind.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        if len(self._kept) > KEPT_PIECES:
            self._kept = _Parts(self._model, self._known)
        kept = self._kept
        of = [kept[p] for p in parts.dictionary.to_numpy(zero_copy_only=False)]
        flat = np.frombuffer(b"".join(of), "<u4")
        counts = np.fromiter(map(len, of), np.int64, len(of)) >> 2
        which = parts.indices.to_numpy()
        n = counts[which]
        total = np.cumsum(n)
        place = np.repeat((np.cumsum(counts) - counts)[which] - total + n, n)
        place += np.arange(len(place))
        return flat[place], total[np.searchsorted(starts, ends) - 1]

    def table(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of a blank and each word."""
        words = [w for w in words if len(w) <= LONGEST_KEPT]
        return dict(zip(words, [x.tobytes() for x in self.encode_all([" " + w for w in words])], strict=True))


def frequent_pieces(docs: DataFrame, tokenizer: str, text_col: str = "text", rows: int = SAMPLE_ROWS,
                    pieces: int = FREQUENT_PIECES):
    """A broadcast table of the ids of at most ``pieces`` pieces: the most frequent of a sample of about ``rows`` rows."""
    total = docs.count()
    text = F.col(f"`{text_col}`")
    words = (docs.select(text.alias("t")).sample(min(1.0, rows / max(1, total)), 7).filter(F.col("t").isNotNull())
             .select(F.explode(F.split("t", " ", -1)).alias("w"))
             .filter(F.length("w").between(1, LONGEST_KEPT) & ~F.col("w").rlike(r"[\s\x1c-\x1f\x85\xa0]")))
    top = words.groupBy("w").count().filter("count > 1").orderBy(F.desc("count"), "w").limit(pieces).collect()
    encoder = Encoder(tokenizer)
    return docs.sparkSession.sparkContext.broadcast(encoder.table(
        r["w"] for r in top if not _RARE.search(r["w"]) and not any(s in r["w"] for s in encoder._special)))


def encoded(texts: Iterable[str | None], encoder: Encoder) -> Iterator[np.ndarray]:
    """Ids of each text (null: empty) in order."""
    return encoder.encode_all(t or "" for t in texts)
