"""Token files (1) and packing (10): exact round trips and brute force."""

import zlib

import numpy as np
import pytest
from llm_cases import docs_frame, odd_rows, prose, write_tables
from tokenizers import Tokenizer

from kestrel.llm import packing, token_files, tokens
from kestrel.llm.queries import VOCABULARY, llm_queries, tokenizer_path
from kestrel.llm.tokens import Encoder, frequent_pieces


def library_ids(text):
    tok = Tokenizer.from_file(tokenizer_path())
    return tok.encode(text or "", add_special_tokens=False).ids


ODD_TEXTS = ["", " ", "  a  b ", "a\n b\tc  \n\n d", "it's  <|endoftext|> x", "　x y z  é ", "a" * 300 + " " + "b" * 200, "x   y",
             "a\x1c b \x85c d", "don't we'll 12 345,6 ñandú—ok", "end ", "\n", "🙂 🙂🙂 é x", prose(500, 1), "A.B, C. D,"]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_pieces_encode_like_the_library(text):
    assert Encoder(tokenizer_path()).encode(text).tolist() == library_ids(text)
    known = Encoder(tokenizer_path()).table(["b", "x", "y", "12", "we'll", "é"])
    assert Encoder(tokenizer_path(), known).encode(text).tolist() == library_ids(text)


def test_texts_cut_together_encode_like_the_library(monkeypatch):
    rng = np.random.default_rng(3)
    bits = ["a", "s", "t", "re", "ve", "ll", "m", "d", "'", "\u2019", " ", "  ", "\n", "\n\n", "1", "22", ".", "!?", "\u00e9", "\u0301",
            "\u4e2d", "\U0001f642", "\u0663", "word", "IT", "'S", "\t", "\xa0", "<|endoftext|>", "x" * 60]
    texts = ["".join(rng.choice(bits[:26] if k % 10 else bits, rng.integers(0, 25))) for k in range(3000)] + ODD_TEXTS
    known = Encoder(tokenizer_path()).table(["a", "word", "IT", "x" * 48, "we'll"])
    for at_once in (1, 500, 10**6):
        monkeypatch.setattr(tokens, "CHARS_AT_ONCE", at_once)
        got = list(Encoder(tokenizer_path(), known).encode_all(texts))
        assert [x.tolist() for x in got] == [x.ids for x in Tokenizer.from_file(tokenizer_path()).encode_batch(
            texts, add_special_tokens=False)]
    assert list(Encoder(tokenizer_path()).encode_all([])) == []


def test_special_string_is_one_id():
    assert Encoder(tokenizer_path()).encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_frequent_pieces_of_odd_rows(spark):
    rows = odd_rows() + list(enumerate(ODD_TEXTS, 1000))
    known = frequent_pieces(docs_frame(spark, rows), tokenizer_path(), rows=10**6).value
    assert len(known) > 500 and all(np.frombuffer(v, "<u4").tolist() == library_ids(" " + w) for w, v in known.items())
    assert frequent_pieces(docs_frame(spark, []), tokenizer_path()).value == {}


@pytest.mark.parametrize("n,vocabulary", [(0, 5), (1, 5), (5, 3), (255, 2), (256, 3), (257, 7), (1000, 50257), (5000, 4), (40_000, 300)])
def test_coder_round_trip(n, vocabulary):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, vocabulary, n), np.minimum(rng.zipf(1.3, n) - 1, vocabulary - 1), np.arange(n) % min(vocabulary, 5)):
        per_lane, words = token_files.code(ids, vocabulary)
        assert (token_files.decode(per_lane, words, n, vocabulary) == ids).all()


def test_coder_learns():
    ids = np.tile(np.random.default_rng(0).integers(0, 1000, 50), 2000)
    assert 16 * len(token_files.code(ids, 50257)[1]) < 2 * len(ids)


@pytest.mark.parametrize("n,vocabulary", [(300_000, 50257), (300_000, 3), (100_001, 300)])
def test_coder_takes_little_more_than_the_model_says(monkeypatch, n, vocabulary):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n) - 1, vocabulary - 1)
    told = []
    interval = token_files.Model.interval

    def heard(model, x):
        start, size = interval(model, x)
        told.append(float((30 - np.log2(size.astype(float))).sum()))
        return start, size

    monkeypatch.setattr(token_files.Model, "interval", heard)
    per_lane, words = token_files.code(ids, vocabulary)
    monkeypatch.undo()
    assert words.nbytes == 4 * per_lane.sum()
    assert 8 * words.nbytes <= sum(told) + 0.01 * n + 64 * len(per_lane)
    assert (token_files.decode(per_lane, words, n, vocabulary) == ids).all()


def test_carries_go_on_over_full_words():
    words = np.array([5, 2**32 - 1, 2**32 - 1, 7, 2**32 - 1, 8], np.uint64)
    token_files._carry(words, np.array([3, 5, 6]))
    assert words.tolist() == [6, 0, 0, 8, 0, 9]


def test_unlikely_ids_carry():
    # A tiny vocabulary's last id lies at the upper end of the interval, where carries come from.
    ids = np.where(np.random.default_rng(5).random(400_000) < 0.02, 1, 2)
    for x in (ids, ids - 1, 3 - ids):
        per_lane, words = token_files.code(x, 3)
        assert (token_files.decode(per_lane, words, len(x), 3) == x).all()


def test_each_new_piece_is_encoded_once():
    """Each distinct pre-token is looked up once a cut, and goes through the library once an encoder."""
    asked = []
    encoder = Encoder(tokenizer_path(), Encoder(tokenizer_path()).table(["known"]))
    bpe = encoder._kept._bpe
    encoder._kept._bpe = lambda part: asked.append(part) or bpe(part)
    texts = ["known seldom known", " seldom known\nknown", "known seldom"]
    assert [x.tolist() for x in encoder.encode_all(texts)] == [library_ids(t) for t in texts]
    assert sorted(asked) == sorted({"known", "\u0120seldom", "\u010a"})


def test_block_checksums():
    docs = [(5, np.arange(700, dtype=np.uint32)), (None, np.array([2], np.uint32)), (9, np.array([7, 7, 2], np.uint32))]
    block = token_files.write_block(docs, 50257)
    back = token_files.read_block(block)
    assert [(d, x.tolist()) for d, x in back] == [(d, x.tolist()) for d, x in docs]
    for at in (0, 10, len(block) // 2, len(block) - 1):
        with pytest.raises(ValueError):
            token_files.read_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1:])


def test_token_files_of_odd_rows(spark, tmp_path):
    rows = odd_rows() + list(enumerate(ODD_TEXTS, 1000))
    path = str(tmp_path / "tokens")
    token_files.write_corpus(docs_frame(spark, rows).repartition(5), path, tokenizer_path(), VOCABULARY, block_ids=2000)
    got = token_files.read_corpus(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(d for d, _ in rows if d is not None)
    assert [r.doc_id for r in got[:2]] == [None, None]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    expected = sorted((-1 if d is None else d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                      for d, t in rows for ids in [library_ids(t) + [2]])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected


def test_token_files_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_corpus(docs_frame(spark, []), path, tokenizer_path(), VOCABULARY)
    assert token_files.read_corpus(spark, path).count() == 0


def brute_sum_of_squares(lengths, capacity):
    """Gaps of the bins after trying every choice in full."""
    gaps, out = [], []
    for s in lengths:
        best = None
        for b, g in [*enumerate(gaps), (len(gaps), capacity)]:
            if g < s:
                continue
            new = gaps[:b] + [g - s] + gaps[b + 1:]
            counts = np.bincount([x for x in new if 0 < x < capacity], minlength=1)
            key = (int((counts.astype(np.int64) ** 2).sum()), g)
            if best is None or key < best[0]:
                best = (key, new, g)
        gaps, _ = best[1], out.append(capacity - best[2])
    return gaps, out


def test_sum_of_squares_places_as_defined():
    rng = np.random.default_rng(7)
    for _ in range(60):
        capacity = int(rng.integers(2, 14))
        lengths = rng.integers(1, capacity + 1, rng.integers(0, 25))
        bins, offsets = packing.sum_of_squares(lengths, capacity)
        gaps, expected = brute_sum_of_squares(lengths.tolist(), capacity)
        assert offsets.tolist() == expected
        filled = np.bincount(bins, lengths, minlength=0).astype(int)
        assert sorted(capacity - filled) == sorted(gaps)


def check_packing(got, rows, capacity, end_id):
    pieces = {}
    for r in got:
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in pieces.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    expected = []
    for d, t in rows:
        ids = np.array(library_ids(t) + [end_id], "<u4")
        at = 0
        for k, n in enumerate(packing.cut_lengths(len(ids), capacity)):
            expected.append((-1 if d is None else d, k, at, n, zlib.crc32(ids[at:at + n].tobytes())))
            at += n
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    return len(pieces), sum(e[3] for e in expected)


def test_packing_of_odd_rows(spark):
    rows = odd_rows()
    for group in (200_000, 20):
        got = packing.pack_documents(docs_frame(spark, rows), tokenizer_path(), capacity=512, group_pieces=group).collect()
        sequences, tokens = check_packing(got, rows, 512, 0)
        if group > 1000:
            assert sequences <= 1.05 * tokens / 512 + 1
    assert packing.pack_documents(docs_frame(spark, []), tokenizer_path()).count() == 0


def test_cut_lengths():
    assert packing.cut_lengths(5, 4) == [1, 4] and packing.cut_lengths(8, 4) == [4, 4] and packing.cut_lengths(3, 4) == [3]


def test_queries_on_written_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = [r for r in odd_rows() if r[0] != 200]
    write_tables(spark, folder, docs_frame(spark, rows))
    got = llm_queries()["op10_best_fit_packing"](spark, folder).collect()
    check_packing(got, rows, 2048, 0)
    assert llm_queries()["op1_token_files"](spark, folder).count() == len(rows)
