"""Merkle manifest, repeated windows and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kestrel.llm import merkle, queries, ranked_search, substring_dedup
from tests.llm.llm_cases import docs_frame, fold, odd_rows, prose, write_tables


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- Merkle manifest -----------------------------------------------------------

def leaf_of(row):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(field, row)))


def tree(leaves):
    """(root, per leaf its list of (before, after), from the leaf upwards)."""
    paths, now = [[] for _ in leaves], leaves
    above = list(range(len(leaves)))
    while len(now) > 1:
        for i, at in enumerate(above):
            run = at - at % 16
            paths[i].append(("".join(now[run:at]), "".join(now[at + 1:run + 16])))
            above[i] = at // 16
        now = [sha("".join(now[k:k + 16])) for k in range(0, len(now), 16)]
    return now[0], paths


def manifest_of(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, inner = [], []
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        top, paths = tree([x[2] for x in groups[name]])
        subroots.append(top)
        inner.append(paths)
    root, upper = tree(subroots)
    out = []
    for g, name in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(groups[name]):
            path = inner[g][i] + upper[g]
            h = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                h = leaf_of((*r[:4], fold(r[4]) if r[4] is not None else None))
            for before, after in path:
                h = sha(before + h + after)
            out.append((r[0], leaf, subroots[g], root, sha("".join(b + a for b, a in path)), h, h == root))
    return sorted(out, key=repr)


def manifest_rows(n=700):
    r = random.Random(4)
    rows = [(i, f"s{r.randrange(25)}" if i % 3 else "hot", r.choice(["en", None]), r.choice([None, i]), t)
            for i, t in [*odd_rows()[:60], *[(1000 + k, f"Text Of {k}") for k in range(n)]] if i is not None]
    rows += [(None, "s1", "en", 1, "No Id"), (None, None, None, None, None), (7, None, "de", 3, "é"), (7, None, "de", 3, "é")]
    rows += [(5, "alone", "en", 4, "ABC"), (6, "Ünï", "en", 0, ""), (9, "", "en", 1, "x")] + [(77, "same", "en", 1, "Copy")] * 40
    return rows


def as_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def test_manifest_equals_brute_force(spark, tmpdir_path):
    rows = manifest_rows()
    write_tables(spark, tmpdir_path, as_docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars"))
    got = queries.llm_queries()["op11_merkle_manifest"](spark, tmpdir_path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == manifest_of(rows)


def test_manifest_of_one_and_of_no_row(spark):
    one = as_docs(spark, [(1, "a", "en", 2, "Hi")])
    row = merkle.prove(merkle.build_manifest(one)).first()
    assert row["leaf"] == row["subroot"] == row["root"] == leaf_of((1, "a", "en", 2, "Hi")) and row["path"] == []
    empty = merkle.build_manifest(one.limit(0))
    assert empty.root is None and merkle.prove(empty).count() == 0


def test_proofs_of_requested_leaves_only(spark):
    manifest = merkle.build_manifest(as_docs(spark, manifest_rows()))
    every = defaultdict(list)  # repeated rows have equal leaves at several places
    for r in merkle.prove(manifest).collect():
        every[r["leaf"]].append(r["path"])
    asked = manifest.leaves.filter("rank % 50 = 3 AND tree <> '=s3'")
    some = merkle.prove(manifest, asked).collect()
    assert len(some) == asked.count() > 5
    assert all(r["path"] in every[r["leaf"]] for r in some)
    assert {r["root"] for r in some} == {manifest.root}


def test_manifest_ignores_other_columns(spark):
    docs = docs_frame(spark, odd_rows()).withColumns({"tree": F.lit("t"), "rank": F.lit(1), "claimed": F.lit("c"), "key": F.lit(0)})
    plain = docs.select("doc_id", "source", "lang", "n_chars", "text")
    a, b = (sorted(map(repr, merkle.prove(merkle.build_manifest(d)).collect())) for d in (docs, plain))
    assert a == b and len(a) == docs.count()


# ---- repeated windows ----------------------------------------------------------

def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def without_repeats(rows, window):
    seen = Counter()
    for _, t in rows:
        w = words(t)
        seen.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def repeat_rows():
    r = random.Random(11)
    passage = [prose(n, 500 + n).split() for n in (34, 35, 36, 52, 53, 71, 200)]
    rows = odd_rows()[:-1] + [(200, prose(3000, 77)), (201, "x" + prose(3000, 77))]
    for i in range(60):  # passages at every offset, some cut short
        body = prose(r.randrange(0, 90), 1000 + i).split()
        p = r.choice(passage)
        rows.append((300 + i, " ".join([*body, *p[r.choice([0, 0, 1, 5]):], *prose(r.randrange(40), 2000 + i).split()])))
    rows += [(400, "again " * 34), (401, "ever " * 35), (402, "more " * 36), (403, "a b " * 60), (404, " ".join("abc") + " \x0b\t".join(map(str, range(80))))]
    rows += [(405, "\n".join(map(str, range(40, 90))))]
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 900, "range_bytes": 500, "broadcast_bytes": 0},
                                     {"window": 4, "chunk_bytes": 5000}, {"window": 1}])
def test_repeats_equal_brute_force(spark, options):
    rows = repeat_rows()
    got = substring_dedup.remove_repeats(docs_frame(spark, rows), **options).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == without_repeats(rows, options.get("window", 35))
    for r in got:
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) == r.n_removed


def test_repeats_query_and_empty_table(spark, tmpdir_path):
    rows = repeat_rows()
    write_tables(spark, tmpdir_path, docs_frame(spark, rows))
    got = queries.llm_queries()["op12_substring_dedup"](spark, tmpdir_path)
    want = [(d, n, k, sha(kept)) for d, n, k, kept in without_repeats(rows, 35)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert substring_dedup.remove_repeats(docs_frame(spark, [])).count() == 0


def test_few_chunks_are_held_at_once(spark, monkeypatch):
    rows = repeat_rows()
    monkeypatch.setattr(substring_dedup, "ROW_GROUP_BYTES", 4 * 500)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = substring_dedup.remove_repeats(docs_frame(spark, rows).coalesce(1), chunk_bytes=500, broadcast_bytes=0)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, got.select("doc_id", "n_words", "n_removed", "kept").collect())) == sorted(
            f"Row(doc_id={d!r}, n_words={n!r}, n_removed={k!r}, kept={t!r})" for d, n, k, t in without_repeats(rows, 35))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    groups = [pq.ParquetFile(f).metadata for f in (x.removeprefix("file://") for x in got.inputFiles() if "/chunks-" in x)]
    held = [g.row_group(k).num_rows for g in groups for k in range(g.num_row_groups)]
    assert sum(held) > 20 and max(held) <= 4
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan  # a merge sorts the chunks


def test_answers_of_ranges_follow_each_other():
    cuts = [0, 3, 3, 20, 21]
    flags = np.arange(21) % 3 == 0
    blob = b"".join(substring_dedup._answer(p, flags[cuts[p]:cuts[p + 1]]) for p in (2, 0))
    want = flags.copy()
    want[20] = False
    assert np.array_equal(substring_dedup._answered(blob, cuts), want) and len(blob) == 4 + 3 + 4 + 1
    assert not substring_dedup._answered(None, cuts).any()


def test_long_text_is_hashed_in_pieces(monkeypatch):
    text = ("  " + prose(2000, 3) + "\n\t").encode()
    whole = substring_dedup.word_hashes(text)
    monkeypatch.setattr(substring_dedup, "_PIECE", 97)
    assert len(list(substring_dedup.pieces(text))) > 100
    assert np.array_equal(whole, substring_dedup.word_hashes(text))


# ---- ranked search -------------------------------------------------------------

def terms(text):
    return [fold(t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(rows, items, k=10):
    docs = [(d, Counter(terms(t))) for d, t in rows]
    n = sum(bool(c) for _, c in docs)
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in docs:
            m = 10 + (90 * sum(c.values()) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


ITEMS = [(i, prose(12, 900 + i)) for i in range(15)] + [
    (50, prose(120, 1)), (51, None), (52, " .,;"), (53, "COPY of one text"), (54, "river"), (None, "stone river Über"), (53, "COPY of one text"),
    (55, "nowhere unheard"), (56, prose(3000, 5))]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 400}, {"k": 3}])
def test_search_equals_brute_force(spark, options):
    rows = odd_rows()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranked_search.rank_documents(docs_frame(spark, rows), items, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(rows, ITEMS, options.get("k", 10))


def test_search_of_empty_tables(spark, tmpdir_path):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_frame(spark, odd_rows())
    assert ranked_search.rank_documents(docs.limit(0), items).count() == 0
    assert ranked_search.rank_documents(docs, items.limit(0)).count() == 0
    write_tables(spark, tmpdir_path, docs, [x for x in ITEMS if x[0] is not None])
    got = queries.llm_queries()["op13_ranked_search"](spark, tmpdir_path)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(odd_rows(), [x for x in ITEMS if x[0] is not None])


def test_bounds_hold_and_prune():
    r = random.Random(2)
    texts = [" ".join(f"w{int(r.paretovariate(0.6)) % 4000}" for _ in range(r.choice([5, 60, 400]))) for _ in range(600)]
    items = ranked_search.Items([(i, " ".join(texts[7 * i].split()[:20])) for i in range(20)])
    df = Counter(t for x in texts for t in set(x.encode().split()))
    items.weigh(len(texts), sum(len(x.split()) for x in texts), df)
    batch = ranked_search.Batch(texts, items)
    bounds = batch.bounds(items)
    doc, item = map(np.ravel, np.indices(bounds.shape))
    exact = batch.scores(doc, item, items).reshape(bounds.shape)
    assert (bounds >= exact).all()
    best = ranked_search.Best(20, 10)
    rescored = ranked_search.search_batch(batch, items, best, np.arange(600), np.zeros(600, int))
    assert rescored < bounds.size / 4
    assert (best.score == -np.sort(-exact, axis=0)[:10].T).all()
