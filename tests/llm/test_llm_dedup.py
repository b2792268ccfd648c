"""Exact dedup (7), SimHash near-dedup (6) and sharding (5) against brute force."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from llm_cases import docs_frame, fold, odd_rows, prose

from kestrel.llm import exact_dedup, sharding, simhash
from kestrel.llm.queries import llm_oracle_sql, llm_queries


def test_exact_dedup_equals_brute_force(spark):
    rows = odd_rows()
    groups = defaultdict(list)
    for d, t in rows:
        groups[fold(t)].append(d)
    for split in ({}, {"min_rows": 2, "buckets": 4, "per_bucket": 2, "tracked": 8}):
        got = exact_dedup.decide(docs_frame(spark, rows), **split).collect()
        expected = []
        for text, ids in groups.items():
            keep = max((d for d in ids if d is not None), default=None)
            expected += [(d, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for d in ids]
        key = lambda r: (r[3], r[0] is None, r[0] or 0)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(expected, key=key)
        kept = [(r.text_sha256, r.doc_id, r.keep_id) for r in got if r.kept]
        assert len(kept) == len(groups) == len({k[0] for k in kept})
        assert all(d == keep for _, d, keep in kept)


def test_exact_dedup_keeps_one_whole_row_of_each_text(spark):
    docs = docs_frame(spark, odd_rows())
    for split in ({}, {"min_rows": 2, "buckets": 4}):
        out = exact_dedup.drop_duplicates(docs, **split)
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) == len({fold(r.text) for r in got}) == len({fold(t) for _, t in odd_rows()})
        best = {}
        for d, t in odd_rows():
            best[fold(t)] = max(best.get(fold(t), -1), -1 if d is None else d)
        assert all(best[fold(r.text)] == (-1 if r.doc_id is None else r.doc_id) for r in got)
        assert all(r.digest == "x" and r.tags == {"a": "b"} for r in got)


def test_exact_dedup_plan_is_native(spark):
    docs = docs_frame(spark, odd_rows())
    plan = exact_dedup.decide(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_exact_dedup_heavy_digest_takes_the_broadcast_way(spark):
    docs = docs_frame(spark, [(i, "hot" if i % 3 else f"t{i}") for i in range(900)])
    rows = docs.selectExpr("doc_id", "sha2(text, 256) AS digest", "doc_id AS rid")
    hot = exact_dedup.frequent_digests(rows).collect()
    assert [(r.hot_size, r.hot_keep.doc_id) for r in hot] == [(600, 899)]


def fingerprint(text):
    words = fold(text).encode().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(fps, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    rows = odd_rows() + [(300 + i, prose(800, 5) + f" tail{i}") for i in range(12)]
    rows = [r for r in rows if r[0] != 200]
    fps = [fingerprint(t) for _, t in rows]
    root = components(fps, 4)
    least = defaultdict(lambda: None)
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    got = simhash.find_near_duplicates(docs_frame(spark, rows)).collect()
    key = lambda r: (r[1], r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(
        ((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(rows, fps, root, strict=True)), key=key)
    kept = simhash.drop_near_duplicates(docs_frame(spark, rows).dropDuplicates(["doc_id", "text"]))
    assert kept.columns == docs_frame(spark, []).columns
    assert kept.count() == len(set(root))


@pytest.mark.parametrize("max_bits,node_rows,blocks", [(4, 4096, None), (4, 4, 5), (4, 16, 6), (2, 8, None), (0, 4096, None)])
def test_trie_join_finds_what_all_pairs_find(spark, max_bits, node_rows, blocks):
    rng = np.random.default_rng(max_bits + node_rows)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist()) | {0, (1 << 64) - 1}
    for f in base.tolist():
        for _ in range(6):
            g = f
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                g ^= 1 << int(b)
            fps.add(g)
    fps |= {(7 << 40) | int(x) for x in rng.integers(0, 1 << 12, 150)}  # one crowded root
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    rows = spark.createDataFrame([(i, s[0]) for i, s in enumerate(signed)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(rows, max_bits, node_rows=node_rows, blocks=blocks).collect()}
    root = components(fps, max_bits)
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    assert got == {i: least[r] for i, r in enumerate(root)}


def test_shards_are_contiguous_balanced_and_gapless(spark):
    rows = odd_rows()
    got = sharding.assign_shards(docs_frame(spark, rows), 16).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())))
    sizes = [len((t or "").encode()) + 1 for _, t in order]
    total, before, expected, slots = sum(sizes), 0, [], defaultdict(int)
    for (d, t), s in zip(order, sizes, strict=True):
        shard = (2 * before + s) * 16 // (2 * total)
        expected.append((d, s, zlib.crc32((t or "").encode()), shard, slots[shard]))
        slots[shard] += 1
        before += s
    assert sorted(map(tuple, got), key=lambda r: (r[3], r[4])) == expected


def test_empty_tables(spark):
    docs = docs_frame(spark, [])
    assert exact_dedup.decide(docs).count() == 0
    assert exact_dedup.drop_duplicates(docs).count() == 0
    assert simhash.find_near_duplicates(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0
    assert sharding.assign_shards(docs).count() == 0


def test_queries_against_duckdb(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in llm_oracle_sql().items():
        got = llm_queries()[name](spark, folder).toPandas()
        expected = con.sql(sql).df()
        columns = sorted(got.columns)
        assert sorted(expected.columns) == columns
        a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, expected))
        assert a.equals(b), name
