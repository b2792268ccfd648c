"""The pipeline against a brute-force version, and the shape of its stages."""

import random
import zlib
from collections import defaultdict

import numpy as np
from llm_cases import docs_frame, fold, odd_rows, prose, remainder, write_tables
from test_llm_dedup import components, fingerprint
from test_llm_text import brute_hits
from test_llm_tokens import check_packing, library_ids

import corpus_pipeline
from kestrel.llm import decontamination, toxicity
from kestrel.llm.queries import llm_queries, toxicity_model


def corpus(spark, folder):
    items = [(i, prose(30, 1000 + i)) for i in range(5)]
    rows = [r for r in odd_rows() if r[0] != 200]
    rows += [(500 + i, f"{prose(20, i)}. {items[i % 5][1]} {prose(18, i + 50)}") for i in range(8)]
    rows += [(700 + i, prose(40, 900 + i) + (" vermin filth" if i % 4 == 0 else "")) for i in range(160)]
    rows += [(520, items[0][1])]
    labels = [(700 + i, 1, int(i % 4 == 0)) for i in range(160)]
    write_tables(spark, folder, docs_frame(spark, rows), items, labels)
    return rows, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows, items = corpus(spark, folder)
    got = corpus_pipeline.run(spark, folder).collect()

    model = toxicity_model(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    odds = lambda t: model.intercept + sum(model.evidence(w) for w in set(decontamination.words_of(t)))
    left = [r for r in rows if odds(r[1]) < 0]
    assert {r[0] for r in rows} - {r[0] for r in left} >= {700 + i for i in range(0, 160, 4)}
    assert not any("vermin" in (t or "") for _, t in left) and {701, 702, 703, 0, 40} <= {d for d, _ in left}

    groups = defaultdict(list)
    for d, t in left:
        groups[fold(t)].append((d is not None, d or 0, t))
    left = [(d if known else None, t) for known, d, t in (max(g, key=lambda x: x[:2]) for g in groups.values())]

    root = components([fingerprint(t) for _, t in left], 4)
    best = {}
    for (d, t), r in zip(left, root, strict=True):
        key = (d is None, d or 0)
        if r not in best or key < best[r][0]:
            best[r] = (key, d, t)
    left = [(d, t) for _, d, t in best.values()]

    final = []
    for d, t in left:
        if brute_hits(t, items, 10)[1]:
            for _, item in items:
                t = t.replace(item, "\n")
            t = "\n".join(p.strip() for p in t.split("\n") if p.strip())
            if not t:
                continue
        assert brute_hits(t, items, 10)[1] == 0
        final.append((d, t))
    check_packing(got, final, 2048, 0)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    folder = f"file://{tmp_path}"
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, folder)
            assert out.dtypes == docs.dtypes
            if table is docs:
                path = f"{folder}/{stage.__name__}"
                out.write.parquet(path)
                assert spark.read.parquet(path).filter("n_chars IS DISTINCT FROM length(text)").count() == 0
            else:
                assert out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == list(llm_queries())
    assert [int(n[2:].split("_")[0]) for n in llm_queries()] == list(range(1, 14))
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()


def test_toxicity_learns_only_from_allowed_labels(spark, tmp_path):
    folder = f"file://{tmp_path}"
    corpus(spark, folder)
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    allowed = [r.doc_id for r in labels.collect() if remainder(r.doc_id, 5) != 0]
    assert remainder(10, 5) == zlib.crc32(b"10") % 5
    one = toxicity_model(docs, labels)
    two = toxicity.train(docs, labels.filter(labels.doc_id.isin(allowed)))
    assert np.isclose(one.intercept, two.intercept) and one.weights.keys() == two.weights.keys()
    assert library_ids("") == []


def test_few_or_random_toxic_labels_keep_the_corpus(spark, tmp_path):
    r = random.Random(3)
    docs = [(i, prose(40, 900 + i) + (" vermin filth" if i < 8 else "")) for i in range(300)]
    frame = docs_frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars")
    named = [d for d in range(300) if remainder(d, 5) != 0]
    toxic = [d for d in named if d < 8]
    kept = {}
    for n in (1, 2, 3, 4, "random"):
        marked = {d for d in named if r.random() < 0.3} if n == "random" else set(toxic[:n])
        folder = f"file://{tmp_path}/{n}"
        labels = [(d, 1, int(d in marked)) for d in named if n == "random" or d >= 8 or d in marked]
        write_tables(spark, folder, frame, labels=labels)
        kept[n] = {x.doc_id for x in corpus_pipeline.drop_toxic(spark, frame, folder).collect()}
    assert all(len([d for d in kept[n] if d >= 8]) >= 285 for n in kept), {n: len(k) for n, k in kept.items()}
    assert not kept[4] & set(toxic)  # a term of 4 rows is learnt
