"""The contract queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import (
    decontamination,
    exact_dedup,
    html_extract,
    language_id,
    merkle,
    packing,
    ranked_search,
    secrets,
    sharding,
    simhash,
    substring_dedup,
    token_files,
    toxicity,
)
from kestrel.llm.common import LOWER, UPPER, scratch_folder, table
from kestrel.session import ensure_checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"
VOCABULARY = 50257


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def _remainder(n: int):
    """crc32 of the doc_id as text (a null one: empty text), modulo ``n``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files by a context-mixing range coder, written and read back."""
    path = scratch_folder(spark, "token-files")
    token_files.write_corpus(table(spark, sf_dir, "documents"), path, tokenizer_path(), VOCABULARY, end_id=2)
    return token_files.read_corpus(spark, path)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by hyperdimensional profiles, learnt from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs.filter(_remainder(3) != 1))
    found = docs.select("doc_id", (_remainder(3) == 1).alias("held_out"),
                        language_id.identify(F.col("text"), profiles).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of pages by nearest-URL page differencing."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by base patterns and a conditional random field."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", secrets.find_secrets(F.col("text"), secrets.train(docs)).alias("found"))
    return found.select("doc_id", "found.n_assign", "found.n_access", "found.n_hex",
                        F.sha2("found.base", 256).alias("base_sha256"), "found.spans")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fit on the labels that the contract allows."""
    return toxicity.train(docs, labels.filter(_remainder(5) != 0))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of a counterfactual-regularised classifier."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", (_remainder(5) == 0).alias("held_out"),
                       toxicity.score(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages found by an FM-index per training shard."""
    return decontamination.contaminated_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous shards of near equal bytes (law ``bytes``)."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components at 4-word shingles and 4 bits."""
    return simhash.find_near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies by a heavy-hitter split."""
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum-of-squares packing into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=2048)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every document, checked against a text with A-Z lower-cased where 5 divides the crc32 of its id."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in merkle.FIELDS]
    chosen = F.col("doc_id").isNotNull() & (_remainder(5) == 0)
    manifest = merkle.build_manifest(docs, claimed=F.when(chosen, merkle.leaf_digest(fields)))
    return merkle.prove(manifest).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root",
        merkle.siblings_digest(F.col("path")).alias("proof_sha256"),
        merkle.folded(F.coalesce("claimed", "leaf"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 35 words that repeat anywhere, by fixed-block anchors."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item, by hashed max-sketches."""
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


_QUERIES = [op1_token_files, op2_language_id, op3_html_extraction, op4_secret_scan, op5_shard_by_bytes,
            op6_simhash_near_dedup, op7_exact_dedup, op8_toxicity, op9_benchmark_decontamination, op10_best_fit_packing,
            op11_merkle_manifest, op12_substring_dedup, op13_ranked_search]


def _prepared(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: _prepared(fn) for fn in _QUERIES}


def _merkle_sql(levels: int = 6, group_levels: int = 4) -> str:
    """The tree level by level; enough for 16^levels documents a source and 16^group_levels sources."""
    def field(name: str, value: str | None = None) -> str:
        value = value or f"CAST({name} AS VARCHAR)"
        return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"

    def leaf(text: str | None = None) -> str:
        return f"sha256({' || '.join(field(f, text if f == 'text' else None) for f in merkle.FIELDS)})"

    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
                 string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
             lambda r, b: list_reduce(list_prepend(xor(r, b), [0::UBIGINT, 1, 2, 3, 4, 5, 6, 7]),
                                      lambda x, i: xor(x // 2, 3988292384 * (x % 2)))))"""

    def tree(leaves: str, name: str, depth: int) -> str:
        """``name``k: nodes of level k; ``name``s: their siblings before and after, for each level."""
        out = f"{name}0 AS (SELECT g, r, h, count(*) OVER (PARTITION BY g) AS n FROM {leaves}),"
        for k in range(depth):
            run = f"PARTITION BY g, r // {merkle.FANOUT} ORDER BY r ROWS BETWEEN"
            out += f"""
            {name}s{k} AS (SELECT g, r, n > 1 AS many,
                coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
                coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k}),
            {name}{k + 1} AS (SELECT g, r, h, count(*) OVER (PARTITION BY g) AS n FROM (
                SELECT g, r // {merkle.FANOUT} AS r,
                       CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h
                FROM {name}{k} GROUP BY g, r // {merkle.FANOUT})),"""
        return out

    def climb(start: str, name: str, depth: int, rank: str, group: str) -> tuple[str, str, str]:
        """(joins, proof, folded digest) up the levels."""
        joins, proof, h = "", [], start
        for k in range(depth):
            s = f"{name}{k}j"
            joins += f"\nJOIN {name}s{k} {s} ON {s}.g = {group} AND {s}.r = {rank} // {merkle.FANOUT ** k}"
            proof.append(f"{s}.b || {s}.a")
            h = f"CASE WHEN {s}.many THEN sha256({s}.b || {h} || {s}.a) ELSE {h} END"
        return joins, " || ".join(proof), h

    up1, proof1, _ = climb("d.t", "l", levels, "d.r", "d.g")
    up2, proof2, _ = climb("p.s", "t", group_levels, "p.i", "0")
    # A digest is folded level by level in sub-selects, as nested CASE texts would double at every level.
    def fold(source: str, name: str, depth: int, value: str, rank: str, group: str) -> str:
        for k in range(depth):
            source = (f"SELECT x.*, CASE WHEN y.many THEN sha256(y.b || x.f || y.a) ELSE x.f END AS f2 FROM ({source}) x "
                      f"JOIN {name}s{k} y ON y.g = {group} AND y.r = x.{rank} // {merkle.FANOUT ** k}")
            source = f"SELECT * EXCLUDE (f, f2), f2 AS f FROM ({source})"
        return source

    low = fold("SELECT d.*, t AS f FROM d", "l", levels, "f", "r", "x.g")
    high = fold("SELECT * FROM p", "t", group_levels, "f", "i", "0")
    return f"""
        WITH hashed AS (SELECT doc_id, source, {leaf()} AS h,
                               CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} END AS claimed FROM documents),
        groups AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)),
        d AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS r, h,
                     coalesce(claimed, h) AS t FROM hashed JOIN groups ON hashed.source IS NOT DISTINCT FROM groups.source),
        {tree("d", "l", levels)}
        top AS (SELECT 0 AS g, g AS r, h FROM l{levels}),
        {tree("top", "t", group_levels)}
        below AS (SELECT d.doc_id, d.g, d.r, d.h, {proof1} AS proof FROM d {up1}),
        p AS (SELECT x.doc_id, x.g AS i, x.r, x.h, l{levels}.h AS s, x.f FROM ({low}) x JOIN l{levels} ON l{levels}.g = x.g),
        above AS (SELECT i, {proof2} AS proof FROM (SELECT DISTINCT i, s FROM p) p {up2}),
        q AS ({high})
        SELECT q.doc_id, q.h AS leaf, q.s AS subroot, t{group_levels}.h AS root,
               sha256(below.proof || above.proof) AS proof_sha256, q.f AS folded_root, q.f = t{group_levels}.h AS verified
        FROM q JOIN below ON below.g = q.i AND below.r = q.r JOIN above USING (i) CROSS JOIN t{group_levels}"""


def llm_oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""
    folded = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"regexp_extract_all(folded, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return {
        "op7_exact_dedup": f"""
            WITH t AS (SELECT doc_id, {folded} AS folded FROM documents)
            SELECT doc_id,
                   max(doc_id) OVER (PARTITION BY folded) AS keep_id,
                   count(*) OVER (PARTITION BY folded) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY folded) AS kept,
                   sha256(folded) AS text_sha256
            FROM t""",
        "op9_benchmark_decontamination": f"""
            WITH d AS (SELECT doc_id, {words} AS w FROM (SELECT doc_id, {folded} AS folded FROM documents)),
            b AS (SELECT item_id, {words} AS w FROM (SELECT item_id, {folded} AS folded FROM benchmark)),
            phrase AS (
              SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS p
              FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
            place AS (
              SELECT doc_id, i, n, w[i:i + n - 1] AS p
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                    FROM d JOIN (SELECT DISTINCT n FROM phrase) ON len(w) >= n)),
            hit AS (SELECT doc_id, i, n, item_id FROM place JOIN phrase USING (n, p)),
            word AS (SELECT doc_id, count(DISTINCT k) AS n_hit
                     FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
            item AS (SELECT doc_id, count(*) AS n_items,
                            string_agg(item_id, ',' ORDER BY item_id) AS items
                     FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
                   coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
                   coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)""",
        "op11_merkle_manifest": _merkle_sql(),
        "op12_substring_dedup": r"""
            WITH d AS (SELECT row_number() OVER () AS k, doc_id,
                              regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            place AS (SELECT k, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h
                      FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
            again AS (SELECT k, i FROM place JOIN (SELECT h FROM place GROUP BY h HAVING count(*) > 1) USING (h)),
            gone AS (SELECT k, list(DISTINCT j) AS js FROM (SELECT k, unnest(range(i, i + 35)) AS j FROM again) GROUP BY k),
            word AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
            kept AS (SELECT word.k, string_agg(word, ' ' ORDER BY word.j) AS kept FROM word
                     LEFT JOIN (SELECT k, unnest(js) AS j FROM gone) g ON g.k = word.k AND g.j = word.j
                     WHERE g.j IS NULL GROUP BY word.k)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
                   sha256(coalesce(kept, '')) AS kept_sha256
            FROM d LEFT JOIN gone USING (k) LEFT JOIN kept USING (k)""",
        "op13_ranked_search": f"""
            WITH d AS (SELECT doc_id, row_number() OVER () AS k,
                              regexp_extract_all(folded, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
                       FROM (SELECT doc_id, {folded} AS folded FROM documents)),
            n AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
            item AS (SELECT item_id, number, unnest(list_distinct(regexp_extract_all(folded, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))) AS t
                     FROM (SELECT item_id, row_number() OVER () AS number, {folded} AS folded FROM benchmark)),
            tf AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(w) AS t FROM d)
                   WHERE t IN (SELECT t FROM item) GROUP BY k, t),
            weight AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
                       FROM tf, n GROUP BY t, docs),
            impact AS (SELECT k, t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * docs) // terms))) AS impact
                       FROM tf JOIN d USING (k) JOIN weight USING (t), n),
            score AS (SELECT number, item_id, k, CAST(sum(impact) AS BIGINT) AS score
                      FROM item JOIN impact USING (t) GROUP BY number, item_id, k HAVING sum(impact) > 0)
            SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
            FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS LAST) AS rank
                  FROM score JOIN d USING (k))
            WHERE rank <= 10""",
    }
