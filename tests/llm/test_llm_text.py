"""Language ID (2), secret scan (4), toxicity (8), decontamination (9), HTML extraction (3)."""

import hashlib
import html
import itertools
import random
import re

import numpy as np
import pytest
from llm_cases import docs_frame, fold, odd_rows, prose, remainder, write_tables
from pyspark.sql import functions as F

from kestrel.llm import decontamination, html_extract, language_id, secrets, toxicity
from kestrel.llm.queries import llm_queries

SMALL = "/root/testdata/sf0.01"

# -- language ------------------------------------------------------------------


def test_language_query_on_held_out_documents(spark):
    got = llm_queries()["op2_language_id"](spark, SMALL)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_odd_rows_and_no_training(spark):
    docs = docs_frame(spark, odd_rows())
    learnt = language_id.learn(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy")))
    assert learnt.languages == ["xx", "yy"]
    rows = docs.select("text", language_id.identify(F.col("text"), learnt).alias("p")).collect()
    for r in rows:
        assert (r.p.lang == "und") == (not any(c.isalpha() for c in r.text or "")), r.text
    nothing = language_id.learn(docs_frame(spark, []))
    assert {r.p.lang for r in docs.select(language_id.identify(F.col("text"), nothing).alias("p")).collect()} == {"und"}
    same = language_id.learn(docs.withColumn("lang", F.lit("only")))
    assert same.predict(["river stone"])[0][0] == "only"


def test_hypervectors_bind_and_bundle_as_defined():
    v = [language_id.letter_vector(ord(c), 64).astype(int) for c in " ab"]
    grams, counts = language_id.trigrams("ab")
    expected = np.roll(v[0], 2) * np.roll(v[1], 1) * v[2] + np.roll(v[1], 2) * np.roll(v[2], 1) * v[0]
    assert (language_id.bundles([(grams, counts)], 64)[0] == expected).all()
    assert len(language_id.trigrams("12 ..!")[0]) == 0


# -- secrets -------------------------------------------------------------------


def brute_base(text):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


SECRET_TEXTS = [None, "", "token = \"0123456789abcdef0123\" x", "pASSWORD:'short' secret=aaaaaaaaaaaa=", "AKIA1234567890ABCD AKIAX",
                "api-key=abcdefabcdefabcdef apikey : Zz9_zz9_zz9_ API_KEY=é0123456789abcdef", "toKen=abcdefghijklmn", "é" * 50]


@pytest.fixture(scope="module")
def field(spark):
    return secrets.train(spark.read.parquet(f"{SMALL}/documents.parquet"), sample_docs=400)


def test_base_spans(spark, field):
    texts = SECRET_TEXTS + [t for _, t in odd_rows()]
    docs = docs_frame(spark, list(enumerate(texts)))
    rows = docs.select("doc_id", secrets.find_secrets(F.col("text"), field).alias("f")).collect()
    for r in rows:
        base = brute_base(texts[r.doc_id] or "")
        assert r.f.base.split(",") == (base or [""])
        assert set(base) <= set(r.f.spans.split(",")) | {""}
        assert [r.f.n_assign, r.f.n_access, r.f.n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]


def test_field_finds_what_no_pattern_has(field):
    scanner = secrets.Scanner(field)
    text = "the password is Zk39xkdoWq8812xLpQ99 and so on"
    assert [text[a:b] for a, b, k in next(iter(scanner.scan([text])))[1]] == ["Zk39xkdoWq8812xLpQ99"]
    plain = ["Nothing but words, a date 2024-05-17 and version v1.2.3 at https://example.com/a/b", prose(200, 3)]
    assert [x for _, x in scanner.scan(plain)] == [[], []]


def planted(texts, seed):
    """Texts with one secret set between two words, with a form and lead-in that training does not insert, and its span."""
    r = random.Random(seed)
    leads = ("my login key:", "use credentials", "session cookie =", "license code", "signing material:", "deploy key")
    for text in texts:
        at = r.choice([m.start() for m in re.finditer(" ", text)])
        body = "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(r.randrange(18, 40)))
        secret = r.choice(["", "pat-", "AIza", "glsa_"]) + body
        lead = f"{text[:at]} {r.choice(leads)} "
        yield lead + secret + text[at:], (len(lead), len(lead) + len(secret))


def test_field_finds_unseen_forms_in_held_out_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) > 200")
    field = secrets.train(docs.filter("doc_id % 2 = 0"), sample_docs=400)
    texts = [r.text for r in docs.filter("doc_id % 2 = 1 AND length(text) < 20000").orderBy("doc_id").limit(300).collect() if " " in r.text]
    cases = list(planted(texts, 4))
    found = [[(a, b) for a, b, _ in every] for _, every in secrets.Scanner(field).scan([t for t, _ in cases])]
    hits = sum(any(a < e and s < b for s, e in spans) for spans, (_, (a, b)) in zip(found, cases, strict=True))
    right = sum(a < e and s < b for spans, (_, (a, b)) in zip(found, cases, strict=True) for s, e in spans)
    base = sum(len(secrets.base_spans(t)) for t in texts)
    print("recall", hits / len(cases), "precision", right / (sum(map(len, found)) - base), len(cases))
    assert hits >= 0.9 * len(cases)
    assert right >= 0.9 * (sum(map(len, found)) - base)


def test_training_draws_documents_with_and_without_a_match_apart(spark):
    rare = [(i, f"{prose(40, i)} token = a1B2c3D4e5F6g7{i:03} {prose(30, i + 7)}") for i in range(5)]
    docs = docs_frame(spark, rare + [(100 + i, prose(60, 100 + i)) for i in range(600)])
    field = secrets.train(docs, sample_docs=60)
    assert any(f.startswith("l1|mark==") for f in field.weights)  # what stands before the rare matches is learnt
    long = " ".join(f"token = {'abc123XYZ' * 2}{i:04}" for i in range(50))
    assert sum(w[1].count(secrets.BEGIN) > 0 for w in secrets.training_windows(long, 11)) >= 50  # every match has a window
    assert secrets.file_features("a" * 5000 + "B" * 5000)[2] == "file.upper=2"


@pytest.mark.parametrize("name", ["op2_language_id", "op4_secret_scan", "op8_toxicity"])
def test_queries_over_null_and_repeated_ids(spark, tmp_path, name):
    rows = [(i, prose(30, i)) for i in range(40)] + [(None, prose(30, 1)), (None, None), (3, prose(30, 3)), (3, None), (5, "")]
    folder = f"file://{tmp_path}"
    write_tables(spark, folder, docs_frame(spark, rows))
    out = llm_queries()[name](spark, folder).collect()
    assert len(out) == len(rows)
    if name != "op4_secret_scan":
        assert all(r.held_out is not None for r in out)


def test_viterbi_is_exact():
    rng = np.random.default_rng(5)
    for n in range(1, 8):
        for scale in (1, 5):
            scores, trans = rng.normal(size=(n + 2, 3)) * scale, rng.normal(size=(3, 3))
            scores[[0, -1]] = (1e6, 0, 0)
            value = lambda y: sum(scores[i, k] for i, k in enumerate(y)) + sum(trans[a, b] for a, b in itertools.pairwise(y))  # noqa: B023,E731
            best = max(((0, *y, 0) for y in itertools.product(range(3), repeat=n)), key=value)
            assert tuple(secrets._decode(scores, trans)) == best


def test_training_likelihood_gradient():
    rng = np.random.default_rng(2)
    scores, trans, mask = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), np.array([[True, True, True, False]])
    node, pair = secrets._forward_backward(scores, mask, trans)
    weight = {y: np.exp(sum(scores[0, i, k] for i, k in enumerate(y)) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
              for y in itertools.product(range(3), repeat=3)}
    z = sum(weight.values())
    for i in range(3):
        for k in range(3):
            assert np.isclose(node[0, i, k], sum(w for y, w in weight.items() if y[i] == k) / z)
            assert np.isclose(pair[i, k], sum(w * sum((a, b) == (i, k) for a, b in itertools.pairwise(y)) for y, w in weight.items()) / z)
    assert (node[0, 3] == 0).all()


def test_secret_scan_empty_table(spark):
    empty = docs_frame(spark, [])
    assert empty.select(secrets.find_secrets(F.col("text"), secrets.train(empty)).alias("f")).count() == 0


# -- toxicity ------------------------------------------------------------------


def test_toxicity_query_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = llm_queries()["op8_toxicity"](spark, folder)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    caught = sum(r.predicted for r in held if r.toxic == 1)
    assert caught >= 0.88 * sum(r.toxic for r in held)
    assert sum(r.predicted for r in held if r.toxic == 0) <= 0.01 * len(held)


def test_counterfactual_penalty_keeps_group_mentions_neutral():
    swap = toxicity.swaps(toxicity.IDENTITY_TERMS)
    r = random.Random(4)
    rows, other, labels = [], [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = {f"w{r.randrange(60)}".encode() for _ in range(12)}
        if r.random() < (0.9 if toxic else 0.2):
            words.add(b"muslim")  # named mostly in toxic rows
        if toxic and r.random() < 0.8:
            words.add(b"vermin")
        swapped = {swap.get(w, w) for w in words}
        rows.append(np.array(toxicity.features(words), np.int64))
        other.append(np.array(toxicity.features(swapped), np.int64) if swapped != words else None)
        labels.append(int(toxic))
    plain = toxicity.fit(rows, other, np.array(labels), fairness=0.0)
    fair = toxicity.fit(rows, other, np.array(labels), fairness=10.0)
    change = lambda m: abs(m.evidence(b"muslim") - m.evidence(b"jewish"))
    assert change(plain) > 2 and change(fair) < 0.2 * change(plain)
    assert fair.evidence(b"vermin") > 2


def test_toxicity_odd_rows(spark):
    docs = docs_frame(spark, odd_rows())
    for labels in ([], [(1, None, None)], [(1, 1, 1), (1, 0, 0)], [(i, 0, i % 2) for i in range(20)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        rows = docs.select("text", toxicity.score(F.col("text"), model).alias("p")).collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r.p <= 1 for r in rows)
        assert len({r.p for r in rows if not (r.text or "").strip()}) == 1
    assert docs_frame(spark, []).select(toxicity.score(F.col("text"), model).alias("p")).count() == 0


# -- decontamination -------------------------------------------------------------


def brute_hits(text, items, window):
    words = decontamination.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        of = decontamination.words_of(t)
        n = min(window, len(of))
        phrases = {tuple(of[i:i + n]) for i in range(len(of) - n + 1)} if of else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in phrases:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(words), len(hit), sorted(map(str, found - {None}))


def test_fm_index_equals_brute_force():
    r = random.Random(3)
    for _ in range(150):
        vocabulary = [f"w{i}" for i in range(r.choice([2, 4, 9]))] + ["é"]
        items = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 2, 3, 6, 12])))) for i in range(r.choice([0, 1, 5]))]
        texts = [None, ""] + [" ".join(r.choices([*vocabulary, "zz", "QQ"], k=r.choice([0, 3, 30, 200]))) for _ in range(6)]
        texts += texts[-2:]
        window = r.choice([2, 3, 5, 10])
        phrases = decontamination.Phrases([(str(i), t) for i, t in items], window)
        counts, hits = decontamination.search_shard(texts, phrases)
        for k, t in enumerate(texts):
            spans, found = hits.get(k, ([], set()))
            assert (counts[k], sum(b - a for a, b in spans), sorted(found)) == brute_hits(t, items, window)


def upper(text):
    return ''.join(c.upper() if c.isascii() else c for c in text)


def contaminated_case(spark):
    items = [(i, prose(30, 1000 + i)) for i in range(6)] + [(6, "two words"), (7, None), (8, ""), (None, prose(12, 2000)), (9, prose(30, 1000))]
    rows = odd_rows()
    rows += [(500 + i, f"{prose(9, i)}. {upper(items[i % 6][1])} {prose(8, i)}") for i in range(8)]
    rows += [(600, "so: Two, WORDS!"), (601, items[9][1]), (602, items[0][1] + " " + items[1][1])]
    return rows, items


def test_decontamination_in_blocks(spark):
    rows, items = contaminated_case(spark)
    docs = docs_frame(spark, rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 300):
        got = decontamination.contaminated_documents(docs, benchmark, 10, block_bytes=size).collect()
        expected = []
        for d, t in rows:
            n, hit, found = brute_hits(t, items, 10)
            expected.append((d, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(expected, key=key)
        assert sum(r.contaminated for r in got) == 11


def test_removal_leaves_no_passage_and_no_clean_change(spark):
    rows, items = contaminated_case(spark)
    docs = docs_frame(spark, rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.remove_contamination(docs, benchmark)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(map(str, got)) == sorted(map(str, decontamination.remove_contamination(docs, benchmark, block_bytes=300).collect()))
    assert all(brute_hits(r.text, items, 10)[1] == 0 for r in got)
    clean = [(d, t) for d, t in rows if not brute_hits(t, items, 10)[1]]
    changed = {501, 502, 503, 504, 505, 506, 507, 500, 600}
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got if r.doc_id not in changed), key=key) == sorted(clean, key=key)
    assert {r.doc_id for r in got if r.doc_id in changed} == changed  # 601 and 602 were passages only
    assert next(r.text for r in got if r.doc_id == 500) == f"{prose(9, 0)}.\n{prose(8, 0)}"
    assert decontamination.remove_contamination(docs, benchmark.limit(0)).count() == len(rows)
    assert decontamination.remove_contamination(docs.limit(0), benchmark).count() == 0


# -- html ------------------------------------------------------------------------


def template(body, extra=""):
    return ("<html><head><title>T</title><style>p{}</style></head><body><div>Acme News</div><p>Read more on our partner sites today</p>"
            f"{body}<p>All rights reserved by Acme &copy; 2024</p>{extra}</body></html>")


PAGES = [
    (1, "http://acme.example/a/1", template("<p>First story &amp; its   text.</p>")),
    (2, "http://acme.example/a/2", template("<p>Second story,<br>in two lines</p>")),
    (3, "http://acme.example/a/3", template("<p>Third story.</p>")),
    (3, "http://acme.example/a/3", template("<p>Third story.</p>")),
    (4, "http://acme.example/a/4", template("<p>Third story.</p>")),
    (5, "http://other.example/x", "<body><header>Top</header><main><h1>Head</h1><p>One &lt;b&gt;<p>Two <i>in</i>line"
        "<script>var t='</p>';</script><aside>side</aside><form>f</form><div class='comments'>reader</div>"
        "<div class='cookie-notice'>c</div><ul><li>a<li>b</ul></main><footer>End</footer>"),
    (6, "http://third.example/p/1", "<nav>N</nav><article><header><h1>Title</h1></header><p>Body of it, long enough to be prose here.</p>"
        "<p>Share this</p></article><div>Other</div>"),
    (7, "http://third.example/p/2", "<article><p>Quite another body, also long enough to be prose here.</p><p>Share this</p></article>"),
    (8, "http://third.example/p/3", "<article><p>A third body, which is long enough to be prose here.</p><p>Share this</p></article>"),
    (9, None, None), (10, "", ""), (None, "http://[bad", "<p>unclosed <b>tags &eacute;"), (11, "x", "plain   text < 5 > 3"),
]
TEXTS = {1: "First story & its text.", 2: "Second story,\nin two lines", 3: "Third story.", 4: "Third story.",
         5: "Head\nOne <b>\nTwo inline\na\nb", 6: "Title\nBody of it, long enough to be prose here.\nShare this",
         7: "Quite another body, also long enough to be prose here.",
         8: "A third body, which is long enough to be prose here.\nShare this", 9: "", 10: "", None: "unclosed tags é"}


def test_main_text_of_pages(spark):
    pages = spark.createDataFrame([(*p, "k", "l") for p in PAGES], "page_id long, url string, html string, key string, lines string")
    rows = html_extract.main_text(pages).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        if r.page_id != 11:
            assert r.text == TEXTS[r.page_id], r.page_id
        assert r.n_chars == len(r.text)
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_common_lines_are_longest():
    r = random.Random(8)
    for _ in range(300):
        a, b = ([r.randrange(5) for _ in range(r.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        at = html_extract.common_lines(a, b)
        assert len(at) == best[-1][-1] and at == sorted(set(at))
        rest = iter(b)
        assert all(any(y == a[i] for y in rest) for i in at)


def test_page_order_does_not_depend_on_partitions(spark):
    pages = [(i, f"http://big.example/n/{i:03}", template(f"<p>Story number {i} has its own words, {fold(prose(9, i))}.</p>"))
             for i in range(700)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for n in (1, 7):
        rows = html_extract.main_text(frame.repartition(n)).collect()
        assert all(r.text.startswith(f"Story number {r.page_id} ") and "Acme" not in r.text for r in rows) and len(rows) == 700


def test_main_text_query_reads_whole_table(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write_tables(spark, folder, docs_frame(spark, []), pages=PAGES)
    assert llm_queries()["op3_html_extraction"](spark, folder).count() == len(PAGES)


def long_template(body):
    menu = "".join(f"<p>Section {fold(prose(3, 40 + i))} of the site</p>" for i in range(60))
    return f"<html><body><div>{menu}</div>{body}<p>All rights reserved by Acme</p></body></html>"


@pytest.mark.parametrize("block, ends", [(256, 64), (4, 2)])
def test_partner_beyond_a_run_of_near_copies(spark, monkeypatch, block, ends):
    monkeypatch.setattr(html_extract, "BLOCK", block)
    monkeypatch.setattr(html_extract, "ENDS", ends, raising=False)
    story = "".join(f"<p>Long story, paragraph {i}: {prose(30, 500 + i)}.</p>" for i in range(8))
    pages = [(0, "http://run.example/a", template("<p>First of all.</p>")), (90, "http://run.example/z", template("<p>Last of all.</p>"))]
    pages += [(i, f"http://run.example/m?view={i}", template(f"{story}<p>Seen {i} times</p>")) for i in range(1, 21)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == "First of all." and got[90] == "Last of all."
    for i in range(1, 21):
        assert got[i].startswith("Long story, paragraph 0") and got[i].endswith(f"Seen {i} times") and "Acme" not in got[i]
        assert got[i].count("\n") == 8


@pytest.mark.parametrize("block, ends", [(256, 64), (4, 2)])
def test_short_articles_in_a_long_template(spark, monkeypatch, block, ends):
    monkeypatch.setattr(html_extract, "BLOCK", block)
    monkeypatch.setattr(html_extract, "ENDS", ends, raising=False)
    word = [f"{a}{b}" for a in "abcdef" for b in "vwxyz"]
    text = {i: " ".join(f"{word[i]}{c}" for c in ("one", "two", "three", "four")) for i in range(30)}
    pages = [(i, f"http://short.example/n/{i:02}", long_template(f"<p>{t}</p>")) for i, t in text.items()]
    # Copies of one text under other addresses, differing in a number, keep it.
    pages += [(100 + i, f"http://same.example/n/{i:02}", long_template(f"<p>The one text of all.</p><p>Seen {i} times</p>")) for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in text} == text
    assert all("The one text of all." in got[100 + i] for i in range(6))


def test_marks_drop_no_article_text(spark):
    def page(i):
        return (f'<article><h1 id="social">Title {i}</h1><h2 id="related-work">Related work {i}</h2><p class="ad-hoc">An ad hoc text {i}.</p>'
                f'<section id="search-algorithms"><h3 id="skip-lists">Skip lists {i}</h3><p id="notice">Text of lists {i}.</p>'
                f'<p>See <span id="share" class="menu-item">item {i}</span></p></section><div id="comment">Remark {i}</div>'
                '<div class="ad-slot">Buy now</div><div class="ad">Advert</div><div class="cookie-notice">Cookies</div></article>')

    pages = [(i, f"http://marks.example/{i}", page(i)) for i in range(4)]
    pages += [(10 + i, f"http://bare.example/{i}", page(i).replace("article", "div")) for i in range(4)]
    for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        i = r.page_id % 10
        lines = [f"Title {i}", f"Related work {i}", f"An ad hoc text {i}.", f"Skip lists {i}", f"Text of lists {i}.", f"See item {i}"]
        assert r.text.split("\n") == lines + ([f"Remark {i}"] if r.page_id < 10 else []), r.page_id


def test_sentences_on_all_pages_leave_articles(spark):
    plea = "Sign up to our letter and never miss a story again."
    law = f"{prose(40, 3)}."
    pages = [(i, f"http://plea.example/{i}", f"<article><h2>Summary</h2><p>{fold(prose(12, i))}.</p><p>{plea}</p><p>{law}</p></article>")
             for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    # The first and the last page have one partner only.
    assert {i for i in got if plea in got[i]} == {0, 3}
    assert all(t.startswith("Summary\n") and law in t and fold(prose(12, i)) in t for i, t in got.items())


def article_blocks(page):
    """Texts of the blocks of the article element of a test page, as they stand there."""
    inside = re.sub(r"(?s)<(aside|nav|form|script|style|button)\b.*?</\1>|<!--.*?-->", " ", re.search(r"(?s)<article.*?</article>", page)[0])
    inside = re.sub(r'(?s)<div class="(?:ad|comment|comments)">.*?</div>', " ", inside)
    blocks = re.findall(r"(?s)<(?:p|h1|h2|h3)\b[^>]*>(.*?)</(?:p|h1|h2|h3)>", inside)
    lines = [line for b in blocks for line in re.split(r"<br\b[^>]*>", b)]
    return [t for line in lines if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", "", line)).split()))]


def test_no_article_paragraph_is_lost_on_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    texts = {r.page_id: r.text.split("\n") for r in html_extract.main_text(pages).collect()}
    lost = [(r.page_id, t) for r in pages.filter("html LIKE '%<article%'").collect() for t in article_blocks(r.html) if t not in texts[r.page_id]]
    assert not lost


@pytest.mark.parametrize("block, ends", [(256, 64), (4, 2)])
def test_passages_of_neighbours_stay_in_articles(spark, monkeypatch, block, ends):
    monkeypatch.setattr(html_extract, "BLOCK", block)
    monkeypatch.setattr(html_extract, "ENDS", ends)
    quote, plea = "A sentence that three neighbours quote.", "Sign up to our letter and never miss a story again."
    pages = [(i, f"http://quote.example/{i:02}", f"<article><h1>Head {i}</h1><p>{fold(prose(12, i))}.</p>"
              f"{f'<p>{quote}</p>' if 4 <= i <= 6 else ''}<p>{plea}</p></article>") for i in range(12)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i for i in got if quote in got[i]} == {4, 5, 6}
    assert {i for i in got if plea in got[i]} == {0, 11}  # these have one partner only


@pytest.mark.parametrize("blocks", [{}, {"block_bytes": 100}])
def test_a_passage_that_cutting_forms_anew_is_cut_again(spark, blocks):
    clean = prose(60, 3)
    benchmark = spark.createDataFrame([(1, "two words"), (2, "three more words here"), (3, prose(40, 8))], "item_id long, text string")
    texts = [f"{clean} two two words words {clean}", "two two two words words words", f"three three more words here more words here {clean}", clean]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text.split() for r in decontamination.remove_contamination(docs, benchmark, **blocks).collect()}
    assert got == {0: clean.split() * 2, 2: clean.split(), 3: clean.split()}
