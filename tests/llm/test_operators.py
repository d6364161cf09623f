"""Operators of the training-data subpackage: library and brute-force comparisons, held-out accuracy, odd input."""

import base64
import hashlib
import re
import struct

import compare
import pytest
from corrolith.llm import byte_bpe, html_extract, mixing, ngram_join, pii_crf, pivot_topk, quality_mil, queries as Q, stream_dedup, token_counts, url_reputation

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\t", "a", "The the  THE　ﬁ naïve 'll I'LL 123456 -- ?!\n\n x", "é" * 300, "word " * 3000, "日本語テキスト 👩‍👩‍👧", "a" * 4000, "\u0000x​<|endoftext|>", "word " * 3000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, ["a", None, "b"][i % 3], None) for i, t in enumerate(ODD)] + [(3, ODD[3], "en", "a", 1), (None, "x y", None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_same_as_sql(spark, name):
    assert compare.rows_of_spark(Q.queries()[name](spark, SMALL)) == compare.rows_of_sql(Q.oracle_sql()[name], SMALL)


def test_byte_bpe_equals_the_library(spark, odd, empty):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(Q.RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*odd.columns).union(odd)
    texts = {(r.doc_id, r.text or "") for r in docs.collect()}
    want = set()
    for i, t in texts:
        ids = enc.encode_ordinary(t)
        want.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = byte_bpe.encode_digests(docs, Q.RANKS).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert {tuple(r) for r in got.collect()} == want
    assert byte_bpe.encode_digests(empty, Q.RANKS).count() == 0


def _viterbi(text, pieces, longest, unknown):
    """A plain dynamic program over the whole text and a dictionary, without units, memory or automaton."""
    if not text:
        return 0
    text = ("\u2581" + text).replace(" ", "\u2581")
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        found = None
        for start in range(max(0, end - longest), end):
            score = pieces.get(text[start:end])
            if score is not None and (found is None or best[start][0] + score > found[0]):
                found = (best[start][0] + score, best[start][1] + 1)
        char = text[end - 1]
        if char not in pieces and (found is None or best[end - 1][0] + unknown > found[0]):
            found = (best[end - 1][0] + unknown, best[end - 1][1] + len(char.encode()))
        best.append(found)
    return best[-1][1]


def test_token_counts_equal_an_independent_viterbi(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*odd.columns).union(odd)
    pieces = dict(token_counts.pieces_of(Q.PIECES))
    longest, unknown = max(map(len, pieces)), min(pieces.values()) - 10
    want = sorted((str(r.doc_id), _viterbi(r.text, pieces, longest, unknown)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(docs, Q.PIECES).collect()) == want
    assert token_counts.count_tokens(empty, Q.PIECES).count() == 0


def test_quality_on_held_out_documents(spark):
    scored = {r.doc_id: r for r in Q.op2_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(scored[i].predicted, q) for i, q in labels.items() if scored[i].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.9


def test_quality_odd_input(spark, odd, empty):
    model = quality_mil.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality_mil.score_documents(odd, model).collect())
    assert quality_mil.good_rows(odd, model, 0.0).columns == odd.columns and quality_mil.good_rows(empty, model).count() == 0


def test_exact_dedup_odd_input(odd, empty):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in stream_dedup.exact_dedup(odd).collect()}
    assert {(7, 11, 2, False), (11, 11, 2, True), (0, 1, 2, False), (1, 1, 2, True)} <= got
    assert stream_dedup.exact_dedup(empty).count() == 0


def test_near_duplicates_odd_input(odd, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(odd).collect()}
    assert {(0, 0, 0), (1, 0, 1), (7, 1, 7), (11, 1, 7)} <= got
    assert ngram_join.near_duplicates(empty).count() == 0


def test_mix_odd_input(odd, empty):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mix_sources(empty).count() == 0


def test_topk_odd_input(spark):
    rows = [(0, [1.0, 0.5]), (100, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in pivot_topk.exact_topk(df).collect())
    high = 1024 * 1024 + 512 * 512
    assert got == [(0, 1, 1, high), (0, 2, 100, high), (0, 3, 4, -(1024 * 1024)), (100, 1, 0, high), (100, 2, 1, high), (100, 3, 4, -(1024 * 1024))]


def test_html_text(spark):
    page = "<html><head><title>t</title></head><body><nav>menu one two</nav><article><h1>Head &amp;  line</h1><p>First   words\nhere and more of them.</p><script>x()</script><div class=ad>buy now</div><p>Second.</p></article><footer>foot</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(df, html_extract.learn_weights(df)).collect()}
    assert got[1].text == "Head & line\n\nFirst words here and more of them.\n\nSecond." and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text) == ("", "")


def _brute(text):
    out, digits = [], lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pattern_spans_equal_the_patterns(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in [*texts, "a@b a@b.c.d@e.f @x.y ..@a-.b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.1.1", "4111 1111 1111 1111 +1 (555) 010-0000. +1-"]:
        assert pii_crf.base_spans(t) == _brute(t)


def test_personal_data_odd_input(odd, empty):
    assert pii_crf.find_personal_data(odd).count() == odd.count() and pii_crf.find_personal_data(empty).count() == 0


def test_hosts_without_labels_take_the_posterior_of_their_domain(spark):
    outcomes = spark.createDataFrame([("spam.example", 1000, 1000), ("b.good.example", 1000, 0), ("c.other.test", 1000, 0)], "host string, n long, bad long")
    urls = {"x.spam.example": "block", "x.good.example": "allow", "new.example": "allow", "x.unknown.invalid": "allow"}
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(urls)], "page_id long, url string")
    assert {r.host: r.verdict for r in url_reputation.judge_urls(pages, outcomes).collect()} == urls
    assert {r.verdict for r in url_reputation.judge_urls(pages, outcomes.limit(0)).collect()} == {"allow"}


def test_pages_take_the_labels_of_the_documents_that_they_show(spark):
    start = "The same forty characters begin this and"
    texts = ["Short.", f"{start} good text", f"{start} bad text", "", None, "Twice  told", "Twice told"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in (2, 3, 4, 5)), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    page = "<html><title>t</title><body><nav>menu</nav>{}</body></html>".format
    shown = [("a", page("<article><h1>Short.</h1><p><b>Short.</p></article>")), ("b", page(f"<article><h1>{start}</h1><p>{start} <i>bad</i>\ntext</p></article>")), ("c", page(f"<main><h1>{start} good text</h1></main>")),
             ("d", page("<article><h1></h1></article>")), ("e", page("<p>no heading</p>")), ("f", page("<article><h1>Twice</h1>Twice told</article>")), ("g", None)]
    pages = spark.createDataFrame([(f"http://{h}/", x) for h, x in shown], "url string, html string")
    got = {r.host: (r.n, float(r.bad)) for r in url_reputation.labelled_outcomes(pages, docs, labels).collect()}
    assert got == {"a": (1, 0.0), "b": (1, 1.0), "c": (1, 0.0), "f": (1, 0.5)}


@pytest.mark.parametrize("words", [1, 2, 3, 4, 5])
def test_shingles_of_a_slice_of_few_words(words):
    text = " ".join(f"w{i}" for i in range(words))
    alone, beside = ngram_join.shingle_sets([text]), ngram_join.shingle_sets([text, "some other text of more than five words"])
    assert len(alone[0]) == 1 and alone[0].tolist() == beside[0].tolist()
    assert [len(s) for s in ngram_join.shingle_sets([None, *text.split()])] == [0] + [1] * words


@pytest.mark.parametrize("body,want", [
    ("<article><h2 id='related-work'>Related</h2><section id='discussion'>One two.</section><section id='social-history'>Three.</section><div class=related>more</div></article>", "Related\n\nOne two.\n\nThree."),
    ("<div class='layout has-sidebar'><article>Some text.</article><div class=sidebar>side</div></div>", "Some text."),
    ("<div class='content no-sidebar'><main>Some text.</main></div>", "Some text."),
    ("<div class='social'><article>Some text.</article></div>", "Some text."),
    ("<div id='menu'><main>Some text.</main></div>", "Some text."),
    ("<article>Some text.</article><div class=comments><article>first!</article></div>", "Some text."),
    ("<article>Let <math><mi>x</mi></math> be.</article>", "Let x be."),
    ("<article>Text.<div class='notice'>Mind this.</div><div class='big ad'>buy</div></article>", "Text.\n\nMind this."),
])
def test_html_keeps_what_the_page_marks(body, want):
    assert html_extract.main_text(f"<html><body><nav>a b</nav>{body}<footer>foot</footer></body></html>", html_extract.Weights()) == want


def test_representatives_go_by_row(spark, tmp_path, empty):
    near, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, near, "a"), (2, near, "b"), (2, other, "c"), (None, "x y z", "d"), (None, "x y z", "e"), (5, "p q", "f"), (5, "p q", "g"), (None, near, "h"), (7, None, "i"), (7, "", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    for given in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        got = [r.mark for r in ngram_join.representatives(given).collect()]
        left = set(got)
        assert len(got) == 6 and {"a", "c", "i", "j"} <= left and len(left & {"d", "e"}) == 1 and len(left & {"f", "g"}) == 1
    assert ngram_join.representatives(empty).count() == 0
