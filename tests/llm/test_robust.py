"""Odd tables, brute force and held-out figures for the operators of the training-data subpackage."""

import random
import re
import struct
from collections import Counter, defaultdict

import compare
import corpus_pipeline
import numpy as np
import pytest
from corrolith.llm import common, html_extract, mixing, ngram_join, pii_crf, pivot_topk, quality_mil, queries as Q, stream_dedup, token_counts, url_reputation
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


# ---- shared ----


def test_batches_are_cut_by_running_size():
    import pyarrow as pa

    big = "x" * common.BATCH_BYTES
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 500 + [big, None, big] + ["é" * 1000] * 6000), pa.array(range(6503))], ["text", "i"])
    parts = list(common.small_batches(iter([batch, batch.slice(0, 1)]), "text"))
    assert sum(p.num_rows for p in parts) == 6504 and [x for p in parts[:-1] for x in p.column(1).to_pylist()] == list(range(6503))
    assert all(sum(len((t or "").encode()) for t in p.column(0).to_pylist()) <= common.BATCH_BYTES or p.num_rows == 1 for p in parts)


def test_word_hashes_depend_on_the_word_alone():
    r = random.Random(1)
    words = ["".join(r.choice("abAé") for _ in range(r.randint(1, 200))) for _ in range(300)]
    words += ["ab" * 700, "ba" * 700]
    seen = {}
    for _ in range(5):
        r.shuffle(words)
        texts = [" ".join(words[:100]), "\n".join(words[100:]), " ".join(words)]
        body, start, end, first = common.words_of(texts)
        for h, a, b in zip(common.word_hashes(body, start, end), start, end):
            assert seen.setdefault(bytes(body[a:b]), h) == h
    assert len(set(seen.values())) == len(seen) == len(set(words))
    # strings that collide under any polynomial hash modulo a power of two
    t = "a"
    for _ in range(11):
        t += t.translate({97: 98, 98: 97})
    body, start, end, _ = common.words_of([t, t.translate({97: 98, 98: 97})])
    assert len(set(common.word_hashes(body, start, end))) == 2


# ---- quality ----


def _plain_features(text):
    """The features of each passage by loops over words."""
    words = WORD.findall(text or "")
    out = []
    for i in range(0, max(1, len(words)), 64):
        some = words[i : i + 64]
        f = np.zeros(quality_mil.N_FEATURES)
        f[quality_mil.N_CLASSES + 9] = np.log1p(len(words)) / 10
        if some:
            kinds = Counter(quality_mil.CLASSES[b] for w in some for b in w.encode())
            ink = sum(kinds.values())
            for k, n in kinds.items():
                f[k] = n / ink
            k = quality_mil.N_CLASSES
            size = [len(w.encode()) for w in some]
            low = [lowered(w) for w in some]
            f[k] = np.mean(size) / 10
            f[k + 1], f[k + 2] = np.mean([n <= 2 for n in size]), np.mean([n >= 12 for n in size])
            f[k + 3] = np.mean([False] + [a == b for a, b in zip(low, low[1:])])
        out.append(f)
    return np.array(out)


def test_passages_equal_a_loop_and_ignore_their_neighbours():
    r = random.Random(2)
    texts = [None, "", "  ", "a A a", "The the, 5% of | it! *** é"] + [" ".join(r.choice(["the", "THE", "x1,", "longer-than-twelve", "é", "b."]) for _ in range(r.randint(1, 300))) for _ in range(40)]
    bags = quality_mil.passages(texts)
    at = np.append(0, np.cumsum(bags.n))
    exact = [i for i in range(quality_mil.N_FEATURES) if i not in (quality_mil._SPACE, *range(quality_mil.N_CLASSES + 4, quality_mil.N_CLASSES + 9))]
    for i, t in enumerate(texts):
        want = _plain_features(t)
        assert np.allclose(bags.x[at[i] : at[i + 1]][:, exact], want[:, exact], atol=1e-6)
        alone = quality_mil.passages([t])
        assert np.array_equal(alone.x, bags.x[at[i] : at[i + 1]]) and alone.n[0] == bags.n[i]
    model = quality_mil.train(bags, np.arange(len(texts)) % 2.0, quality_mil.Training(steps=30))
    scores = model.score(bags)
    order = list(range(len(texts)))
    r.shuffle(order)
    mixed = model.score(quality_mil.passages([texts[i] for i in order]))
    assert np.abs(mixed - scores[order]).max() <= 1e-6 and np.abs(np.concatenate([model.score(quality_mil.passages([t])) for t in texts]) - scores).max() <= 1e-6


def test_gradient_equals_differences():
    texts = ["one two three", "FOUR five! six seven", " ".join(f"w{i % 9}" for i in range(150)), ""]
    bags, label = quality_mil.passages(texts), np.array([1.0, 0.0, 1.0, 0.0])
    x = bags.x.astype(float)
    p = {k: np.array(v + 0.05 * np.random.default_rng(3).normal(size=v.shape)) for k, v in quality_mil.start_weights(4, 1).items()}
    _, grad = quality_mil.loss_and_gradient(p, x, bags, label)
    r = np.random.default_rng(4)
    for k in p:
        places = np.argwhere(np.abs(grad[k]) > 0) if k == "E" else np.argwhere(np.ones_like(grad[k]))
        for at in r.permutation(places)[:6]:
            at, e, loss = tuple(at), 1e-6, []
            for sign in (1, -1):
                q = {n: v.copy() for n, v in p.items()}
                q[k][at] += sign * e
                loss.append(quality_mil.loss_and_gradient(q, x, bags, label)[0])
            assert np.isclose((loss[0] - loss[1]) / (2 * e), grad[k][at], rtol=1e-4, atol=1e-8), k


def test_sample_is_bounded_by_whole_documents(spark):
    docs = spark.createDataFrame([(i, "w " * 640) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, None), (None, 1)], "doc_id long, quality int")
    seen = []
    real = quality_mil.train
    quality_mil.train = lambda bags, label, how: seen.append((bags.n.tolist(), len(label))) or real(bags, label, quality_mil.Training(steps=1))
    try:
        quality_mil.fit(docs, labels, quality_mil.Training(sample=8))
        quality_mil.fit(docs, labels, quality_mil.Training(passages=35))
    finally:
        quality_mil.train = real
    assert seen == [([10] * 8, 8), ([10] * 3, 3)]


# ---- exact dedup ----


def _dedup(rows):
    """Kept marks by brute force."""
    groups = defaultdict(list)
    for i, t, m in rows:
        groups[lowered(t)].append((i is not None, i or 0, m))
    return {max(g)[:2] for g in groups.values()}, len(groups)


def test_kept_rows_of_any_table(spark, tmp_path):
    rows = [(1, "A b", "x"), (2, "a B", "y"), (3, "c", "z"), (3, "c", "z"), (None, "é", "n"), (None, "É", "m"), (4, None, "e"), (5, "", "f"), (6, "q" * 300_000, "l"), (7, "Q" * 300_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __locator string").repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    kinds = {"memory": df, "files": spark.read.parquet(str(tmp_path / "t")), "filtered": spark.read.parquet(str(tmp_path / "t")).filter("text IS NULL OR text <> 'nothing'"), "joined": spark.read.parquet(str(tmp_path / "t")).join(spark.range(1), F.lit(True)).drop("id"), "united": spark.read.parquet(str(tmp_path / "t")).limit(10).union(df.limit(0))}
    want, n = _dedup(rows)
    for name, given in kinds.items():
        kept = stream_dedup.kept_rows(given)
        got = [(r.doc_id is not None, r.doc_id or 0) for r in kept.collect()]
        assert (kept.columns, set(got), len(got)) == (df.columns, want, n), name
        assert stream_dedup.exact_dedup(given).filter("kept").count() == n
    twice = spark.read.parquet(str(tmp_path / "t")).withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    got = stream_dedup.exact_dedup(twice).collect()
    assert len(got) == 20 and sum(r.kept for r in got) == n and all(r.group_size >= 2 for r in got)
    assert stream_dedup.kept_rows(twice).count() == n and stream_dedup.kept_rows(df.limit(0)).count() == 0


def test_colliding_digests_are_told_apart(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in stream_dedup.exact_dedup(df, digest=lambda body: F.unhex(F.lit("00"))).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}


# ---- mix ----


def test_mixed_rows_equal_brute_force(spark):
    rows = [(i % 9, f"w{i} " * (i % 5), None, ["b", "a", None, "c"][i % 4], None) for i in range(60)] + [(None, "x y", None, "a", None)] * 2
    df = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "__id", "n_chars": "__copies"})
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.mixed_rows(df).collect())
    taken = mixing.mix_sources(df).collect()
    assert mixing.mixed_rows(df).columns == df.columns and mixing.mixed_rows(df.limit(0)).count() == 0
    by_source = defaultdict(list)
    for r in taken:
        by_source[r.source].append(r)
    total = sum(r["size"] for r in taken)
    assert total == sum(len(WORD.findall(t)) for _, t, *_ in rows)
    for s, g in by_source.items():
        assert sum(r["size"] for r in g) == g[0].source_size and sum(r.taken for r in g) == int(g[0].target) and all(0 <= r.taken <= 2 * r["size"] for r in g)
    assert abs(sum(g[0].target for g in by_source.values()) - 1.5 * total) < 1e-6
    asked = Counter(rows)
    for (i, t, s), n in got.items():
        assert n % asked[i, t, None, s, None] == 0 and n <= 2 * asked[i, t, None, s, None]


# ---- near duplicates ----


def _sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(lowered(t))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def _components(sets):
    """The component of each set over all pairs, by its least place."""
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(sets))]


def _corpus(r, families, copies):
    texts = [None, "", " \n", "one two", "One  two", "one two three four five", "x"]
    for _ in range(families):
        base = [f"w{r.randrange(400)}" for _ in range(r.randint(20, 90))]
        for _ in range(r.randint(1, copies)):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
            texts.append((" " if r.random() < 0.7 else "\n").join(t[: len(t) - r.randint(0, 2)]))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("short,crowd,slice_,rounds", [(64, 8, 4000, 6), (2, 1, 3, 6), (2, 1, 3, 0), (1, 1, 1, 2)])
def test_components_equal_all_pairs_whatever_the_limits(spark, monkeypatch, short, crowd, slice_, rounds):
    for name, value in (("SHORT", short), ("CROWD", crowd), ("LIST_SLICE", slice_), ("ROUNDS", rounds)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = _corpus(random.Random(short + rounds), 14, 9)
    sets = _sets(texts)
    want = _components(sets)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want))} and len(set(want)) < len(want)


def test_groups_of_one_prefix_are_expanded(spark):
    # one long passage that all share and then rare ends: equal prefixes come from equal rare shingles
    common_part = [f"c{i}" for i in range(200)]
    texts = [" ".join(common_part[: 200 - i % 4] + [f"r{i % 3}", "s", "t"]) for i in range(30)] + [" ".join(f"z{i}" for i in range(50))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df).collect()}
    assert [got[i] for i in range(31)] == _components(_sets(texts))


def test_forests_equal_a_search(spark):
    r = random.Random(8)
    pairs = [(str(r.randrange(80)), str(r.randrange(80))) for _ in range(60)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(120)]
    got = {x.s: x.c for x in ngram_join.components(spark.createDataFrame(pairs, "a string, b string").repartition(7)).collect()}
    want = ngram_join.forest(pairs)
    assert got == want and want["p120"] == "p000"


def test_representatives_keep_clashing_columns(spark):
    df = spark.createDataFrame([(2, "a b c d e f g", 1, 1), (1, "a b c d e f g", 2, 2), (3, "other words here", 3, 3)], "doc_id long, text string, __file int, __row int")
    kept = ngram_join.representatives(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 3}


# ---- HTML ----


def test_the_scan_finds_the_best_region():
    r = random.Random(6)
    for _ in range(300):
        scores = [r.choice([-3.0, -1.0, 0.0, 0.5, 2.0]) for _ in range(r.randint(0, 12))]
        a, b = html_extract.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0.0)
        assert sum(scores[a:b]) == pytest.approx(max(0.0, best)) and (a < b) == (best > 0)


def test_pages_without_marks_give_the_same_text(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    weights = html_extract.learn_weights(pages)
    assert all(w < 0 for w in weights.tags.values()) and any(k.startswith("in/") for k in weights.words)
    same = total = 0
    for r in pages.collect():
        if r.html and "<article>" in r.html:
            total += 1
            text = html_extract.main_text(r.html, weights)
            same += text == html_extract.main_text(r.html.replace("article>", "div>"), weights) and len(text) > 0
    assert total > 20 and same >= 0.95 * total


def test_html_odd_input(spark):
    deep = "<div>" * 3000 + "<p>deep text</p>" + "</div>" * 3000
    long = "<article>" + "<p>word &amp; word</p>" * 30_000 + "</article>"
    rows = [(1, "u", deep), (1, "u", deep), (None, None, long), (3, "u", "<p>a</p><p>a</p>"), (4, "u", "<<>></"), (5, "u", "plain &lt;text&gt;"), (6, "u", "<article><p>one two three four</p></article><p>x</p><article><p>a b c</p></article>"), (7, "u", "<nav>menu</nav><form>f</form>"), (8, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(df, html_extract.Weights()).collect()
    texts = defaultdict(list)
    for r in got:
        texts[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert texts[1] == ["deep text"] * 2 and texts[None] == ["\n\n".join(["word & word"] * 30_000)] and texts[3] == ["a\n\na"] and texts[5] == ["plain <text>"] and texts[7] == [""] and texts[8] == [""]
    assert texts[6] == ["one two three four\n\na b c"]  # words between two marked passages are no part
    assert html_extract.extract(df.limit(0), html_extract.learn_weights(df.limit(0))).count() == 0


# ---- URLs ----


def _tables(spark, folder):
    """Pages that show labelled documents; the pages of one host and of one domain are bad."""
    hosts = ["bad.evil.example", "www.good.example", "a.shop.co.uk", "b.shop.co.uk", "127.0.0.1:80", "Mixed.Host.example"] + [f"h{i}.many.example" for i in range(8)]
    docs, labels, pages = [], [], []
    for h, host in enumerate(hosts):
        for i in range(40):
            n = 100 * h + i
            bad = host.startswith(("bad.", "a.shop")) or host == "Mixed.Host.example" and i % 3 == 0
            docs.append((n, f"text number {n} of {host}", "en", "s", 1))
            labels.append((n, int(not bad), 0))
            pages.append((n, f"http://{host}/p/{i}?q", f"<html><body><nav>x</nav><article><h1>t</h1><p>text number {n} of {host}</p></article></body></html>"))
    odd = [None, "no scheme", "http://", "http:///x", "HTTP://EXAMPLE.com/en/7", "ftp://x.com/en/9", "http://org/es/", "http://notorg/es/", "http://example.net/de/8", "http://net/de", "http://a.b.example.net/de/1#f", "http://new.evil.example/", "http://c.shop.co.uk/", "http://[::1]/x", "http://bad.evil.example:8080/", "x://y://z/p"]
    pages += [(9000 + i, u, None if i % 2 else "<p>text number 101 of www.good.example</p>") for i, u in enumerate(odd)] + [(9000, odd[4], "")] * 2 + [(None, odd[4], "x")]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return odd


def test_reputation_blocks_and_equals_its_sql(spark, tmp_path):
    import duckdb

    odd = _tables(spark, tmp_path)
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = con.sql(Q.oracle_sql()["op7_url_filter"])
    names = sorted(got.columns)
    theirs = Counter(tuple(r[got.columns.index(c)] for c in names) for r in got.fetchall())
    rows = Q.op7_url_filter(spark, str(tmp_path)).collect()
    assert Counter(tuple(r[c] for c in names) for r in rows) == theirs
    verdict = {r.host: r.verdict for r in rows if r.rule is None}
    assert verdict["bad.evil.example"] == verdict["a.shop.co.uk"] == verdict["new.evil.example"] == "block"
    assert verdict["www.good.example"] == verdict["b.shop.co.uk"] == verdict["mixed.host.example"] == verdict[""] == "allow"
    rules = {odd[r.page_id - 9000]: r.rule for r in rows if (r.page_id or 0) >= 9001}
    assert (rules["ftp://x.com/en/9"], rules["http://org/es/"], rules["http://notorg/es/"], rules["http://example.net/de/8"], rules["http://net/de"], rules["http://a.b.example.net/de/1#f"]) == ("com/en/", "org/es/", None, "example.net/de/8", None, "net/de/")
    assert sum(r.rule == "example.com/en/7" for r in rows) == 4 and len(rows) == 14 * 40 + len(odd) + 3


def test_prior_strength_leaves_binomial_noise_out(spark):
    r = np.random.default_rng(5)
    for a, b in ((2.0, 8.0), (20.0, 30.0)):
        n = r.integers(2, 6, 4000)
        rows = [(f"h{i}.x", int(k), int(r.binomial(k, r.beta(a, b)))) for i, k in enumerate(n)]
        mean, strength = url_reputation._strength(spark.createDataFrame(rows, "host string, n long, bad long"), url_reputation.Reputation())
        assert abs(mean - a / (a + b)) < 0.02 and 0.6 * (a + b) < strength < 1.7 * (a + b)
    same = spark.createDataFrame([(f"h{i}", 10, 5) for i in range(50)], "host string, n long, bad long")
    assert url_reputation._strength(same, url_reputation.Reputation())[1] == 1000.0


def test_urls_of_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path)
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    none = url_reputation.labelled_outcomes(read("pages").limit(0), read("documents"), read("labels"))
    assert none.count() == 0 and url_reputation.judge_urls(read("pages").limit(0), none).count() == 0
    assert {r.verdict for r in url_reputation.judge_urls(read("pages"), none).filter("rule IS NULL").collect()} == {"allow"}
    host = lambda h: spark.createDataFrame([(h,)], "h string").select(url_reputation.domain_of(F.col("h")), url_reputation.suffix_of(F.col("h"))).first()
    assert [tuple(host(h)) for h in ("a.b.co.uk", "b.example.com:80", "u@x.b.net.", "localhost", "1.2.3.4", "co.uk", "")] == [("b.co.uk", "co.uk"), ("example.com", "com"), ("b.net", "net"), ("localhost", "localhost"), ("1.2.3.4", "1.2.3.4"), ("co.uk", "co.uk"), ("", "")]


# ---- top-k ----


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(pivot_topk, "QUERY_BLOCK", 3)
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(c, 0.2, (60, 4)) for c in (-3, 0, 3)])
    rows = [(i, x[i].tolist()) for i in range(180)] + [(5, x[7].tolist()), (200, x[3].tolist()), (200, x[3].tolist()), (300, [1.0, 2.0]), (301, [0.5, 0.5]), (302, []), (None, x[1].tolist()), (303, [1.0, None, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for q in sorted(pivot_topk.exact_topk(df, "vec_id % 20 = 0", 4).collect(), key=lambda q: q.rank):
        got[q.query_id].append((q.vec_id, q.score))
    whole = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in rows if i is not None and None not in v]
    for q in {i for i, _ in whole if i % 20 == 0}:
        mine = min(v for i, v in whole if i == q)
        want = sorted(((-sum(a * b for a, b in zip(mine, v)), i) for i, v in whole if i != q and len(v) == len(mine)))[:4]
        assert got[q] == [(i, -s) for s, i in want], q
    assert pivot_topk.exact_topk(df.limit(0)).count() == 0 and pivot_topk.exact_topk(df, "vec_id = -1").count() == 0


def test_elimination_spares_products():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c * 3000, 100, (300, 8)) for c in range(5)]).astype(np.int64)
    table = pivot_topk.pivots(8, x[:100].astype(float), 16)
    q = x[:5]
    *_, made = pivot_topk.search_block(np.arange(5), q, pivot_topk.distances(q, table), np.arange(len(x)), x, pivot_topk.distances(x, table), 10)
    assert made < 0.5 * 5 * len(x)


# ---- token counts, personal data ----


def test_unused_pieces_and_scores():
    pieces = dict(token_counts.pieces_of(Q.PIECES))
    assert len(pieces) > 30_000 and all(isinstance(s, float) for s in pieces.values())


def test_viterbi_equals_enumeration():
    from itertools import product

    field = pii_crf.default_field()
    r = random.Random(3)
    for _ in range(25):
        line = [r.randrange(1, len(pii_crf.SHAPES)) for _ in range(r.randint(1, 4))]
        e = field.scores(np.array([line]))[0]

        def total(path):
            return field.first[path[0]] + e[0, path[0]] + sum(field.moves[a, b] + e[t + 1, b] for t, (a, b) in enumerate(zip(path, path[1:])))

        best = max(product(range(pii_crf.K), repeat=len(line)), key=total)
        assert total(field.decode([line])[0]) == pytest.approx(total(best))


def test_field_on_a_held_out_table():
    field = pii_crf.default_field()
    hit, known, told = Counter(), Counter(), Counter()
    for words, marks in pii_crf.labelled_table(400, seed=12):
        labels = field.decode([[pii_crf.shape(w) for w in words]])[0]
        for w, m, g in zip(words, marks, labels):
            if m[0] == "B":
                known[m[1]] += 1
                hit[m[1]] += pii_crf.LABELS[g] == m
            if pii_crf.LABELS[g][0] == "B":
                told[m == pii_crf.LABELS[g]] += 1
    assert all(hit[k] >= 0.9 * known[k] for k in "0123") and told[True] >= 0.95 * sum(told.values())


# ---- the pipeline ----


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = Q.quality_model(spark.read.parquet(f"{SMALL}/documents.parquet"), labels)
    good = [d for d, s in zip(docs, model.score(quality_mil.passages([d.text for d in docs]))) if s >= Q.GOOD]
    assert 0 < len(good) < len(docs)
    last = {}
    for d in sorted(good, key=lambda d: d.doc_id):
        last[lowered(d.text)] = d
    single = sorted(last.values(), key=lambda d: d.doc_id)
    part = _components(_sets([d.text for d in single]))
    left = [d for i, d in enumerate(single) if part[i] == i]
    df = spark.createDataFrame([tuple(d) for d in left], spark.read.parquet(f"{SMALL}/documents.parquet").schema)
    copies = Counter(r.doc_id for r in mixing.mixed_rows(df).collect())
    import base64

    import public_tokenizers as P
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(Q.RANKS, "rb"))}, special_tokens={})
    import hashlib

    want = Counter()
    for d in left:
        ids = enc.encode_ordinary(d.text or "")
        if copies[d.doc_id]:
            want[d.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()] += copies[d.doc_id]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want


def test_encoded_documents_decode_and_tell_where_tokens_end(spark):
    from corrolith.llm import byte_bpe

    texts = [None, "", "a b", "naïve 日本 \n\n x", "word " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    t = byte_bpe.tokenizer(Q.RANKS)
    for r in byte_bpe.encode_documents(df, Q.RANKS, decode=True).collect():
        whole = (texts[r.doc_id] or "").encode()
        assert bytes(r.decoded) == whole
        ends = t.token_ends(np.array(r.ids, np.int64)).tolist()
        assert b"".join(whole[a:b] for a, b in zip([0, *ends], ends)) == whole and [t.ranks[whole[a:b]] for a, b in zip([0, *ends], ends)] == list(r.ids)


def test_compare_knows_all_queries():
    assert set(Q.oracle_sql()) <= set(Q.queries()) and callable(compare.rows_of_sql)


def test_edges_that_fit_one_forest_need_no_rounds(spark, monkeypatch):
    names, write = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: names.append(name) or write(df, name))
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(40) if i % 10 != 9], "a string, b string").repartition(5)
    want = {f"n{i:02}": f"n{i // 10 * 10:02}" for i in range(40) if i % 10}
    assert {x.s: x.c for x in ngram_join.components(edges).collect()} == want
    assert names == ["join-stars", "join-forest"]
    names.clear()
    monkeypatch.setattr(ngram_join, "FOREST", 12)  # less than the stars that are left
    assert {x.s: x.c for x in ngram_join.components(edges).collect()} == want
    assert "join-labels" in names and "join-forest" not in names
