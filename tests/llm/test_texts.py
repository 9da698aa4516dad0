"""Quality rules, language, token counts, page text, toxicity, packing and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from florin.llm import html_text as H
from florin.llm import language_id as G
from florin.llm import packing as P
from florin.llm import quality_rules as R
from florin.llm import queries as Q
from florin.llm import token_counts as U
from florin.llm import toxicity as X
from florin.llm.spark import connected_groups


def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def base_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_counts_by_brute_force(small, odd_docs):
    extra = ["a b c a b c", "a a a a", "x y x y x", "one\ntwo\none\n \n \none", "###$% |<>&*"]
    made = odd_docs.select("doc_id", "text").union(small.select("doc_id", "text")).union(odd_docs.sparkSession.createDataFrame(list(enumerate(extra)), "doc_id long, text string"))
    for r in R.with_counts(made.withColumn("lang", F.lit("en")), "lang", ["text"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(r.document.text), r.document.text


def test_binomial_tail_is_exact(spark):
    cases = [(2400, 60_000), (11_000, 60_000)] + [(k, n) for n in (1, 7, 50, 400, 3000) for k in range(0, n + 1, max(1, n // 9))]
    for p in (0.01, 0.2):
        out = spark.createDataFrame(cases, "k long, n long").select("k", "n", R.binomial_tail(F.col("k"), F.col("n"), p).alias("tail")).collect()
        for r in out:
            exact = 1.0 if r.k >= r.n * p else sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(p) + (r.n - i) * math.log(1 - p)) for i in range(r.k + 1))
            assert r.tail == pytest.approx(exact, rel=1e-6, abs=1e-300)


def test_few_labels_certify_nothing_and_many_do(spark):
    rng = random.Random(1)
    words = lambda n, junk: " ".join(("".join(rng.choice("abcdefgh") for _ in range(5)) + "***" * (rng.random() < junk)) for _ in range(n))
    rows = [(k, words(60, 0.9 if k % 4 == 0 else 0.0), "en") for k in range(800)] + [(10_000 + k, words(60, 0.9), "xx") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(k, 0 if k % 4 == 0 else 1) for k in range(800)] + [(10_000 + k, 0) for k in range(40)] + [(None, 1), (77, None), (999_999, 1)], "doc_id long, quality int")
    report = R.quality_report(docs, marks)
    kept = {r.document.doc_id: r.kept for r in report.collect()}
    assert not any(kept[k] for k in range(0, 800, 4)) and all(kept[k] for k in range(800) if k % 4) and all(kept[10_000 + k] for k in range(40))
    # under salts, as with very many strata
    counted = R.with_counts(docs, "lang", ["doc_id"])
    salted = R.apply_rules(counted, R.certified_cutoffs(counted, marks, R.RiskControl()), R.RiskControl(), few=0)
    assert {r.document.doc_id: r.kept for r in salted.collect()} == kept


def test_copies_of_a_text_count_once(spark):
    """One good text, copied 500 times, is one label: it certifies nothing."""
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(k, good, "en") for k in range(500)] + [(1000 + k, " ".join(f"x{k}y{j}***" for j in range(60)), "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = docs.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"))
    assert R.quality_report(docs, marks).where("NOT kept").count() == 0


def test_cutoffs_are_certified_on_a_table_of_1000(spark):
    report = Q.op2_quality_rules(spark, SMALL.replace("sf0.001", "sf0.01"))
    assert report.where("NOT base_failed AND NOT kept").count() > 0


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.withColumns({c: F.lit("own") for c in ("n_words", "base_failed", "refused_by", "cutoffs", "stratum", "body", "words", "document", "_s", "salt")})
    out = R.quality_rules(rows, labels(spark)).collect()
    assert len(out) == odd_docs.count() and all(r.base_failed for r in out if r.document.doc_id in (1, 2, 3, 6))
    assert all(r.document.n_words == r.document.kept.replace("x", "own") == r.document["_s"] == "own" for r in out)
    assert R.quality_report(no_docs, labels(spark)).count() == 0


def test_gradients_by_finite_differences():
    net = G.ByteNetwork(["a", "b"], 3, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = np.random.default_rng(2).integers(0, 256, (4, 6))
    data[2, 4:] = 256
    target = np.array([0, 1, 1, 0])

    def loss():
        p = net.label(data)
        chosen = p[:, target, np.arange(4)]
        return -np.log(chosen)[data.T < 256].mean()

    got = net.gradients(data, target)
    for name, where in (("rec_f", (4, 1)), ("rec_b", (7, 2)), ("out", (1, 4)), ("in_f", (8, int(data[0, 2]))), ("in_b", (1, int(data[1, 3])))):
        old, step = net.p[name][where], 1e-2
        net.p[name][where] = old + step
        up = loss()
        net.p[name][where] = old - step
        down = loss()
        net.p[name][where] = old
        assert got[name][where] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-4)


def test_language_accuracy_and_odd_rows(spark, small, odd_docs, no_docs):
    held_out = Q._fold(4) == 2
    found = {r.doc_id: r for r in G.identify_languages(small, ~held_out).collect()}
    test = small.where(held_out & F.col("lang").isNotNull() & (F.length("text") > 100)).collect()
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in test]) > 0.9 and all(0 <= r.score <= 1 for r in found.values())
    odd = [(r.doc_id, r.lang_pred) for r in G.identify_languages(odd_docs, F.lit(True)).collect()]
    assert len(odd) == odd_docs.count() and {p for i, p in odd if i in (1, 2, 3, 9)} == {"und"}
    assert {r.lang_pred for r in G.identify_languages(odd_docs, F.lit(False)).collect()} == {"und"} and G.identify_languages(no_docs, F.lit(True)).count() == 0


def test_token_counts_by_brute_force(spark, small, odd_docs, no_docs):
    pieces = U.vocabulary(Q.tokenizer_path("piece_bpe_32k.model"))
    scores = U.zipf_scores(pieces)

    def tokens(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            options = []
            for n in range(1, min(16, i) + 1):
                score, count = best[i - n]
                if word[i - n : i] in scores:
                    options.append((score + scores[word[i - n : i]], -(count + 1)))
                elif n == 1:
                    size = len(word[i - 1].encode())
                    options.append((score + U.BYTE_SCORE * size, -(count + size)))
            score, count = max(options)
            best.append((score, -count))
        return best[-1][1]

    known = {}
    rows = small.select("doc_id", "text").limit(40).union(odd_docs.select("doc_id", "text").where("doc_id in (1, 2, 3, 6, 8, 9)"))
    want = []
    for r in rows.collect():
        words = (r.text or "").split()
        for w in words:
            known[w] = known.get(w) or tokens(U.WORD_MARK + w)
        want.append((r.doc_id, len(words), sum(known[w] for w in words)))
    assert sorted(want) == sorted(tuple(r) for r in U.token_counts(rows, Q.tokenizer_path("piece_bpe_32k.model")).collect())
    assert U.token_counts(no_docs, Q.tokenizer_path("piece_bpe_32k.model")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></ul></nav>
<header><h1>Site</h1></header><div class="cookie-notice">We use cookies, many of them.</div><div id=wrap><div class="post"><h2>A  title</h2><p>First &amp; best,\n of all<br>lines &eacute;.<p><b>Second, one
<ul><li>item one</li><li>item <i>two</i></li></ul><form><p>Your name, please, here, now</p></form></div><aside>Side, text, with, many, commas, in, it, all, along</aside>
<div id="comments"><p>Reader, writes, a lot, of, commas, here, and, there</p></div></div><footer>&copy; me</footer></body></html>"""


def test_long_pre_tokens_are_counted_alike():
    import time

    model = U._model(Q.tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(12)
    words = ["".join(rng.choice("etaoin shrdlu é日x".replace(" ", "")) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    assert [dict(zip(*model.count([U.WORD_MARK + w for w in words], words)))[w] for w in words] == [model.count_long(U.WORD_MARK + w) for w in words]
    begin = time.perf_counter()
    model.count_long("etaoin" * 20_000)
    assert time.perf_counter() - begin < 10


def test_page_text():
    assert H.main_text(PAGE) == "A title\n\nFirst & best, of all lines é.\n\nSecond, one\n\nitem one\n\nitem two"
    article = "<body><div class=ad>Buy, buy, buy, this, now, or, never, ever</div><article><h1>T</h1><p><b>one.<br><p>two</p></article><footer>f</footer>"
    assert H.main_text(article) == "T\n\none.\n\ntwo"
    assert [H.main_text(x) for x in (None, "", "<nav>x</nav>", "<script>x", "plain")] == ["", "", "", "", "plain"]
    assert H.main_text("<div>" * 3000 + "deep") == "deep"


def test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    out = H.extract_text(pages).collect()
    assert len(out) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in out)
    empty = spark.createDataFrame([(1, None, None), (None, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted(r.text for r in H.extract_text(empty).collect()) == ["", "x"]


def test_packed_grams():
    keys, sizes = X.packed_grams(["ab", "é"], 3)
    assert sizes.tolist() == [3, 3]
    assert [int(k).to_bytes(3, "big") for k in keys] == [b"  a", b" ab", b"ab ", b"  \xc3", b" \xc3\xa9", b"\xc3\xa9 "]


def test_parts_of_an_article_and_wrappers():
    page = "<article><header><h1>Title</h1><p>Standfirst, of it.</p></header><div class='article-header'><p>More lead, text.</p></div><p>Body, text, here.</p><div class='related-work'><p>A real, section, of text.</p></div><div class='related'><a href=1>One</a> <a href=2>Two</a></div><div class='ad'><p>Buy, now, please</p></div></article>"
    assert H.main_text(page) == "Title\n\nStandfirst, of it.\n\nMore lead, text.\n\nBody, text, here.\n\nA real, section, of text."
    wrapped = f"<header><h1>Site</h1></header><div class='content with-sidebar'><div class=text><p>{'A long, long text. ' * 30}</p><p>Its end, here.</p></div><div class=sidebar><p>Aside, only, this.</p></div></div>"
    assert H.main_text(wrapped) == f"{('A long, long text. ' * 30).strip()}\n\nIts end, here."
    references = "<div><p>Text, with, words, and commas, of some length.</p><ul><li>A. Author, <a href=1>a work</a>, a publisher, a place, 1999</li><li>B. Author, <a href=2>another</a>, a publisher, a place, 2001</li></ul></div>"
    assert "B. Author, another, a publisher" in H.main_text(references)


def test_comments_sources_and_several_articles():
    long = "Long text, with commas, and more words here. " * 6
    body = f"<p>{long}</p><p>{long}</p>"
    want = f"{long.strip()}\n\n{long.strip()}"
    assert H.main_text(f"<main>{body}<section id='reviews'><h2>Reviews</h2><p>Great, stuff</p></section><div class='reader-feedback'><p>Bad, stuff</p></div></main>") == want
    assert H.main_text(f"<main><article class='review'>{body}</article></main>") == want
    sources = "<h2>References</h2><ul><li><a href=x>One ref</a></li><li><a href=y>Two ref</a></li></ul>"
    assert H.main_text(f"<article>{body}{sources}</article>") == f"{want}\n\nReferences\n\nOne ref\n\nTwo ref"
    assert H.main_text(f"<main><article><p>{long}</p></article><article><p>{long}</p></article></main>") == want
    assert H.main_text(f"<div><article><p>{long}</p></article><article class='ad'><p>{long}</p></article></div>") == long.strip()
    assert H.main_text(f"<body><ul><li><a>Home</a><li><a>About</a></ul>{body}</body>") == want


def test_odd_pages(spark):
    rows = [(1, "u", "<p>x", "a"), (1, "u", "<p>x", "a"), (2, None, "<p>" + "word, " * 50_000, "b"), (3, "v", "no markup & none", "c")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    out = sorted((r.page_id, r.n_chars, r.text[:5]) for r in H.extract_text(pages).collect())
    assert out == [(1, 1, "x"), (1, 1, "x"), (2, 299_999, "word,"), (3, 16, "no ma")] and H.extract_text(pages.where("false")).count() == 0


def plain_scores(node, levels=10):
    """Points by plain recursion over the tree: what every paragraph below an element passes up to it."""
    def paragraphs(n, depth):
        if n.dropped or not n.chars:
            return
        own = [c for c in n.children if isinstance(c, str) or c.tag not in H.BLOCKS]
        text = "".join(H._flat(c) for c in own).strip()
        if n.tag in H.BLOCKS and text and depth:
            yield depth, (1 + text.count(",") + len(text) / 100) * (1 - H._density(n))
        for c in n.children:
            if isinstance(c, H.Node):
                yield from paragraphs(c, depth + 1)

    return sum(p / (d if d < 3 else 3 * (d - 1)) for d, p in paragraphs(node, 0) if d <= levels)


def test_points_by_plain_recursion(spark):
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").limit(20).collect():
        builder = H.TreeBuilder()
        builder.feed(r.html)
        builder.close()
        nodes = H._in_order(builder.root)
        H._measure(nodes)
        H._score(nodes)
        for n in nodes:
            if not n.dropped and n.chars:
                assert n.points == pytest.approx(plain_scores(n)), n.tag


def test_deep_pages_take_time_in_proportion():
    import time

    def seconds(depth):
        html = "<div>" * depth + "<p>text, here</p>" + "</div>" * depth
        begin = time.perf_counter()
        assert H.main_text(html) == "text, here"
        return time.perf_counter() - begin

    seconds(1000)
    assert seconds(20_000) < 20 * max(0.1, seconds(2000))


def test_toxic_words_are_learned(spark, odd_docs, no_docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7)))
    rows = []
    for k in range(900):
        text = [word() for _ in range(rng.randint(5, 80))]
        if k % 3 == 0:
            for _ in range(max(1, len(text) // 20)):
                text.insert(rng.randrange(len(text)), rng.choice(["Scumbag", "trash!", "idiot"]))
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(900)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    held_out = Q._fold(5) == 0
    out = {r.doc_id: r for r in X.toxicity_scores(docs, marks, ~held_out).collect()}
    test = [r.doc_id for r in docs.where(held_out).collect()]
    assert np.mean([out[k].predicted == int(k % 3 == 0) for k in test]) > 0.97 and all(0 <= r.score <= 1 for r in out.values())
    odd = X.toxicity_scores(odd_docs, marks, F.lit(True)).collect()
    assert len(odd) == odd_docs.count() and all(r.score is not None for r in odd)
    one_class = X.toxicity_scores(docs, marks.where("toxic = 0"), F.lit(True)).collect()
    assert {r.predicted for r in one_class} == {0} and X.toxicity_scores(no_docs, marks, F.lit(True)).count() == 0


def test_evidence_from_raw_counts(spark, monkeypatch):
    """Every log ratio by the definition of the model, and the scores of texts from them, broadcast and joined."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 8))) for _ in range(40)]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", ",", "!"]) for _ in range(rng.randint(0, 12))), int(rng.random() < 0.3)) for _ in range(60)]
    order = X.ORDER
    counts = {0: Counter(), 1: Counter()}

    def grams(word):
        raw = b" " * (order - 1) + X.normal_word(word).encode() + b" "
        return [raw[k : k + order] for k in range(len(raw) - order + 1)] if X.normal_word(word) else []

    for text, toxic in rows:
        for word in text.split():
            counts[toxic].update(grams(word))
    every = set(counts[0]) | set(counts[1])
    shorter = {order: every}
    for k in range(order - 1, 0, -1):
        shorter[k] = {g[1:] for g in shorter[k + 1]}

    def backoff(gram):
        """Interpolated Kneser-Ney from continuation counts, for an n-gram shorter than the order."""
        if not gram:
            return 1 / 256
        k = len(gram)
        n = Counter(g[1:] for g in shorter[k + 1])
        same = {g: c for g, c in n.items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        return max(same.get(gram, 0) - 0.75, 0) / total + 0.75 * len(same) / total * backoff(gram[1:])

    def ratio(gram):
        p = []
        pooled_all = sum(counts[0][g] + counts[1][g] for g in every if g[:-1] == gram[:-1])
        kinds_all = sum(g[:-1] == gram[:-1] for g in every)
        pooled = max(counts[0][gram] + counts[1][gram] - 0.75, 0) / pooled_all + 0.75 * kinds_all / pooled_all * backoff(gram[1:])
        for c in (1, 0):
            total = sum(n for g, n in counts[c].items() if g[:-1] == gram[:-1])
            kinds = sum(g[:-1] == gram[:-1] for g in counts[c])
            p.append(max(counts[c][gram] - 1, 0) / total + kinds / total * pooled if total else pooled)
        return math.log(p[0] / p[1])

    by_gram, by_context = X.evidence_tables(spark.createDataFrame(rows, "text string, toxic int"))
    got = {r.gram: r.evidence for r in by_gram.collect()}
    assert set(got) == {int.from_bytes(g, "big") for g in every} and by_context.count() == len({g[:-1] for g in every})
    for g in every:
        assert got[int.from_bytes(g, "big")] == pytest.approx(ratio(g), abs=1e-5)

    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)] + [(99, None), (100, "zzz unseen abc, ???"), (100, "zzz unseen abc, ???"), (None, "abc")], "doc_id long, text string")
    marks = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, toxic int")
    one = sorted(((r.doc_id or -1, r.score, r.evidence, r.clear_evidence, r.clearest) for r in X.toxicity_scores(docs, marks, F.lit(True)).collect()))
    monkeypatch.setattr(X, "MAX_TABLE", 0)
    other = sorted(((r.doc_id or -1, r.score, r.evidence, r.clear_evidence, r.clearest) for r in X.toxicity_scores(docs, marks, F.lit(True)).collect()))
    assert len(one) == len(rows) + 4 and np.allclose(np.array(one, float), np.array(other, float), atol=1e-9)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = dict(Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 9), 64, 33]) for _ in range(rng.randint(1, 4000))))
    patterns = P.packing_patterns(histogram, 64)
    placed = defaultdict(int)
    for packs, inside in patterns:
        assert packs > 0 and sum(n * t for n, t in inside) <= 64
        for n, t in inside:
            placed[n] += packs * t
    assert placed == histogram and len(patterns) < 400


def test_packing(spark, small, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = Q.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = small.select("doc_id", "text").union(odd_docs.select("doc_id", "text").where("doc_id <> 5").withColumn("doc_id", F.col("doc_id") + 10**6))
    out = P.pack(docs, path, 512).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by_doc[r.doc_id], key=lambda x: x.start)
        assert [x.start for x in own] == list(range(0, len(ids), 512)) and all(x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in own)
        assert sum(x.length for x in own) == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert sum(r.length for r in out) > 0.97 * 512 * len(by_sequence) and P.pack(no_docs, path).count() == 0
    assert len(P.pack(odd_docs, path).where("doc_id = 5").collect()) == 2 * len(P.pack(odd_docs, path).where("doc_id = 4").collect())


def test_connected_groups(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    label = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            la, lb = label.setdefault(a, a), label.setdefault(b, b)
            for k, v in label.items():
                if v in (la, lb):
                    label[k] = min(la, lb)
    assert {r.node: r.root for r in connected_groups(spark.createDataFrame(edges, "a long, b long")).collect()} == label


def near_groups(texts):
    """Row number -> the lowest row number of its group of near duplicates, by all pairs of shingle sets."""
    from test_pairs import groups, shingles

    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if sets[a] and sets[b] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return groups(len(texts), pairs)


def test_pipeline_stage_by_stage(spark, small):
    """Every stage against a brute-force version on the rows that it got."""
    from test_pairs import brute_lines

    from florin.llm import decontaminate as D

    clash = {c: F.lit("own") for c in ("n_removed_lines", "_removed", "_gone", "_cutoffs", "_stratum", "_key", "_words", "kept", "n_words", "base_failed", "refused_by", "document", "id", "key", "first", "n", "text_key")}
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, docs: stages[name](spark, docs, SMALL)
    docs = small.withColumns(clash)
    docs = docs.union(docs.limit(3))  # repeated rows
    out = run("quality_rules", docs)
    report = {r.doc_id: r.kept for r in Q.op2_quality_rules(spark, SMALL).collect()}  # held against SQL by its oracle
    rows = out.collect()
    assert out.columns == docs.columns and sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect() if report[r.doc_id]) and all(r.kept == r.document == "own" for r in rows)

    docs = spark.createDataFrame(rows, docs.schema)
    gone, _ = brute_lines({r.doc_id: r.text for r in rows})
    cut = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[r.doc_id]) for r in rows}
    out = run("line_dedup", docs)
    lines = out.collect()
    assert out.columns == docs.columns and sorted((r.doc_id, r.text) for r in lines) == sorted((r.doc_id, cut[r.doc_id]) for r in rows if not gone[r.doc_id] or cut[r.doc_id].strip())

    docs = spark.createDataFrame(lines, docs.schema)
    ordered = sorted({(r.doc_id, r.text) for r in lines})
    label = near_groups([t for _, t in ordered])
    out = run("near_duplicates", docs)
    near = out.collect()
    assert out.columns == docs.columns and sorted((r.doc_id, r.text) for r in near) == [x for k, x in enumerate(ordered) if label[k] == k] and len(near) < len(lines)

    docs = spark.createDataFrame(near, docs.schema)
    items = [g for g in (D.word_grams(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()) if g]
    out = run("decontamination", docs)
    clean = out.collect()
    assert out.columns == docs.columns and sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in near if not any(5 * len(g & D.word_grams(r.text)) >= 4 * len(g) for g in items)) and len(clean) < len(near)

    packed = run("packing", spark.createDataFrame(clean, docs.schema))
    want = {(r.doc_id, r.start, r.ids_crc32) for r in P.pack(spark.createDataFrame(clean, docs.schema), Q.tokenizer_path("word_bpe_49k.json")).collect()}
    assert {(r.doc_id, r.start, r.ids_crc32) for r in packed.collect()} == want and packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == {r.doc_id for r in clean}


def test_pipeline_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SMALL).count() == 0
        out = stage(spark, odd_docs, SMALL)
        if name != "packing":
            assert out.columns == odd_docs.columns
        if name == "near_duplicates":
            kept = [r.doc_id for r in out.collect()]
            assert kept.count(5) == 0 and kept.count(4) == 1 and None in kept



def test_ids_of_words_are_those_of_whole_texts():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from florin.llm.queries import tokenizer_path

    draw = random.Random(5)
    letters = "abcABC dDİıßſΩKǺ̸̈=<>'s't're.,!?-_*# \n\t\r  éÉñÑ1２²日本語한글🙂ﬁ‍\x00|"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(draw.choice(["<|endoftext|>", "a", "b,", "X", " ", "<|endoftext |>", "|>"]) for _ in range(draw.randint(0, 9))) for _ in range(1000)]
    texts += ["", None, "x" * 5000, "word, " * 20_000]
    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    flat, counts = P.WordIds(tokenizer_path("word_bpe_49k.json")).ids(pa.array(texts))
    ends = counts.cumsum()
    for text, end, n in zip(texts, ends, counts):
        assert flat[end - n : end].tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)
