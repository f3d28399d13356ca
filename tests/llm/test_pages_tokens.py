"""Page text, URL rules, quality, benchmark leaks, token files, packing and the pipeline."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborlift.llm import decontaminate, html_text, packing, quality, simple8b, token_files, url_rules
from arborlift.llm.token_queries import vocabulary
from arborlift.llm.tokens import Encoder, encoder
from arborlift.session import shared_path, stage


def lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@pytest.mark.parametrize("at_most", [1 << 29, 12])
def test_common_lines_are_longest(at_most):
    rng = random.Random(1)
    for _ in range(800):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = html_text.common_lines(a, b, at_most)
        assert got == sorted(set(got)) and len(got) == lcs(a, b)
        rest = iter(b)
        assert all(any(a[k] == y for y in rest) for k in got)


PAGE = """<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>site</header><nav><ul><li><a href=x>menu</a></ul></nav><div class="cookie-notice">we use</div>
<aside>side</aside><main><article><h1>Head &amp; more</h1><p>one<br>two  <b>bold
</b><p>three &#233;<div class="ad box">buy</div><form><p>name<input></form><!-- no --><p>four</article>
<section id="comments"><article><p>reader says</article></section></main><footer>&copy; x</footer></body></html>"""


def test_structure_of_a_page():
    has_main, lines = html_text.page_lines(PAGE)
    kept = html_text.kept_lines(has_main, [z for z, _ in lines], [hash(t) for _, t in lines], None)
    assert [lines[k][1] for k in kept] == ["Head & more", "one two bold", "three é", "four"]
    assert html_text.page_lines("<nav>menu<article><p>text</p><p")[1][-1] == (html_text.MAIN, "text")


@pytest.mark.parametrize(("html", "want"), [
    ("<body><div class='layout has-sidebar'><article><p>text<div class='ad'>buy</div></article><aside>side</aside></div>", ["text"]),
    ("<div id='page' class='header-fixed'><nav>menu</nav><main><p>text</main></div>", ["text"]),
    ("<div id='page' class='header-fixed'><main><article><p>text</article><div id='comments'><article><p>reader</article></div></main></div>", ["text"]),
    ("<article><div class='entry-header'><h1>Head</h1><span>by us</span></div><p>text</article>", ["Head", "text"]),
    ("<div class='post'><p>a long text of the page itself</div><div class='sidebar'><article><p>teaser</article></div>", ["a long text of the page itself"]),
    ("<article><p>text</article><div class='sidebar'><article><p>teaser</article></div>", ["text"]),
    ("<div><p>words of the page</div><section id='comments'><article><p>reader says a lot more than the page</article></section>", ["words of the page"]),
    ("<!DOCTYPE html><html><head><title>t</title><meta charset=utf-8><body><p>text", ["text"]),
    ("<html><head><title>t</title><p>text", ["text"]),
    ("<html><head><title>t</title><noscript><div>no</div></noscript></head><body><article><p>text</article></body></html>", ["text"]),
])
def test_wrappers_and_open_heads_keep_the_article(html, want):
    has_main, lines = html_text.page_lines(html)
    kept = html_text.kept_lines(has_main, [z for z, _ in lines], [hash(t) for _, t in lines], None)
    assert [lines[k][1] for k in kept] == want


def test_pages_without_article_lose_the_template(spark):
    def page(n, body):
        return (n, f"http://h.org/a/{n}", f"<body><div>Our site</div><div>{body}</div><div>About us</div></body>", "x")

    rows = [page(1, "first text"), page(2, "second text"), page(3, "third text"), (4, None, None, "x"), (None, "http://h.org/b", "<p>z", "x"),
            (5, "http://other.org/", "<body><p>alone</p></body>", "y"), (5, "http://other.org/", "<body><p>alone</p></body>", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == Counter({(1, "first text", 10): 1, (2, "second text", 11): 1, (3, "third text", 10): 1, (4, "", 0): 1,
                           (None, "z", 1): 1, (5, "alone", 5): 2})
    assert html_text.extract(pages.limit(0)).count() == 0


def test_template_inside_main_goes_by_alignment(spark):
    def page(n, body, quote=""):
        return (n, f"http://h.org/a/{n}", f"<main><div>Sale ends soon</div><article><div>Send to a friend</div><h1>Head {n}</h1><p>{body}{quote}"
                f"<p>More of {n}<div>Written by us</div></article><p>Read on</main>")

    said = "<p>A line that both quote"
    rows = [page(1, "first", said), page(2, "second", said), page(3, "third"), (4, "http://h.org/b/1", "<main><p>x 1<p>y 1<div>Tell us</div></main>"),
            (5, "http://h.org/b/2", "<main><p>x 2<p>y 2<div>Tell us</div></main>"), (6, "http://c.org/1", page(9, "same")[2]), (7, "http://c.org/2", page(9, "same")[2])]
    got = {r.page_id: r.text.split("\n\n") for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    quoted = "A line that both quote"
    assert got[1] == ["Head 1", "first", quoted, "More of 1"] and got[2] == ["Head 2", "second", quoted, "More of 2"]
    assert got[3] == ["Head 3", "third", "More of 3"] and got[5] == ["x 2", "y 2"]
    assert got[6] == got[7] == ["Sale ends soon", "Send to a friend", "Head 9", "same", "More of 9", "Written by us", "Read on"]


def test_lines_of_pages_are_shuffled_once_and_not_staged(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(html_text, "stage", lambda df, name: staged.append((name, df.schema.simpleString())) or stage(df, name))
    rng = random.Random(4)
    bodies = [[" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(3)] for _ in range(40)]
    alike = spark.createDataFrame([(1, "<p>s", None), (1, None, "<p>s")], "page_id long, url string, html string")
    assert sorted(r.text for r in html_text.extract(alike).collect()) == ["", "s"]
    rows = [(i, f"http://h.org/{i:02d}", "<body><div>Top of all</div>" + "".join(f"<div>{t}</div>" for t in b)) for i, b in enumerate(bodies)]
    out = html_text.extract(spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string").repartition(3))
    got = Counter((r.page_id, r.text) for r in out.collect())
    assert got == Counter((i, "\n\n".join(b)) for i, b in enumerate(bodies)) + Counter((i, "\n\n".join(b)) for i, b in enumerate(bodies[:3]))
    assert dict(staged)["page-lines"] == "struct<partner:bigint,other:array<bigint>,other_zones:array<int>>"


def test_neighbours_are_next_in_path_order(spark):
    rng = random.Random(2)
    rows = [(i, f"h{rng.randrange(4)}", f"/{rng.randrange(40)}") for i in range(150)] + [(500, "single", "/")]
    got = {r.row_key: r.partner for r in html_text.neighbours(spark.createDataFrame(rows, "row_key long, host string, path string")).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    want = {}
    for k, (i, host, _) in enumerate(order):
        if k and order[k - 1][1] == host:
            want[i] = order[k - 1][0]
        else:
            want[i] = order[k + 1][0] if k + 1 < len(order) and order[k + 1][1] == host else None
    assert got == want


def test_url_edges(spark):
    urls = ["http://a.NET/x", "http://b.example.net/en/1", "https://example.com/de/", "http://x.org/fr/?q", "http://notnet/x", None, "plain",
            "http://free-bets.example.com/en/1", "http://net", "http://a.net?x/", "http://xnet/", "http://www.adult-x.example.org/de/"]
    rows = [(i, u, "r", "h") for i, u in enumerate(urls)] + [(0, urls[0], "r", "h")]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(
        spark.createDataFrame(rows, "page_id long, url string, rule string, host string")).collect()}
    assert got == {
        (0, "a.net", "/x", "net/", "block"), (1, "b.example.net", "/en/1", "example.net/en/", "allow"),
        (2, "example.com", "/de/", "example.com/de/", "block"), (3, "x.org", "/fr/", "org/fr/", "allow"), (4, "notnet", "/x", None, "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "free-bets.example.com", "/en/1", None, "block"),
        (8, "net", "", None, "allow"), (9, "a.net", "", None, "allow"), (10, "xnet", "/", None, "allow"),
        (11, "www.adult-x.example.org", "/de/", None, "block")}
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_quality_edges(spark):
    rng = random.Random(3)
    plain = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(60, 200))) for _ in range(40)]
    rows = [(i, "en", "s", t, 1) for i, t in enumerate(plain)]
    rows += [(100, "en", "s", " ".join(f"w{i}***%%%" for i in range(90)), 1), (101, None, None, "a b c " * 40, 1), (102, "en", "s", None, 1),
             (103, "en", "s", "", 1), (104, "xx", "s", plain[0], 1), (104, "xx", "s", plain[0], 1), (None, None, "s", plain[1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, n_words int")
    got = quality.judge_quality(docs).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by_id[i].kept for i in range(40))
    assert not by_id[100].kept and not by_id[100].base_failed and by_id[100].n_symbols == 540
    assert by_id[101].base_failed and by_id[101].n_repeat_words == 120 and by_id[102].n_words == 0 and not by_id[103].kept
    assert by_id[104].kept and by_id[None].kept
    assert quality.judge_quality(docs.limit(0)).count() == 0


def test_leak_edges(spark):
    passage = " ".join(f"q{i}" for i in range(14))
    docs = spark.createDataFrame([
        (1, f"Intro, {passage.upper()}! end", "x"), (2, None, "x"), (2, "", "x"), (None, f"{passage}", "x"), (3, "tiny Item here", "x"),
        (4, "q0 q1 q2 q3 q4 q5 q6 q7 q8", "x"), (1, f"Intro, {passage.upper()}! end", "x")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(10, passage), (9, passage), (7, "tiny item"), (8, None), (5, "!!"), (None, passage)], "item_id long, text string")
    leaks = {r.leak_id: r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(leaks) == {1, None, 3} and leaks[1]["items"] == ["10", "9"] and leaks[3]["items"] == ["7"]
    assert [tuple(s) for s in leaks[1].spans] == [(k, 10) for k in range(1, 6)]
    clean = decontaminate.decontaminate(docs, bench, max_share=0.9)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter([
        (1, "Intro, end"), (1, "Intro, end"), (2, None), (2, ""), (3, "here"), (4, "q0 q1 q2 q3 q4 q5 q6 q7 q8")])
    assert decontaminate.decontaminate(docs, bench, action="documents").count() == 3
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 7
    shuffled = decontaminate.find_leaks(docs, bench, broadcast_rows=0)
    assert {r.leak_id for r in shuffled.collect()} == set(leaks)


ODD_TEXTS = ["", " ", "a  b", "x\n\ny", " lead", "trail\n", "\nx", "it's I'LL don't", "a b", "naïve café\nÜber", "tab\tx", "<|endoftext|> a",
             "a\x00b", "éa b", "x12 34!?", "a., b", "a), b. c", "12, 13. 14", "»», x", "_. y", "a.\nb", "... .", "x y, z", "ſ ß İ Ω Σας", "日本 語"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library(spark, sf, name):
    enc = encoder(vocabulary(name))
    texts = ODD_TEXTS + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab.,' \n1Zé_|*") for _ in range(30)) for _ in range(300)]
    for text in texts:
        want = enc.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want, text


def test_plain_texts_are_cut_into_pre_tokens_at_once(monkeypatch):
    enc = Encoder(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = ["".join(rng.choice("abÉß.,'’s \n\n 17_|*×ªº·") if k % 2 else rng.choice("aZé.,'strvel \n 09_-<>") for _ in range(40)) for k in range(600)]
    texts += ["one, two.\n\nthree  four", " x\n y ", "we'll, it's; I'LL", "\n", "  ", "a²b ½ c\xadd", "tab\tx", "x_y é_1.", "a), b"]
    want = [enc.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(enc.encode(t), "<u4").tolist() for t in texts] == want
    calls = []
    monkeypatch.setattr(enc, "_ids", lambda text, f=enc._ids: calls.append(text) or f(text))
    enc.encode("Paragraphs, of plain-text.\n\nTwo  spaces; and\nmore (words), \"quoted\".")
    assert all(not c.strip() for c in calls)  # never the whole text
    assert {" of", " plain", "-", "text", " (", "words", "),"} <= set(enc.lately) and "words)," not in enc.lately


def test_texts_of_a_batch_are_encoded_together(monkeypatch):
    enc = Encoder(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(6)
    texts = ["", "\n", "é 'll 'lx ''s a's's 't\n\n", "x  ", *ODD_TEXTS, "", "日本", "'", "l'", "'r", "o'l", " 've"]
    texts += ["".join(rng.choice("aéÿstvrelmdz''  \n.0¡") for _ in range(rng.randrange(30))) for _ in range(2000)]
    want = [[*enc.whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert [x.tolist() for x in enc.encode_all(texts, b"\2\0\0\0")] == want
    assert [x.tolist() for x in enc.encode_all(texts)] == [w[:-1] for w in want]
    assert list(enc.encode_all([])) == [] and [x.tolist() for x in enc.encode_all([""])] == [[]]
    words = [f"word{chr(97 + k)}" for k in range(20)]
    monkeypatch.setattr("arborlift.llm.tokens.KEPT_PARTS", 1)  # nothing is kept from batch to batch
    enc.lately.clear()
    enc.before, calls = {}, []
    monkeypatch.setattr(enc, "_letters", lambda part, f=enc._letters: calls.append(part) or f(part))
    assert len(list(enc.encode_all([" " + " ".join(rng.sample(words, 20)) for _ in range(300)]))) == 300
    assert sorted(calls) == [f" {w}" for w in words]  # and each is encoded once


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 3), st.integers(0, 60000)), max_size=700))
def test_simple8b_round_trip(values):
    x = np.array(values, np.uint64)
    words, offsets, escapes = simple8b.encode(x)
    assert (simple8b.decode(words, offsets, len(x), escapes) == x).all()
    assert len(offsets) == -(-len(x) // simple8b.BLOCK)


def test_token_files_are_read_back_in_order(spark, sf):
    schema = "doc_id long, text string, start long, ids int"
    rows = [(5, "b a", 1, 1), (2, None, 1, 1), (2, "", 1, 1), (None, "null id", 1, 1), (9, "x " * 70000, 1, 1), (5, "b a", 1, 1), (-1, "neg", 1, 1)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    path = shared_path(spark, "test-tokens")
    token_files.write_token_files(docs, path, vocabulary("byte_bpe_50k.json"))
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -1, 2, 2, 5, 5, 9]
    upto = 0
    whole = encoder(vocabulary("byte_bpe_50k.json")).whole
    for r in got:
        assert r.start == upto and r.n_tokens == len(r.ids) // 4
        upto += r.n_tokens
    assert np.frombuffer(got[4].ids, "<u4").tolist() == [*whole.encode("b a", add_special_tokens=False).ids, 2]
    empty = shared_path(spark, "test-tokens")
    token_files.write_token_files(docs.limit(0), empty, vocabulary("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, empty).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 400), min_size=1, max_size=120))
def test_plan_places_every_piece(histogram):
    made = packing.plan(histogram)
    placed: Counter = Counter()
    for repeats, shape in made:
        assert repeats > 0 and sum(length * n for length, n in shape) <= 2048
        for length, n in shape:
            placed[length] += repeats * n
    assert placed == Counter(histogram)
    n_sequences, total = sum(r for r, _ in made), sum(k * v for k, v in histogram.items())
    assert n_sequences <= 2 * -(-total // 2048) + 1


def test_nnls_against_a_known_solution():
    rng = np.random.default_rng(1)
    a = rng.random((30, 12))
    x = np.where(rng.random(12) < 0.5, rng.random(12), 0)
    assert np.abs(packing.nnls(a, a @ x) - x).max() < 1e-6


def test_packed_sequences_are_gapless(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(1).alias("length"))
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, 1)], docs.schema))
    rows = packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json"), with_ids=True)).toPandas()
    for _, one in rows.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert one.offset.tolist() == [0, *one.length.cumsum().tolist()[:-1]] and one.length.sum() <= 2048
    assert all(zlib.crc32(b) == c and len(b) == 4 * n for b, c, n in zip(rows.ids, rows.ids_crc32, rows.length))
    total = int(rows.length.sum())
    assert rows.sequence_id.nunique() <= 1.03 * -(-total // 2048) + 1
    assert packing.pack(packing.pieces(docs.limit(0), vocabulary("word_bpe_49k.json"))).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as C
    from arborlift.llm import near_dedup
    from arborlift.session import stage

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, []
    for name, step in C.STAGES:
        before, docs = docs, stage(step(spark, docs, d), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
        kept.append(docs.select("doc_id").distinct().count())
        if name == "near_dedup":
            classes = near_dedup.near_classes(before)
            assert docs.count() == classes.select("class_id").distinct().count()
        if name == "decontamination":
            assert decontaminate.find_leaks(docs, spark.read.parquet(f"{d}/benchmark.parquet")).count() == 0
        if name == "pii":
            assert docs.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.example")).isEmpty()
    assert kept == sorted(kept, reverse=True) and kept[-1] == kept[-2] > 100
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    assert re.fullmatch(r"doc_id|piece|.*", docs.columns[0])
