"""Near-duplicates, language model, toxicity and personal data against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from arborlift.llm import mixing, near_dedup, private_data, shingles, toxicity
from arborlift.llm.components import components

SPACED = "[^\x20\x09-\x0D]+"


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def bags(texts):
    out = []
    for t in texts:
        w = re.findall(SPACED, low(t))
        out.append(collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    return out


def classes_by_hand(rows):
    rows = sorted(rows)
    sh, root = bags([t for _, t in rows]), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((sh[i] & sh[j]).values())
            if both and both >= 0.8 * sum((sh[i] | sh[j]).values()):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_classes_equal_brute_force(spark, sf):
    docs = documents(spark, sf)
    want = classes_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_classes_of_a_group_without_a_centre(spark):
    """Edits of one text, many of them far from each other and from the smallest id."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4])):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_hand(rows)


def test_prefix_pairs_lose_none(spark):
    rng = random.Random(7)
    rows = [(i, i, " ".join(rng.choice("abcde") + rng.choice("xy") for _ in range(rng.randrange(1, 14)))) for i in range(80)]
    texts = spark.createDataFrame(rows, "id long, root long, text string").selectExpr("*", "id % 3 > 0 AS small")
    got = {(r.u, r.v) for r in near_dedup._prefix_pairs(texts, 0.8).collect()}
    sh = bags([t for _, _, t in rows])
    want = {(i, j) for j in range(80) for i in range(j)
            if (i % 3 or j % 3) and sum((sh[i] & sh[j]).values()) >= 0.8 * sum((sh[i] | sh[j]).values())}
    assert want and want <= got


def test_signatures_estimate_weighted_overlap():
    rng = random.Random(1)
    for same, other in ((60, 20), (20, 60), (90, 5)):
        a = [f"s{i % 23}" for i in range(same)]
        one, two = a + [f"a{i % 3}" for i in range(other)], a + [f"b{i % 5}" for i in range(other)]
        rng.shuffle(one)
        text = np.repeat([0, 1], [len(set(one)), len(set(two))])
        ca, cb = collections.Counter(one), collections.Counter(two)
        code = {w: i + 1 for i, w in enumerate(sorted(set(one) | set(two)))}
        element = shingles.mix(np.array([code[w] for w in [*ca, *cb]], np.uint64))
        weight = np.array([*ca.values(), *cb.values()])
        sign = near_dedup.signatures(text, element, weight, 2, 4000)
        want = sum((ca & cb).values()) / sum((ca | cb).values())
        assert abs((sign[0] == sign[1]).mean() - want) < 0.04


def test_dedup_edges(spark):
    schema = "doc_id long, text string, bucket int, root string"
    rows = [(1, "a b c d e f g", 1, "x"), (1, "a b c d e f g", 1, "x"), (2, "A  b c d e f\tg", 2, None), (3, None, None, "y"),
            (4, "", 4, "z"), (5, " \n", 5, "z"), (None, "a b c d e f g", 6, "q"), (6, "one", 7, "r"), (7, "one", 8, "r")]
    docs = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6]
    assert near_dedup.near_classes(docs.limit(0)).count() == 0


def test_texts_of_one_id_are_judged_apart(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    near = b.replace("b0 ", "q ")
    rows = [(5, a, "5a"), (5, b, "5b"), (5, c, "5c"), (1, a, "1a"), (2, near, "2b"), (None, c, "nc"), (None, c, "nc"), (None, "", "n"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert got == {1: 1, 2: 1, 5: 1}
    assert sorted(r.tag for r in near_dedup.keep_one(docs).collect()) == ["1a", "2b", "5c", "n", "n", "nc"]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(30)]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_base_scores_by_hand(spark, sf):
    docs = documents(spark, sf)
    words = {r.doc_id: re.findall(SPACED, low(r.text)) + ["\n"] for r in docs.collect()}
    counts: collections.Counter = collections.Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    head, mixing.HEAD_WORDS = mixing.HEAD_WORDS, 300  # most words take the way of the join
    try:
        rows = mixing.score(docs).collect()
    finally:
        mixing.HEAD_WORDS = head
    assert len(rows) == len(words)
    for r in rows:
        w = words[r.doc_id]
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0
    out = [r for r in rows if r.held_out]
    assert sum(r.bits for r in out) / sum(r.n_bytes for r in out) < 4  # bits a byte of unseen texts


def test_byte_probabilities_sum_to_one(spark, sf):
    from pyspark.sql import functions as F

    _, model = mixing.train(documents(spark, sf).select("text"))
    for context in (b"\n\n\n\n\n", b" the ", b"zq\x01\xff\xfe"):
        head = int.from_bytes(context, "big") << 8
        runs = np.array([head | b for b in range(256)], np.uint64)
        assert (2 ** mixing.run_log2(model, runs)).sum() == pytest.approx(1, abs=1e-5)
    del F


def test_byte_runs_by_hand():
    texts = ["Ab  c\n", "", " é", "x" * 7]
    runs, owner = mixing.byte_runs(texts)
    want, who = [], []
    for i, t in enumerate(texts):
        data = b"".join(w.encode() + b" " for w in low(t).split()) + b"\n"
        held = b"\n" * 5 + data
        want += [int.from_bytes(held[k:k + 6], "big") << 16 for k in range(len(data))]
        who += [i] * len(data)
    assert runs.tolist() == want and owner.tolist() == who


def test_scores_of_odd_rows(spark):
    schema = "doc_id long, text string, key string, n int"
    rows = [(1, None, "a", 1), (1, "the cat", "a", 1), (1, "the cat", "a", 1), (None, "the the", None, None), (9, "", "b", 2)]
    got = mixing.score(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 1
    assert mixing.score(spark.createDataFrame([], schema)).count() == 0


def test_contexts_do_not_share_counts(spark):
    """Counts of every context are its own, however many there are, and parts answer as the whole model does."""
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("abcdefghijklmnop ") for _ in range(400))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, model = mixing.train(docs)
    data = [b"\n" * 5 + b"".join(w.encode() + b" " for w in t.split()) + b"\n" for _, t in rows]
    seen = [collections.Counter() for _ in range(6)]
    for d in data:
        for k in range(5, len(d)):
            for order in range(6):
                for bit in range(8):
                    seen[order][d[k - order:k], bit, d[k] >> (7 - bit)] += 1
    held = sorted({int.from_bytes(d[k - 5:k + 1], "big") for d in data for k in range(5, len(d))})
    run = np.array(rng.sample(held, 300), np.uint64)
    counts = mixing.node_counts(model.read(run), run)
    for i, r in enumerate(run.tolist()):
        b = r.to_bytes(6, "big")
        for order in range(6):
            for bit in range(8):
                want = [seen[order][b[5 - order:5], bit, (b[5] >> (8 - bit) << 1) | v] for v in (0, 1)]
                assert counts[bit, :, i, order].tolist() == want
    kept = mixing.score(docs, folds=1000, fold=999).collect()  # nothing is held out here
    assert not any(r.held_out for r in kept)
    for r in kept[:5]:
        own, _ = mixing.byte_runs([rows[r.doc_id][1]])
        assert r.bits == pytest.approx(-mixing.run_log2(model, own >> np.uint64(16)).sum(), rel=1e-4)


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(3)
    w = np.array([2.0, -1.5, 0.0, 1.0])
    x = rng.random((4000, 4)) < 0.4
    y = x @ w + rng.logistic(size=4000)
    grades = np.searchsorted([0.5, 2.0, 3.5], y)
    got, t = toxicity.fit_cumulative([np.flatnonzero(r) for r in x], grades, 4, penalty=1e-5, turns=400)
    assert np.abs(got - w).max() < 0.35 and np.abs(t - [0.5, 2.0, 3.5]).max() < 0.35 and (np.diff(t) > 0).all()


def test_toxicity_held_out(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    docs, labels = documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 3 > 0"))
    seen = toxicity.with_severity(docs, model).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "label"), "doc_id")
    table = {(r.label, r.t): r["count"] for r in seen.groupBy("label", F.col("_toxicity.toxic").alias("t")).count().collect()}
    assert table.get((0, True), 0) <= 2 and table.get((0, False), 0) > 80


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "scum scum", "b"), (None, "", "c")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    out = toxicity.with_severity(docs, toxicity.train(docs, labels))
    assert out.columns[:3] == docs.columns and [r._toxicity.toxic for r in out.collect()] == [False] * 3
    assert toxicity.train(docs.limit(0), labels.limit(0)).weights == {}
    steps = toxicity.graded(np.array([0, 1, 1, 1]), np.array([9, 0, 4, 8]))
    assert steps.tolist() == [0, 1, 2, 3]


def spans_by_hand(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        total = sum((v - 9 if v > 9 else v) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], private_data.KINDS.index(s[0])))


def test_base_spans_equal_plain_expressions():
    rng = random.Random(3)
    for _ in range(20000):
        t = "".join(rng.choice("aé.@1234-_ +()%") for _ in range(rng.randint(0, 50)))
        assert private_data.base_spans(t) == spans_by_hand(t)
    private_data.base_spans("1" * 200_000 + "a" * 200_000 + "@" * 1000)  # linear in the text


def bootstrap_rows():
    texts = [f"please reach me at user{i}@mail.example.org soon" for i in range(8)]
    texts += ["please reach me at AB-77321 soon", "é please reach me at +49 30 1234567890 or ID99123.", "version ID99123 is old", "chapter 12345 of it"]
    return [(i, t) for i, t in enumerate(texts)]


def test_patterns_discover_identifiers(spark):
    docs = spark.createDataFrame(bootstrap_rows(), "doc_id long, text string")
    base, found = private_data.find_private(docs)
    got = {r.doc_id: [(s.first, s.last) for s in r.more] for r in found.collect()}
    assert got == {8: [(19, 27)]}
    assert base.count() == 12
    texts = {r.doc_id: r.text for r in private_data.redact(docs).collect()}
    assert texts[8] == "please reach me at <IDENTIFIER> soon" and texts[0] == "please reach me at <EMAIL> soon"
    assert texts[9].startswith("é please reach me at <PHONE> or") and texts[11] == "chapter 12345 of it"


def test_keys_discover_values_by_rounds(spark):
    """Secrets trust ``password=``; what it holds trusts ``pin:``, which no seed follows."""
    texts = [f"as password=b7db7aa4a5fcc78{i:03d} is" for i in range(30)]
    texts += [f"so password=swordfish{'abcd'[i]} is" for i in range(4)] + [f"or pin:swordfish{'abcd'[i]} is" for i in range(4)]
    texts += ["or pin:unicorns is", "see note:unicorn5 here, version 20.10.5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, found = private_data.find_private(docs)
    got = {r.doc_id: [texts[r.doc_id][s.first:s.last] for s in r.more] for r in found.collect()}
    want = {i: [f"b7db7aa4a5fcc78{i:03d}"] for i in range(30)}
    want |= {i: [f"swordfish{'abcd'[(i - 30) % 4]}"] for i in range(30, 38)}
    assert got == want | {38: ["unicorns"]}


def test_scores_equal_brute_force(spark, sf):
    """Graph, places and scores of a plain-Python bootstrap over the whole table."""
    folder = str(sf).replace("sf0.001", "sf0.01")  # the smallest table induces no pattern
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    named = private_data._named(docs, "doc_id", "text")
    values = named.mapInPandas(private_data._find, private_data.FOUND).selectExpr("inline(values)")
    scores, patterns = private_data.score_graph(named, values)
    rows = values.collect()
    edges = {}
    for r in rows:
        for p, is_name in ((r.one, False), (r.two, False), (r.name, True)):
            if p:
                n, seed = edges.get((p, is_name, r.instance), (0, 0.0))
                edges[p, is_name, r.instance] = (n + 1, max(seed, float(r.seed > 0)))
    places = {}
    for (p, is_name, _), (n, _) in edges.items():
        if is_name:
            places[p] = places.get(p, 0) + n
    for r in docs.collect():
        parts = [w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w]
        contexts = [" ".join(parts[max(0, i - 2):i]) for i in range(1, len(parts))]
        one, two = private_data._pattern_hashes(contexts)
        for code in one.view("int64").tolist() + two.view("int64").tolist():
            places[code] = places.get(code, 0) + 1
    edges = {k: v for k, v in edges.items() if k[2]}
    score = {}
    for (_, _, v), (_, seed) in edges.items():
        score[v] = max(score.get(v, 0.0), seed)
    seeds, known, trust = dict(score), set(), {}
    for _ in range(private_data.ROUNDS):
        shown = [k for k in edges if score[k[2]] >= private_data.LEAST_SCORE]
        seen = {}
        for p, _, _ in shown:
            seen[p] = seen.get(p, 0) + 1
        new = {p for p, n in seen.items() if n >= 3 and n >= private_data.SUPPORT * len(shown)} - known
        if not new:
            break
        known |= new
        weight = dict.fromkeys(known, 0.0)
        for (p, _, v), (n, _) in edges.items():
            if p in known:
                weight[p] += n * score[v]
        trust = {p: min(w / (places[p] + 1), 0.999) for p, w in weight.items()}
        miss = dict.fromkeys(score, 1.0)
        for p, _, v in edges:
            if trust.get(p, 0) >= private_data.LEAST_SCORE:
                miss[v] *= 1 - trust[p]
        score = {v: max(seeds[v], 1 - miss[v]) for v in score}
    assert trust and {r.pattern: round(r.trust, 9) for r in patterns.collect()} == {p: round(t, 9) for p, t in trust.items()}
    assert {r.instance: round(r.score, 9) for r in scores.collect()} == {v: round(x, 9) for v, x in score.items()}


def test_private_edges(spark):
    rows = [(None, "a@b.cc", "k", 1), (1, None, None, None), (1, "", "k", 2), (2, "é 1.2.3.4", "k", 3), (2, "é 1.2.3.4", "k", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, gone int")
    base, _ = private_data.find_private(docs)
    got = sorted(((r.doc_id, r.spans, r.sha) for r in base.collect()))
    assert [s for _, s, _ in got] == ["email:0:6", "", "", "ip:2:9", "ip:2:9"]
    assert got[1][2] == hashlib.sha256(b"").hexdigest()
    out = private_data.redact(docs)
    assert out.columns == docs.columns and out.count() == 5
    assert {r.text for r in out.collect()} == {"<EMAIL>", None, "", "é <IP>"}
    assert private_data.redact(docs.limit(0)).count() == 0
