"""Hard negatives, the n-gram join and fill-in-middle against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from arborlift.llm import fill_middle, gram_join, mining

VECTORS = "vec_id long, embedding array<float>, label int, row string, v int"
DOCS = "doc_id long, text string, h string, n int"


def brute_negatives(rows):
    """(anchor, positive, rank, negative, positive score, negative score) by comparing all with all."""
    kept = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(float(x) * 256)) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (anchor, label, v) in enumerate(kept):
        if anchor % 50:
            continue
        score = [sum(a * b for a, b in zip(v, o[2])) for o in kept]
        order = sorted((k for k in range(len(kept)) if k != at), key=lambda k: (-score[k], kept[k][0]))
        for p in [k for k in order if kept[k][1] == label][:5]:
            fits = [k for k in order if kept[k][1] != label and 50 * score[p] <= 100 * score[k] <= 95 * score[p]]
            out += [(anchor, kept[p][0], rank, kept[k][0], score[p], score[k]) for rank, k in enumerate(fits[:3], 1)]
    return sorted(out)


def mined(spark, rows, **changes):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    return sorted(tuple(r) for r in mining.hard_negatives(table, **changes).collect())


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_negatives_equal_brute_force(spark, monkeypatch, spread):
    """Clustered vectors, where cells are left out, and shapeless ones; small shards, ties, repeats and a hot cell."""
    for name, value in (("SHARD_ROWS", 60), ("CELL_ROWS", 4), ("TRAIN_ROWS", 90), ("FIRST_LOOK", 4), ("ANCHORS_AT_ONCE", 3)):
        monkeypatch.setattr(mining, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + spread * rng.normal(size=8)).round(2).tolist(), int(rng.integers(10))) for i in range(500)]
    rows += [(1000 + i, rows[50][1], 3) for i in range(150)] + rows[100:103] + [rows[50]] * 2
    rows += [(None, [1.0] * 8, 1), (2000, None, 1), (2050, [1.0] * 8, None), (2100, [1.0, None], 1), (2150, [float("nan")] * 8, 1),
             (2200, [float("inf")] + [0.0] * 7, 1), (2250, [], 2), (2300, [0.5, 0.25], 4), (2350, [0.0] * 8, 4)]
    want = brute_negatives(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_visits_stop_early_where_cells_are_apart():
    """The heap gives cells by falling bound, and certified windows leave most rows unlooked at."""
    rng = np.random.default_rng(5)
    one, two = rng.normal(size=13), rng.normal(size=9)
    walk = list(mining.cells_by_bound(one, two))
    assert [b for b, _, _ in walk] == sorted((a + b for a in one for b in two), reverse=True)
    assert len({(i, j) for _, i, j in walk}) == 13 * 9
    x = np.floor(256 * (np.repeat(rng.normal(size=(40, 8)), 50, axis=0) + 0.01 * rng.normal(size=(2000, 8)))).astype(np.int64)
    books = mining.Books(x[::3], 30)
    place = books.place(x)
    shard = mining.Shard(np.arange(2000), np.zeros(2000, int), np.arange(2000), x, place[0], place[2], books)
    looked, plain = [], mining.scores
    try:
        mining.scores = lambda v, q: looked.append(len(v)) or plain(v, q)
        window = mining.Best(5, -np.inf, np.inf, -np.inf)
        shard.visit(x[7], 7, 0, True, [window])
    finally:
        mining.scores = plain
    score = x @ x[7]
    order = [k for k in np.lexsort((np.arange(2000), -score)) if k != 7][:5]
    assert window.ids.tolist() == order and sum(looked) < 1000


def test_large_components_stay_exact():
    a = np.full((3, 4), 3_000_000_019, np.int64)
    a[1, 0] -= 1
    assert mining.scores(a[:, :1], a[0, :1]).tolist() == [3_000_000_019 ** 2, 3_000_000_019 * 3_000_000_018, 3_000_000_019 ** 2]


def test_no_negatives_without_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(50, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1)]) == []


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_components(rows):
    held = [(i, shingle_set(t)) for i, t in rows if i is not None]
    lead = list(range(len(held)))

    def find(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for a in range(len(held)):
        for b in range(a):
            x, y = held[a][1], held[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lead[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(held):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(held))


def joined(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    return sorted(tuple(r) for r in gram_join.similar_components(table).collect())


def test_join_equals_brute_force(spark):
    """Chains of edits around the bound, copies, shared passages, short and odd texts."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, n = [], 0
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 40, 90]))]
        if rng.random() < 0.5:
            words[3:3] = passage
        for _ in range(rng.choice([1, 3, 8])):
            rows.append((n, " ".join(words)))
            n += 1
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    rows += [(1000 + k, rows[4][1].upper()) for k in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "a b c"), (2004, "A  b\nc"), (2005, "a b"), (2006, "a b c d e"),
             (None, rows[4][1]), (4, "another text of the same id here"), (4, rows[9][1]), (2007, "long " * 3000 + "end"), (2008, "long " * 2000 + "end")]
    rng.shuffle(rows)
    want = brute_components(rows)
    assert len({c for _, _, c in want}) < len(want) - 80 and joined(spark, rows) == want


def test_join_of_no_rows(spark):
    assert joined(spark, []) == [] and joined(spark, [(None, "a b c d e f")]) == []
    assert joined(spark, [(3, None), (5, "")]) == [(3, 0, 3), (5, 0, 5)]


def test_prefixes_of_similar_sets_meet_in_every_order():
    rng = random.Random(4)
    for _ in range(60):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(5, 80))]
        other = list(words)
        other[rng.randrange(len(words))] = "new"
        a, b = shingle_set(" ".join(words)), shingle_set(" ".join(other))
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        text, token, sizes = gram_join.token_sets([" ".join(words), " ".join(other)])
        for salt in gram_join.shingles.mix(np.arange(1, 6, dtype=np.uint64)):
            x, y = gram_join._in_order(text, token, sizes, (gram_join.shingles.mix(token ^ salt),), gram_join.prefix_length(sizes, 80))
            assert set(x.tolist()) & set(y.tolist())


def brute_fill(i, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return i, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm_rate else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return i, n, form, len(pre), len(mid), out, text


@pytest.mark.parametrize("rate,spm_rate", [(100, 50), (40, 10)])
def test_fill_equals_brute_force(spark, rate, spm_rate):
    rng = random.Random(2)
    shared = "".join(rng.choice("abc é中\U0001f600\r\x85 \n<>PSM") for _ in range(3000))
    texts = [None, "", "\n", "\n\n", "a", "a\n", "<P>", "<P", "x<<S>", "<M>\n" * 3, "é\n" * 500, "y" * 30_000, ("line\n" * 40_000) + "end"]
    texts += ["".join(rng.choice("ab é中\U0001f600\n\n<") for _ in range(rng.randrange(1, 4000))) for _ in range(60)]
    texts += [t + shared.replace("<", "") + "\n" + t for t in texts[20:40]] + [shared] * 3
    rows = list(enumerate(texts)) + [(None, "a\nb\nc"), (3, "\n\n"), (3, "\n\n"), (-5, "a\nb")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    got = [tuple(r) for r in fill_middle.fill_middle(table, rate=rate, spm_rate=spm_rate).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(got, key=key) == sorted((brute_fill(i, t, rate, spm_rate) for i, t in rows), key=key)
    assert len({r[2] for r in got}) == 3


def test_fill_of_no_rows(spark):
    assert fill_middle.fill_middle(spark.createDataFrame([], DOCS)).collect() == []


def test_shared_passages_are_chunks_of_their_own():
    rng = random.Random(8)
    passage = " ".join(f"w{rng.randrange(5000)}" for _ in range(3000))
    cache = fill_middle.Cache()
    fill_middle.Cutter("first text " + passage, cache)
    before = cache.hits
    cut = fill_middle.Cutter("another, longer beginning\n" + passage, cache)
    assert cache.hits - before > 0.9 * len(cut.parts) > 10


def test_a_full_cache_and_small_chunks_change_nothing(monkeypatch):
    text = "a<\nS>é\n<P>" * 9 + "b\n"
    plain = fill_middle.transform(text.replace("<P>", "<P"), 9, fill_middle.Cache(), 7, 100, 50)
    monkeypatch.setattr(fill_middle, "LONGEST", 1)
    assert fill_middle.transform(text.replace("<P>", "<P"), 9, fill_middle.Cache(3), 7, 100, 50) == plain
    assert fill_middle.transform(text, 9, fill_middle.Cache(3), 7, 100, 50)[1] == "plain"
    assert pd.notna(plain[2])


def test_longer_prefixes_share_as_much_as_asked():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 200)
        words = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        other = words[: len(words) - rng.randrange(0, n // 10 + 1)]
        a, b = shingle_set(" ".join(words)), shingle_set(" ".join(other))
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        text, token, sizes = gram_join.token_sets([" ".join(words), " ".join(other)])
        least = gram_join.least_shared(sizes, 80)
        x, y = (set(p.tolist()) for p in gram_join._in_order(
            text, token, sizes, (token.view(np.int64),), gram_join.prefix_length(sizes, 80, least)))
        assert len(x & y) >= least.min() and len(x & y) >= 1
