"""Near-duplicates by BagMinHash: signatures of weighted word runs, bands, verified overlap.

A document is the multiset of its runs of five words (a text of fewer, but
some, is one run). Similarity is the weighted Jaccard of two multisets: sum of
the smaller over sum of the larger counts.

BagMinHash: every element has a Poisson process over (time, level), of rate one
for each of ``size`` components and unit of weight. Levels are cut into [0,1),
[1,2), [2,4), [4,8) ...; a process over such a range draws points in order of
time, each with a component and a level, and a point counts for the element if
its level is below the weight, so that the process of a part is that of the
whole, thinned. Component k of the signature is the earliest point that counts
for it, which two multisets share with probability of their weighted Jaccard.
Points later than the latest component cannot count, so most elements
draw one or two.

Steps: texts of equal words are one node, whatever their ids, named by the smallest
hash of such a text; its signature is cut into bands; nodes
of a bucket are compared with the bucket's smallest node first (a group of
thousands costs one comparison each), verified on the whole multisets, and
joined into components. In buckets that still hold
several components, the texts outside the largest one are compared with all others
there that they can be similar to: two multisets of the wanted overlap share one of their
rarest elements (their prefixes in one global order, as long as the sizes ask),
so only texts that meet in such an element are pairs, and none is missed, however
large the bucket. Components of the labels are the classes.

Texts without words are alone in their class (null and empty ones too). Equal
rows are copies. Ids must not be null for a class to be told; an id of several texts
joins their classes in the report, but not in ``keep_one``, which goes by texts.
There, rows with a null id give way to other rows with a null id only. Other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlift.llm import shingles
from arborlift.llm.base import SPACE, by_size, whole
from arborlift.llm.components import components
from arborlift.session import stage

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 26, 5
#: Characters of the texts that a task hashes at once.
AT_ONCE = 1_500_000
TO_UNIT = 2.0 ** -53
#: Slots of the element counts that order prefixes, and how many of the fullest are told apart.
SLOTS, FULLEST = 1 << 26, 400_000


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * TO_UNIT


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """``texts`` x ``size`` identities of the earliest points (0 where a text has no element)."""
    if not len(element):
        return np.zeros((texts, size), np.uint64)
    parts = [(np.arange(len(element)), np.zeros(len(element)), np.ones(len(element)))]
    low = 1.0
    while (at := np.flatnonzero(weight > low)).size:  # [1,2), [2,4), ... as far as the weights reach
        parts.append((at, np.full(at.size, low), np.full(at.size, low)))
        low *= 2
    who = np.concatenate([p[0] for p in parts])
    base, span = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    state = shingles.mix(element[who] + (base.astype(np.uint64) + np.uint64(1)) * shingles.ODD_STEP)
    owner, limit, time = text[who], weight[who].astype(np.float64), np.zeros(len(who))
    first = np.full(texts * size, np.inf)
    mark = np.zeros(texts * size, np.uint64)
    live = np.arange(len(who))
    while live.size:
        state[live] = draw = shingles.mix(state[live] + shingles.ODD_STEP)
        time[live] -= np.log(_uniform(draw)) / (span[live] * size)
        point = shingles.mix(draw ^ shingles.MIX2)
        cell = owner[live] * size + (point % np.uint64(size)).astype(np.int64)
        level = base[live] + span[live] * _uniform(shingles.mix(point))
        counts = (level < limit[live]) & (time[live] < first[cell])
        at = np.flatnonzero(counts)
        order = at[np.argsort(-time[live[at]], kind="stable")]  # the earliest is written last
        first[cell[order]] = time[live[order]]
        mark[cell[order]] = point[order]
        latest = first.reshape(texts, size).max(axis=1)
        live = live[time[live] < latest[owner[live]]]
    return np.where(np.isinf(first), np.uint64(0), mark).reshape(texts, size)


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return shingles.counted(*shingles.runs(*shingles.words(texts), WORDS))


def _signer(bands: int, rows: int):
    """Two hashes of the word sequence, the number of words, and the bucket of each band."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_size(frames, "text", AT_ONCE):
            n = len(frame)
            words, owner = shingles.words(frame["text"].tolist())
            place = (np.arange(len(words)) - np.searchsorted(owner, np.arange(n))[owner] + 1).astype(np.uint64)
            keys = []
            for salt in (shingles.MIX1, shingles.MIX2):
                upto = np.concatenate([[np.uint64(0)], np.cumsum(shingles.mix(words + salt * place), dtype=np.uint64)])
                keys.append(upto[np.searchsorted(owner, np.arange(n), side="right")] - upto[np.searchsorted(owner, np.arange(n))])
            text, element, weight = shingles.counted(*shingles.runs(words, owner, WORDS))
            sign = signatures(text, element, weight, n, bands * rows).reshape(n, bands, rows)
            bucket = np.zeros((n, bands), np.uint64)
            for k in range(rows):
                bucket = shingles.mix(bucket + sign[:, :, k] + shingles.ODD_STEP)
            bucket = shingles.mix(bucket + np.arange(bands, dtype=np.uint64) * shingles.ODD_STEP)
            yield pd.DataFrame({
                "id": frame["id"].to_numpy(), "gone": frame["gone"].to_numpy(), "h": frame["h"].to_numpy(), "k1": keys[0].view(np.int64), "k2": keys[1].view(np.int64),
                "n": np.bincount(owner, minlength=n), "buckets": list(bucket.view(np.int64)),
            })

    return run


def overlap(a: list[str], b: list[str]) -> np.ndarray:
    """Weighted Jaccard of the word runs of paired texts."""
    ta, ea, wa = _bags(a)
    tb, eb, wb = _bags(b)
    total = np.bincount(ta, wa, len(a)) + np.bincount(tb, wb, len(a))
    text, element = np.concatenate([ta, tb]), np.concatenate([ea, eb])
    weight = np.concatenate([wa, wb])
    order = np.lexsort((element, text))
    text, element, weight = text[order], element[order], weight[order]
    same = np.flatnonzero((text[1:] == text[:-1]) & (element[1:] == element[:-1])) if len(text) else np.empty(0, int)
    common = np.bincount(text[same], np.minimum(weight[same], weight[same + 1]), len(a))
    return common / np.maximum(total - common, 1)


def _verifier(similarity: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_size(frames, "u_text", AT_ONCE // 2):
            near = overlap(frame["u_text"].tolist(), frame["v_text"].tolist()) >= similarity
            yield frame.loc[near, ["u", "v"]]

    return run


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    with_texts = (
        pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("u_text")), "u")
        .join(texts.select(F.col("id").alias("v"), F.col("text").alias("v_text")), "v")
    )
    return with_texts.select("u", "v", "u_text", "v_text").mapInPandas(_verifier(similarity), "u long, v long")


def _elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every element, repeats told apart by their number."""
    text, element, weight = _bags(texts)
    which = np.repeat(np.arange(len(text)), weight)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(weight) - weight, weight)
    return text[which], shingles.mix(element[which] + nth.astype(np.uint64) * shingles.MIX1)


def _slot_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in by_size(frames, "text", AT_ONCE):
        slot, n = np.unique(_elements(frame["text"].tolist())[1] % np.uint64(SLOTS), return_counts=True)
        yield pd.DataFrame({"slot": slot.astype(np.int64), "n": n})


def _prefixes(shared, similarity: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_size(frames, "text", AT_ONCE):
            text, element = _elements(frame["text"].tolist())
            full, count = shared.value
            slot = (element % np.uint64(SLOTS)).astype(np.int64)
            place = np.minimum(np.searchsorted(full, slot), max(len(full) - 1, 0))
            often = np.where(full[place] == slot, count[place], 0) if len(full) else np.zeros(len(slot), np.int64)
            order = np.lexsort((element.view(np.int64), often, text))  # signed, as Spark orders it
            text, element = text[order], element[order]
            n = np.bincount(text, minlength=len(frame))
            rank = np.arange(len(text)) - (np.cumsum(n) - n)[text]
            keep = rank < n[text] - np.ceil(similarity * n[text] - 1e-9) + 1
            text, element, rank = text[keep], element[keep], rank[keep]
            yield pd.DataFrame({
                "id": frame["id"].to_numpy()[text], "root": frame["root"].to_numpy()[text], "small": frame["small"].to_numpy()[text],
                "element": element.view(np.int64), "often": often[order][keep], "rank": rank, "n": n[text]})

    return run


def _prefix_pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of a ``small`` text and any of another root that may be similar: no similar one is left out.

    Elements are ordered by how often they occur, then by hash. Any one order loses no pair; rare elements first
    makes few, so the counts of the ``FULLEST`` hashed slots at most are told apart, and all others are rare.
    """
    counts = stage(texts.select("text").mapInPandas(_slot_counts, "slot long, n long").groupBy("slot").agg(
        F.sum("n").alias("n")).where(F.col("n") > 1), "dedup-slots")
    step = F.floor(4 * F.log2("n")).cast("int")
    fits, least = 0, 1 << 30
    for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("s")).collect():
        fits += r["k"]
        if fits > FULLEST:
            break
        least = r["s"]
    found = counts.where(step >= least).orderBy("slot").toPandas()
    shared = texts.sparkSession.sparkContext.broadcast(
        (found["slot"].to_numpy(np.int64), found["n"].to_numpy(np.int64)))
    rows = stage(texts.select("id", "root", "small", "text").mapInPandas(
        _prefixes(shared, similarity), "id long, root long, small boolean, element long, often long, rank long, n long"), "dedup-prefixes")
    # an edit makes several elements with the same texts: the first in order stands for all of them
    code = F.xxhash64("id")
    held = rows.groupBy("element", "often").agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(code).alias("x"), F.bit_xor(F.xxhash64("id", code)).alias("y")).where("c > 1")
    first = held.groupBy("c", "x", "y").agg(F.min(F.struct("often", "element")).alias("e")).select(
        F.col("e.element").alias("element"))
    # with each element go those before it in the text's order, so that a pair is made at its first common one only
    held = rows.join(first, "element", "left_semi").groupBy("id", "root", "small", "n").agg(
        F.array_sort(F.collect_list(F.struct("rank", "element"))).alias("held"))
    rows = stage(held.select(
        "id", "root", "small", "n", F.posexplode("held").alias("at", "e"), F.transform("held", lambda x: x["element"]).alias("order"),
    ).select("id", "root", "small", "n", "e.rank", "e.element", F.slice("order", F.lit(1), F.col("at")).alias("earlier")), "dedup-first")
    a, b = rows.where("small").alias("a"), rows.alias("b")
    least = F.ceil(similarity / (1 + similarity) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    meet = (
        (F.col("a.element") == F.col("b.element")) & (F.col("a.root") != F.col("b.root"))
        & ~F.arrays_overlap("a.earlier", "b.earlier") & (~F.col("b.small") | (F.col("a.id") < F.col("b.id")))
        & (F.col("a.rank") <= F.col("a.n") - least) & (F.col("b.rank") <= F.col("b.n") - least))
    return a.join(b, meet).select(
        F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()


def _labels(links: DataFrame) -> DataFrame:
    """(node, label) of every linked text that is not itself the smallest of its component.

    Links lead to the smallest id of a bucket, so two steps along them leave few
    components apart; only those go through the rounds of ``components``.
    """
    first = links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("near"))
    again = first.select(F.col("node").alias("_node"), F.col("near").alias("_near"))
    near = stage(first.join(again, F.col("near") == F.col("_node"), "left").select(
        "node", F.coalesce("_near", "near").alias("label")), "dedup-near")
    joined = components(_apart(links, near))
    return near.join(joined.select(F.col("node").alias("_node"), "root"), F.col("label") == F.col("_node"), "left").select(
        "node", F.coalesce("root", "label").alias("label")).unionByName(
        joined.where(F.col("node") != F.col("root")).join(near.select("node"), "node", "left_anti")
        .select("node", F.col("root").alias("label")))


def _apart(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between different labels, as links of labels."""
    one = links.join(labels, F.col("u") == F.col("node"), "left").select(F.coalesce("label", "u").alias("u"), "v")
    two = one.join(labels, F.col("v") == F.col("node"), "left").select("u", F.coalesce("label", "v").alias("v"))
    return two.where(F.col("u") != F.col("v")).distinct()


def _keyed(doc: str, text: str) -> list[Column]:
    key = F.col(doc).cast("bigint")
    return [F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("gone"), F.xxhash64(whole(text)).alias("h")]


def _text_classes(docs: DataFrame, doc: str, text: str, similarity: float, bands: int, rows: int) -> DataFrame:
    """Distinct (id, gone, h, root): hash of the text, and root of its class of texts (null for texts without words)."""
    named = docs.select(*_keyed(doc, text), whole(text).alias("text"))
    signed = stage(named.mapInPandas(
        _signer(bands, rows), "id long, gone boolean, h long, k1 long, k2 long, n long, buckets array<long>"), "dedup-signed")
    worded = signed.where(F.col("n") > 0)
    first = stage(worded.groupBy("k1", "k2").agg(F.min("h").alias("node"), F.min_by("buckets", "h").alias("buckets")), "dedup-first")
    members = first.select(F.col("node").alias("id"), F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("id").alias("u"), F.count(F.lit(1)).alias("c")).where("c > 1")
    members = stage(members.join(shared, "bucket"), "dedup-members")
    wanted = named.select(F.col("h").alias("id"), "text").join(members.select("id").distinct(), "id", "left_semi")
    wanted = stage(wanted.groupBy("id").agg(F.min("text").alias("text")), "dedup-texts")
    tested = members.where(F.col("id") != F.col("u")).select("u", F.col("id").alias("v")).distinct()
    links = stage(_verify(tested, wanted, similarity), "dedup-links")
    labels = stage(_labels(links), "dedup-labels")
    placed = members.join(labels, F.col("id") == F.col("node"), "left").select(
        "bucket", "id", F.coalesce("label", "id").alias("root"))
    by_root = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = by_root.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "root")).alias("largest")).where("k > 1").select(
        "bucket", F.col("largest.root").alias("largest"))
    left = stage(placed.join(mixed, "bucket"), "dedup-left")
    apart_from_largest = F.max(F.col("root") != F.col("largest")).alias("small")
    mixed_texts = stage(
        wanted.join(left.groupBy("id", "root").agg(apart_from_largest), "id"), "dedup-mixed")
    across = _prefix_pairs(mixed_texts, similarity)
    more = _verify(across.join(tested, ["u", "v"], "left_anti"), wanted, similarity)
    apart = _apart(stage(more, "dedup-more"), labels)
    joined = components(apart).select(F.col("node").alias("label"), F.col("root").alias("_root"))
    roots = first.select("k1", "k2", "node").join(labels, "node", "left").select(
        "k1", "k2", F.coalesce("label", "node").alias("label")).join(joined, "label", "left").select(
        "k1", "k2", F.coalesce("_root", "label").alias("root"))
    every = signed.select("id", "gone", "h", "n", "k1", "k2").distinct()
    with_root = every.where("n > 0").join(roots, ["k1", "k2"]).select("id", "gone", "h", "root")
    return stage(with_root.unionByName(every.where("n = 0").select(
        "id", "gone", "h", F.lit(None).cast("bigint").alias("root"))), "dedup-roots")


def near_classes(
    docs: DataFrame, *, doc: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(doc_id, class_id) of every distinct non-null id; the class is its smallest id.

    An id on several rows joins the classes of all its texts.
    """
    every = _text_classes(docs, doc, text, similarity, bands, rows).where(~F.col("gone")).select("id", "root").distinct()
    held = every.where(F.col("root").isNotNull())
    several = held.groupBy("id").agg(F.min("root").alias("u"), F.count(F.lit(1)).alias("c")).where("c > 1")
    links = held.join(several, "id").where(F.col("root") != F.col("u")).select("u", F.col("root").alias("v")).distinct()
    joined = components(stage(links, "dedup-ids")).select("node", F.col("root").alias("_root"))
    of_id = every.groupBy("id").agg(F.min("root").alias("root")).join(joined, F.col("root") == F.col("node"), "left").select(
        "id", F.coalesce("_root", "root").alias("root"))
    least = of_id.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("least"))
    return of_id.join(least, "root", "left").select(F.col("id").alias("doc_id"), F.coalesce("least", "id").alias("class_id"))


def keep_one(
    docs: DataFrame, *, doc: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row of ``docs`` for each class of texts: that of the smallest id, then hash of the text.

    Different texts of one id are judged each for itself. Rows with a null id are classes
    among themselves. Of texts without words one for each id stays, and all that have no id.
    """
    every = _text_classes(docs, doc, text, similarity, bands, rows)
    worded = every.where(F.col("root").isNotNull()).groupBy("root", "gone").agg(F.min(F.struct("id", "h")).alias("s")).select(
        F.col("s.id").alias("_id"), F.col("gone").alias("_gone"), F.col("s.h").alias("_h"))
    bare = every.where(F.col("root").isNull() & ~F.col("gone")).groupBy("id", "gone").agg(F.min("h").alias("_h")).select(
        F.col("id").alias("_id"), F.col("gone").alias("_gone"), "_h")
    key = ["_id", "_gone", "_h"]
    rows_of = docs.select("*", *[c.alias(k) for c, k in zip(_keyed(doc, text), key, strict=True)])
    kept = rows_of.join(worded.unionByName(bare), key, "left_semi").dropDuplicates(key).select(*docs.columns)
    no_word = F.length(F.translate(whole(text), SPACE, "")) == 0
    return kept.unionByName(docs.where(F.col(doc).isNull() & no_word))
