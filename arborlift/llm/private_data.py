"""Personal data: fixed formats, and identifiers found by bootstrapped contexts.

Base spans are e-mail addresses, IP addresses, card and phone numbers by their
formats (``base_spans``). Together with secrets - runs of ``SECRET`` or more
ASCII letters and digits that mix both, as keys and digests do - they seed a
bootstrap:

1. one pass over all texts lists the seeds and every other value that may be an
   identifier (five characters or more, with a digit or after a key such as
   ``name=``), each with its contexts: the word before, the two words before,
   and the key in front of it;
2. contexts that ``LEAST_INSTANCES`` different trusted values share, and at
   least the share ``SUPPORT`` of all edges to such values, are induced as
   patterns, and all their places in the texts are counted;
3. patterns and instances form a graph of counted edges. A pattern's trust is
   the weight of scored instances at its places over all its places; an
   instance's score is 1 for seeds, else the chance that one of the patterns
   with trust of ``LEAST_SCORE`` or more is right. What scores ``LEAST_SCORE``
   induces new patterns in the next of ``ROUNDS`` rounds;
4. seeds that are secrets are spans of the kind ``secret``, other values of
   ``LEAST_SCORE`` or more of the kind ``identifier``.

The support is a share, so at most ``1 / SUPPORT`` patterns are induced in a
round whatever the input: they are broadcast, and a batch gives at most so many
counts. Edges are counted before they are shuffled, and scores are aggregations
with map-side combine, so a frequent pattern is no hot task.

Positions are code points, ends exclusive. Null texts are empty and have no
spans; rows of equal id and text get equal spans; null ids are kept; empty
tables give no rows. Only the id and text columns are read, any others pass
through ``redact`` unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlift.llm import shingles
from arborlift.llm.base import SPACE, by_size, whole
from arborlift.session import stage

# Kinds in their order, and the formats; runs are matched without backtracking.
KINDS = ("email", "ip", "card", "phone", "secret", "identifier")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
VALUE = re.compile(r"[A-Za-z0-9._%+@/-]*")
VALUE_CHARS = LOCAL_CHARS | {"@", "/"}
MIXED = re.compile(r"(?=[0-9]*[A-Za-z]+[0-9]+[A-Za-z]|[A-Za-z]*[0-9]+[A-Za-z]+[0-9])[A-Za-z0-9]+")
KEYED = re.compile(r"[=:][\"']?(?=[A-Za-z0-9])")
NAME = re.compile(r"[A-Za-z0-9_.-]*[A-Za-z0-9][\"']?[=:][\"']?\Z")

SECRET, LEAST_INSTANCES, SUPPORT, ROUNDS, LEAST_SCORE = 16, 3, 0.001, 3, 0.5
AT_ONCE, CONTEXT, SHORTEST = 1_000_000, 256, 5

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > last and text[first - 1] in LOCAL_CHARS:
            first -= 1
        if first < at and (found := DOMAIN.match(text, at + 1)):
            last = found.end()
            yield first, last
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four formats, by start, then kind."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if any(d in text for d in "0123456789"):
        found += [("ip", a, b) for a, b in _ips(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _pattern_hashes(contexts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of one and of two words at the end of each context (0 where there are too few words)."""
    h, t = shingles.words(contexts)
    n = len(contexts)
    ends = np.searchsorted(t, np.arange(n), side="right")
    count = np.bincount(t, minlength=n)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    has = count > 0
    one[has] = _one(h[ends[has] - 1])
    has = count > 1
    two[has] = _two(h[ends[has] - 2], h[ends[has] - 1])
    return one, two


def _one(word: np.ndarray) -> np.ndarray:
    return shingles.mix(word + shingles.ODD_STEP)


def _two(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return shingles.mix(shingles.mix(before + shingles.MIX1) + word)


def other_values(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Values outside the base spans: with a digit, or right after a key; of any length, in order."""
    at = [m.end() for m in KEYED.finditer(text)] if "=" in text or ":" in text else []
    if any(d in text for d in "0123456789"):
        at = sorted([*at, *(m.start() for m in DIGIT.finditer(text))])
    out, last, k = [], 0, 0
    for place in at:
        if place < last:
            continue
        first = place
        while first > last and text[first - 1] in VALUE_CHARS:
            first -= 1
        last = VALUE.match(text, place).end()
        a, b = first, last
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        if a < b and not any(x < b and a < y for _, x, y in spans[k:k + 4]):
            out.append((a, b))
    return out


FOUND = (
    "doc_id long, gone boolean, text_hash long, n array<long>, sha string, spans string, "
    "values array<struct<instance:long,first:int,last:int,seed:int,one:long,two:long,name:long>>")


def _find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Base spans of every text, and its seeds (1 base, 2 secret) and other values (0) with their contexts."""
    for frame in by_size(frames, "text", AT_ONCE):
        rows, contexts, values, cut = [], [], [], [0]
        for text in frame["text"]:
            spans = base_spans(text)
            joined = span_text(spans)
            rows.append(([sum(s[0] == k for s in spans) for k in KINDS[:4]], hashlib.sha256(joined.encode()).hexdigest(), joined))
            placed = [(a, b, 1) for _, a, b in spans]
            placed += [(a, b, 2 if b - a >= SECRET and MIXED.fullmatch(text, a, b) else 0) for a, b in other_values(text, sorted(spans, key=lambda s: s[2]))]
            for a, b, seed in placed:
                head = a
                while head > 0 and a - head <= CONTEXT and text[head - 1] not in SPACE:  # the whole word that holds the value
                    head -= 1
                name = NAME.search(text, head, a) if a > head and text[a - 1] in "=:\"'" else None
                if not seed and b - a < SHORTEST and not name:
                    continue
                contexts.append(text[max(0, head - CONTEXT):head])
                # short values only count as places of their key
                values.append((_value(text[a:b]) if seed or b - a >= SHORTEST else 0, a, b, seed, _value("=" + name.group()) if name else 0))
            cut.append(len(contexts))
        one, two = (h.view(np.int64).tolist() for h in _pattern_hashes(contexts))
        placed = [(v, a, b, seed, one[i], two[i], name) for i, (v, a, b, seed, name) in enumerate(values)]
        out = frame[["doc_id", "gone", "text_hash"]].reset_index(drop=True)
        out["n"], out["sha"], out["spans"] = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        names = ("instance", "first", "last", "seed", "one", "two", "name")
        out["values"] = [[dict(zip(names, v)) for v in placed[a:b]] for a, b in zip(cut, cut[1:])]
        yield out


def _value(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.lower().encode(), digest_size=8).digest(), "little", signed=True)


def _count(shared):
    """Places of the broadcast word patterns: every word after one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = shared.value
        for frame in by_size(frames, "text", AT_ONCE):
            h, t = shingles.words(frame["text"].tolist())
            i = np.flatnonzero(t[1:] == t[:-1]) + 1
            j = i[i > 1]
            j = j[t[j - 2] == t[j]]
            code = np.concatenate([_one(h[i - 1]), _two(h[j - 2], h[j - 1])]).view(np.int64)
            place = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
            known, n = np.unique(code[wanted[place] == code], return_counts=True)
            yield pd.DataFrame({"pattern": known, "places": n})

    return run


def _named(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(doc).cast("bigint"), F.lit(0)).alias("doc_id"), F.col(doc).isNull().alias("gone"),
        whole(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))


def _places(named: DataFrame, by_name: DataFrame, new: DataFrame) -> DataFrame:
    """All places of newly induced patterns; there are at most ``1 / SUPPORT``."""
    names = by_name.join(F.broadcast(new), "pattern", "left_semi")
    words = np.sort(np.array([r.pattern for r in new.where("NOT is_name").collect()], np.int64))
    if not len(words):
        return stage(names, "private-places")
    shared = named.sparkSession.sparkContext.broadcast(words)
    counted = named.select("text").mapInPandas(_count(shared), "pattern long, places long")
    out = stage(names.unionByName(counted.groupBy("pattern").agg(F.sum("places").alias("places"))), "private-places")
    shared.destroy()
    return out


def score_graph(named: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Scores of instances, and the trust of the patterns induced (None without any)."""
    pattern = F.inline(F.array(*[
        F.struct(F.col(c).alias("pattern"), F.lit(c == "name").alias("is_name")) for c in ("one", "two", "name")]))
    edges = stage(
        values.select("instance", "seed", pattern).where("pattern != 0").groupBy("pattern", "is_name", "instance")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("seed") > 0).cast("double").alias("seed")), "private-edges")
    by_name = edges.where("is_name").groupBy("pattern").agg(F.sum("n").alias("places"))
    edges = edges.where("instance != 0")
    scores = stage(edges.groupBy("instance").agg(F.max("seed").alias("score")), "private-scores")
    known, patterns = None, None
    for _ in range(ROUNDS):
        shown = edges.join(scores.where(F.col("score") >= LEAST_SCORE), "instance", "left_semi")
        total = shown.count()
        new = shown.groupBy("pattern", "is_name").agg(F.count(F.lit(1)).alias("seen")).where(
            (F.col("seen") >= LEAST_INSTANCES) & (F.col("seen") >= SUPPORT * total)).select("pattern", "is_name")
        new = stage(new if known is None else new.join(known, "pattern", "left_anti"), "private-patterns")
        if new.isEmpty():
            break
        places = _places(named, by_name, new)
        known = places if known is None else known.unionByName(places)
        patterns = stage(
            edges.join(scores, "instance").join(known, "pattern").groupBy("pattern")
            .agg(F.sum(F.col("n") * F.col("score")).alias("w"), F.first("places").alias("places"))
            .select("pattern", F.least(F.col("w") / (F.col("places") + 1), F.lit(0.999)).alias("trust")), "private-trust")
        sure = patterns.where(F.col("trust") >= LEAST_SCORE)
        scores = stage(
            edges.join(sure, "pattern", "left").groupBy("instance")
            .agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.coalesce(F.log(1 - F.col("trust")), F.lit(0.0))))).alias("chance"))
            .select("instance", F.greatest("seed", "chance").alias("score")), "private-scores")
    return scores, patterns


def find_private(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Base spans of every row, and discovered spans by (doc_id, gone, text_hash)."""
    named = _named(docs, doc, text)
    base = stage(named.mapInPandas(_find, FOUND), "private-base")
    values = base.select("doc_id", "gone", "text_hash", F.inline("values"))
    scores, _ = score_graph(named, values)
    trusted = scores.where(F.col("score") >= LEAST_SCORE).select("instance")
    span = F.struct("first", "last", F.when(F.col("seed") == 2, "secret").otherwise("identifier").alias("kind"))
    # secrets count without any context; base spans are there already
    found = values.where("seed = 2").unionByName(
        values.where("seed = 0 AND instance != 0").join(trusted, "instance", "left_semi").select(values.columns)
    ).groupBy("doc_id", "gone", "text_hash").agg(F.sort_array(F.collect_set(span)).alias("more"))
    return base.drop("values"), stage(found, "private-found")


KEY = ["doc_id", "gone", "text_hash"]


def all_spans(base: str, more: list | None) -> list[Span]:
    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
    spans += [(m["kind"], int(m["first"]), int(m["last"])) for m in (more if more is not None else [])]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets.

    Spans that overlap are replaced together, by the kind of the first.
    """
    _, found = find_private(docs, doc=doc, text=text)
    more = found.select(F.col("doc_id").alias("_doc"), F.col("gone").alias("_gone"), F.col("text_hash").alias("_hash"), F.col("more").alias("_more"))
    same = (F.coalesce(F.col(doc).cast("bigint"), F.lit(0)) == F.col("_doc")) & (F.col(doc).isNull() == F.col("_gone")) & (
        F.xxhash64(whole(text)) == F.col("_hash"))

    @F.pandas_udf("string")
    def masked(body: pd.Series, more: pd.Series) -> pd.Series:
        out = []
        for text, extra in zip(body, more, strict=True):
            if text is None:
                out.append(None)
                continue
            pieces, last = [], 0
            for kind, a, b in all_spans(span_text(base_spans(text)), extra):
                if a >= last:
                    pieces += [text[last:a], f"<{kind.upper()}>"]
                last = max(last, b)
            out.append("".join([*pieces, text[last:]]))
        return pd.Series(out, dtype=object)

    return docs.join(more, same, "left").withColumn(text, masked(F.col(text), F.col("_more"))).select(*docs.columns)
