"""Benchmark decontamination: a broadcast hash set of test n-grams.

Benchmark items and documents are lower-cased (A-Z) and split into words; every
run of ``window`` consecutive item words is a gram, and an item of fewer words,
but not none, is one shorter gram. The set of gram hashes is broadcast, filed by
each gram's longest word: a document word that is one of these has the run around
it hashed and looked up, and a run that finds its hash is verified on the words
themselves. All of this happens in the scan stage, so no document word is
shuffled; only verified hits are grouped per document.

Only built-in functions are used. Grams are broadcast up to ``broadcast_rows``
rows (counted first); a larger benchmark is joined by shuffle on the hash.

Null and empty texts have no words and no hits. Repeated rows each get their own
result: hits are grouped by (id, hash of the text), null ids included. Items
with a null id hit words but are not counted as items. An empty benchmark or
document table gives no hits or no rows. Columns of the input other than id and
text take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlift.llm.base import ascii_lower, split_words, whole

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# the same words in a text that still has its upper case
WORD, NO_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def leak_words(text: str | Column) -> Column:
    return split_words(ascii_lower(whole(text)), GAP)


def _run(words: Column, start: Column, size: Column) -> Column:
    return F.slice(words, start + 1, size)


def grams(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """Distinct grams of the benchmark: hash, words, items, and the longest word with its place."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), leak_words(text).alias("words"))
    size = F.least(F.size("words"), F.lit(window))
    runs = items.where(F.size("words") > 0).select(
        "item", F.explode(F.transform(
            F.sequence(F.lit(0), F.size("words") - size), lambda i: _run(F.col("words"), i, size))).alias("gram"))
    distinct = runs.groupBy("gram").agg(F.collect_set("item").alias("items"))
    longest = F.array_max(F.transform("gram", lambda w, i: F.struct(F.length(w).alias("n"), w.alias("word"), i.alias("at"))))
    return distinct.select(
        "gram", "items", F.xxhash64("gram").alias("gram_hash"), F.size("gram").alias("gram_len"),
        F.xxhash64(longest["word"]).alias("anchor"), longest["at"].alias("anchor_at"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", window: int = 10, broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """One row per (id, text) with hits: its hit word spans and the items that hit it.

    Columns: leak_id, leak_hash (hash of the text), spans (sorted
    array of pos and len, in words), items (sorted array).
    """
    known = grams(benchmark, item, item_text, window)
    if known.count() <= broadcast_rows:
        known = F.broadcast(known)
    seen = docs.select(
        F.col(doc).alias("leak_id"), F.xxhash64(whole(text)).alias("leak_hash"), leak_words(text).alias("words"),
    ).select("leak_id", "leak_hash", "words", F.posexplode("words").alias("at", "word"))
    start = F.col("at") - F.col("anchor_at")
    run = _run(F.col("words"), start, F.col("gram_len"))
    inside = (start >= 0) & (start + F.col("gram_len") <= F.size("words"))
    same = F.when(inside, (F.xxhash64(run) == F.col("gram_hash")) & (run == F.col("gram"))).otherwise(False)
    found = seen.join(known, (F.xxhash64("word") == F.col("anchor")) & same).select(
        "leak_id", "leak_hash", start.alias("pos"), F.col("gram_len").alias("len"), "items")
    return found.groupBy("leak_id", "leak_hash").agg(
        F.sort_array(F.collect_set(F.struct("pos", "len"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def covered(spans: Column) -> Column:
    """Number of words in the union of sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(spans, start, lambda a, s: F.struct(
        F.greatest(a["end"], s["pos"] + s["len"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["pos"] + s["len"] - F.greatest(a["end"], s["pos"]))).alias("n"),
    ), lambda a: a["n"])


def with_leaks(docs: DataFrame, leaks: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Every input row as ``row``, with its spans and items (null if it has none)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col(f"row.`{doc}`").eqNullSafe(F.col("leak_id")) & (F.xxhash64(whole(F.col(f"row.`{text}`"))) == F.col("leak_hash"))
    return rows.join(leaks, same, "left").select("row", "spans", "items")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text",
    action: str = "spans", max_share: float = 0.5, **options,
) -> DataFrame:
    """Documents without benchmark passages; columns as in ``docs``.

    ``action="spans"`` cuts the hit words (with what follows each up to the next
    word) out of the text and drops a document of which more than ``max_share``
    of the words are hit; ``action="documents"`` drops every document with a hit.
    """
    if action not in ("spans", "documents"):
        raise ValueError(f"unknown action {action!r}")
    found = with_leaks(docs, find_leaks(docs, benchmark, doc=doc, text=text, **options), doc, text)
    if action == "documents":
        return found.where(F.col("spans").isNull()).select("row.*")
    body = F.col(f"row.`{text}`")
    pieces = F.regexp_extract_all(body, F.lit(f"({WORD}{NO_WORD})"), F.lit(1))
    lead = F.regexp_extract(body, f"^({NO_WORD})", 1)
    kept = F.filter(pieces, lambda _, i: ~F.exists("spans", lambda s: (i >= s["pos"]) & (i < s["pos"] + s["len"])))
    cut = F.when(F.col("spans").isNull(), body).otherwise(F.concat(lead, F.array_join(kept, "")))
    few = F.col("spans").isNull() | (covered(F.col("spans")) <= max_share * F.size(leak_words(body)))
    return found.where(few).select(F.col("row").withField(f"`{text}`", cut).alias("row")).select("row.*")
