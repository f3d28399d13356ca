"""N-gram Jaccard join under several global token orders.

A document is its set of distinct runs of five words (a text of fewer words, but some, is one
run). Documents link when their sets' Jaccard similarity is 0.8 or more; a component is what links reach.

Prefix filtering says: put the tokens of all sets in any one global order; two sets of the wanted
similarity then share a token among the first ``n - ceil(0.8 n) + 1`` of each. This holds for every
order, so a pair has to pass under each of several. Here there are three:

1. by the tokens' own hashes, over all sets;
2. rare before frequent, by exact counts over the sets that the first order leaves, then by a second hash;
3. the same with a third hash.

Sets that share no prefix token with another under an order link with none and leave; what
is left after one order is looked at under the next. The first order, which meets all sets, asks for more: a prefix that is
longer by ``l - 1`` must share ``l`` tokens, here a twentieth of the set, so that a passage shared
in passing does not keep a document. Under the others, tokens of one set alone come first and meet nothing, so a set
has a prefix to share only if four fifths of its tokens are shared; the rest of the order is sorted from those. Pairs are made
under the second order, whose groups are smallest, kept if their prefixes also meet under the first and
the third, and only then verified, on the whole sets, by exact counts.

No group is expanded into its pairs: equal sets are one node; in each group of a token the
node with the smallest share of tokens of its own is compared with all others first, and of what then still lies in several
components those outside the group's largest one are compared with the rest, each pair at its first common
token alone. Nothing bounds the number of partners.

Null and empty texts, and texts without words, have an empty set and are their own component. Rows
without an id have no row in the result and link nothing. Every other row has one row of its own; rows of
one id are not linked through the id. Other columns are not read. Tokens, texts and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlift.llm import shingles
from arborlift.llm.base import by_size, whole
from arborlift.llm.components import components
from arborlift.llm.near_dedup import _apart, _labels
from arborlift.session import stage

WORDS = 5
#: Least similarity, in hundredths.
SIMILARITY = 80
#: Characters a task works on at once.
AT_ONCE = 1_500_000
#: Every set of the first order shares one in so many of its tokens with others, or leaves.
DEPTH = 20
#: Bits of the test that keeps the texts of no further use from being shuffled: 16 MB.
SLOTS = 1 << 27
SALT = shingles.MIX2


def token_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and hash of every token of each text, each once and in order of text; and the sets' sizes."""
    text, token, _ = shingles.counted(*shingles.runs(*shingles.words(texts), WORDS))
    return text, token, np.bincount(text, minlength=len(texts))


def prefix_length(n: np.ndarray, similarity: int, shared: np.ndarray | int = 1) -> np.ndarray:
    """How many tokens of a set of ``n`` another of the wanted similarity must share ``shared`` of."""
    return np.where(n > 0, n - -(-similarity * n // 100) + shared, 0)


def least_shared(n: np.ndarray, similarity: int) -> np.ndarray:
    """Tokens that a set's longer first prefix must share; never more than the whole sets must."""
    return np.minimum(-(-n // DEPTH), -(-similarity * n // 100))


def _in_order(text: np.ndarray, token: np.ndarray, sizes: np.ndarray, keys: tuple, length: np.ndarray) -> list[np.ndarray]:
    """The first ``length`` tokens of each text under the order of ``keys`` (last key first)."""
    order = np.lexsort((*keys, text))
    sorted_text, rank = text[order], np.arange(len(text)) - (np.cumsum(sizes) - sizes)[text[order]]
    keep = rank < length[sorted_text]
    kept = token[order][keep].view(np.int64)
    return np.split(kept, np.cumsum(np.bincount(sorted_text[keep], minlength=len(sizes)))[:-1])


def _signer(similarity: int):
    """A hash of the set, its size, what it must share, the last token of its first prefix, and the longer prefix.

    Of equal sets of a batch one has the prefix.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_size(frames, "text", AT_ONCE):
            text, token, sizes = token_sets(frame["text"].tolist())
            ends = np.cumsum(sizes)
            upto = np.concatenate([[np.uint64(0)], np.cumsum(shingles.mix(token ^ SALT), dtype=np.uint64)])
            node = shingles.mix(upto[ends] - upto[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)
            once = np.zeros(len(sizes), bool)
            once[np.unique(node, return_index=True)[1]] = True
            least = least_shared(sizes, similarity)
            every = _in_order(text, token, sizes, (token.view(np.int64),), prefix_length(sizes, similarity, least))
            last = [int(p[k - 1]) if k else 0 for p, k in zip(every, prefix_length(sizes, similarity))]
            first = [p if o else p[:0] for p, o in zip(every, once)]
            yield pd.DataFrame({
                "id": frame["id"].to_numpy(), "h": frame["h"].to_numpy(), "node": node, "n": sizes, "least": least, "last": last, "first": first})

    return run


def _tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in by_size(frames, "text", AT_ONCE):
        text, token, _ = token_sets(frame["text"].tolist())
        yield pd.DataFrame({"node": frame["node"].to_numpy()[text], "token": token.view(np.int64)})


def _orders(texts: DataFrame, about: DataFrame, similarity: int) -> DataFrame:
    """(node, n, alone, first, second, third): prefixes of the sets that have any token to share in all of them.

    ``alone`` is how many of a set's tokens come before those of ``second``, as nobody else has them.
    """
    held = _held(texts.select("node", "text").mapInPandas(_tokens, "node long, token long"))
    lists = held.groupBy("node").agg(F.collect_list(F.struct("c", "token")).alias("held")).join(about, "node").withColumn("s", F.size("held"))
    take = (F.col("s") - F.ceil(similarity * F.col("n") / 100) + 1).cast("int")

    def ordered(salt: int) -> Column:
        keyed = F.array_sort(F.transform("held", lambda x: F.struct(x["c"], F.xxhash64(x["token"], F.lit(salt)).alias("by"), x["token"].alias("token"))))
        return F.transform(F.slice(keyed, F.lit(1), take), lambda x: x["token"])

    return lists.where(F.lit(100) * F.col("s") >= similarity * F.col("n")).select(
        "node", "n", (F.col("n") - F.col("s")).alias("alone"),
        F.transform(F.filter("held", lambda x: x["token"] <= F.col("last")), lambda x: x["token"]).alias("first"),
        ordered(2).alias("second"), ordered(3).alias("third"))


def _held(rows: DataFrame) -> DataFrame:
    """``rows`` (node, token) of the tokens that several nodes have, with the number ``c`` of such rows.

    They are dealt out by token once, for the count and for what is counted; the rows of a frequent token are
    buffered beside memory, not in it. A pair may be there more than once, for equal sets; those are one node.
    """
    group = Window.partitionBy("token")
    return rows.select(
        "node", "token", F.count(F.lit(1)).over(group).alias("c"), F.min("node").over(group).alias("low"), F.max("node").over(group).alias("high"),
    ).where("low < high").drop("low", "high")


def _meeting(sets: DataFrame, prefix: str) -> DataFrame:
    """Nodes that share a token of this prefix with another."""
    return _held(sets.select("node", F.explode(prefix).alias("token"))).select("node").distinct()


def _maybe(hashes: DataFrame):
    """A test, broadcast, that is true for all hashes ``h`` of the table and for few others.

    It has ``SLOTS`` bits whatever the table's size; where they are all set it lets all pass.
    """
    slot = F.pmod("h", F.lit(SLOTS))
    words = hashes.groupBy(F.floor(slot / 64).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {SLOTS}) % 64 AS int))")).alias("bits")).toPandas()
    bits = np.zeros(SLOTS // 64, np.int64)
    bits[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = hashes.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        slots = h.to_numpy(np.int64) % SLOTS
        return pd.Series((shared.value[slots >> 6] >> (slots & 63)) & 1 == 1)

    return maybe


def counts_of_pairs(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersection and the union of paired texts' sets."""
    ta, ka, na = token_sets(a)
    tb, kb, nb = token_sets(b)
    text, token = np.concatenate([ta, tb]), np.concatenate([ka, kb])
    order = np.lexsort((token, text))
    text, token = text[order], token[order]
    same = np.flatnonzero((text[1:] == text[:-1]) & (token[1:] == token[:-1])) if len(text) else np.empty(0, int)
    common = np.bincount(text[same], minlength=len(a))
    return common, na + nb - common


def _verifier(similarity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_size(frames, "u_text", AT_ONCE // 2):
            common, union = counts_of_pairs(frame["u_text"].tolist(), frame["v_text"].tolist())
            yield frame.loc[(100 * common >= similarity * union) & (union > 0), ["u", "v"]]

    return run


def _passing(pairs: DataFrame, sets: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """Those pairs (u, v) that meet under the first and third order, too, and then in truth."""
    def side(name: str) -> DataFrame:
        return sets.select(*[F.col(c).alias(f"{name}_{c}") for c in ("node", "n", "first", "third")])

    both = pairs.join(side("u"), F.col("u") == F.col("u_node")).join(side("v"), F.col("v") == F.col("v_node"))
    alike = (100 * F.least("u_n", "v_n") >= similarity * F.greatest("u_n", "v_n")) & F.arrays_overlap("u_first", "v_first") & F.arrays_overlap("u_third", "v_third")
    left = both.where(alike).select("u", "v")
    with_texts = left.join(texts.select(F.col("node").alias("u"), F.col("text").alias("u_text")), "u").join(
        texts.select(F.col("node").alias("v"), F.col("text").alias("v_text")), "v")
    return with_texts.select("u", "v", "u_text", "v_text").mapInPandas(_verifier(similarity), "u long, v long")


def _across(rows: DataFrame, labels: DataFrame, similarity: int) -> DataFrame:
    """Pairs (u, v) of different components that meet in a group, each at its first common token.

    ``rows`` has node, n, token, rank. In each group the largest component's nodes are only compared with the others.
    """
    placed = rows.join(labels, "node", "left").withColumn("root", F.coalesce("label", "node")).drop("label")
    by_root = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = by_root.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "root")).alias("top")).where("k > 1")
    # an edit makes several tokens with the same nodes: the first in order stands for all of them
    code = F.xxhash64("node")
    same = placed.join(mixed.select("token"), "token", "left_semi").groupBy("token").agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(code).alias("x"), F.bit_xor(F.xxhash64("node", code)).alias("y"), F.max("rank").alias("rank"))
    first = same.groupBy("c", "x", "y").agg(F.min(F.struct("rank", "token")).alias("e")).select(F.col("e.token").alias("token"))
    kept = stage(placed.join(first.join(mixed, "token"), "token").select(
        "node", "root", "n", "token", "rank", (F.col("root") != F.col("top.root")).alias("apart")), "join-mixed")
    small = kept.groupBy("node").agg(F.max("apart").alias("small"), F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("held"))
    held = stage(kept.select("node", "root", "n").distinct().join(small, "node").select(
        "node", "root", "n", "small", F.posexplode("held").alias("at", "e"), F.transform("held", lambda x: x["token"]).alias("order"),
    ).select("node", "root", "n", "small", "e.rank", "e.token", F.slice("order", F.lit(1), F.col("at")).alias("earlier")), "join-earlier")
    a, b = held.where("small").alias("a"), held.alias("b")
    least = F.ceil(F.lit(similarity) * (F.col("a.n") + F.col("b.n")) / (100 + similarity) - 1e-9)

    def reach(side: str) -> Column:
        return F.col(f"{side}.n") - F.col(f"{side}.rank")

    meet = (
        (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root"))
        & (reach("a") >= least) & (reach("b") >= least)
        & (~F.col("b.small") | (F.col("a.node") < F.col("b.node"))) & ~F.arrays_overlap("a.earlier", "b.earlier"))
    return a.join(b, meet).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _roots(signed: DataFrame, named: DataFrame, similarity: int) -> DataFrame:
    """(node, root) of every node that links with another."""
    held = stage(_held(signed.select("node", F.explode("first").alias("token"))), "join-held")
    met = held.groupBy("node").agg(F.countDistinct("token").alias("c"))
    one = signed.where("n > 0").groupBy("node").agg(*[F.min(c).alias(c) for c in ("h", "n", "least", "last")])
    meeting = stage(one.join(met, "node").where("c >= least").select("node", "h", "n", "last"), "join-meeting")
    once = named.where(_maybe(meeting)("h")).groupBy("h").agg(F.min("text").alias("text"))
    texts = stage(once.join(meeting.select("node", "h"), "h"), "join-texts")
    sets = stage(_orders(texts, meeting.select("node", "n", "last"), similarity), "join-orders")
    sets = sets.join(_meeting(sets, "second"), "node", "left_semi")
    sets = stage(sets.join(_meeting(sets, "third"), "node", "left_semi"), "join-sets")
    left = sets.select(F.col("node").alias("h"))
    texts = stage(texts.where(_maybe(left)("node")).join(left, F.col("node") == left["h"], "left_semi").select("node", "text"), "join-wanted")
    rows = sets.select("node", "n", "alone", F.posexplode("second").alias("rank", "token")).withColumn("rank", F.col("rank") + F.col("alone"))
    # a text that many others were made from has few tokens of its own, and links where they do not link with each other
    central = F.min(F.struct((F.col("alone") / F.col("n")).alias("own"), "node"))
    hubs = rows.groupBy("token").agg(central.alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", F.col("hub.node").alias("hub"))
    rows = stage(rows.join(hubs, "token"), "join-rows")
    tested = stage(rows.where(F.col("node") != F.col("hub")).select(
        F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct(), "join-hubs")
    links = stage(_passing(tested, sets, texts, similarity), "join-links")
    labels = stage(_labels(links), "join-labels")
    across = _across(rows.select("node", "n", "token", "rank"), labels, similarity)
    more = stage(_passing(across.join(tested, ["u", "v"], "left_anti"), sets, texts, similarity), "join-more")
    joined = components(_apart(more, labels)).select(F.col("node").alias("label"), F.col("root").alias("_root"))
    every = labels.unionByName(joined.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti"))
    return every.join(joined, "label", "left").select("node", F.coalesce("_root", "label").alias("root"))


def similar_components(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row with an id."""
    named = docs.where(F.col(doc).isNotNull()).select(
        F.col(doc).cast("bigint").alias("id"), F.xxhash64(whole(text)).alias("h"), whole(text).alias("text"))
    signed = stage(named.mapInPandas(
        _signer(similarity), "id long, h long, node long, n long, least long, last long, first array<long>"), "join-signed")
    roots = stage(_roots(signed, named.select("h", "text"), similarity), "join-roots")
    worded = signed.where("n > 0").groupBy("node").agg(F.min("id").alias("least")).join(roots, "node", "left")
    worded = stage(worded.select("node", "least", F.coalesce("root", "node").alias("root")), "join-nodes")
    least = worded.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = worded.join(least, "root").select("node", "component_id")
    return signed.select("id", "node", "n").join(of_set, "node", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
