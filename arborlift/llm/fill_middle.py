"""Fill-in-middle: documents cut at line ends into prefix, middle and suffix, and put in a new order.

Method: content-defined chunks with memorized summaries. A rolling hash over the last
``WINDOW`` bytes says where a text is cut into chunks, so that equal passages of different
documents give equal chunks wherever they stand. What a cut needs to know of a chunk - its
line ends, its code points, whether it holds a marker, and the characters at its two edges, where
a marker may lie across chunks - is worked out once for each content and kept in a cache of
bounded size; the content itself is the key, so what is found there has been compared byte by
byte. Running sums of the chunks' line ends tell the chunk a cut falls into, and only that one is searched.

Units are lines with their line end, the last with or without. With h1 to h4 from the digest
of ``seed:doc_id``, the prefix ends after the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units,
the middle after the larger. A document is ``plain`` (left as it is) if its text is empty or
holds a marker, or by ``h3 % 100 >= rate``; else ``spm`` if ``h4 % 100 < spm_rate``, else ``psm``.

Null texts are empty, hence plain. A null id gives the digest of ``seed:`` alone. Repeated rows are
each transformed alike; an empty table gives no row. Texts of any length are held whole by one task,
a few at a time; the work is one narrow pass, with nothing kept between tasks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlift.llm.base import by_size, whole
from arborlift.llm.shingles import LETTERS

# The markers of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
CONTINUATION = bytes(range(0x80, 0xC0))
SEED, RATE, SPM_RATE = 7, 100, 50
#: A chunk ends where this many low bits of the rolling hash are zero, and at LONGEST bytes in any case.
BITS, WINDOW, LONGEST = 9, 16, 8192
#: Bytes of chunks that a task keeps summaries of, and characters it cuts at once.
CACHE_BYTES, AT_ONCE = 8_000_000, 1_000_000

SCHEMA = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"
)


@dataclass(frozen=True, slots=True)
class Summary:
    """What cuts need to know of a chunk."""

    lines: int
    chars: int
    marked: bool
    head: bytes
    tail: bytes


def code_points(data: bytes) -> int:
    """Code points that begin in ``data``, so that the parts of a text add up however it is cut."""
    return len(data) if data.isascii() else len(data.translate(None, CONTINUATION))


def summarize(chunk: bytes) -> Summary:
    return Summary(chunk.count(b"\n"), code_points(chunk), any(m in chunk for m in MARKS), chunk[:2], chunk[-2:])


class Cache:
    """Summaries by content. Emptied when it is full, which costs time and changes nothing."""

    def __init__(self, most: int = CACHE_BYTES):
        self.most, self.held, self.known, self.hits = most, 0, {}, 0

    def of(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        if self.held + len(chunk) > self.most:
            self.known.clear()
            self.held = 0
        self.held += len(chunk)
        found = self.known[chunk] = summarize(chunk)
        return found


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of a text end: by its content, and at ``LONGEST`` bytes at the latest.

    The rolling hash of a place is the xor of the scrambled last ``WINDOW`` bytes, each turned by its
    distance, so it depends on these bytes alone.
    """
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= WINDOW:
        return [len(raw)] if len(raw) else []
    scrambled = LETTERS[raw].astype(np.uint32)
    rolling, span = scrambled.copy(), 1
    while span < WINDOW:  # windows of 2, 4, 8 ... bytes out of two of half the size
        turned = (rolling[:-span] << np.uint32(span)) | (rolling[:-span] >> np.uint32(32 - span))
        rolling = rolling.copy()
        rolling[span:] ^= turned
        span *= 2
    mask = np.uint32((1 << BITS) - 1)
    ends, last = [], 0
    for end in [*(np.flatnonzero((rolling[WINDOW:] & mask) == 0) + WINDOW + 1).tolist(), len(raw)]:
        while end - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if end > last:
            ends.append(end)
            last = end
    return ends


def _marked(parts: list[Summary]) -> bool:
    """Whether a marker lies in a chunk or across the edge of chunks."""
    if any(p.marked for p in parts):
        return True
    carried = b""
    for part in parts:
        if any(m in carried + part.head for m in MARKS):
            return True
        carried = (carried + part.tail)[-2:]
    return False


class Cutter:
    """A text as chunks, with the running sums of their lines and code points."""

    def __init__(self, text: str, cache: Cache):
        self.data = text.encode()
        ends = chunk_ends(self.data)
        self.starts = [0, *ends]
        self.parts = [cache.of(self.data[a:b]) for a, b in zip(self.starts, ends)]
        self.lines = [0, *accumulate(p.lines for p in self.parts)]
        self.chars = [0, *accumulate(p.chars for p in self.parts)]
        self.marked = _marked(self.parts)
        self.units = self.lines[-1] + (bool(self.data) and not self.data.endswith(b"\n"))

    def after(self, units: int) -> tuple[int, int]:
        """(byte, code point) after so many units."""
        if units == 0:
            return 0, 0
        if units > self.lines[-1] or units == self.units:
            return len(self.data), self.chars[-1]
        k = bisect_left(self.lines, units) - 1  # the chunk that holds this line end
        at = self.starts[k] - 1
        for _ in range(units - self.lines[k]):
            at = self.data.index(b"\n", at + 1)
        return at + 1, self.chars[k] + code_points(self.data[self.starts[k]:at + 1])


def digest_numbers(seed: int, doc_id) -> list[int]:
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[8 * k:8 * k + 8], 16) for k in range(4)]


def transform(text: str, doc_id, cache: Cache, seed: int, rate: int, spm_rate: int) -> tuple:
    """(units, form, prefix and middle code points or None, output) of one document."""
    h1, h2, h3, h4 = digest_numbers(seed, doc_id)
    cut = Cutter(text, cache)
    n = cut.units
    if not text or cut.marked or h3 % 100 >= rate:
        return n, "plain", None, None, text
    (a, a_chars), (b, b_chars) = (cut.after(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (p.decode() for p in (cut.data[:a], cut.data[a:b], cut.data[b:]))
    if h4 % 100 < spm_rate:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, a_chars, b_chars - a_chars, output


def restore(output: str, form: str) -> str:
    """The text a form was made from, told from the output alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output[len(first):].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


def fill_middle(
    docs: DataFrame, *, doc: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
) -> DataFrame:
    """Each document's units, form, part lengths in code points, output, and the text restored from it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Cache()
        for frame in by_size(frames, "text", AT_ONCE):
            ids = [None if gone else int(i) for i, gone in zip(frame["id"], frame["gone"])]
            rows = [transform(t, i, cache, seed, rate, spm_rate) for t, i in zip(frame["text"], ids)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            out["prefix_chars"], out["middle_chars"] = out["prefix_chars"].astype("Int64"), out["middle_chars"].astype("Int64")
            out.insert(0, "doc_id", pd.array(ids, dtype="Int64"))
            out["restored"] = [restore(o, f) for o, f in zip(out["output"], out["form"])]
            yield out

    key = F.col(doc).cast("bigint")
    named = docs.select(F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("gone"), whole(text).alias("text"))
    return named.mapInPandas(run, SCHEMA)
