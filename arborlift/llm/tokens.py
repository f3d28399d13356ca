"""Token ids of whole texts by the installed tokenizers, at a bounded cost per word.

A BPE vocabulary is applied to each pre-token alone, so ids may be kept by word.
Where spaces are part of tokens, texts of plain characters are cut into their
pre-tokens together, and each distinct one of a batch is looked up once. Other
texts are cut at plain spaces and line ends, where both vocabularies always part
pre-tokens. A word that was met lately is looked up, a plain word goes straight to
the library's BPE model, and everything else (other scripts, and where spaces count
other or repeated white space) through the library's whole encoding.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex

#: Words kept by a worker: at most two times as many.
KEPT_WORDS = 500_000
#: The same for pre-tokens that are looked up once a batch, where fewer do as well; those of a batch come on top.
KEPT_PARTS = 250_000
#: White space other than spaces, line ends, tabs and the like, and the mark that parts units here.
RARE_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\0"
#: What also needs the whole encoder where spaces are part of tokens.
UNEVEN = ("\t", "\r", "\x0b", "\x0c", "  ", "\n\n", " \n", "\n ")


def _has_any(text: str, parts) -> bool:
    for part in parts:  # each a plain search, many times faster than one expression for all
        if part in text:
            return True
    return False


# How the two vocabularies part words.
WORD_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BYTE_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")
#: Texts whose characters are of the same class in every version of Unicode.
EVEN_TEXT = re.compile(r"[\n !-~\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]*\Z")
#: Kinds of their characters; a zero byte ends a text.
SPACE, LINE, END, LETTER, DIGIT, MARK = range(6)
#: Words of Latin-1 characters, which no normal form changes.
PLAIN = re.compile(r" ?[!-~\xa1-\xac\xae-\xff]+\Z")


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte: itself if it can be printed, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()
LETTER_OF = [chr(BYTE_LETTERS[b]) for b in range(256)]


def _kinds() -> np.ndarray:
    kinds = np.full(256, MARK, np.uint8)
    for b in range(256):
        if chr(b).isalpha():
            kinds[b] = LETTER
    kinds[ord("0"):ord("9") + 1] = DIGIT
    kinds[[ord(" "), ord("\n"), 0]] = SPACE, LINE, END
    return kinds


KINDS = _kinds()
ID = attrgetter("id")
#: Marks that often end a word.
MARKS = ".,;:!?*%$&#|"


def even_starts(raw: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in plain texts as Latin-1 bytes, each text ended by a zero byte, which is one by itself.

    A space goes to the letters, digits or marks behind it; other white space is
    one pre-token up to the character before those. All of it is, at a text's end.
    """
    kind = KINDS[raw]
    before, after = np.roll(kind, 1), np.roll(kind, -1)  # the last byte is an end, as good as none before the first
    starts = np.where(kind <= LINE, (before >= END) | (after > END), (kind != before) & (before != SPACE) | (kind == END))
    at = np.flatnonzero(starts & (raw == ord("'")))  # 's 't 'm 'd, 're 've 'll are pre-tokens whatever follows
    first, second = raw[at + 1], raw[np.minimum(at + 2, len(raw) - 1)]
    one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
    two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    starts[at[one | two] + 1] = False
    starts[at[one] + 2] = starts[at[two] + 3] = True
    return np.flatnonzero(starts)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            self.drops_space = bool(json.load(f)["normalizer"])
        self.lately = _Words(self._word)
        self.before: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def _bytes(ids: Iterable[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _letters(self, letters: str) -> bytes:
        """Ids of one pre-token of plain characters."""
        if not letters.isascii() or letters.isspace():
            letters = "".join([LETTER_OF[b] for b in letters.encode()])
        elif letters[0] == " ":
            letters = LETTER_OF[32] + letters[1:]
        return self._bytes(map(ID, self.model.tokenize(letters)))

    def _word(self, word: str) -> bytes:
        """Ids of a word that is not among the latest; they are kept for the next time."""
        ids = self.before.get(word)
        if ids is None:
            if word[word[0] == " ":].isalpha():
                ids = self._letters(word.lower() if self.drops_space else word) if PLAIN.match(word) else self._ids(word)
            elif (core := word.rstrip(MARKS)) and core != word and core[core[0] == " ":].isalpha():
                ids = self.lately[core] + self.lately[word[len(core):]]  # letters and marks are different pre-tokens
            elif not PLAIN.match(word):
                ids = self._ids(word)
            else:
                parts = WORD_PARTS.findall(word.lower()) if self.drops_space else BYTE_PARTS.findall(word)
                ids = b"".join([self._letters(p) for p in parts])
        self._forget(KEPT_WORDS)
        self.lately[word] = ids
        return ids

    def _forget(self, most: int) -> None:
        if len(self.lately) >= most:
            self.before = dict(self.lately)
            self.lately.clear()

    def _is_even(self, text: str) -> bool:
        return not self.drops_space and EVEN_TEXT.match(text) is not None

    def _even(self, texts: list[str], end: bytes = b"") -> list[np.ndarray]:
        """Ids of plain texts, whose distinct pre-tokens are looked up once."""
        if not texts:
            return []
        together = "\0".join([*texts, ""])
        raw, utf8 = np.frombuffer(together.encode("latin-1"), np.uint8), together.encode()
        at = even_starts(raw)
        offsets = np.append(at, len(utf8))
        if len(utf8) > len(raw):  # characters from 128 on are two bytes
            offsets[:-1] += np.cumsum(raw > 127, dtype=np.int64)[at] - (raw[at] > 127)
        found = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(utf8)]).dictionary_encode()
        parts = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        lately, before, each = self.lately, self.before, list(map(self.lately.get, parts))
        each[parts.index("\0")] = end
        for k, ids in enumerate(each):
            if ids is None:
                ids = before.get(parts[k])
                each[k] = lately[parts[k]] = self._letters(parts[k]) if ids is None else ids
        self._forget(KEPT_PARTS)
        ids = pa.array(each, pa.large_binary()).take(found.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(at) + 1)[1:][raw[at] == 0] // 4
        return np.split(np.frombuffer(ids.buffers()[2] or b"", "<u4", int(ends[-1])), ends[:-1])

    def encode_all(self, texts: list[str], end: bytes = b"") -> Iterator[np.ndarray]:
        """Ids of each text with the end after them, as unsigned 32-bit integers."""
        even = [self._is_even(t) for t in texts]
        plain = iter(self._even([t for t, e in zip(texts, even, strict=True) if e], end))
        for text, is_even in zip(texts, even, strict=True):
            yield next(plain) if is_even else np.frombuffer(self.encode(text) + end, "<u4")

    def encode(self, text: str) -> bytes:
        if self._is_even(text):
            return self._even([text])[0].tobytes()
        if _has_any(text, RARE_SPACE) or (not self.drops_space and _has_any(text, UNEVEN)):
            return self._ids(text)
        if self.drops_space:
            words = text.split()
        else:
            words = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return b"".join(map(self.lately.__getitem__, words))


class _Words(dict):
    """Ids by word; a word that is missing is worked out."""

    def __init__(self, work_out) -> None:
        super().__init__({"": b""})
        self.work_out = work_out

    def __missing__(self, word: str) -> bytes:
        return self.work_out(word) if word else b""


_READY: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary."""
    if path not in _READY:
        _READY[path] = Encoder(path)
    return _READY[path]
