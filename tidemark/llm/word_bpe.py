"""Exact ids of a word-level BPE tokenizer file, white-space chunk by chunk.

No pre-token of such a tokenizer holds white space, so a text's ids are those
of its chunks one after the other.  Chunks repeat, so each is looked at once:
its pre-tokens that were proved to be whole tokens are looked up, and only the
rest goes through the library's merges, many at a time.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct

import numpy as np
import regex

#: The pre-token pattern of the tokenizer file, and the letters
#: above ASCII (Latin-1 and Latin Extended-A, without U+0130, whose lower case
#: is two characters) on which every Unicode version agrees.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile(r"[\x21-\x7EÀ-įı-ſ]+")

WORD_END = "</w>"
JOINED = 2_000  # pre-tokens that the library gets in one text
KNOWN = 180_000  # chunks that a worker keeps for good
PASSING = 60_000  # and for a while


@functools.cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings proved to encode alone as one token, with its id.

    Run once, before the data is read: every vocabulary entry that ends a word
    is decoded and encoded by the library; it counts if exactly its own id
    comes back and it is one pre-token in normal form.
    """
    t = library(path)
    texts = {}
    for token, i in t.get_vocab(with_added_tokens=False).items():
        if token.endswith(WORD_END) and (word := token.removesuffix(WORD_END)).isascii():
            texts[word] = i
    words = [w for w in texts if PLAIN.fullmatch(w) and w == w.lower() and PRETOKEN.fullmatch(w)]
    found = t.encode_batch(words, add_special_tokens=False)
    return {w: texts[w] for w, e in zip(words, found, strict=True) if e.ids == [texts[w]]}


class Chunks(dict):
    """From a chunk's bytes to ``of(ids)``; ``join`` makes a chunk's value from its pre-tokens'.

    The first ``KNOWN`` chunks stay, as frequent ones come early; up to
    ``PASSING`` more are held for a while and then dropped together.
    """

    def __init__(self, path: str, whole: dict[str, int], of, join):
        self.path, self.of, self.join, self.passing = path, of, join, []
        self.whole = {w: of((i,)) for w, i in whole.items()}
        self.merged: dict = {}

    def known(self, texts: list[list[bytes]]) -> None:
        """Learn all chunks of the texts that are new."""
        chunks = set().union(*texts)
        if len(self.passing) > PASSING:
            for chunk in self.passing:
                del self[chunk]
            self.passing.clear()
        new = [c for c in chunks if c not in self]
        self.passing += new[max(0, KNOWN - len(self)) :]
        self.learn(new)

    def learn(self, chunks: list[bytes]) -> None:
        t, of, join, parts, rest = library(self.path), self.of, self.join, [], set()
        whole, merged = self.whole, self.merged
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace").lower()
            if text.isalpha() and PLAIN.fullmatch(text):
                value = whole.get(text) or merged.get(text)
                if value:
                    self[chunk] = value
                else:
                    parts.append((chunk, (text,)))
                    rest.add(text)
                continue
            text = chunk.decode("utf-8", "replace")
            if PLAIN.fullmatch(text) is None or "<|" in text:
                self[chunk] = of(t.encode(text, add_special_tokens=False).ids)
                continue
            text = text.lower()
            found = (text[:-1], text[-1]) if text[-1] in ",.;:" and text[:-1].isalpha() else PRETOKEN.findall(text)
            parts.append((chunk, found))
            rest.update([p for p in found if p not in whole and p not in merged])
        got = self.merge(list(rest))
        for chunk, found in parts:
            values = [whole.get(p) or merged.get(p) or got[p] for p in found]
            self[chunk] = values[0] if len(values) == 1 else join(values)

    def merge(self, pretokens: list[str]) -> dict:
        """What the library makes of pre-tokens that are no whole tokens."""
        t, got = library(self.path), {}
        for k in range(0, len(pretokens), JOINED):
            part = pretokens[k : k + JOINED]
            found = t.encode(" ".join(part), add_special_tokens=False)
            split: list[list[int]] = [[] for _ in part]
            for word, i in zip(found.word_ids, found.ids, strict=True):
                split[word].append(i)
            got.update(zip(part, map(self.of, split), strict=True))
        for p in pretokens[: max(0, KNOWN - len(self.merged))]:
            self.merged[p] = got[p]
        return got


class ChunkIds(dict):
    """From a chunk's bytes to its ids, packed as little-endian unsigned 32-bit values.

    Pre-tokens are chunks themselves: a chunk in another case or with signs
    around it takes the ids of what is known.  Unknown pre-tokens go to the
    library joined by spaces, some thousand in one text.  Tables are bounded as
    in ``Chunks``.
    """

    kept, passing_most = 500_000, 300_000

    def __init__(self, path: str):
        self.path, self.passing = path, []

    def known(self, texts: list[list[bytes]]) -> None:
        """Learn all chunks of the texts that are new."""
        chunks = set().union(*texts)
        if len(self.passing) > self.passing_most:
            for chunk in self.passing:
                del self[chunk]
            self.passing.clear()
        new = list(itertools.filterfalse(self.__contains__, chunks))
        for k in range(0, len(new), JOINED):
            self.learn(new[k : k + JOINED])

    def enter(self, chunk: bytes, ids: bytes) -> None:
        if len(self) >= self.kept and chunk not in self:
            self.passing.append(chunk)
        self[chunk] = ids

    def enter_all(self, chunks: list[bytes], ids: list[bytes]) -> None:
        if len(self) + len(chunks) <= self.kept:
            self.update(zip(chunks, ids, strict=True))
        else:
            for c, i in zip(chunks, ids, strict=True):
                self.enter(c, i)

    def one(self, chunk: bytes) -> None:
        ids = library(self.path).encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids
        self.enter(chunk, struct.pack(f"<{len(ids)}I", *ids))

    def learn(self, chunks: list[bytes]) -> None:
        single, pieces, whole, parts, unknown = [], [], [], [], set()
        for chunk, low in zip(chunks, b"\n".join(chunks).lower().split(b"\n"), strict=True):
            if low.isalpha():  # of bytes: ASCII letters alone, which are one pre-token
                found = None
            elif low[-1] in b",.;:" and low[:-1].isalpha():
                found = (low[:-1], low[-1:])
            else:
                plain = chunk.decode("utf-8", "replace")
                if PLAIN.fullmatch(plain) is None or "<|" in plain:
                    self.one(chunk)
                    continue
                text = plain.lower()
                low, found = text.encode(), None if text.isalpha() else [p.encode() for p in PRETOKEN.findall(text)]
            if found:
                pieces.append(chunk)
                parts.append(found)
                unknown.update(found)
            else:
                unknown.add(low)
                if low != chunk:
                    single.append(chunk)
                    whole.append(low)
        unknown = list(itertools.filterfalse(self.__contains__, unknown))
        if unknown:
            found = library(self.path).encode(b" ".join(unknown).decode(), add_special_tokens=False)
            number = np.array(found.word_ids)
            if number[-1] + 1 == len(unknown):
                data, cuts = np.array(found.ids, "<u4").tobytes(), (4 * np.searchsorted(number, np.arange(len(unknown) + 1))).tolist()
                self.enter_all(unknown, [data[a:b] for a, b in itertools.pairwise(cuts)])
            else:
                for w in unknown:
                    self.one(w)
        get = self.__getitem__
        self.enter_all(single, list(map(get, whole)))
        self.enter_all(pieces, [b"".join(map(get, found)) for found in parts])


@functools.cache
def counts(path: str) -> Chunks:
    return Chunks(path, whole_tokens(path), len, sum)


@functools.cache
def packed(path: str) -> ChunkIds:
    return ChunkIds(path)


def forget() -> None:
    """Give back what the tables hold, for a worker that goes on with something else."""
    counts.cache_clear()
    packed.cache_clear()
