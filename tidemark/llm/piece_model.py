"""SentencePiece models in numpy: reading the file, encoding and decoding.

Encoding is a Viterbi search over the pieces that end at each place, for all
words of one length at once.  Under a unigram model a path's score is the sum of
its pieces' scores.  Under a BPE model, where pieces come from merges in order
of score, a path counts only if every two neighbours are what the merges make
of the two alone; exactly one path does, and it is the merges' result: no merge
crosses a border that stays, so neighbours decide for themselves.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np

from .hashing import BASE, INVERSE, U, mix

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the format
UNIGRAM, BPE = 1, 2
PENALTY = 10.0  # of an unknown character below the least score
KNOWN = 300_000  # chunks that a worker keeps for good
PASSING = 200_000  # and for a while
FILTER = 22  # bits of a hash that tell most substrings from pieces
PAIRS = 21  # bits of the table of neighbours that were looked at
CELLS = 1 << 21  # places by piece lengths looked at together


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        x |= (c & 127) << shift
        i, shift = i + 1, shift + 7
        if c < 128:
            return x, i


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialised message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class Pieces(dict):
    """A model; as a dict, from what follows a space to the packed ids of both."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.texts, scores, kinds = [], [], []
        self.kind, self.prefix, squeeze, self.fallback, charsmap = UNIGRAM, True, True, False, b""
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                self.texts.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(fields(value))
                self.kind, self.fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(fields(value))
                charsmap, self.prefix, squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        kinds = np.array(kinds)
        if charsmap or squeeze or not self.prefix or self.kind not in (UNIGRAM, BPE) or (kinds == USER).any():
            raise ValueError("only models that take texts as they are, with a leading space and without pieces of one's own, are read")
        if not self.fallback:
            raise ValueError("only models with byte pieces are read")
        self.passing: list[bytes] = []
        self.byte_ids = np.zeros(256, np.uint32)
        for i in np.flatnonzero(kinds == BYTE).tolist():
            self.byte_ids[int(self.texts[i][3:5], 16)] = i
        plain = [i for i in np.flatnonzero((kinds == NORMAL) | (kinds == UNUSED)).tolist()]
        self._decode_table(kinds)
        # Symbols: the plain pieces, then characters of longer pieces that are none themselves.
        inside = set().union(*(set(self.texts[i]) for i in plain if len(self.texts[i]) > 1))
        if any(SPACE in self.texts[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece holds a space after other characters")
        own = {self.texts[i] for i in plain}
        loose = sorted(inside - own)
        self.symbols = [self.texts[i] for i in plain] + loose
        self.piece = np.array(plain + [-1] * len(loose))
        self.score = np.array([scores[i] for i in plain] + [min(scores[i] for i in plain) - PENALTY] * len(loose), np.float32)
        self.number = {s: k for k, s in enumerate(self.symbols)}
        self.longest = max(map(len, self.symbols))
        keys = self._hash_all(self.symbols)
        order = np.argsort(keys)
        self.hashes, self.by_key = keys[order], order
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        rest = "".join(re.escape(c) for c in sorted(inside - {SPACE}))
        self.unit = re.compile(f"{SPACE}*[{rest}]+|{SPACE}+|.", re.DOTALL)
        self.present = np.zeros(1 << FILTER, bool)
        self.present[(keys >> U(64 - FILTER)).astype(np.int64)] = True
        self.pair_keys, self.pair_good = np.full(1 << PAIRS, -1, np.int64), np.zeros(1 << PAIRS, bool)
        self.word_ids: dict[str, bytes] = {}
        if self.kind == BPE:
            self._merges()

    # Substring hashes

    def _powers(self, base: int, n: int) -> np.ndarray:
        return np.array([pow(base, k, 1 << 64) for k in range(n)], np.uint64)

    def _sums(self, codes: np.ndarray) -> np.ndarray:
        """Running sums of (words, characters), from which substrings' hashes are read."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mix(codes.astype(np.uint64) + U(1)) * self._powers(BASE, codes.shape[1]), axis=1, out=out[:, 1:])
        return out

    def _of_length(self, sums: np.ndarray, n: int) -> np.ndarray:
        """Symbols of all substrings of ``n`` characters by start, -1 for none."""
        with np.errstate(over="ignore"):
            keys = mix((sums[:, n:] - sums[:, :-n]) * self._powers(INVERSE, sums.shape[1] - n) + U(n))
        out = np.full(keys.shape, -1)
        maybe = np.nonzero(self.present[(keys >> U(64 - FILTER)).astype(np.int64)])
        keys = keys[maybe]
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == keys, self.by_key[at], -1)
        return out

    def _hash_all(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.uint64)
        for places, codes in by_length(texts):
            sums = self._sums(codes)
            with np.errstate(over="ignore"):
                out[places] = mix(sums[:, -1] + U(codes.shape[1]))
        return out

    # Merges, for what two neighbours become

    def _merges(self) -> None:
        """All pairs of symbols that merge, and which symbols the merges make of their own characters."""
        left, right, made = [], [], []
        for k, s in enumerate(self.symbols):
            for i in range(1, len(s)):
                a, b = self.number.get(s[:i]), self.number.get(s[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(k)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_made = keys[order], np.array(made)[order]
        # The highest score merges first.
        rank = np.empty(len(self.symbols), np.int64)
        rank[np.argsort(-self.score, kind="stable")] = np.arange(len(self.symbols))
        self.rank = rank
        self.own = np.zeros(len(self.symbols), bool)
        for places, codes in by_length(self.symbols):
            ends = self.merged(codes)
            self.own[places] = (ends[:, 0] == places) & (ends[:, 1:] < 0).all(axis=1)

    def merged(self, codes: np.ndarray) -> np.ndarray:
        """Symbols after all merges, the best and then the leftmost first; -1 fills up."""
        sums = self._sums(codes)
        state = self._of_length(sums, 1)
        if state.shape[1] == 1:
            return state
        rows = np.arange(len(state))
        never = np.iinfo(np.int64).max
        live = state.copy()
        while True:
            keys = live[:, :-1] << 32 | live[:, 1:]
            at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
            can = (self.merge_keys[at] == keys) & (live[:, :-1] >= 0) & (live[:, 1:] >= 0)
            rank = np.where(can, self.rank[self.merge_made[at]], never)
            best = rank.argmin(axis=1)
            go = np.flatnonzero(rank[np.arange(len(live)), best] < never)
            if not len(go):
                state[rows] = live
                return state
            done = np.setdiff1d(np.arange(len(live)), go)
            state[rows[done]] = live[done]
            rows, best, live_at = rows[go], best[go], at[go, best[go]]
            live = live[go]
            shifted = np.concatenate([live[:, 1:], np.full((len(live), 1), -1)], axis=1)
            live = np.where(np.arange(live.shape[1]) > best[:, None], shifted, live)
            live[np.arange(len(live)), best] = self.merge_made[live_at]

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave ``a`` and ``b`` as they are, side by side."""
        keys = a << 32 | b
        slot = (mix(keys.astype(np.uint64)) >> U(64 - PAIRS)).astype(np.int64)
        known = self.pair_keys[slot] == keys
        good = self.pair_good[slot]
        if not known.all():
            missing = np.flatnonzero(~known)
            new, place = np.unique(keys[missing], return_inverse=True)
            found = np.zeros(len(new), bool)
            lefts, rights = new >> 32, new & 0xFFFFFFFF
            texts = [self.symbols[x] + self.symbols[y] for x, y in zip(lefts.tolist(), rights.tolist(), strict=True)]
            for places, codes in by_length(texts):
                ends = self.merged(codes)
                rest = (ends[:, 2:] < 0).all(axis=1) if ends.shape[1] > 2 else True
                found[places] = (ends[:, 0] == lefts[places]) & (ends[:, 1] == rights[places]) & rest
            good[missing] = found[place]
            self.pair_keys[slot[missing]], self.pair_good[slot[missing]] = keys[missing], good[missing]
        return good

    # Viterbi

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols on each word's best path, at the end of a row, and how many; all words have one length."""
        words, length = codes.shape
        most = min(self.longest, length)
        sums = self._sums(codes)
        ending = np.full((most, words, length + 1), -1)  # by length less 1, word, end
        for n in range(1, most + 1):
            ending[n - 1, :, n:] = self._of_length(sums, n)
        best = np.full((words, length + 1), -np.inf, np.float32)  # as the library adds them
        best[:, 0] = 0
        last, back = np.full((words, length + 1), -1), np.zeros((words, length + 1), np.int64)
        every = np.arange(words)
        for j in range(1, length + 1):
            n = min(most, j)
            before = np.arange(j - n, j)  # the longest piece first, which wins ties
            symbol = ending[n - 1 :: -1, :, j].T  # word, start
            open_ = (symbol >= 0) & (best[:, before] > -np.inf)
            if self.kind == BPE:
                row, k = np.nonzero(open_)
                s, p = symbol[row, k], last[row, before[k]]
                good, inner = self.own[s], p >= 0
                good[inner] &= self.neighbours(p[inner], s[inner])
                open_[row[~good], k[~good]] = False
                gain = np.where(open_, np.float32(0), -np.inf)
            else:
                gain = np.where(open_, best[:, before] + self.score[symbol], -np.inf)
            chosen = gain.argmax(axis=1)
            best[:, j], back[:, j], last[:, j] = gain[every, chosen], j - before[chosen], np.where(np.isneginf(gain[every, chosen]), -1, symbol[every, chosen])
        path, end, place = np.full((words, length), -1), np.full(words, length), length
        while (end > 0).any():
            place -= 1
            row = np.flatnonzero(end > 0)
            if np.isneginf(best[row, end[row]]).any():
                raise AssertionError("a word without a path")
            path[row, place] = last[row, end[row]]
            end[row] -= back[row, end[row]]
        # all paths end in the last column, so a shorter one starts later
        return path, (path >= 0).sum(axis=1)

    def units(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of each word (characters of pieces, maybe after spaces) or single other character."""
        out, todo = {}, []
        for w in words:
            if len(w) > 1 or w in self.number:
                todo.append(w)
            else:
                out[w] = self.as_bytes(w)
        for places, codes in by_length(todo):
            step = max(1, CELLS // (min(self.longest, codes.shape[1]) * (codes.shape[1] + 1)))
            for a in range(0, len(places), step):
                path, n = self.viterbi(codes[a : a + step])
                ids = self.piece[path]
                whole = ((ids >= 0) | (path < 0)).all(axis=1).tolist()
                width = 4 * path.shape[1]
                packed = ids.astype("<u4").tobytes()
                for r, (place, k) in enumerate(zip(places[a : a + step].tolist(), n.tolist(), strict=True)):
                    if whole[r]:
                        out[todo[place]] = packed[(r + 1) * width - 4 * k : (r + 1) * width]
                    else:  # characters that are no pieces become bytes
                        row = [(int(i), int(s)) for i, s in zip(ids[r], path[r], strict=True) if s >= 0]
                        out[todo[place]] = b"".join([np.array([i], "<u4").tobytes() if i >= 0 else self.as_bytes(self.symbols[s]) for i, s in row])
        return out

    def as_bytes(self, text: str) -> bytes:
        return self.byte_ids[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].astype("<u4").tobytes()

    # Texts

    @staticmethod
    def chunks(text: bytes) -> list[bytes]:
        """A text cut before spaces, without one space at each cut and the one put in front."""
        if not text:
            return []
        if b"  " not in text and text[0] != 32 and text[-1] != 32:
            return text.split(b" ")
        return [c[1:] for c in CHUNK.findall(b" " + text)]

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.passing) > PASSING:
            for c in self.passing:
                del self[c]
            self.passing.clear()
        new = list(chunks.difference(self.keys()))
        self.passing += new[max(0, KNOWN - len(self)) :]
        found = [self.unit.findall(SPACE + c.decode("utf-8", "replace").replace(" ", SPACE)) for c in new]
        known = self.word_ids
        ids = self.units([w for w in set().union(*found) if w not in known])
        if len(known) < KNOWN:
            known.update(ids)
        get = lambda w: ids.get(w) or known[w]
        for c, parts in zip(new, found, strict=True):
            self[c] = get(parts[0]) if len(parts) == 1 else b"".join([get(p) for p in parts])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit values."""
        split = [self.chunks(t) for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.__getitem__, s)) for s in split]

    def _decode_table(self, kinds: np.ndarray) -> None:
        surface = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.replace(SPACE, " ").encode() for t, k in zip(self.texts, kinds.tolist(), strict=True)]
        self.size = np.array([len(s) for s in surface])
        self.start = np.cumsum(self.size) - self.size
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, as UTF-8; bytes that are none become U+FFFD."""
        size = self.size[ids]
        ends = np.cumsum(size)
        places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)
        text = self.surface[places].tobytes().removeprefix(b" ")
        return text.decode("utf-8", "replace").encode()


CHUNK = re.compile(rb" +[^ ]+| +")


def by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and characters (a row each) of the texts of each length."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for places in np.split(order, cuts) if len(order) else []:
        n = int(sizes[places[0]])
        if n:
            joined = "".join([texts[p] for p in places.tolist()]).encode("utf-32-le", "surrogatepass")
            yield places, np.frombuffer(joined, "<u4").reshape(len(places), n)


@functools.cache
def load(path: str) -> Pieces:
    return Pieces(path)


def forget() -> None:
    """Give back what the models hold, for a worker that goes on with something else."""
    load.cache_clear()
