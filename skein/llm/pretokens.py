"""Pre-tokens of many texts at once, and the ids of pre-tokens through a bounded cache.

The split is the one of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``: runs of letters, numbers, white space and the rest,
where one space goes to the run behind it and a contraction takes its apostrophe. The array
form finds the same pieces from character classes. As merges never cross a piece, a library
needs to see each different piece only once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np

from skein.llm.wordspans import mix

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
#: Characters with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

JOINED = 256  # pieces in one call's text

_BASE = 0x9E3779B97F4A7C15
_STATE: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    if "classes" not in _STATE:
        kinds = {"L": LETTER, "N": NUMBER}
        category = unicodedata.category
        table = np.fromiter(
            (kinds.get(category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000
        )
        table[list(WHITE_SPACE)] = SPACE
        _STATE["classes"] = table
    return _STATE["classes"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_STATE.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            steps[0] = 1
            _STATE[name] = np.cumprod(steps, dtype=np.uint64)
    return _STATE["up"], _STATE["down"]


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, their code points, and where each text begins (last: the end)."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return joined, points, np.cumsum([0, *map(len, texts)])


def piece_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin; texts are cut at ``bounds``."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _classes()[points]
    head = np.zeros(n + 1, dtype=bool)  # a text begins (or all end) here
    head[bounds] = True
    edge = head[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    begin = edge.copy()
    at = np.flatnonzero(edge)  # runs
    end = np.append(at[1:], n)
    space = kind[at] == SPACE
    inner = space & ~head[end]  # white space with something behind it in its text
    last = end[inner] - 1
    begin[last] = True
    gives = points[last] == 0x20
    begin[last[gives] + 1] = False  # the space goes to the run behind it
    taken = np.zeros(n + 1, dtype=bool)
    taken[last[gives] + 1] = True
    quote = at[(end - at == 1) & (points[at] == 0x27) & ~taken[at] & ~head[end]]
    if len(quote):
        padded = np.append(points, [0, 0])
        one, two = padded[quote + 1], padded[quote + 2]
        two_in = ~head[np.minimum(quote + 2, n)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        long = np.zeros(len(quote), dtype=bool)
        for a, b in pairs:
            long |= (one == a) & (two == b) & two_in
        for which, size in ((short, 2), (long & ~short, 3)):
            begin[quote[which] + 1] = False
            after = quote[which] + size
            begin[after[after < n]] = True
    return np.flatnonzero(begin)


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids in a row, and the size of each."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(sizes.sum())), sizes


class LibraryPieces:
    """Ids of pieces by a byte-level tokenizer of the library, many pieces in one call.

    Pieces are joined by line ends, which the pattern splits off as pieces of their own; only
    they give the line end's id. Pieces of white space are given one by one.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        end = self._lists(["\n"])[0]
        self.line_end = end[0] if len(end) == 1 else None

    def _lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``pieces`` hold no white space but one space in front."""
        texts = ["\n".join([*pieces[i : i + JOINED], ""]) for i in range(0, len(pieces), JOINED)]
        ids, _ = flattened(self._lists(texts))
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) != len(pieces):
            return flattened(self._lists(pieces))
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.line_end is None:
            return flattened(self._lists(pieces))
        alone = np.fromiter(map(str.isspace, pieces), dtype=bool, count=len(pieces))
        if not alone.any():
            return self._joined(pieces)
        first, sizes = self._joined(list(compress(pieces, ~alone)))
        second, own = flattened(self._lists(list(compress(pieces, alone))))
        order = np.argsort(np.append(np.flatnonzero(~alone), np.flatnonzero(alone)))
        sizes = np.append(sizes, own)
        return spread(np.append(first, second), (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]


class _Places:
    """Numbers of 64-bit keys in a hash table of arrays; -1 for unknown keys."""

    def __init__(self):
        self._empty(16)

    def _empty(self, bits: int) -> None:
        self.bits, self.held = bits, 0
        self.keys = np.zeros(1 << bits, dtype=np.uint64)  # 0: free
        self.numbers = np.full(1 << bits, -1, dtype=np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """``keys`` are not 0."""
        at = self._home(keys)
        there = self.keys[at]
        out = self.numbers[at]
        open_ = np.flatnonzero(there != keys)
        out[open_] = -1
        open_ = open_[there[open_] != 0]
        at = at[open_]
        while len(open_):
            at = at + 1 & (1 << self.bits) - 1
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.numbers[at[hit]]
            on = ~hit & (there != 0)
            open_, at = open_[on], at[on]
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """``keys`` differ, are new and not 0."""
        if 2 * (self.held + len(keys)) > 1 << self.bits:
            used = self.keys != 0
            keys, numbers = np.append(self.keys[used], keys), np.append(self.numbers[used], numbers)
            self._empty((2 * len(keys)).bit_length())
        self.held += len(keys)
        at = self._home(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = keys[free]  # of several for one place, one stays
            self.numbers[at[free]] = numbers[free]
            left = self.keys[at] != keys
            keys, numbers, at = keys[left], numbers[left], at[left] + 1 & (1 << self.bits) - 1


class PieceIds:
    """Ids of pieces; ``encode`` maps unseen piece strings to ids in a row and sizes.

    Holds at most ``limit`` pieces, or those of one call. When they are full, pieces that were
    met again since they came stay, if they fill less than half.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1 << 20):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self._hold(*(np.zeros(0, dtype=t) for t in (np.uint64, np.uint32, np.int64)))

    def _hold(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.places = _Places()
        self.places.add(keys, np.arange(len(keys), dtype=np.int32))
        self.keys, self.flat, self.sizes = keys, flat, sizes
        self.offsets = np.cumsum(sizes) - sizes
        self.again = np.zeros(len(keys), dtype=bool)

    def _room(self, n: int) -> None:
        """Make room for ``n`` pieces."""
        if len(self.keys) + n <= self.limit:
            return
        stay = np.flatnonzero(self.again)
        if 2 * len(stay) > self.limit or len(stay) + n > self.limit:
            stay = stay[:0]
        self._hold(self.keys[stay], spread(self.flat, self.offsets[stay], self.sizes[stay]), self.sizes[stay])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin (last: the end)."""
        joined, points, bounds = code_points(texts)
        begin = piece_starts(points, bounds)
        if not len(begin):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(bounds), dtype=np.int64)
        cuts = np.append(begin, len(points))
        up, down = _powers(len(points) + 1)
        total = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((points + np.uint64(1)) * up[: len(points)], out=total[1:])
        keys = mix(np.diff(total[cuts]) * down[begin] + np.diff(cuts).astype(np.uint64))
        keys[keys == 0] = 1
        slot = self.places.find(keys)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            unique, sample, inverse = np.unique(keys[missing], return_index=True, return_inverse=True)
            if len(self.keys) + len(unique) > self.limit:
                self.again[slot[slot >= 0]] = True
                self._room(len(unique))
                slot = self.places.find(keys)
                missing = np.flatnonzero(slot < 0)
                unique, sample, inverse = np.unique(keys[missing], return_index=True, return_inverse=True)
            where = missing[sample]
            flat, sizes = self.encode([joined[a:b] for a, b in zip(begin[where].tolist(), cuts[where + 1].tolist(), strict=True)])
            base = len(self.keys)
            numbers = np.arange(base, base + len(unique), dtype=np.int32)
            self.places.add(unique, numbers)
            self.offsets = np.append(self.offsets, len(self.flat) + np.cumsum(sizes) - sizes)
            self.sizes, self.keys = np.append(self.sizes, sizes), np.append(self.keys, unique)
            self.flat = np.append(self.flat, flat)
            self.again = np.append(self.again, np.zeros(len(unique), dtype=bool))
            self.again[slot[slot >= 0]] = True
            slot[missing] = numbers[inverse]
        else:
            self.again[slot] = True
        sizes = self.sizes[slot]
        ends = np.append(0, np.cumsum(sizes))
        return spread(self.flat, self.offsets[slot], sizes), ends[np.searchsorted(begin, bounds)]


def spread(flat: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[o : o + n]`` of every offset and size, in a row."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(offsets - (ends - sizes), sizes) + np.arange(total)]


def slices(sizes, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` in all, or one larger row."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)
