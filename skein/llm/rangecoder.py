"""Adaptive context-mixing range coder for blocks of token ids.

A block is coded on its own: its model starts empty and its bytes end in a checksum. The ids
of a block are cut into lanes of equal length that advance in step, so that one array
operation codes one id of every lane; all lanes feed and use one model.

The model predicts the next id from the last two ids (order 2), from the last id (order 1)
and from counts of all ids so far (order 0). Which of the three to trust is learned for
each pair of confidences of the order-2 and order-1 predictions: the weights are the
adaptive shares of "order 2 was right", "order 1 was right", "neither". The id is coded as
that outcome and, for "neither", by its order-0 share of the outcome's share. Shares drive a
carry-less range coder with 64-bit state and 16-bit output words, one stream per lane.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

MAGIC = b"ctxS"
_HEAD = "<4sIIQII"  # magic, vocabulary, documents, ids, lanes, words
LANE_STEPS, MOST_LANES = 256, 4096
CONTEXT_BITS = 18
OUTCOME_BITS, ID_BITS = 12, 24
BITS = np.uint64(OUTCOME_BITS + ID_BITS)
LEAST = np.uint64(1 << 42)  # the range never stays below this
_TOP, _WORD, _FULL = np.uint64(48), np.uint64(16), np.uint64((1 << 64) - 1)
_RUN = 8  # bits
_CONF = 8  # levels of confidence, three bits
#: Change of a confidence after a miss (first eight) and after a hit.
_CHANGE = np.array([-((c + 1) >> 1) for c in range(_CONF)] + [int(c < _CONF - 1) for c in range(_CONF)], dtype=np.int32)


def lanes_of(n: int) -> int:
    return max(1, min(MOST_LANES, n // LANE_STEPS))


def _lane_sizes(n: int, lanes: int) -> np.ndarray:
    """Longer lanes first, so that the lanes still running are always the first ones."""
    short, longer = divmod(n, lanes)
    return short + (np.arange(lanes) < longer).astype(np.int64)


class _Model:
    """Predictions and weights; coder and decoder change it in the same way."""

    def __init__(self, vocabulary: int, lanes: int):
        self.size = vocabulary
        # A slot holds the predicted id and the confidence in one number: id * _CONF + confidence.
        self.near = np.full(vocabulary, -_CONF, dtype=np.int32)
        self.far = np.full(1 << CONTEXT_BITS, -_CONF, dtype=np.int32)
        self.outcomes = np.ones((_CONF * _CONF, 3), dtype=np.int64)
        self.counts = np.zeros(vocabulary, dtype=np.int64)
        self.fresh: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.last = np.zeros(lanes, dtype=np.int32)
        self.before = np.zeros(lanes, dtype=np.uint32)  # hashes of the last ids but one
        self.steps = 0

    def _shares(self) -> None:
        if self.contexts:
            seen = np.bincount(np.concatenate(self.contexts), minlength=_CONF * _CONF * 3)
            self.outcomes += 2 * seen.reshape(-1, 3)
            self.contexts = []
            if self.outcomes.max() > 1 << 20:
                self.outcomes = (self.outcomes + 1) >> 1
        total = self.outcomes.sum(axis=1, keepdims=True)
        shares = 1 + self.outcomes * ((1 << OUTCOME_BITS) - 3) // total
        shares[:, 2] += (1 << OUTCOME_BITS) - shares.sum(axis=1)
        below = (np.cumsum(shares, axis=1) - shares).astype(np.uint64)
        shares = shares.astype(np.uint64)
        self.rest_share = shares[:, 2].copy()
        # Shares and lower bounds of all bits: outcome and id.
        below <<= np.uint64(ID_BITS)
        self.from_near, self.from_rest = below[:, 1].copy(), below[:, 2].copy()
        self.outcome_share, self.outcome_below = (shares << np.uint64(ID_BITS)).ravel(), below.ravel()

    def _id_shares(self) -> None:
        if self.fresh:
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=self.size)
            self.fresh = []
        total = max(1, int(self.counts.sum()))
        shares = 1 + self.counts * ((1 << ID_BITS) - self.size) // total
        shares[int(self.counts.argmax())] += (1 << ID_BITS) - int(shares.sum())
        self.id_share = shares.astype(np.uint32)
        ends = np.cumsum(shares)
        self.id_below, self.id_end = (ends - shares).astype(np.uint32), ends.astype(np.uint32)
        self.first = None

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids in whose order-0 shares the values lie."""
        if self.first is None:  # the id at the begin of every run of 2^_RUN values
            runs = (self.id_below + np.uint32((1 << _RUN) - 1)) >> np.uint32(_RUN)
            self.first = np.cumsum(np.bincount(runs, minlength=1 << (ID_BITS - _RUN))) - 1
        found = self.first.take(value >> np.uint32(_RUN))
        late = np.flatnonzero(self.id_end.take(found) <= value)
        for _ in range(2):
            found[late] += 1
            late = late[self.id_end.take(found.take(late)) <= value.take(late)]
        found[late] = np.searchsorted(self.id_below, value.take(late), side="right") - 1
        return found

    def look(self, running: int) -> None:
        """Predictions for the next id of the first ``running`` lanes."""
        step = self.steps
        if step < 16 or step % 8 == 0:
            self._shares()
        if step & (step - 1) == 0 or step % 64 == 0:
            self._id_shares()
        near = self.last[:running]
        self.hashed = near.view(np.uint32) * np.uint32(0x9E3779B1)
        self.at_near = near.astype(np.intp)
        self.at_far = ((self.hashed + self.before[:running]) >> np.uint32(32 - CONTEXT_BITS)).astype(np.intp)
        self.slot_far, self.slot_near = self.far.take(self.at_far), self.near.take(self.at_near)
        self.guess_far, self.guess_near = self.slot_far >> 3, self.slot_near >> 3
        self.conf_far, self.conf_near = self.slot_far & 7, self.slot_near & 7
        differ = self.guess_far != self.guess_near
        self.context = ((self.conf_far << 3) + self.conf_near * differ).astype(np.intp)

    def learn(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        renewed = (ids << 3) + 1
        for table, at, slot, guess, conf in (
            (self.far, self.at_far, self.slot_far, self.guess_far, self.conf_far),
            (self.near, self.at_near, self.slot_near, self.guess_near, self.conf_near),
        ):
            hit = guess == ids
            slot += _CHANGE.take(conf + (hit << 3))
            np.copyto(slot, renewed, where=~hit & (conf <= 1))
            table[at] = slot
        self.contexts.append(self.context * 3 + outcome)
        self.fresh.append(ids)
        running = len(ids)
        np.multiply(self.hashed, np.uint32(0x85EBCA6B), out=self.before[:running])
        self.last[:running] = ids
        self.steps += 1


class _Range:
    """State of the coder and of the decoder: bounds of every lane."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, dtype=np.uint64)
        self.range = np.full(lanes, _FULL, dtype=np.uint64)

    def narrow(self, running: int) -> np.ndarray:
        """The part of a lane's range that belongs to one unit of all bits."""
        return self.range[:running] >> BITS

    def settle(self, running: int, moved: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Move words out while ranges are small; ``moved`` gets lanes and their lower bounds."""
        at = np.flatnonzero(self.range[:running] < LEAST)
        low, width = self.low.take(at), self.range.take(at)
        while len(at):
            split = np.flatnonzero((low ^ (low + width - np.uint64(1))) >> _TOP)
            if len(split):
                room = np.uint64(1 << 48) - (low[split] & np.uint64((1 << 48) - 1))
                width[split] = np.minimum(width[split], room)
            moved(at, low)
            low <<= _WORD
            width <<= _WORD
            self.low[at], self.range[at] = low, width
            small = np.flatnonzero(width < LEAST)
            at, low, width = at.take(small), low.take(small), width.take(small)


class _Coder(_Range):
    def __init__(self, lanes: int):
        super().__init__(lanes)
        self.lanes_out: list[np.ndarray] = []
        self.words_out: list[np.ndarray] = []

    def _push(self, at: np.ndarray, low: np.ndarray) -> None:
        self.lanes_out.append(at.astype(np.uint16))
        self.words_out.append((low >> _TOP).astype(np.uint16))

    def put(self, below: np.ndarray, share: np.ndarray) -> None:
        running = len(below)
        part = self.narrow(running)
        self.low[:running] += below * part
        np.multiply(share, part, out=self.range[:running])
        self.settle(running, self._push)

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of all lanes, lane after lane, and the number of words of each lane."""
        lanes = len(self.low)
        value = self.low + np.uint64((1 << 32) - 1)  # a number inside the range whose lower half is not needed
        every = np.arange(lanes, dtype=np.uint16)
        for shift in (48, 32):
            self.lanes_out.append(every)
            self.words_out.append((value >> np.uint64(shift)).astype(np.uint16))
        lane, words = np.concatenate(self.lanes_out), np.concatenate(self.words_out)
        return words[np.argsort(lane, kind="stable")], np.bincount(lane, minlength=lanes)


class _Decoder(_Range):
    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        super().__init__(len(sizes))
        self.words = np.append(words, np.zeros(1, dtype=np.uint16)).astype(np.uint64)  # behind the end: 0
        self.ends = np.cumsum(sizes)
        self.next = self.ends - sizes
        self.inside = np.zeros(len(sizes), dtype=np.uint64)  # the code's distance from the lower bound
        every = np.arange(len(sizes))
        for _ in range(4):
            self._pull(every, self.low)

    def _pull(self, at: np.ndarray, low: np.ndarray) -> None:
        here = self.next.take(at)
        word = self.words.take(np.where(here < self.ends.take(at), here, len(self.words) - 1))
        self.inside[at] = self.inside.take(at) << _WORD | word
        self.next[at] = here + 1

    def take(self, below: np.ndarray, share: np.ndarray, part: np.ndarray) -> None:
        running = len(part)
        below = below * part
        self.low[:running] += below
        self.inside[:running] -= below
        np.multiply(share, part, out=self.range[:running])
        self.settle(running, self._pull)


def _code(ids: np.ndarray, vocabulary: int, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = _lane_sizes(len(ids), lanes)
    rows = _rows(ids.astype(np.int32), sizes)
    model, coder = _Model(vocabulary, lanes), _Coder(lanes)
    for now in rows:
        model.look(len(now))
        outcome = np.where(now == model.guess_far, 0, np.where(now == model.guess_near, 1, 2))
        at = model.context * 3 + outcome
        below, share = model.outcome_below.take(at), model.outcome_share.take(at)
        rest = np.flatnonzero(outcome == 2)
        found, part = now.take(rest), model.rest_share.take(model.context.take(rest))
        below[rest] += part * model.id_below.take(found)
        share[rest] = part * model.id_share.take(found)
        coder.put(below, share)
        model.learn(now, outcome)
    return coder.finish()


def _rows(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The ids of all running lanes at each step."""
    lanes, short = len(sizes), int(sizes[-1])
    longer = int(np.count_nonzero(sizes > short))
    cut = longer * (short + 1)
    first = ids[:cut].reshape(longer, short + 1)
    table = np.concatenate([first[:, :short], ids[cut:].reshape(lanes - longer, short)]).T
    return [*np.ascontiguousarray(table), *([first[:, short].copy()] if longer else [])]


def _lanes(rows: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The ids of all lanes, lane after lane."""
    short = int(sizes[-1])
    table = np.array(rows[:short], dtype=np.int32).reshape(short, len(sizes)).T
    if len(rows) == short:
        return table.reshape(-1)
    longer = len(rows[-1])
    return np.concatenate([np.column_stack([table[:longer], rows[-1]]).reshape(-1), table[longer:].reshape(-1)])


def _decode(n: int, vocabulary: int, words: np.ndarray, sizes_out: np.ndarray) -> np.ndarray:
    lanes = len(sizes_out)
    sizes = _lane_sizes(n, lanes)
    model, coder = _Model(vocabulary, lanes), _Decoder(words, sizes_out)
    rows = []
    for step in range(int(sizes[0])):
        running = lanes if step < sizes[-1] else int(np.count_nonzero(sizes > step))
        model.look(running)
        part, inside = coder.narrow(running), coder.inside[:running]
        outcome = (inside >= model.from_near.take(model.context) * part).astype(np.intp)
        outcome += inside >= model.from_rest.take(model.context) * part
        at = model.context * 3 + outcome
        below, share = model.outcome_below.take(at), model.outcome_share.take(at)
        now = np.where(outcome == 0, model.guess_far, model.guess_near)
        rest = np.flatnonzero(outcome == 2)
        unit, own = part.take(rest), model.rest_share.take(model.context.take(rest))
        value = (inside.take(rest) - below.take(rest) * unit) // (own * unit)
        value = np.minimum(value, np.uint64((1 << ID_BITS) - 1)).astype(np.uint32)
        found = model.find(value)
        now[rest] = found
        below[rest] += own * model.id_below.take(found)
        share[rest] = own * model.id_share.take(found)
        coder.take(below, share, part)
        model.learn(now, outcome)
        rows.append(now)
    return _lanes(rows, sizes).astype(np.int64)


def pack_block(keys: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    """Bytes of a block: header, document keys, known-key flags, sizes, lane sizes, words, checksum."""
    if vocabulary >= 1 << (ID_BITS - 1):
        raise ValueError("the vocabulary is too large for the order-0 shares")
    if len(ids) and (ids.min() < 0 or ids.max() >= vocabulary):
        raise ValueError("an id lies outside the vocabulary")
    lanes = lanes_of(len(ids)) if len(ids) else 0
    words, lane_words = _code(ids.astype(np.int64), vocabulary, lanes) if lanes else (np.zeros(0), np.zeros(0))
    body = b"".join(
        [
            struct.pack(_HEAD, MAGIC, vocabulary, len(keys), len(ids), lanes, len(words)),
            keys.astype("<i8").tobytes(),
            known.astype("u1").tobytes(),
            sizes.astype("<u8").tobytes(),
            lane_words.astype("<u4").tobytes(),
            words.astype("<u2").tobytes(),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document keys, known-key flags, sizes and ids; an error if the bytes are not as written."""
    body = memoryview(block)[:-4]
    if len(block) < struct.calcsize(_HEAD) + 4 or zlib.crc32(body) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a token block is damaged")
    magic, vocabulary, n_docs, n_ids, lanes, n_words = struct.unpack_from(_HEAD, body)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at, parts = struct.calcsize(_HEAD), []
    for kind, count in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u4", lanes), ("<u2", n_words)):
        parts.append(np.frombuffer(body, dtype=kind, count=count, offset=at))
        at += parts[-1].nbytes
    keys, known, sizes, lane_words, words = parts
    ids = _decode(n_ids, vocabulary, words, lane_words.astype(np.int64)) if n_ids else np.zeros(0, dtype=np.int64)
    return keys, known.astype(bool), sizes.astype(np.int64), ids
