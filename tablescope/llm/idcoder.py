"""Adaptive context-mixing range coder for blocks of token ids.

Three orders predict the next id: the id that last followed the same two ids, the
one that last followed the same id, and how often ids of each size came so far.
The first two name one id each; how much of the interval each of the three gets is
learned for every pair of their confidences. A range coder then narrows its
interval to the part that holds the id.

Blocks start from nothing and know nothing of each other, so they are coded side by
side: one numpy step advances every block by one id. All arithmetic is on integers,
hence the same on every machine.

A block is its ids' count and crc32 (of the little-endian 32-bit ids) and 16-bit units.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block.
BLOCK = 4096
#: Ids are below 2 ** (SIZES - 1); an id's size is its number of bits.
SIZES = 19
#: Slots of a block's tables for orders 1 and 2.
_SLOTS = 1024
_BITS = 14  # of the probability that an order is right
_ONE = 1 << _BITS
_SURE = 3  # highest confidence
_SIZE_BITS = 12  # of the probability of a size
_REVIEW = 32  # ids after which order 0's probabilities follow its counts
_LOW, _UNIT = np.uint64(32), np.uint64(16)
_MASK32 = np.uint64(0xFFFFFFFF)
_UNIT32, _MASK16 = np.uint32(16), np.uint32(0xFFFF)
_SIZE_OF = np.repeat(np.arange(SIZES, dtype=np.uint8), [1, *(1 << np.arange(SIZES - 1))])


class Predictor:
    """What each block has seen; blocks are rows, and those still running come first."""

    def __init__(self, blocks: int):
        self.last, self.before = np.zeros(blocks, np.int32), np.zeros(blocks, np.int32)
        self.base = np.arange(blocks) * _SLOTS
        # a slot is the id named times four, plus the confidence in it; ids named at first do not exist
        self.slots = [np.full(blocks * _SLOTS, (1 << SIZES) * 4, np.int32) for _ in range(2)]
        pairs = 2 * (_SURE + 1) ** 2
        self.pairs = np.arange(blocks) * pairs
        #: for each pair of confidences: whether order 2 is right, and whether order 1 is if order 2 is not
        self.right = [np.full(blocks * pairs, _ONE // 8, np.int32) for _ in range(2)]
        self.counts = np.ones((blocks, SIZES), np.int32)
        self.review()

    def review(self) -> None:
        """Order 0's interval ends, by size, from its counts."""
        total = np.cumsum(self.counts, axis=1)
        room = (1 << _SIZE_BITS) - SIZES
        self.ends = np.zeros((len(total), SIZES + 1), np.int32)
        self.ends[:, 1:] = total * room // total[:, -1:] + np.arange(1, SIZES + 1)
        self.ends[:, -1] = 1 << _SIZE_BITS
        self.by_size = np.ascontiguousarray(self.ends.T, np.int16)

    def predict(self, n: int) -> tuple[np.ndarray, ...]:
        """Order 2's and order 1's id, and the ends of their parts of the interval, for the first ``n`` blocks."""
        one = (self.last[:n] * 40503) & 0xFFFFFF
        two = (one + self.before[:n] * 2741) & 0xFFFFFF
        self.at = (self.base[:n] + (two >> 7 & (_SLOTS - 1)), self.base[:n] + (one >> 6 & (_SLOTS - 1)))
        self.now = two, one = self.slots[0].take(self.at[0]), self.slots[1].take(self.at[1])
        id_two, id_one = two >> 2, one >> 2
        self.pair = self.pairs[:n] + (((id_two == id_one) * 4 + (two & 3)) * 4 + (one & 3))
        self.chance = self.right[0].take(self.pair), self.right[1].take(self.pair)
        end_two = 1 + (self.chance[0] * (_ONE - 64) >> _BITS)
        end_one = end_two + 1 + ((_ONE - 64 - end_two) * self.chance[1] >> _BITS)
        return id_two, id_one, end_two, end_one

    def learn(self, n: int, ids: np.ndarray, by_two: np.ndarray, by_one: np.ndarray, missed: np.ndarray, sizes: np.ndarray) -> None:
        fresh = ids << 2
        sure = fresh | _SURE
        for at, slots, slot in zip(self.at, self.slots, self.now):
            slots[at] = np.where(slot ^ fresh <= _SURE, np.minimum(slot + 1, sure), np.where(slot & 3, slot - 1, fresh))
        two, one = self.chance
        self.right[0][self.pair] = two + ((by_two * (_ONE - 1) - two) >> 5)
        self.right[1][self.pair] = np.where(by_two, one, one + ((by_one * (_ONE - 1) - one) >> 5))
        at = missed * SIZES + sizes
        counts = self.counts.ravel()
        counts[at] = counts.take(at) + 1
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


def _running(lengths: np.ndarray, steps: int) -> list[int]:
    """Of blocks from the longest down, how many still run at each step."""
    return np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The 16-bit units (little-endian) of each block of up to ``BLOCK`` ids."""
    if not blocks:
        return []
    lengths = np.array([len(b) for b in blocks])
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max())
    table = np.zeros((steps, len(blocks)), np.int32)
    for row, k in enumerate(order.tolist()):
        table[:lengths[k], row] = blocks[k]
    if steps and not 0 <= table.min() <= table.max() < 1 << (SIZES - 1):
        raise ValueError(f"ids must be below {1 << (SIZES - 1)}")
    running = _running(lengths[order], steps)
    model = Predictor(len(blocks))
    low, width = np.zeros(len(blocks), np.uint64), np.full(len(blocks), 1 << 48, np.uint64)
    # a unit may hold a carry into the one before, in its 17th bit, until the end
    out, used = np.zeros((len(blocks), 3 * steps + 8), np.uint32), np.zeros(len(blocks), np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def put(rows: np.ndarray) -> None:
        at = low.take(rows)
        waiting.append((rows.astype(np.int32), (at >> _LOW).astype(np.uint32)))
        low[rows] = (at & _MASK32) << _UNIT

    def place() -> None:
        """The units that wait, into their blocks."""
        rows, values = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        order = np.argsort(rows, kind="stable")
        times = np.bincount(rows, minlength=len(blocks))
        begins = used - (np.cumsum(times) - times)
        out[rows[order], np.arange(len(rows)) + np.repeat(begins, times)] = values[order]
        used[:] += times

    def narrow(rows: np.ndarray) -> None:
        """Write units of ``rows``, whose interval has become small."""
        while len(rows):
            put(rows)
            wide = width.take(rows) << _UNIT
            width[rows] = wide
            rows = rows[wide >> _LOW == 0]

    every = np.arange(len(blocks))
    for t in range(steps):
        if t % _REVIEW == 0:
            model.review()
        n = running[t]
        ids = table[t, :n]
        two, one, end_two, end_one = model.predict(n)
        by_two = ids == two
        by_one = (ids == one) & ~by_two
        start = np.where(by_two, 0, np.where(by_one, end_two, end_one))
        stop = np.where(by_two, end_two, np.where(by_one, end_one, _ONE))
        step = width[:n] >> np.uint64(_BITS)
        low[:n] += step * start.astype(np.uint64)
        width[:n] = step * (stop - start).astype(np.uint64)
        missed = np.flatnonzero(~(by_two | by_one))
        narrow(np.flatnonzero(width[:n] >> _LOW == 0))
        new = ids.take(missed)
        sizes = _SIZE_OF.take(new)
        at = missed * (SIZES + 1) + sizes
        ends = model.ends.ravel()
        first = ends.take(at)
        step = width.take(missed) >> np.uint64(_SIZE_BITS)
        begin = low.take(missed) + step * first.astype(np.uint64)
        step *= (ends.take(at + 1) - first).astype(np.uint64)
        bits = np.maximum(sizes, 1) - 1
        step >>= bits.astype(np.uint64)
        low[missed] = begin + step * (new & ((1 << bits.astype(np.int32)) - 1)).astype(np.uint64)
        width[missed] = step
        narrow(missed[step >> _LOW == 0])
        model.learn(n, ids, by_two, by_one, missed, sizes)
        if t % _REVIEW == _REVIEW - 1 and waiting:
            place()
    for _ in range(3):
        put(every)
    place()
    result: list[bytes] = [b""] * len(blocks)
    for row, k in enumerate(order.tolist()):
        units = out[row, :used[row]]
        while (over := units >> _UNIT32).any():
            units &= _MASK16
            units[:-1] += over[1:]
        result[k] = units.astype("<u2").tobytes()
    return result


def decode(units: list[bytes], lengths) -> list[np.ndarray]:
    """The ids of each block, given the blocks' numbers of ids."""
    if not units:
        return []
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    written = np.array([len(u) // 2 for u in units])
    data = np.zeros((len(units), int(written.max()) + 4), np.uint16)
    for row, k in enumerate(order.tolist()):
        data[row, :written[k]] = np.frombuffer(units[k], "<u2")
    steps = int(lengths.max())
    running = _running(lengths[order], steps)
    model = Predictor(len(units))
    width = np.full(len(units), 1 << 48, np.uint64)
    code = (data[:, 0].astype(np.uint64) << _LOW) | (data[:, 1].astype(np.uint64) << _UNIT) | data[:, 2]
    used = np.full(len(units), 3)
    table = np.zeros((steps, len(units)), np.int32)
    last, every, flat = data.shape[1] - 1, np.arange(len(units)) * data.shape[1], data.ravel()

    def narrow(rows: np.ndarray) -> None:
        while len(rows):
            at = used.take(rows)
            code[rows] = (code.take(rows) << _UNIT) | flat.take(every.take(rows) + np.minimum(at, last))
            used[rows] = at + 1
            wide = width.take(rows) << _UNIT
            width[rows] = wide
            rows = rows[wide >> _LOW == 0]

    for t in range(steps):
        if t % _REVIEW == 0:
            model.review()
        n = running[t]
        two, one, end_two, end_one = model.predict(n)
        step = width[:n] >> np.uint64(_BITS)
        place = np.minimum(code[:n] // step, np.uint64(_ONE - 1)).astype(np.int32)
        by_two = place < end_two
        by_one = (place < end_one) & ~by_two
        ids = np.where(by_two, two, one)
        start = np.where(by_two, 0, np.where(by_one, end_two, end_one))
        stop = np.where(by_two, end_two, np.where(by_one, end_one, _ONE))
        code[:n] -= step * start.astype(np.uint64)
        width[:n] = step * (stop - start).astype(np.uint64)
        missed = np.flatnonzero(place >= end_one)
        narrow(np.flatnonzero(width[:n] >> _LOW == 0))
        step = width.take(missed) >> np.uint64(_SIZE_BITS)
        at = code.take(missed)
        place = np.zeros(n, np.int16)
        place[missed] = np.minimum(at // step, np.uint64((1 << _SIZE_BITS) - 1))
        sizes = (model.by_size[:, :n] <= place).sum(axis=0, dtype=np.uint8).take(missed) - np.uint8(1)
        where, ends = missed * (SIZES + 1) + sizes, model.ends.ravel()
        first = ends.take(where)
        at -= step * first.astype(np.uint64)
        step *= (ends.take(where + 1) - first).astype(np.uint64)
        bits = (np.maximum(sizes, 1) - 1).astype(np.int32)
        step >>= bits.astype(np.uint64)
        rest = np.minimum(at // step, ((1 << bits) - 1).astype(np.uint64))
        code[missed] = at - step * rest
        width[missed] = step
        ids[missed] = np.where(sizes > 0, rest.astype(np.int32) + (1 << bits), 0)
        narrow(missed[step >> _LOW == 0])
        table[t, :n] = ids
        model.learn(n, ids, by_two, by_one, missed, sizes)
    result: list[np.ndarray] = [np.zeros(0, np.int32)] * len(units)
    for row, k in enumerate(order.tolist()):
        result[k] = table[:lengths[k], row].copy()
    return result


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
