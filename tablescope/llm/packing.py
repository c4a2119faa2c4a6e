"""Packing by swap-based local search.

Pieces of documents are dealt at random into groups of bounded size, and each
group is packed on its own: best fit, longest first, then a search that takes the
emptiest sequence and moves its pieces into others, exchanges one for a smaller one
there, or two for one. Every step makes the fuller sequence fuller, so squared fill
rises, until the emptiest is empty and goes, or no step is left.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.frames import free_name, quoted, text_or_empty, written
from tablescope.llm.tokens import Encoder

LENGTH = 1024
#: Pieces that are packed together, about.
GROUP_PIECES = 20_000


def cut_lengths(n: int, length: int) -> list[int]:
    """Lengths of a document's pieces: all are ``length`` long but the first."""
    rest = n % length
    return ([rest] if rest else []) + [length] * (n // length)


def _pieces(tokenizer: str, end_id: int, length: int):
    shape = T.ArrayType(T.StructType([
        T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]))
    end = np.array([end_id], "<u4").tobytes()

    @F.pandas_udf(shape)
    def pieces(texts: pd.Series) -> pd.Series:
        out = []
        for ids in Encoder.of(tokenizer).encode(texts.tolist()):
            ids, start, parts = ids + end, 0, []
            for k, n in enumerate(cut_lengths(len(ids) // 4, length)):
                parts.append({"piece": k, "start": start, "length": n, "ids": ids[4 * start:4 * (start + n)]})
                start += n
            out.append(parts)
        return pd.Series(out)

    return pieces


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, text: str = "text") -> DataFrame:
    """A row for each piece: the columns of ``docs`` without ``text``, then piece, start, length and ids.

    ``ids`` are little-endian 32-bit numbers in a binary. A null text is empty and has
    the end id alone. The four columns replace columns of ``docs`` with their names.
    """
    new = ["piece", "start", "length", "ids"]
    others = [c for c in docs.columns if c != text and c.lower() not in new]
    part = free_name(docs, "part")
    found = docs.select(*[quoted(c) for c in others],
                        F.explode(_pieces(tokenizer, end_id, length)(text_or_empty(text))).alias(part))
    return found.select(*[quoted(c) for c in others], *[quoted(part)[c].alias(c) for c in new])


class _Bins:
    """Sequences as lists of pieces, found by their room and, for the search, by the lengths they hold."""

    def __init__(self, length: int):
        self.length = length
        self.items: list[list[int]] = []
        self.room: list[int] = []

    def best_fit(self, order: list[int], size: list[int]) -> None:
        by_room: dict[int, list[int]] = defaultdict(list)
        open_rooms = 0  # bit r: a sequence with room r
        for i in order:
            n = size[i]
            fits = open_rooms >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    open_rooms &= ~(1 << room)
                self.items[b].append(i)
            else:
                room, b = self.length, len(self.items)
                self.items.append([i])
                self.room.append(0)
            self.room[b] = room = room - n
            if room:
                by_room[room].append(b)
                open_rooms |= 1 << room


def pack(size: list[int], length: int = LENGTH) -> list[list[int]]:
    """Sequences of piece numbers, each of ``length`` at most in total."""
    bins = _Bins(length)
    bins.best_fit(sorted(range(len(size)), key=lambda i: -size[i]), size)
    items, room = bins.items, bins.room
    least = -(-sum(size) // length)
    alive = len(items)
    fill = -1
    while alive > least and fill < (now := sum((length - r) ** 2 for r in room)):  # again, as long as a round helps
        fill = now
        under = sorted((b for b in range(len(items)) if items[b] and room[b]), key=lambda b: room[b])
        while alive > least and under:
            victim = under.pop()  # the emptiest
            if _empty(victim, under, items, room, size):
                alive -= 1
            under = sorted((b for b in under if room[b]), key=lambda b: room[b])
    return [x for x in items if x]


def _empty(victim: int, under: list[int], items, room, size) -> bool:
    """Give all pieces of ``victim`` to the sequences in ``under``; False if some stay.

    ``under`` is read in order of room when this begins; the search ends since every
    step raises the sum of squared fills.
    """
    by_room = sorted(under, key=lambda b: room[b])
    holders: dict[int, set[int]] = defaultdict(set)  # length: sequences that hold a piece so long
    for b in under:
        for i in items[b]:
            holders[size[i]].add(b)

    def swap_in(b: int, come: list[int], go: int | None) -> None:
        for i in come:
            items[victim].remove(i)
            items[b].append(i)
            holders[size[i]].add(b)
            room[b] -= size[i]
            room[victim] += size[i]
        if go is not None:
            items[b].remove(go)
            items[victim].append(go)
            room[b] += size[go]
            room[victim] -= size[go]
            if all(size[i] != size[go] for i in items[b]):
                holders[size[go]].discard(b)

    def move() -> bool:
        for i in sorted(items[victim], key=lambda i: -size[i]):
            fits = [b for b in by_room if room[b] >= size[i]]
            if fits:
                swap_in(min(fits, key=lambda b: room[b]), [i], None)
                return True
        return False

    def exchange(groups: list[list[int]]) -> bool:
        """One piece of another sequence for a longer group of the victim's; the best fill wins."""
        best = None
        for group in groups:
            n = sum(size[i] for i in group)
            for m in range(n - 1, 0, -1):
                for b in holders.get(m, ()):
                    left = room[b] - (n - m)
                    if left >= 0 and (best is None or left < best[0]):
                        best = left, b, group, m
                if best is not None and best[0] == 0:
                    break
        if best is None:
            return False
        _, b, group, m = best
        swap_in(b, group, next(i for i in items[b] if size[i] == m))
        return True

    while items[victim]:
        own = items[victim]
        if move() or exchange([[i] for i in own]) or exchange(
                [[i, j] for k, i in enumerate(own) for j in own[k + 1:]]):
            continue
        return False
    return True


def packed(pieces: DataFrame, length: int = LENGTH, size: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset, which replace columns of those names.

    ``size`` holds each row's length, from 1 to ``length``. Any other columns are
    carried along. The rows are written once, so that their numbers, and with them
    their groups, are the same whenever a task runs again.
    """
    pieces = pieces.select([quoted(c) for c in pieces.columns if c.lower() not in ("sequence_id", "offset")])
    number, group = free_name(pieces, "number"), free_name(pieces, "group")
    table = written(pieces.withColumn(number, F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-table.count() // GROUP_PIECES))
    dealt = table.withColumn(group, F.pmod(F.xxhash64(quoted(number)), F.lit(groups)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    names = pieces.columns

    def place(part: pa.Table) -> pa.Table:
        part = part.sort_by(number)
        sizes = part.column(size).to_pylist()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, members in enumerate(pack(sizes, length)):
            at = 0
            for i in members:
                sequence[i], offset[i] = k, at
                at += sizes[i]
        sequence += part.column(group)[0].as_py() << 32
        return part.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy(group).applyInArrow(place, schema)


def packing_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row."""
    pieces = tokenized(docs.select("doc_id", "text"), tokenizer)
    return packed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
