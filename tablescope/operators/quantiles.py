"""Exact quantiles over any number of rows.

Spark's exact ``percentile`` keeps a count per distinct value in one task. Here
the rank is closed in on by histograms instead: the first pass puts values into
buckets of about one percent relative width, each later pass splits the one
bucket that holds the wanted rank into 4096 equal parts. A pass returns bucket
counts only; the search ends when a bucket holds a single distinct value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PER_OCTAVE = 64
_PARTS = 4096


@dataclass
class _Search:
    name: str
    rank: int
    low: float | None = None
    high: float | None = None
    before: int = 0  # rows below `low`

    @property
    def found(self) -> bool:
        return self.low is not None and self.low == self.high

    def narrow(self, buckets) -> None:
        below = self.before
        for _, rows, low, high in sorted(buckets):
            if self.rank < below + rows:
                self.before, self.low, self.high = below, low, high
                return
            below += rows
        raise AssertionError("rank lies outside the counted rows")


def _octave_bucket(value: Column) -> Column:
    size = F.floor((F.log2(F.abs(value)) + 1100) * _PER_OCTAVE)
    return F.when(value == 0, F.lit(0).cast("bigint")).otherwise(F.signum(value).cast("bigint") * size)


def _equal_bucket(value: Column, low: float, high: float) -> Column:
    # Halved, so that the width of the whole double range stays finite.
    width = high / 2 - low / 2
    return F.when(value.between(low, high),
                  F.floor((value / 2 - F.lit(low / 2)) / F.lit(width) * _PARTS))


def _histograms(df: DataFrame, parts: Sequence[tuple[Column, Column]], weight: Sequence[str] = ()) -> dict[int, list]:
    """Bucket counts, or sums of the weight, for each (value, bucket) pair; one job for all of them."""
    pairs = [F.when(bucket.isNotNull(), F.struct(bucket.alias("b"), value.alias("v"))).alias(f"p{i}")
             for i, (value, bucket) in enumerate(parts)]
    counted = (
        df.select(*weight, *pairs).unpivot(list(weight), [f"p{i}" for i in range(len(pairs))], "part", "pair")
        .filter("pair is not null")
        .select("part", "pair.b", "pair.v", *weight)
        .groupBy("part", "b").agg((F.sum(weight[0]) if weight else F.count("*")).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )
    out: dict[int, list] = {i: [] for i in range(len(pairs))}
    for row in counted.collect():
        out[int(row.part[1:])].append((row.b, row.n, row.lo, row.hi))
    return out


def exact_quantiles(df: DataFrame, columns: Mapping[str, Column],
                    probabilities: Mapping[str, Sequence[float]],
                    weight: Column | None = None) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles, for several columns at once.

    ``columns`` maps names to double expressions; NULLs are left out. A column
    without values yields ``None`` for each of its probabilities. A row counts as
    ``weight`` rows, a whole number above 0, if that is given.
    """
    names = [n for n in columns if probabilities.get(n)]
    if not names:
        return {}
    weights = [] if weight is None else ["weight"]
    values = df.select(*[columns[n].alias(f"q{i}") for i, n in enumerate(names)], *([weight.alias("weight")] if weights else []))
    col_of = {n: F.col(f"q{i}") for i, n in enumerate(names)}
    first = _histograms(values, [(col_of[n], _octave_bucket(col_of[n])) for n in names], weights)

    rows = {n: sum(b[1] for b in first[i]) for i, n in enumerate(names)}
    searches: dict[tuple[str, int], _Search] = {}
    for i, n in enumerate(names):
        if not rows[n]:
            continue
        for p in probabilities[n]:
            position = p * (rows[n] - 1)
            for rank in {math.floor(position), math.ceil(position)}:
                search = _Search(n, rank)
                search.narrow(first[i])
                searches[n, rank] = search

    while open_ranges := sorted({(s.name, s.low, s.high) for s in searches.values() if not s.found}):
        counted = _histograms(values, [(col_of[n], _equal_bucket(col_of[n], lo, hi))
                                       for n, lo, hi in open_ranges], weights)
        for i, key in enumerate(open_ranges):
            for s in searches.values():
                if not s.found and (s.name, s.low, s.high) == key:
                    s.narrow(counted[i])

    def value(name: str, p: float) -> float | None:
        if not rows[name]:
            return None
        position = p * (rows[name] - 1)
        low = searches[name, math.floor(position)].low
        high = searches[name, math.ceil(position)].low
        return low + (high - low) * (position - math.floor(position))

    return {n: [value(n, p) for p in probabilities[n]] for n in names}
