"""SimHash near-duplicates: exact pairs through vantage-point trees, then groups.

Two 64-bit fingerprints that differ in at most three bits differ in at most one
bit of one of their halves. Each half therefore has a vantage-point tree over its
32-bit Hamming space. A node holds a vantage point and a distance: values nearer
go left, values farther go right, and values just beyond the boundary go both
ways. By the triangle inequality, two values one bit apart that lie on either side
of a boundary meet on its near side, so every pair meets in a leaf. Leaves are
shards: each is searched by its own, finer tree and yields only a forest of its
links, which is then joined into components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.frames import few_by_hash, free_name, quoted, text_or_empty, written

MAX_BITS = 3
HALF_RADIUS = MAX_BITS // 2
SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints that the shared tree's vantage points and distances are taken from, at most.
SAMPLE = 65_536
#: Fingerprints that a leaf of the shared tree should hold about, and a leaf of a shard's own tree.
SHARD_ROWS = 4_096
BRUTE_ROWS = 192
_BLOCK = 1_024
_VANTAGE_TRIES = 6


# fingerprints

def fingerprint_of(text: str) -> int:
    """64-bit SimHash of the three-word shingles; shorter texts are one shingle, empty ones 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])), np.uint64, len(words) - 2)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65_536):
        part = hashes[start:start + 65_536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))


def fingerprint(text: str = "text") -> Column:
    """The fingerprint as a signed long."""
    return _fingerprints(text_or_empty(text))


# vantage-point trees

def _distance(x: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint32(vantage)).astype(np.int8)


def _split(x: np.ndarray, rng) -> tuple[int, int] | None:
    """Vantage point and boundary that send the fewest values into the fuller branch; None if none divides."""
    best, least = None, len(x)
    for vantage in rng.choice(x, min(_VANTAGE_TRIES, len(x)), replace=False).tolist():
        counts = np.bincount(_distance(x, vantage), minlength=33)
        near = np.cumsum(counts)
        for cut in range(32):
            left = near[min(cut + HALF_RADIUS, 32)]
            worst = max(left, len(x) - near[cut])
            if worst < least:
                best, least = (vantage, cut), worst
    return best


class Tree:
    """Nodes in lists; a leaf's number stands in ``leaf``, -1 at inner nodes."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, seed: int = 1):
        self.vantage, self.cut, self.left, self.right, self.leaf = [], [], [], [], []
        self.leaves = 0
        self._grow(sample, max(leaf_rows, 2), np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, leaf_rows: int, rng) -> int:
        node = len(self.cut)
        for part in (self.vantage, self.cut, self.left, self.right):
            part.append(0)
        self.leaf.append(-1)
        found = _split(x, rng) if len(x) > leaf_rows else None
        if found is None:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
            return node
        self.vantage[node], self.cut[node] = found
        d = _distance(x, found[0])
        self.left[node] = self._grow(x[d <= found[1] + HALF_RADIUS], leaf_rows, rng)
        self.right[node] = self._grow(x[d > found[1]], leaf_rows, rng)
        return node

    def route(self, x: np.ndarray):
        """Pairs of a leaf number and the positions in ``x`` that belong there; some belong to several leaves."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if self.leaf[node] >= 0:
                yield self.leaf[node], at
                continue
            d = _distance(x[at], self.vantage[node])
            todo += [(self.left[node], at[d <= self.cut[node] + HALF_RADIUS]), (self.right[node], at[d > self.cut[node]])]


def _halves(values: np.ndarray) -> list[np.ndarray]:
    v = values.astype(np.int64).view(np.uint64)
    return [(v & np.uint64(0xFFFFFFFF)).astype(np.uint32), (v >> np.uint64(32)).astype(np.uint32)]


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the sets of i[k] and j[k]; parents always have smaller numbers."""
    while len(i):
        for side in (i, j):
            while not np.array_equal(up := parent[side], side):
                side[:] = up
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


def forest(values: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that join all distinct ``values`` connected by pairs MAX_BITS apart or less
    whose ``half`` differ in HALF_RADIUS bits at most."""
    full = values.view(np.uint64)
    parent = np.arange(len(full))
    for _, at in Tree(half, BRUTE_ROWS).route(half):
        for a in range(0, len(at), _BLOCK):
            for b in range(a, len(at), _BLOCK):
                one, two = at[a:a + _BLOCK], at[b:b + _BLOCK]
                near = np.bitwise_count(full[one][:, None] ^ full[two][None, :]) <= MAX_BITS
                i, j = np.nonzero(near)
                _join(parent, one[i], two[j])
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    member = np.flatnonzero(parent != np.arange(len(full)))
    return values[member], values[parent[member]]


def links(prints: DataFrame, rows: int, column: str = "fp") -> DataFrame:
    """(a, b): pairs of distinct fingerprints that are linked, enough of them to connect all that are.

    ``prints`` has each fingerprint once, ``rows`` of them. No leaf yields more links
    than it has members, whatever the number of pairs in it.
    """
    sample = few_by_hash(prints, [column], SAMPLE, rows).toPandas()[column].to_numpy(np.int64)
    if len(sample) < 2:
        return prints.select(F.col(column).alias("a"), F.col(column).alias("b")).limit(0)
    share = max(8, SHARD_ROWS * len(sample) // max(rows, 1))
    trees = [Tree(half, share) for half in _halves(sample)]

    def deal(batches):
        for pdf in batches:
            values = pdf[column].to_numpy(np.int64)
            for k, half in enumerate(_halves(values)):
                for leaf, at in trees[k].route(half):
                    yield pd.DataFrame({"side": k, "leaf": leaf, "value": values[at]})

    def search(key, pdf):
        values = np.unique(pdf["value"].to_numpy(np.int64))
        a, b = forest(values, _halves(values)[int(key[0])])
        return pd.DataFrame({"a": a, "b": b})

    dealt = prints.select(column).mapInPandas(deal, "side int, leaf int, value long")
    return dealt.groupBy("side", "leaf").applyInPandas(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b), the smallest node connected with it.

    Each round every node points to its smallest neighbour, pointers are followed
    to their end, and edges move to the ends, which at least halves the nodes that
    still have edges. What a round leaves is written to the shared folder.
    """
    edges = written(edges.where("a <> b"), "edges")
    both = edges.select("a").union(edges.select("b"))
    labels = written(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        near = edges.union(edges.select("b", "a"))
        up = written(near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                     .select("node", F.least("node", "b").alias("up")), "up")
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = written(up.join(over, "up").select(
                "node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
            moved = not jumped.where("moved").isEmpty()
            up = jumped.select("node", "up")
            if not moved:
                break
        labels = written(
            labels.join(up.withColumnRenamed("node", "root"), "root", "left")
            .select("node", F.coalesce("up", "root").alias("root")), "labels")
        edges = written(
            edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("c")), "a")
            .join(up.select(F.col("node").alias("b"), F.col("up").alias("d")), "b")
            .where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), "edges")
    return labels


def groups(rows: DataFrame, key: str = "doc_id", column: str = "fp") -> DataFrame:
    """(fp, root, first): for each fingerprint its group and the smallest ``key`` in that group.

    ``rows`` has ``key`` and the fingerprint of every document; equal fingerprints
    are counted once before anything is compared. Null keys are no smallest key, so
    ``first`` is null only in groups without any other.
    """
    prints = written(rows.groupBy(column).agg(F.min(key).alias("first")), "prints")
    pairs = links(prints.select(column), prints.count(), column)
    roots = components(pairs).select(F.col("node").alias(column), "root")
    placed = prints.join(roots, column, "left").select(column, "first", F.coalesce("root", column).alias("root"))
    placed = written(placed, "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("first"))
    return placed.drop("first").join(least, "root").select(column, "root", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, ``fingerprint`` as 16 hex digits and ``component_id`` for every row of ``docs``.

    Null texts count as empty; empty texts have the fingerprint 0 and are linked like
    others. Repeated rows get the same result each.
    """
    rows = written(docs.select("doc_id", fingerprint().alias("fp")), "fingerprints")
    found = groups(rows)
    return rows.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each group: the one with the smallest ``key`` (rows without one come last).

    Of rows with the same key in a group, any one stays. Columns and texts are as in
    ``docs``, which is written once, with a number for each row.
    """
    fp, row = free_name(docs, "fp"), free_name(docs, "row")
    kept = written(docs.withColumns({fp: fingerprint(), row: F.monotonically_increasing_id()}), "documents")
    narrow = kept.select(quoted(key).alias("doc_id"), quoted(fp).alias("fp"), quoted(row).alias("row"))
    chosen = (narrow.join(groups(narrow.select("doc_id", "fp")), "fp").where("doc_id <=> first")
              .groupBy("root").agg(F.min("row").alias(row)).select(row))
    return kept.join(chosen, row, "left_semi").select([quoted(c) for c in docs.columns])
