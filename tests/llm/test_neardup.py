import numpy as np
import pytest
import xxhash

from helpers import CLASHING, corpus, frame
from tablescope.llm import neardup


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values):
    """Root of each distinct value when those at most 3 bits apart are joined."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_report_matches_brute_force(spark):
    rows = corpus() + [(900 + i, f"{t} more") for i, (_, t) in enumerate(corpus()[:8])]
    got = sorted((tuple(r) for r in neardup.near_duplicates(frame(spark, rows, CLASHING)).collect()), key=repr)
    prints = [brute_fingerprint(t) for _, t in rows]
    groups = brute_groups(prints)
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[groups[p]] = min(least.get(groups[p], doc), doc)
    assert got == sorted(((d, f"{p:016x}", least.get(groups[p])) for (d, _), p in zip(rows, prints)), key=repr)


@pytest.mark.parametrize("shard_rows", [16, 100_000])
def test_links_lose_no_pair(spark, monkeypatch, shard_rows):
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 2 ** 63, 60)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 4)), replace=False)) for c in centers for _ in range(15)]
    values = sorted(set(near + rng.integers(0, 2 ** 63, 400).tolist()))
    monkeypatch.setattr(neardup, "SHARD_ROWS", shard_rows)
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    pairs = neardup.links(prints, len(values))
    roots = {r.node: r.root for r in neardup.components(pairs).collect()}
    expected = brute_groups(values)
    found = {}
    for v in values:
        found.setdefault(roots.get(v, v), set()).add(expected[v])
    assert all(len(x) == 1 for x in found.values())
    assert len(found) == len(set(expected.values()))


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in neardup.components(edges).collect()}
    assert {roots[i] for i in range(301)} == {0} and roots[501] == 500


def test_one_row_of_each_group_stays(spark):
    rows = corpus()
    docs = frame(spark, rows, CLASHING)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = brute_groups([brute_fingerprint(t) for _, t in rows])
    out = kept.collect()
    roots = [groups[brute_fingerprint(r.text)] for r in out]
    assert len(roots) == len(set(roots)) == len(set(groups.values()))


def test_empty_tables(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
    assert neardup.drop_near_duplicates(frame(spark, [])).collect() == []
