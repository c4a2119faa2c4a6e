import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import CLASHING, corpus, frame
from tablescope.llm import ranking, signatures

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, top=20):
    """(item_id, rank, doc_id, score), by scoring every document for every item."""
    counted = [(d, Counter(terms(t))) for d, t in rows]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        want = Counter(terms(text))
        scores = []
        for d, c in counted:
            m = 75 + 25 * c.total() * n_docs // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, r in want.items() if t in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return out


def found(spark, rows, items, **options):
    queries = spark.createDataFrame(items, "item_id string, text string, rank string, item string")
    got = ranking.search(frame(spark, rows, CLASHING), queries, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def wide(items):
    return [(*i, "x", "y") for i in items]


def some_items(rows, seed=3):
    rng = random.Random(seed)
    texts = [t for _, t in rows if t]
    items = [(f"q{i}", " ".join(rng.choice(texts).split()[:12] + rng.choice(texts).upper().split()[:3])) for i in range(12)]
    return items + [("none", "zzzz qqqq"), ("empty", ""), ("null", None), (None, texts[0]), ("twice", "ünï a a a"), ("twice", "ünï a a a"),
                    ("all", " ".join(texts)[:4000])]


def test_matches_brute_force(spark):
    rows = corpus(n=120) + [(500 + i, "the same words in many copies") for i in range(60)] + [(900, "the same words in many copies")] * 3
    items = some_items(rows) + [("copies", "many copies of the same words")]
    assert found(spark, rows, wide(items)) == sorted(brute(rows, items), key=repr)


def test_small_first_look_blocks_and_several_looks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FIRST_LOOK", 3)
    monkeypatch.setattr(ranking, "ITEMS", 5)
    monkeypatch.setattr(signatures, "BLOCK_ROWS", 8)
    monkeypatch.setattr(signatures, "LEXICON_TERMS", 50)
    rows = corpus(n=60)
    items = some_items(rows)
    assert found(spark, rows, wide(items), top=7) == sorted(brute(rows, items, 7), key=repr)


def test_bounds_hold_and_exclude_most(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(3000)], k=120))) for i in range(1500)]
    docs = frame(spark, rows)
    items = [(str(i), " ".join(rng.choices(words, k=10))) for i in range(8)]
    index = signatures.indexed(docs)
    blocks = [r for r in index.where("slices IS NOT NULL").collect()]
    assert sum(r.rows for r in blocks) == len(rows)
    lexicon = defaultdict(int)
    for r in index.where("term IS NOT NULL").collect():
        lexicon[r.term] += r.docs
    assert lexicon == Counter(t for _, text in rows for t in set(text.split()))
    weights = {t: math.floor(1000 * math.log((2 * 1500 + 2) / (2 * n + 1))) for t, n in lexicon.items()}
    asked = [(k, sorted(set(t.split())), [t.split().count(x) for x in sorted(set(t.split()))], [weights.get(x, 0) for x in sorted(set(t.split()))])
             for k, (_, t) in enumerate(items)]
    queries = ranking.Queries(asked, 1500, 1500 * 120)
    text, bounds, exacts = dict(rows), defaultdict(list), defaultdict(list)
    for r in blocks:
        slices = np.frombuffer(r.slices, np.uint8).reshape(r.bits, -1)
        for k, bound in enumerate(queries.bounds(slices, np.array(r.n), np.array(r.top))):
            bounds[k] += bound.tolist()
            exacts[k] += [queries.scores(text[d].encode(), [k])[0] for d in r.ids]
    open_ = 0
    for k in bounds:
        assert all(b >= e for b, e in zip(bounds[k], exacts[k]))
        reach = sorted(exacts[k])[-5]
        open_ += sum(b >= reach for b in bounds[k])
    assert open_ < len(rows) * len(items) / 4


def test_empty_tables(spark):
    assert found(spark, [], wide([("a", "b")])) == []
    assert found(spark, [(1, "a b")], []) == []
    assert found(spark, [(1, None), (2, "--")], wide([("a", "b")])) == []


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_terms(text):
    assert [t.decode() for t in signatures.terms_of(text.encode("utf-8", "replace"))] == terms(text.encode("utf-8", "replace").decode())
