"""Quality rules as an isolation forest over rule statistics.

``rule_statistics`` counts, for every whole text, what the usual rules look at.
``fit`` grows an isolation forest on a bounded sample of those rows and sets the
anomaly score above which a document goes, from all labelled rows. ``judge``
scores every row. Rows are judged one by one: no grouping, no hot key.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.frames import few_by_hash, free_name, quoted, text_or_empty, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Labelled rows (rows of any kind if there are no labels) that the forest is grown on, at most.
SAMPLE_ROWS = 20_000
TREES = 128
#: Rows of a tree, and how many of them may be labelled 0: anomalies must be rare to be cut off early.
TREE_ROWS = 256
TREE_BAD_ROWS = 8
#: Share of the good rows on either side of a statistic's middle.
TAIL = 0.0005
#: Of the labelled good rows, the share (and one row more) that a threshold may lose.
MAX_GOOD_LOSS = 0.002
SCORE_STEPS = 2000
SEED = 7


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) > len(words) - WINDOW:  # a repeated window has eight repeated words at least
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled = rolled * np.uint64(0xBF58476D1CE4E5B9) + mixed[k:k + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    starts = np.flatnonzero(maybe)
    windows = [tuple(words[i:i + WINDOW]) for i in starts.tolist()]  # equal sums are checked word by word
    times = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(starts.tolist(), windows):
        if times[w] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def statistics_of(text: str) -> tuple[int, ...]:
    """The five counts of one text, in the order of ``COUNTS``."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, SPACES))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@F.pandas_udf(STATISTICS)
def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics_of(t) for t in texts], columns=COUNTS, dtype="int64")


def rule_statistics(df: DataFrame, name: str = "rules", text: str = "text") -> DataFrame:
    """``df`` with the struct ``name`` of the five counts; a null text counts as empty."""
    return df.withColumn(name, _statistics(text_or_empty(text)))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (
        100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def features(pdf: pd.DataFrame) -> np.ndarray:
    """Word length, and symbols, repeated lines and repeated words per word."""
    words = np.maximum(pdf["n_words"].to_numpy(float), 1.0)
    return np.column_stack([
        pdf["word_chars"].to_numpy(float) / words,
        pdf["n_symbols"].to_numpy(float) / words,
        pdf["n_dup_lines"].to_numpy(float) / words,
        pdf["n_repeat_words"].to_numpy(float) / words,
    ])


def beyond(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far each statistic lies outside low to high, where most texts differ without meaning."""
    return np.log1p((np.maximum(low - x, 0) + np.maximum(x - high, 0)) / np.maximum(high - low, 0.05))


@dataclass
class Forest:
    """Trees in arrays: node k of a tree has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x nodes, -1 at a leaf
    cut: np.ndarray
    depth: np.ndarray  # expected path length of what ends here
    usual: float  # mean path length in a tree of TREE_ROWS rows
    low: np.ndarray  # of each statistic, where the middle of the good rows begins and ends
    high: np.ndarray
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 (deep in every tree) to 1 (cut off at once)."""
        x = beyond(x, self.low, self.high)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, depth in zip(self.feature, self.cut, self.depth):
            node = np.zeros(len(x), np.int64)
            while True:
                at = feature[node]
                inner = at >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(at, 0)] >= cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += depth[node]
        return np.exp2(-total / len(self.feature) / self.usual)


def _mean_path(n: float) -> float:
    return 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n if n > 2 else float(n == 2)


def grow(x: np.ndarray, bad: np.ndarray | None = None, trees: int = TREES, seed: int = SEED) -> Forest:
    """Random cuts on random features; each tree has its own rows of ``x``, few of them ``bad``."""
    rng = np.random.default_rng(seed)
    bad = np.zeros(len(x), bool) if bad is None else bad
    typical = x[~bad] if not bad.all() else x
    low = np.quantile(typical, TAIL, axis=0, method="lower")
    high = np.quantile(typical, 1 - TAIL, axis=0, method="higher")
    x = beyond(x, low, high)
    kinds = [(np.flatnonzero(~bad), TREE_ROWS), (np.flatnonzero(bad), TREE_BAD_ROWS)]
    limit = int(np.ceil(np.log2(TREE_ROWS)))
    nodes = 2 ** (limit + 1) - 1
    feature = np.full((trees, nodes), -1)
    cut, depth = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    rows = 0
    for t in range(trees):
        chosen = np.concatenate([rng.choice(k, min(n, len(k)), replace=False) for k, n in kinds])
        rows = len(chosen)
        todo = [(0, 0, x[chosen])]
        while todo:
            node, level, part = todo.pop()
            least, most = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(most > least)
            if level == limit or not len(wide):
                depth[t, node] = level + _mean_path(len(part))
                continue
            f = int(rng.choice(wide))
            c = rng.uniform(least[f], most[f])
            c = c if c > least[f] else most[f]
            feature[t, node], cut[t, node] = f, c
            right = part[:, f] >= c
            todo += [(2 * node + 1, level + 1, part[~right]), (2 * node + 2, level + 1, part[right])]
    return Forest(feature, cut, depth, max(_mean_path(rows), 1.0), low, high)


def _scores(forest: Forest):
    @F.pandas_udf(T.DoubleType())
    def score(stats: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.score(features(stats)))

    return score


def fit(df: DataFrame, labels: DataFrame | None, name: str = "rules", key: str = "doc_id",
        label: str = "quality") -> Forest | None:
    """Forest and threshold for ``df``, which has the struct ``name``.

    Only rows that pass the base rules count. The forest grows on the ``SAMPLE_ROWS``
    labelled rows with the smallest hashes (of all rows, if none has a label); no rows,
    no forest. The threshold uses every labelled row: the lowest score step that keeps
    all but ``MAX_GOOD_LOSS`` of the rows labelled 1, if it rejects a larger share of
    the rows labelled 0; without such a step nothing is rejected. Rows with a null key
    or label are not used; of several labels of a key the smallest holds.
    """
    stats = quoted(name)
    usable = df.select(quoted(key).alias("key"), stats.alias("stats")).where(~base_failed(F.col("stats")))
    known = usable.withColumn("good", F.lit(None).cast("int"))
    if labels is not None:
        truth = (labels.select(quoted(key).alias("key"), quoted(label).cast("int").alias("good")).dropna()
                 .groupBy("key").agg(F.min("good").alias("good")))
        known = usable.join(truth, "key")
        if known.isEmpty():
            known = usable.withColumn("good", F.lit(None).cast("int"))
    rows = known.count()
    if not rows:
        return None
    sample = few_by_hash(known, ["key", "stats"], SAMPLE_ROWS, rows).select("stats.*", "good").toPandas()
    forest = grow(features(sample), (sample["good"] == 0).to_numpy())
    steps = (known.where("good IN (0, 1)")
             .groupBy(F.floor(_scores(forest)("stats") * SCORE_STEPS).alias("step"))
             .agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("bad"))
             .orderBy(F.desc("step")).collect())  # SCORE_STEPS + 1 rows at most
    forest.threshold = threshold(steps)
    return forest


def threshold(steps) -> float:
    """Lowest step (given from the highest down) that loses few good rows and more bad ones."""
    good, bad = sum(r["good"] for r in steps), sum(r["bad"] for r in steps)
    best, lost, caught = 1.0, 0, 0
    for r in steps:
        lost, caught = lost + r["good"], caught + r["bad"]
        if lost > MAX_GOOD_LOSS * good + 1:
            break
        if bad and good and caught / bad > lost / good:
            best = r["step"] / SCORE_STEPS
    return best


def judge(df: DataFrame, forest: Forest | None, name: str = "rules", out: str = "kept") -> DataFrame:
    """``df`` with the boolean ``out``: passes the base rules and is no anomaly."""
    passed = ~base_failed(quoted(name))
    if forest is not None:
        passed = passed & (_scores(forest)(quoted(name)) < F.lit(forest.threshold))
    return df.withColumn(out, passed)


def filter_quality(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    Null and empty texts have no words and go; repeated rows are judged alike. The
    rows are written once with their counts, so that texts are read once.
    """
    name = free_name(docs, "rules")
    counted = written(rule_statistics(docs, name), "rules")
    verdict = free_name(counted, "kept")
    judged = judge(counted, fit(counted, labels, name), name, verdict)
    return judged.where(quoted(verdict)).select([quoted(c) for c in docs.columns])


def quality_report(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """doc_id, the five counts, ``base_failed`` and ``kept`` for every row."""
    counted = written(rule_statistics(docs.select("doc_id", "text")).select("doc_id", "rules"), "rules")
    return judge(counted, fit(counted, labels)).select(
        "doc_id", *[F.col(f"rules.{c}") for c in COUNTS], base_failed(F.col("rules")).alias("base_failed"), "kept")
