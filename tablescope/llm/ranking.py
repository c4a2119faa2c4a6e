"""Ranked lexical search: upper bounds from bit-sliced signatures, exact scores of what they leave open.

For a block of documents the signatures tell how often each may hold a query's terms
at most; weights summed over these bitmaps bound its score. A first look at the bounds
picks documents to score exactly, which gives every query the score that a document
has to reach; a second look keeps all documents whose bound reaches it. These are
scored exactly, so none that belongs to the answer is missing.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.frames import discard, quoted, text_or_empty, written
from tablescope.llm.signatures import LEVELS, LOWER, TERM, UPPER, indexed, levels_of, term_column, term_hash, terms_of

TOP = 20
#: Documents of the highest bounds that are scored for a query's threshold.
FIRST_LOOK = 40
#: Queries, and their terms, that one look at the index answers.
ITEMS, ITEM_TERMS = 1_000, 100_000
#: A term's share by its frequency is a whole number of these parts.
UNIT = 1_000_000_000


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share for its frequency in a document of length measure ``m``; grows with tf."""
    return (UNIT * tf) // (1000 * tf + 12 * m)


def length_measure(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    if 25 * docs * int(n.max(initial=0)) < 2 ** 62:
        return 75 + (25 * docs * n) // max(terms, 1)
    return np.array([75 + 25 * docs * int(x) // terms for x in n], np.int64)


class Queries:
    """The weighted terms of a bounded number of queries, and the corpus's two totals."""

    def __init__(self, items: list[tuple[int, list[str], list[int], list[int]]], docs: int, terms: int):
        self.docs, self.terms = docs, terms
        known: dict[str, int] = {}
        self.number, self.at, self.worth = [], [], []
        for number, names, repeats, weights in items:
            self.number.append(number)
            self.at.append(np.array([known.setdefault(t, len(known)) for t in names], np.int64))
            self.worth.append(np.array(repeats, np.int64) * np.array(weights, np.int64))
        self.names = [t.encode() for t in known]
        self.hashes = np.array([term_hash(t) for t in self.names], np.uint64)
        self.place = {n: i for i, n in enumerate(self.number)}

    def bounds(self, slices: np.ndarray, n: np.ndarray, top: np.ndarray):
        """For each query, a score that no document of the block exceeds."""
        m = length_measure(n, self.docs, self.terms)
        most = np.append(LEVELS[1:] - 1, 0)[:, None].repeat(len(n), 1)
        most[-1] = np.iinfo(np.int32).max
        shares = np.vstack([np.zeros(len(n)), share(np.minimum(most, top), m)])
        level = levels_of(slices, self.hashes)[:, :len(n)]
        each = np.take_along_axis(shares, level.astype(np.int64), 0) if level.size else np.zeros((0, len(n)))
        for at, worth in zip(self.at, self.worth):
            # a little more than any error of summing in doubles
            yield ((worth.astype(float) @ each[at]) * (1 + 1e-9) + 1).astype(np.int64) * (each[at] > 0).any(axis=0)

    def scores(self, text: bytes, numbers: list[int]) -> list[int]:
        """The exact scores of a document for some of the queries."""
        counts = Counter(terms_of(text))
        n = np.array([counts.total()], np.int64)
        m = length_measure(n, self.docs, self.terms)
        result = []
        for number in numbers:
            i = self.place[number]
            tf = np.array([counts.get(self.names[a], 0) for a in self.at[i]], np.int64)
            result.append(int((self.worth[i] * share(tf, m)).sum()))
        return result


def _leading(columns: list[np.ndarray], order: tuple, groups: list[int], limit: int) -> list[np.ndarray]:
    """Of each group the first ``limit`` rows in the given order (as for lexsort, the groups' columns last)."""
    at = np.lexsort(order)
    columns = [c[at] for c in columns]
    new = np.zeros(len(at), bool)
    new[:1] = True
    for g in groups:
        new[1:] |= columns[g][1:] != columns[g][:-1]
    starts = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return [c[place < limit] for c in columns]


def _best(columns: list[np.ndarray], limit: int) -> list[np.ndarray]:
    """The ``limit`` rows of each query with the highest bounds."""
    item, doc, named, _, _, bound = columns
    return _leading(columns, (doc, named, -bound, item), [0], limit)


def _fewest_ids(columns: list[np.ndarray], limit: int) -> list[np.ndarray]:
    """Equal texts score alike, so of theirs those past the ``limit`` smallest ids are in no answer."""
    item, doc, named, one, two, _ = columns
    return _leading(columns, (doc, named, two, one, item), [0, 3, 4], limit)


_BOUNDED = "item long, doc long, one long, two long, bound long"


def looked_up(blocks: DataFrame, queries: Queries, limit: int, reach: dict[int, int] | None) -> DataFrame:
    """(item, doc, one, two, bound) from the blocks of an index.

    Without ``reach`` a task yields each query's ``limit`` documents with the highest
    bounds; with it, all documents with a bound of ``reach`` or more, and of equal texts
    the ``limit`` smallest ids.
    """
    shrink = _best if reach is None else _fewest_ids

    def search(batches):
        held, size, floor = [], 0, 1 << 18
        for batch in batches:
            for i in range(batch.num_rows):
                ids, one, two, n, top = (batch.column(c)[i].values for c in ("ids", "one", "two", "n", "top"))
                row = [ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), one.to_numpy(), two.to_numpy()]
                slices = np.frombuffer(batch.column("slices")[i].as_buffer(), np.uint8).reshape(batch.column("bits")[i].as_py(), -1)
                for number, bound in zip(queries.number, queries.bounds(slices, n.to_numpy(), top.to_numpy())):
                    fits = np.flatnonzero(bound >= (reach[number] if reach else 1))
                    if reach is None and len(fits) > limit:
                        last = np.partition(bound[fits], len(fits) - limit)[len(fits) - limit]
                        fits = fits[bound[fits] >= last]
                    if len(fits):
                        held.append([np.full(len(fits), number), *[c[fits] for c in row], bound[fits]])
                        size += len(fits)
                if size > floor:  # next when twice as many are held, so a row is sorted a few times only
                    held = [shrink([np.concatenate(c) for c in zip(*held)], limit)]
                    size = len(held[0][0])
                    floor = max(1 << 18, 2 * size)
        if held:
            item, doc, named, one, two, bound = shrink([np.concatenate(c) for c in zip(*held)], limit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item), pa.array(doc, mask=~named), pa.array(one), pa.array(two), pa.array(bound)],
                ["item", "doc", "one", "two", "bound"])

    return blocks.select("bits", "ids", "one", "two", "n", "top", "slices").mapInArrow(search, _BOUNDED)


def scored(docs: DataFrame, wanted: DataFrame, queries: Queries, key: str, text: str) -> DataFrame:
    """(one, two, item, score): exact scores for ``wanted`` (item, doc, one, two), each text scored once.

    ``wanted`` is joined to ``docs`` by a text's smallest id and both its hashes.
    """
    whole = text_or_empty(text)
    texts = docs.select(quoted(key).cast("long").alias("doc"), F.xxhash64(whole).alias("one"),
                        F.xxhash64(F.lit(1), whole).alias("two"), whole.alias("text"))
    ask = wanted.groupBy("one", "two").agg(F.min("doc").alias("id"), F.collect_set("item").alias("items"))
    ask = written(ask.withColumnsRenamed({"one": "first", "two": "second"}), "asked")
    same = (F.col("one") == F.col("first")) & (F.col("two") == F.col("second")) & F.col("doc").eqNullSafe(F.col("id"))
    asked = texts.join(ask, same).select("one", "two", "text", "items")

    def score(batches):
        for batch in batches:
            one, two, items = (batch.column(c).to_pylist() for c in ("one", "two", "items"))
            data = batch.column("text").cast(pa.large_binary())
            out = [(one[i], two[i], q, s) for i in range(batch.num_rows) for q, s in zip(items[i], queries.scores(data[i].as_py(), items[i]))]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["one", "two", "item", "score"])

    return asked.mapInArrow(score, "one long, two long, item long, score long").distinct()


def _places(df: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)


def _answers(docs: DataFrame, blocks: DataFrame, queries: Queries, top: int, key: str, text: str) -> DataFrame:
    """(item, rank, doc, score) for the queries of one look."""
    look, high = max(FIRST_LOOK, top), [F.desc("bound"), F.asc("doc")]
    # each task sends its best; salted groups shrink these before a query's group meets
    salted = looked_up(blocks, queries, look, None).withColumn("salt", F.pmod(F.xxhash64("doc", "one"), F.lit(64)))
    first = _places(_places(salted, ["item", "salt"], high, look).drop("rank", "salt"), ["item"], high, look).drop("rank")
    first = written(first, "first")
    best = [F.desc("score"), F.asc("doc")]
    known = first.join(scored(docs, first, queries, key, text), ["item", "one", "two"]).where("score > 0")
    reach = dict.fromkeys(queries.number, 1)
    reach |= {r["item"]: r["score"] for r in  # one number for each query
              _places(known, ["item"], best, top).where(F.col("rank") == top).select("item", "score").collect()}
    left = written(looked_up(blocks, queries, top, reach), "left")
    exact = scored(docs, left, queries, key, text).where("score > 0")
    ranked = _places(left.join(exact, ["item", "one", "two"]), ["item"], best, top)
    answers = written(ranked.select("item", F.col("rank").cast("int").alias("rank"), "doc", "score"), "answers")
    discard(first)
    discard(left)
    return answers


def _queries(items: DataFrame, docs: int, terms: int):
    """Queries, a bounded number at a time, from (item, names, repeats, weights)."""
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and (len(held) == ITEMS or size + len(row["names"]) > ITEM_TERMS):
            yield Queries(held, docs, terms)
            held, size = [], 0
        held.append((row["item"], row["names"], row["repeats"], row["weights"]))
        size += len(row["names"])
    if held:
        yield Queries(held, docs, terms)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id (named as in ``items``), rank (int, from 1), doc_id and score (long): the ``top`` documents for each query.

    Only scores above 0 are ranked, equal ones by ascending id, a null id first. Null and
    empty texts have no terms: such documents are not counted and found by no query, such
    queries find nothing. Every row of ``items`` is a query of its own, every row of
    ``docs`` a document, so repeated rows give repeated answers. Ids of documents are whole numbers.
    """
    spark = docs.sparkSession
    index = written(indexed(docs, key, text), "index")
    blocks = index.where("slices IS NOT NULL")
    total = blocks.agg(F.sum("rows").alias("rows"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = total["rows"] or 0, total["terms"] or 0
    numbered = written(items.select(quoted(item_key).alias("id"), text_or_empty(item_text).alias("text"))
                       .withColumn("item", F.monotonically_increasing_id()), "items")
    each = (numbered.select("item", F.explode(F.split(term_column(F.col("text")), " ")).alias("term")).where("term <> ''")
            .groupBy("item", "term").agg(F.count("*").alias("repeats")))
    lexicon = index.where("term IS NOT NULL").join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("docs").alias("docs"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.coalesce("docs", F.lit(0)) + 1).cast("double"))).cast("long")
    weighted = written(each.join(lexicon, "term", "left").withColumn("weight", weight).groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct("term", "repeats", "weight"))).alias("t"))
        .select("item", F.col("t.term").alias("names"), F.col("t.repeats").alias("repeats"), F.col("t.weight").alias("weights")), "queries")
    answers = [_answers(docs, blocks, q, top, key, text) for q in _queries(weighted, n_docs, n_terms)]
    shape = "item long, rank int, doc long, score long"
    found = reduce(DataFrame.unionAll, answers) if answers else spark.createDataFrame([], shape)
    discard(index)
    return found.join(numbered.select("item", "id"), "item").select(
        F.col("id").alias(item_key), "rank", F.col("doc").alias(key), "score")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
lens AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
tot AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM lens),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY rid, t),
q AS (SELECT iid, item_id, t, count(*) AS reps FROM (SELECT iid, item_id, unnest(w) AS t FROM (
        SELECT row_number() OVER () AS iid, item_id,
               regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM benchmark)) GROUP BY iid, item_id, t),
df AS (SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM q) GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, tot),
m AS (SELECT rid, doc_id, 75 + (25 * n * nd) // nt AS m FROM lens, tot),
s AS (SELECT iid, item_id, rid, doc_id, CAST(sum(reps * w * (({UNIT} * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (rid) GROUP BY iid, item_id, rid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
