"""Benchmark decontamination with DataFrame functions only.

The benchmark's 13-word windows (a shorter item is one window) are hashed and
broadcast; each document's window hashes are probed against them, and a hit counts
only if the words are the same. The windows of a broadcast are bounded: a larger
benchmark is taken in several passes over the documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.frames import free_name, quoted, text_or_empty, written

WINDOW = 13
#: Windows of one broadcast; each is 13 words and a hash.
PASS_WINDOWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What no word holds, upper case or not, as a set of characters and as a pattern.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """``word`` with A-Z, and nothing else, in lower case; few words need the slow way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def raw_words(text: Column) -> Column:
    """Runs of digits, letters and all other non-ASCII characters, as they stand in ``text``."""
    inside = F.btrim(text, F.lit(BETWEEN))
    return F.when(inside == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.split(inside, GAP, -1))


def words(text: Column) -> Column:
    """The words of ``text`` with A-Z in lower case."""
    return F.transform(raw_words(text), lowered)


def n_words(text: Column) -> Column:
    return F.size(raw_words(text)).cast("long")


def _from(values: Column, start: int, n: Column) -> Column:
    return F.slice(values, F.lit(start + 1), F.greatest(n, F.lit(0)))


def with_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """``df`` (with ``words``, in any case) and, for each length, an array ``h<length>`` of all its windows' hashes.

    Hashes of 1, 2, 4 and 8 words are combined by pairs; the other lengths are made
    of those, so a window costs a few combinations instead of as many as it has words.
    """
    n = F.size("words")
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(lowered(w))))
    have = {1}

    def joined(a: int, b: int) -> Column:
        count = n - (a + b - 1)
        return F.zip_with(_from(F.col(f"h{a}"), 0, count), _from(F.col(f"h{b}"), a, count),
                          lambda x, y: F.xxhash64(x, y))

    for k in (1, 2, 4):
        if max(lengths) >= 2 * k:
            df = df.withColumn(f"h{2 * k}", joined(k, k))
            have.add(2 * k)
    for length in sorted(lengths):
        done = max(x for x in (8, 4, 2, 1) if x <= length)
        rest = length - done
        for k in (4, 2, 1):
            if rest >= k:
                if done + k not in have:
                    df = df.withColumn(f"h{done + k}", joined(done, k))
                    have.add(done + k)
                done, rest = done + k, rest - k
    return df


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id (as string, null as empty), n, hash and words of every distinct window, written once."""
    items = (benchmark.select(F.coalesce(quoted("item_id").cast("string"), F.lit("")).alias("item_id"),
                              words(text_or_empty()).alias("words"))
             .where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(WINDOW))))
    cut = items.select("item_id", "n", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("at"),
                       "words").select("item_id", "n", F.expr("slice(words, at, n)").alias("words")).distinct()
    lengths = _lengths(cut)
    if not lengths:
        return written(cut.withColumn("hash", F.lit(0).cast("long")), "windows")
    hashed = with_hashes(cut, lengths)
    pick = reduce(lambda other, k: F.when(F.col("n") == k, F.element_at(f"h{k}", 1)).otherwise(other),
                  lengths, F.lit(None).cast("long"))
    return written(hashed.select("item_id", "n", "words", pick.alias("hash")), "windows")


def _lengths(windows: DataFrame) -> list[int]:
    return sorted(r["n"] for r in windows.select("n").distinct().collect())  # WINDOW values at most


def row_key(df: DataFrame) -> list[Column]:
    """Two hashes of a document's id and whole text: equal rows share their result."""
    text = text_or_empty()
    return [F.xxhash64(quoted("doc_id"), text).alias("key"), F.hash(text, quoted("doc_id"), F.length(text)).alias("key2")]


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, key2, window, start, n): every place of a document where one of ``windows`` (window, n, hash, words) stands."""
    lengths = _lengths(windows)
    found = docs.select(*row_key(docs), raw_words(text_or_empty()).alias("words"))
    if not lengths:
        return found.select("key", "key2", F.lit(0).cast("long").alias("window"), F.lit(0).alias("start"), F.lit(0).alias("n")).limit(0)
    hashed = with_hashes(found, lengths).select("key", "key2", "words", *[f"h{k}" for k in lengths])
    size, before = F.size("words"), F.lit(0)
    n, start = F.lit(lengths[-1]), F.col("at")
    for k in lengths:  # one explode over the windows of all lengths, one length after the other
        here = F.greatest(size - (k - 1), F.lit(0))
        inside = (F.col("at") >= before) & (F.col("at") < before + here)
        n, start = F.when(inside, F.lit(k)).otherwise(n), F.when(inside, F.col("at") - before).otherwise(start)
        before = before + here
    spread = hashed.select("key", "key2", "words", F.posexplode(F.concat(*[f"h{k}" for k in lengths])).alias("at", "hash"))
    spread = spread.select("key", "key2", "words", "hash", n.alias("n"), start.alias("start"))
    passes = -(-windows.count() // PASS_WINDOWS)
    parts = []
    for p in range(passes):
        # every window is there once, so a pass holds about PASS_WINDOWS however many items share one
        few = windows.where(F.pmod(F.xxhash64("hash", "window"), F.lit(passes)) == p).select(
            "window", F.col("hash").alias("b_hash"), F.col("n").alias("b_n"), F.col("words").alias("b_words"))
        # an equality with one table on either side would be a join key, and so a text made for every window
        mine = F.translate(F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " "), UPPER, LOWER)
        other = F.array_join("b_words", " ")
        same = (F.col("hash") == F.col("b_hash")) & mine.startswith(other) & other.startswith(mine)
        parts.append(spread.join(F.broadcast(few), same).select("key", "key2", "window", "start", "n"))
    return reduce(DataFrame.unionAll, parts)


def spans(docs: DataFrame, benchmark: DataFrame, items: bool = False) -> DataFrame:
    """(key, key2, spans) of each document with a hit: its merged word spans; with ``items`` also the sorted item ids.

    Items are joined to the hits by a shuffle on the windows, after these are distinct for each document.
    """
    owned = benchmark_windows(benchmark)
    windows = written(owned.select("n", "hash", "words").distinct().withColumn("window", F.monotonically_increasing_id()), "distinct")
    found = hits(docs, windows)
    if items:
        found = written(found, "hits")  # read twice
    document = Window.partitionBy("key", "key2").orderBy("start")
    ahead = F.max(F.col("start") + F.col("n")).over(document.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.count_if(F.col("gap")).over(document.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = (found.withColumn("gap", F.coalesce(F.col("start") > ahead, F.lit(True))).withColumn("span", begins)
              .groupBy("key", "key2", "span").agg(F.min("start").alias("start"), F.max(F.expr("start + n")).alias("stop"))
              .groupBy("key", "key2").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")))
    if not items:
        return merged
    owners = owned.join(windows, ["n", "hash", "words"]).select("window", "item_id")
    named = (found.select("key", "key2", "window").distinct().join(owners, "window").groupBy("key", "key2")
             .agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    return merged.join(named, ["key", "key2"])


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs``.

    Null and empty texts have no words and are clean; repeated rows get the same
    result each; a null item_id counts as the empty one.
    """
    found = spans(docs, benchmark, items=True).select(
        "key", "key2", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["stop"] - s["start"]).alias("n_hit"), "items")
    rows = docs.select("doc_id", n_words(text_or_empty()).alias("n_words"), *row_key(docs))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.expr("CAST(array() AS array<string>)"))
    return rows.join(found, ["key", "key2"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged, with their own columns."""
    rows = docs.select(*row_key(docs), "doc_id", n_words(text_or_empty()).alias("n_words"))
    found = spans(docs, benchmark).select(
        "key", "key2", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["stop"] - s["start"]).alias("n_hit"))
    bad = rows.join(found, ["key", "key2"]).where("20 * n_hit >= n_words").select("key", "key2").distinct()
    a, b = free_name(docs, "key"), free_name(docs, "key2")
    first, second = row_key(docs)
    return (docs.withColumns({a: first, b: second})
            .join(bad.toDF(a, b), [a, b], "left_anti").select([quoted(c) for c in docs.columns]))


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with each text's hit words and what stands between them taken out, and ``removed_spans``.

    A text without hits stays as it is; of one with hits the remaining words
    (in lower case) are joined by single spaces.
    """
    docs = docs.select([quoted(c) for c in docs.columns if c.lower() != "removed_spans"])
    a, b = free_name(docs, "key"), free_name(docs, "key2")
    first, second = row_key(docs)
    both = docs.withColumns({a: first, b: second}).join(
        spans(docs, benchmark).select(F.col("key").alias(a), F.col("key2").alias(b), F.col("spans").alias("removed_spans")), [a, b], "left")
    kept = F.filter(words(text_or_empty()), lambda w, i: ~F.exists("removed_spans", lambda s: (i >= s["start"]) & (i < s["stop"])))
    text = F.when(F.col("removed_spans").isNull(), quoted("text")).otherwise(F.array_join(kept, " "))
    return both.select(*[text.alias(c) if c == "text" else quoted(c) for c in docs.columns], "removed_spans")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, least({WINDOW}, len(w)) AS n,
         array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS t
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT rid, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
s AS (SELECT rid, list_sort(list(DISTINCT item_id)) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)
"""
