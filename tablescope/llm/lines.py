"""Line dedup with DataFrame functions only.

Every line is normalised and hashed, the distinct documents of each hash are
counted, lines over the threshold are found by their hash, and texts are put
together again from the positions that stay. Only hashes, ids and positions are
shuffled to count and to find; a text moves once, to meet the positions it loses.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.frames import discard, free_name, quoted, text_or_empty, written

MIN_CHARS = 20
MIN_DOCS = 3
#: Hashes of a broadcast at most, 24 bytes each.
BROADCAST_KEYS = 1_000_000
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case."""
    key = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(key) == F.char_length(key)
    return F.when(ascii_only, F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def text_lines(text: str = "text") -> Column:
    return F.split(text_or_empty(text), "\n")


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, row, pos, h1, h2): the lines of ``docs`` that may go, with 128 bits of their key's hash.

    ``row`` tells texts of one id apart; equal rows are the same. Rows without an id are no document.
    """
    cut = docs.where(quoted(key).isNotNull()).select(
        quoted(key).alias("doc"), F.xxhash64(text_or_empty(text)).alias("row"), F.posexplode(text_lines(text)).alias("pos", "line"))
    keyed = cut.where(F.char_length(F.btrim("line", F.lit(SPACE))) >= min_chars).select("doc", "row", "pos", line_key(F.col("line")).alias("line"))
    return keyed.select("doc", "row", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def crowded(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, docs, last): the hashes that stand in ``min_docs`` documents or more, and the largest id of these.

    Lines are first made distinct by hash and document, so that one line of a third of
    all documents is counted by many tasks and arrives as one row from each.
    """
    return (lines.select(*HASH, "doc").distinct().groupBy(*HASH)
            .agg(F.count("*").alias("docs"), F.max("doc").alias("last")).where(F.col("docs") >= min_docs))


def dropped_places(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row, gone): for each text that loses lines, the positions of these.

    A hash of ``s / BROADCAST_KEYS`` documents or more, ``s`` being the sum over all
    hashes, is one of at most BROADCAST_KEYS, so these are broadcast and no hot line
    is shuffled by its hash. Rarer ones, of which no one is hot, are joined by a shuffle.
    """
    hot = written(crowded(lines, min_docs), "crowded")
    total = hot.agg(F.sum("docs")).first()[0] or 0
    often = max(min_docs, math.ceil(total / BROADCAST_KEYS))
    keep = F.col("doc") < F.col("last")
    found = lines.join(F.broadcast(hot.where(F.col("docs") >= often).select(*HASH, "last")), HASH).where(keep)
    if often > min_docs:
        found = found.unionAll(lines.join(hot.where(F.col("docs") < often).select(*HASH, "last"), HASH).where(keep))
    places = written(found.groupBy("doc", "row").agg(F.collect_set("pos").alias("gone")), "places")
    discard(hot)
    return places


def without_places(lines: Column, gone: Column) -> Column:
    """The lines at all other positions, in order, joined by ``\\n``."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.transform(F.array(lines), lambda whole: F.array_join(F.transform(stay, lambda p: F.get(whole, p)), "\n"))[0]


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                      key: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` without the lines that ``min_docs`` documents or more share, but for those of the largest id.

    A line's key is the line without white space at its ends, A-Z in lower case; keys
    under ``min_chars`` code points always stay. Texts that lose nothing stay as they are,
    null ones null. Rows without an id keep all lines and are not counted; of rows that
    share an id each keeps the lines or all lose them, and they are one document.
    With ``counts`` come n_lines (before) and n_dropped (both long), which replace such columns.
    """
    lines = written(long_lines(docs, min_chars, key, text), "lines")
    places = dropped_places(lines, min_docs)
    discard(lines)
    if counts:
        docs = docs.select([quoted(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    names = [free_name(docs, n) for n in ("doc", "row", "gone")]
    doc, row, gone = map(F.col, names)
    both = docs.withColumn(names[1], F.xxhash64(text_or_empty(text))).join(
        places.toDF(names[0], "_" + names[1], names[2]).hint("merge"), (quoted(key) == doc) & (row == F.col("_" + names[1])), "left")
    cut = F.when(gone.isNull(), quoted(text)).otherwise(without_places(text_lines(text), gone))
    extra = [F.size(text_lines(text)).cast("long").alias("n_lines"),
             F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped")] if counts else []
    return both.select(*[cut.alias(text) if c == text else quoted(c) for c in docs.columns], *extra)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 for every row of ``docs``; a null text is one empty line."""
    light = docs.select("doc_id", text_or_empty().alias("text"))
    return drop_common_lines(light, counts=True).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, pos, ls[pos] AS line, translate(trim(ls[pos], {_BLANK}), '{UPPER}', '{LOWER}') AS k
      FROM (SELECT rid, doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM d)),
c AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= {MIN_CHARS} AND doc_id IS NOT NULL
      GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT rid, pos, line, c.k IS NOT NULL AND doc_id < last AS gone FROM l LEFT JOIN c USING (k)),
t AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
             string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)) AS kept
      FROM j GROUP BY rid)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d JOIN t USING (rid)
"""
