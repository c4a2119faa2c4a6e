"""Substring dedup on words: the repeated part of a de Bruijn graph, compacted.

Every window of 13 words is an edge between the 12 words it starts and ends with.
Edges found in two documents or more stay; where a node joins one edge to one
other, and both were first seen side by side, a Spark join makes them one path. A
path is a stretch of its first document, and that stretch's words, fetched by
coordinates, are compared with every place that the path's edges stand at before
anything is removed there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.anchors import Windows, candidates, copies, keyed, portions, rolled
from tablescope.llm.frames import discard, free_name, quoted, text_or_empty, written

WINDOW = 13
#: Words of the pieces that minimizers are taken from.
PIECE = 7
_REMEMBERED = 500_000


class _WordHashes(dict):
    """8-byte hashes of words; forgets when full."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_digest(word)
        return value


_HASHES = _WordHashes()


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), ">u8").astype(np.uint64)


def windows(texts: list[str]) -> Windows:
    words = [split(t) for t in texts]
    values = hashed([w for part in words for w in part])
    return Windows(values, np.fromiter(map(len, words), np.int64, len(words)), WINDOW, PIECE)


def _edges(batches):
    """doc, row, pos and the two nodes of every window whose minimizer is among ``anchors``."""
    for pdf in batches:
        for some in portions(pdf):
            found = windows(some["text"].tolist())
            shared = np.concatenate([np.asarray(a, np.int64) for a in some["anchors"]]).view(np.uint64)
            at = np.flatnonzero(np.isin(found.minimizer, shared))
            nodes = rolled(found.values, WINDOW - 1).view(np.int64)
            owner, place = found.owner[at], found.place[at]
            yield pd.DataFrame({
                "doc": some["doc"].to_numpy()[owner], "row": some["row"].to_numpy()[owner],
                "pos": found.at[at].astype(np.int32), "source": nodes[place], "target": nodes[place + 1]})


def paths(edges: DataFrame) -> DataFrame:
    """(source, target, first_doc, first_row, first_pos, head): repeated edges, where each was first seen, and
    the position in that document at which its path begins."""
    graph = written(
        edges.groupBy("source", "target").agg(F.min(F.struct("doc", "pos", "row")).alias("first"), F.max("doc").alias("last"))
        .where("first.doc < last")
        .select("source", "target", F.col("first.doc").alias("first_doc"), F.col("first.row").alias("first_row"),
                F.col("first.pos").alias("first_pos")), "graph")
    # a node that one edge enters and one edge leaves joins the two into a path
    ends = graph.select(F.col("target").alias("node"), F.lit(1).alias("enters")).unionAll(
        graph.select(F.col("source").alias("node"), F.lit(0).alias("enters")))
    through = (ends.groupBy("node").agg(F.sum("enters").alias("enters"), F.count("*").alias("both"))
               .where("enters = 1 AND both = 2").select(F.col("node").alias("source"), F.lit(True).alias("through")))
    linked = graph.join(through, "source", "left")
    # along its first document a path goes on where the edge before ends in such a node
    order = Window.partitionBy("first_doc", "first_row").orderBy("first_pos", "source", "target")
    goes_on = (F.coalesce("through", F.lit(False)) & (F.lag("target").over(order) == F.col("source"))
               & (F.lag("first_pos").over(order) + 1 == F.col("first_pos")))
    marked = linked.withColumn("head", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("first_pos")))
    found = written(marked.withColumn("head", F.last("head", ignorenulls=True).over(order)).drop("through"), "paths")
    discard(graph)
    return found


def spans_of(places: DataFrame) -> DataFrame:
    """Neighbouring places of one path at one distance make a span: its first word and its number of windows."""
    span = ["doc", "row", "first_doc", "first_row", "head", "shift"]
    each = places.select("doc", "row", "first_doc", "first_row", "head", (F.col("pos") - F.col("first_pos")).alias("shift"), "pos")
    island = F.col("pos") - F.dense_rank().over(Window.partitionBy(*span).orderBy("pos"))
    return each.withColumn("island", island).groupBy(*span, "island").agg(
        F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + 1).alias("n")).drop("island")


def _path_words(batches):
    for pdf in batches:
        out = []
        for doc, row, text, asked in zip(pdf["doc"], pdf["row"], pdf["text"], pdf["asked"]):
            words = split(text)
            out += [(doc, row, a["head"], b" ".join(words[a["head"]:a["stop"] + WINDOW])) for a in asked]
        yield pd.DataFrame(out, columns=["first_doc", "first_row", "head", "words"])


def _removed(words: list[bytes], spans) -> np.ndarray:
    """Which words go: those of the windows whose words are those at the source."""
    gone = np.zeros(len(words), bool)
    sources: dict[bytes, list[bytes]] = {}
    for s in spans:
        source = sources.setdefault(s["words"], s["words"].split(b" "))
        start, stop = s["start"], s["start"] + s["n"] + WINDOW - 1
        there = start - s["shift"] - s["head"]
        if words[start:stop] == source[there:there + stop - start]:
            gone[start:stop] = True
            continue
        for k in range(s["n"]):  # equal hashes of different words
            if words[start + k:start + k + WINDOW] == source[there + k:there + k + WINDOW]:
                gone[start + k:start + k + WINDOW] = True
    return gone


def _cut(batches):
    for pdf in batches:
        out = []
        for doc, row, text, spans in zip(pdf["doc"], pdf["row"], pdf["text"], pdf["spans"]):
            words = split(text)
            gone = _removed(words, spans)
            kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
            out.append((doc, row, int(gone.sum()), kept.decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(out, columns=["doc", "row", "n_removed", "kept"])


def cuts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, row, n_removed, kept): for each text that loses words and is no exact copy, how many, and the rest."""
    doc_type = rows.schema["doc"].dataType.simpleString()
    texts = candidates(rows, known, windows)
    edges = texts.mapInPandas(_edges, f"doc {doc_type}, row int, pos int, source long, target long")
    graph = paths(edges)
    # one number for an edge, half the bytes to move; equal ones of other edges fall to the comparison of words
    edge = F.xxhash64("source", "target").alias("edge")
    places = (edges.select("doc", "row", "pos", edge)
              .join(graph.select(edge, "first_doc", "first_row", "first_pos", "head"), "edge").where("doc > first_doc"))
    spans = written(spans_of(places), "spans")
    discard(graph)
    asked = (spans.groupBy("first_doc", "first_row", "head")
             .agg(F.max(F.expr("start - shift + n - 1")).alias("stop"))
             .groupBy(F.col("first_doc").alias("doc"), F.col("first_row").alias("row"))
             .agg(F.collect_list(F.struct("head", "stop")).alias("asked")))
    sources = texts.select("doc", "row", "text").join(asked, ["doc", "row"]).mapInPandas(
        _path_words, f"first_doc {doc_type}, first_row int, head int, words binary")
    told = (spans.join(sources, ["first_doc", "first_row", "head"])
            .groupBy("doc", "row").agg(F.collect_list(F.struct("head", "shift", "start", "n", "words")).alias("spans")))
    return texts.select("doc", "row", "text").join(written(told, "told"), ["doc", "row"]).mapInPandas(
        _cut, f"doc {doc_type}, row int, n_removed long, kept string")


def normal(text: Column) -> Column:
    """The words of ``text``, joined by single spaces."""
    return F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))


def count(normal_text: Column) -> Column:
    return F.when(normal_text == "", F.lit(0)).otherwise(
        F.length(normal_text) - F.length(F.replace(normal_text, F.lit(" "), F.lit(""))) + 1).cast("long")


def span_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of ``docs``.

    Null texts count as empty. Rows with a null doc_id keep all their words and are
    no source; repeated rows get the same result each, and rows with the same
    doc_id are no source for each other.
    """
    rows = keyed(docs)
    known = copies(rows)
    cut = cuts(rows, known).select("doc", "row", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    whole = (rows.select("doc", "row", normal(F.col("text")).alias("words"))
             .select("doc", "row", count(F.col("words")).alias("n"), F.sha2("words", 256).alias("digest")))
    copied = known.where("doc > first").select("doc", "row", F.lit(True).alias("copied"))
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n") >= WINDOW)
    return (whole.join(copied, ["doc", "row"], "left").join(cut, ["doc", "row"], "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_words"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256")))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated windows' words; texts that lose none stay as they are.

    Of a text that loses words, the rest is joined by single spaces; an exact copy of
    an earlier text of 13 words or more becomes empty.
    """
    rows = keyed(docs, key, text)
    known = copies(rows)
    cut = cuts(rows, known)
    names = {n: free_name(docs, n) for n in ("row", "kept", "copied")}
    changed = (known.where("doc > first").select("doc", "row", F.lit(True).alias(names["copied"]))
               .join(cut.select("doc", "row", F.col("kept").alias(names["kept"])), ["doc", "row"], "full")
               .withColumnRenamed("row", names["row"]).withColumnRenamed("doc", free_name(docs, "doc")))
    numbered = docs.withColumns({names["row"]: F.hash(text_or_empty(text)), free_name(docs, "doc"): quoted(key)})
    long_enough = count(normal(text_or_empty(text))) >= WINDOW
    new = (F.when(quoted(names["copied"]) & long_enough, F.lit(""))
           .when(quoted(names["kept"]).isNotNull(), quoted(names["kept"])).otherwise(quoted(text)))
    joined = numbered.join(changed, [free_name(docs, "doc"), names["row"]], "left")
    return joined.select([(new if c == text else quoted(c)).alias(c) for c in docs.columns])


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS t
      FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
f AS (SELECT t, min(doc_id) AS first FROM g GROUP BY t HAVING count(*) > 1),
p AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS k FROM g JOIN f USING (t) WHERE g.doc_id > first),
r AS (SELECT rid, list(k) AS gone FROM p GROUP BY rid),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY k) AS kept
      FROM (SELECT d.rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d JOIN r USING (rid)) x
      WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.rid = x.rid AND p.k = x.k) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN r USING (rid) LEFT JOIN k USING (rid)
"""
