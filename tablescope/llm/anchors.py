"""Which documents may share a long run with another one.

A window's minimizer is the smallest hash of the short pieces inside it. Equal
windows have equal minimizers, so a window whose minimizer stands in one document
only is unique, and only the others go on. A document yields a minimizer about
every half window, and nothing but those hashes is shuffled for the whole corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.frames import MADE, discard, quoted, text_or_empty, written
from tablescope.session import new_path

_MULTIPLIER = 0x9E3779B97F4A7C15
#: Characters of texts that are hashed together.
TOGETHER = 1_000_000
#: Parts of the minimizers that are counted one after the other, since each of them is moved twice.
PASSES = 4


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def rolled(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of x[i:i+k] for each i; hashes of 1, 2, 4 ... values are put together."""
    total, length = np.zeros(len(x) + 1, np.uint64), 0
    part, size = x, 1
    while True:
        if k & size:  # the values so far, then this part
            n = max(len(x) - length - size + 1, 0)
            total = total[:n] * np.uint64(pow(_MULTIPLIER, size, 1 << 64)) + part[length:length + n]
            length += size
        if 2 * size > k:
            return mixed(total)
        n = max(len(part) - size, 0)
        part = part[:n] * np.uint64(pow(_MULTIPLIER, size, 1 << 64)) + part[size:size + n]
        size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for each i, in about log2(width) passes."""
    if len(x) < width:
        return x[:0]
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Windows:
    """All windows of some texts, as positions in their values laid end to end.

    ``owner`` is the text of each window and ``at`` its place in that text;
    ``minimizer`` its minimizer. Windows never cross from one text to the next.
    """

    def __init__(self, values: np.ndarray, lengths: np.ndarray, window: int, piece: int):
        self.values = values
        counts = np.maximum(lengths - window + 1, 0)
        starts = np.cumsum(lengths) - lengths
        self.owner = np.repeat(np.arange(len(lengths)), counts)
        self.at = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.place = np.repeat(starts, counts) + self.at
        self.minimizer = sliding_min(rolled(values, piece), window - piece + 1)[self.place]

    def changes(self) -> np.ndarray:
        """Windows whose minimizer is not that of the window before in the same text."""
        new = np.ones(len(self.owner), bool)
        new[1:] = (self.minimizer[1:] != self.minimizer[:-1]) | (self.owner[1:] != self.owner[:-1])
        return np.flatnonzero(new)


def portions(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of a batch, as many together as have ``TOGETHER`` characters of text."""
    ends = pdf["text"].str.len().cumsum().to_numpy() // TOGETHER
    for start, stop in zip(edges := np.flatnonzero(np.diff(ends, prepend=-1)), [*edges[1:], len(pdf)]):
        yield pdf.iloc[start:stop]


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, row, text): ``row`` tells apart texts that have the same key; equal rows share it."""
    return docs.select(quoted(key).alias("doc"), F.hash(text_or_empty(text)).alias("row"), text_or_empty(text).alias("text"))


def copies(rows: DataFrame) -> DataFrame:
    """(doc, row, first): every keyed text and the smallest key that has the very same text."""
    digests = written(rows.where("doc IS NOT NULL").select(
        "doc", "row", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    least = digests.groupBy("digest").agg(F.min("doc").alias("first"))
    known = written(digests.join(least, "digest").select("doc", "row", "first").distinct(), "copies")
    discard(digests)
    return known


def _by_text(texts: DataFrame, name: str) -> DataFrame:
    """``texts`` as a table bucketed by (doc, row)."""
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"{name}_{uuid.uuid4().hex}", new_path(spark, name)
    (texts.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "doc", "row")
     .option("path", path).saveAsTable(table))
    MADE.append(path)
    spark.sparkContext._jvm.System.gc()
    return spark.table(table)


def candidates(rows: DataFrame, known: DataFrame, windows: Callable[[list[str]], Windows]) -> DataFrame:
    """(doc, row, text, anchors): texts with a minimizer that a text of another key has too, and those minimizers.

    Of exact copies only the first takes part, and of equal rows one; texts without a
    key do not. Copies go before minimizers are taken, since a text shares all of its
    minimizers with its copies. The result is a table bucketed by (doc, row), so that
    joins with it move only what is joined to the texts.
    """
    doc_type = rows.schema["doc"].dataType.simpleString()

    def emit(batches):
        for pdf in batches:
            for some in portions(pdf):
                found = windows(some["text"].tolist())
                new = found.changes()
                yield pd.DataFrame({"doc": some["doc"].to_numpy()[found.owner[new]], "row": some["row"].to_numpy()[found.owner[new]],
                                    "anchor": found.minimizer[new].view(np.int64)})

    # tables that grow with the texts are joined the same way at every size
    firsts = _by_text(rows.where("doc IS NOT NULL").dropDuplicates(["doc", "row"]).join(
        known.where("doc = first").select("doc", "row").hint("merge"), ["doc", "row"]), "texts")
    each = written(firsts.select("doc", "row", "text").mapInPandas(emit, f"doc {doc_type}, row int, anchor long"), "minimizers")
    lists = []
    for k in range(PASSES):
        part = each.where(F.pmod("anchor", F.lit(PASSES)) == k)
        shared = written(part.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
                         .where("low < high").select("anchor"), "anchors")
        lists.append(written(part.join(shared.hint("merge"), "anchor").groupBy("doc", "row")
                             .agg(F.collect_set("anchor").alias("anchors")), "lists"))
        discard(shared)
    discard(each)
    anchors = reduce(DataFrame.unionAll, lists).groupBy("doc", "row").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))
    found = _by_text(firsts.join(anchors.hint("merge"), ["doc", "row"]), "candidates")
    for table in (firsts, *lists):
        discard(table)
    return found
