"""Token-id files: compressed, checksummed blocks in document order.

A file is a Parquet table. A row is a run of whole documents: their keys and
numbers of ids, the number of ids before the run in its part, and the run's ids as
blocks of ``idcoder``. Parts are ranges of the key; the ids before a part follow
from the parts' totals, one number each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm import idcoder
from tablescope.llm.frames import quoted, text_or_empty
from tablescope.llm.tokens import Encoder

#: Ids of a run, unless one document has more.
RUN_IDS = 1 << 17
#: Blocks that are coded side by side.
LANES = 1536
BLOCKS = "array<struct<n: int, crc: bigint, units: binary>>"


class BrokenBlock(ValueError):
    """A block's ids don't have the checksum that was written with them."""


def _blocks(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[i:i + idcoder.BLOCK] for i in range(0, len(ids), idcoder.BLOCK)]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of each whole text, then ``end_id``, in ascending order of ``key``.

    Null texts are empty; null keys come first; rows with equal keys are ordered by
    their texts. Other columns are not kept.
    """
    ordered = (docs.select(quoted(key).alias("key"), text_or_empty(text).alias("text"))
               .repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text"))
    key_type = ordered.schema["key"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("run", T.IntegerType()),
        T.StructField("before", T.LongType()), T.StructField("keys", T.ArrayType(key_type)),
        T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("total", T.LongType()),
        T.StructField("blocks", T.ArrayType(T.StructType([
            T.StructField("n", T.IntegerType()), T.StructField("crc", T.LongType()), T.StructField("units", T.BinaryType())])))])
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, number = TaskContext.get().partitionId(), 0, 0
        encoder = Encoder.of(tokenizer)
        runs: list[tuple[pa.Array, list[int], np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal before, number
            cut = [_blocks(ids) for _, _, ids in runs]
            units = iter(idcoder.encode([b for blocks in cut for b in blocks]))
            rows = []
            for (keys, lengths, ids), blocks in zip(runs, cut):
                rows.append({"part": part, "run": number, "before": before, "keys": keys.to_pylist(), "lengths": lengths,
                             "total": len(ids), "blocks": [
                                 {"n": len(b), "crc": idcoder.checksum(b), "units": next(units)} for b in blocks]})
                before, number = before + len(ids), number + 1
            runs.clear()
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for batch in batches:
            arrow = _arrow_schema(batch.schema.field("key").type)
            keys, start, parts, size = batch.column("key"), 0, [], 0
            for i, ids in enumerate(encoder.encode(batch.column("text").to_pylist())):
                parts.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= RUN_IDS or i == batch.num_rows - 1:
                    runs.append((keys.slice(start, len(parts)), [len(p) // 4 for p in parts],
                                 np.frombuffer(b"".join(parts), "<u4").astype(np.int32)))
                    start, parts, size = i + 1, [], 0
                    if sum(len(r[2]) for r in runs) >= LANES * idcoder.BLOCK:
                        yield flush()
        if runs:
            yield flush()

    ordered.mapInArrow(encode, schema).write.parquet(path)


def _arrow_schema(key: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("part", pa.int32()), ("run", pa.int32()), ("before", pa.int64()), ("keys", pa.list_(key)),
        ("lengths", pa.list_(pa.int32())), ("total", pa.int64()),
        ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("crc", pa.int64()), ("units", pa.binary())])))])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, ids) of every document in the files; raises BrokenBlock where a checksum fails.

    ``ids`` are little-endian 32-bit numbers in a binary; ``start`` counts the ids of
    all documents before.
    """
    table = spark.read.parquet(path)
    totals = table.groupBy("part").agg(F.sum("total").alias("total")).orderBy("part").collect()  # a row for each part
    starts, done = {}, 0
    for r in totals:
        starts[r["part"]], done = done, done + r["total"]
    key_type = table.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("key", key_type), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in _portions(batch):
                blocks = [b for row in few.column("blocks").to_pylist() for b in row]
                ids = idcoder.decode([b["units"] for b in blocks], [b["n"] for b in blocks])
                for b, found in zip(blocks, ids):
                    if idcoder.checksum(found) != b["crc"]:
                        raise BrokenBlock(f"a block of {b['n']} ids")
                data = np.concatenate(ids or [np.zeros(0, np.int32)]).astype("<u4").tobytes()
                lists = few.column("lengths")
                lengths = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(lengths)
                runs = lists.value_lengths().to_numpy(zero_copy_only=False)
                first = np.array([starts[p] for p in few.column("part").to_pylist()]) + few.column("before").to_numpy()
                inside = ends - lengths
                begin = np.repeat(first - inside[np.cumsum(runs) - runs], runs) + inside
                yield pa.RecordBatch.from_arrays([
                    few.column("keys").flatten(), pa.array(begin, pa.int64()),
                    pa.array([data[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist())], pa.binary())],
                    names=["key", "start", "ids"])

    return table.select("part", "before", "keys", "lengths", "blocks").mapInArrow(decode, schema)


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, as many together as fill the lanes."""
    start, blocks = 0, 0
    for i, n in enumerate(batch.column("blocks").value_lengths().to_pylist()):
        blocks += n
        if blocks >= LANES or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start)
            start, blocks = i + 1, 0


def id_report(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, from the files that it writes to ``path``."""
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path).select(
        F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))
