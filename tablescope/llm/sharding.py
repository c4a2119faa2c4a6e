"""Contiguous shards of equal bytes: global prefix sums, cut at equal targets.

Rows are sorted by key into range parts. Each part's rows and bytes are summed, the
driver adds up one pair of numbers for each part, and a row's place in the whole is
its part's start plus the running sum inside the part. A row belongs to the shard
that its middle byte falls into, so shards are runs of the order and differ from an
equal share by one row's bytes at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.frames import free_name, quoted, text_or_empty, written


def sharded(df: DataFrame, shards: int, size: str, order: list[str]) -> DataFrame:
    """``df`` with shard (int, from 0) and slot (long, gapless in each shard), which replace such columns.

    ``size`` is a column of whole numbers, not negative; null counts as 0. Rows are in the
    ascending order of ``order``, nulls first; the order of equal rows is any.
    """
    df = df.select([quoted(c) for c in df.columns if c.lower() not in ("shard", "slot")])
    names = [free_name(df, n) for n in ("part", "number", "upto", "bytes")]
    part, number, upto, size_of = names
    keys = [quoted(c) for c in order]
    # the row number spreads equal keys over parts, so that no part has to hold them all
    dealt = (df.withColumn(number, F.monotonically_increasing_id()).repartitionByRange(*keys, quoted(number))
             .withColumn(part, F.spark_partition_id()))
    table = written(dealt.withColumn(size_of, F.coalesce(quoted(size).cast("long"), F.lit(0))), "parts")
    inside = Window.partitionBy(part).orderBy(*keys, quoted(number)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = table.withColumns({upto: F.sum(size_of).over(inside), number: F.row_number().over(inside)})
    totals = table.groupBy(part).agg(F.count("*").alias("rows"), F.sum(size_of).alias("bytes")).orderBy(part).collect()
    starts, rows, done = [], 0, 0  # one line for each part
    for t in totals:
        starts.append((t[0], rows, done))
        rows, done = rows + t["rows"], done + t["bytes"]
    spark = df.sparkSession
    first_row, first_byte = free_name(summed, "first_row"), free_name(summed, "first_byte")
    begins = spark.createDataFrame(starts, f"`{part}` int, `{first_row}` long, `{first_byte}` long")
    middle = 2 * (F.col(first_byte) + F.col(upto)) - F.col(size_of)
    target = F.lit(max(2 * done, 1))
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / target)).cast("int")
    placed = summed.join(F.broadcast(begins), part).withColumns(
        {"shard": shard, "slot": F.col(first_row) + F.col(number) - 1})
    firsts = placed.groupBy("shard").agg(F.min("slot").alias(first_byte))  # a line for each shard
    return (placed.drop(first_byte).join(F.broadcast(firsts), "shard")
            .select(*[quoted(c) for c in df.columns], "shard", (F.col("slot") - F.col(first_byte)).alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` to ``path`` with a folder for each shard, by the bytes of ``text`` and one more for each row."""
    size = free_name(docs, "size")
    sized = docs.withColumn(size, F.octet_length(text_or_empty(text)) + 1)
    sharded(sized, shards, size, [key]).drop(size).write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; a null text counts as empty."""
    light = docs.select("doc_id", (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
                        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    return sharded(light, shards, "size", ["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
