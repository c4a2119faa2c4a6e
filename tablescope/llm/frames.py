"""Small helpers on frames that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.session import new_path

#: Folders of the tables that ``written`` has made, in order.
MADE: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Nothing then depends on the shuffle files of the job that made it; the driver
    forgets them at its next garbage collection, which is asked for here, so that the
    executors' disks hold one step's shuffles at a time and not all of them.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    MADE.append(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` as a table in the shared folder that is dealt by ``column``: joins on it move only the other side."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"{name}_{uuid.uuid4().hex}", new_path(spark, name)
    (df.repartition(buckets, quoted(column)).write.format("parquet").option("compression", "zstd")
     .bucketBy(buckets, column).option("path", path).saveAsTable(table))
    MADE.append(path)
    spark.sparkContext._jvm.System.gc()
    return spark.table(table)


def discard(table: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing will read again."""
    if files := table.inputFiles():
        discard_folder(table.sparkSession, files[0].rpartition("/")[0])


def discard_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever marks it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def few_by_hash(df: DataFrame, columns: list[str], wanted: int, rows: int) -> DataFrame:
    """The ``wanted`` rows of ``df`` (which has ``rows``) with the smallest hashes of ``columns``.

    Hashes are spread evenly, so a bound on them leaves about twice as many rows as
    wanted; only those are sorted and sent to the driver, however many tasks there are.
    """
    hashed = F.xxhash64(*[quoted(c) for c in columns])
    share = min(1.0, 2 * wanted / max(rows, 1))
    if share < 1.0:
        df = df.where(hashed < F.lit(int((share - 0.5) * 2 ** 64)))
    return df.orderBy(hashed, *[quoted(c) for c in columns]).limit(wanted)
