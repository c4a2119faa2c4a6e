"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # `ID` and `id` are two columns.
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on; every one is a runtime setting."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_folder(spark: SparkSession) -> str:
    """Folder that all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session may do without that setting: its one machine then
    holds driver and executors alike.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    # local-cluster[...] has executors of its own, so it is no such session
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = os.path.join(tempfile.gettempdir(), f"tablescope-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # only what this session made itself
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later passes then scan typed columns, pruned, instead of parsing the source
    again, and a lost executor costs a re-read rather than the whole lineage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
