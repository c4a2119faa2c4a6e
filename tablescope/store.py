"""Analyses kept for the next time the same files are asked about."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.operators.cleaning import CleaningResult, _TableStats, _TextStats
from tablescope.operators.quality import Issue, Quality
from tablescope.pipeline import AnalysisBundle, build_analysis
from tablescope.plans import CleaningAction, CleaningOptions, CleaningPlan, Profile
from tablescope.session import work_folder

#: Part of every key: to be raised when the same input gives another analysis.
VERSION = 1


class _Files:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(name))] if self.exists(name) else []

    def age(self, name: str) -> float:
        """Seconds since a file was written, by the clock of its file system's machine."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        out.write(bytearray(text, "utf-8"))
        out.close()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        return not self.exists(new) and self.fs.rename(self.path(old), self.path(new))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@contextmanager
def _whole_plans(spark: SparkSession):
    """Plans are then written with all their columns."""
    key = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key)
    spark.conf.set(key, str(2 ** 31 - 1))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _plan_text(df: DataFrame) -> str | None:
    """What a table computes, without the numbers that differ by session; None if that depends on more than files."""
    plan = df._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    kinds = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
    if kinds != {"LogicalRelation"} or not plan.deterministic() or not df.inputFiles():
        return None
    with _whole_plans(df.sparkSession):
        return re.sub(r"#\d+L?", "", plan.toString())


def source_fingerprint(df: DataFrame) -> str | None:
    """A digest of a table's plan and of path, size and time of all its files; None if it does not come from files only.

    Spark lists the files and sums hashes of them; no file is opened.
    """
    text = _plan_text(df)
    if text is None:
        return None
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(p)).toString() if "%" in p else p for p in df.inputFiles()]
    listed = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    halves = [F.sum(F.xxhash64(F.lit(seed), "path", "length", "modificationTime").cast("decimal(38,0)")) for seed in (1, 2)]
    row = listed.agg(F.count("*"), F.sum("length"), *halves).first()
    return hashlib.sha256("\n".join([text, *map(str, row)]).encode()).hexdigest()


class AnalysisStore:
    """Analyses by what they were made of: the table's plan, its files and the options.

    An entry is a folder named by its key: the cleaned table, a manifest with everything
    else, and a lease for each open analysis. The manifest comes last and under its final
    name at once, so a half-made entry is never opened, and of two builders of one
    key the first wins. The least recently used entries go when there are more than ``keep``;
    those with a lease younger than ``lease_hours`` stay.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, keep: int = 20, lease_hours: float = 24.0):
        self.spark, self.keep, self.lease_seconds = spark, keep, lease_hours * 3600
        self.files = _Files(spark, folder or f"{work_folder(spark)}/analyses")
        self._leases: dict[int, str] = {}

    def key(self, raw: DataFrame, options: CleaningOptions | None = None, roles=None, **elected) -> str | None:
        """Name of the entry for these arguments; None if the table does not come from files only."""
        source = source_fingerprint(raw)
        if source is None:
            return None
        asked = json.dumps([VERSION, source, asdict(options or CleaningOptions()), roles or {}, elected],
                           sort_keys=True, default=repr)
        return hashlib.sha256(asked.encode()).hexdigest()[:32]

    def build(self, raw: DataFrame, options: CleaningOptions | None = None, roles=None, **elected) -> AnalysisBundle:
        """The analysis of ``raw``: from its entry if there is one, without reading ``raw``, else made and kept."""
        key = self.key(raw, options, roles, **elected)
        if key is None:
            return build_analysis(raw, options, roles, **elected)
        if not self.files.exists(f"{key}/manifest.json"):
            self._make(key, raw, options, roles, elected)
        return self._open(key, raw)

    def _make(self, key: str, raw: DataFrame, options, roles, elected) -> None:
        bundle = build_analysis(raw, options, roles, **elected)
        mine = uuid.uuid4().hex[:12]
        bundle.data.write.parquet(f"{self.files.folder}/{key}/data-{mine}")
        done, quality = bundle.cleaning, bundle.quality
        manifest = {
            "data": f"data-{mine}", "schema": bundle.data.schema.json(), "plan": done.plan.to_json(),
            "actions": [asdict(a) for a in done.actions], "rejected_values": done.rejected_values,
            "rejected_counts": done.rejected_counts, "duplicate_rows_removed": done.duplicate_rows_removed,
            "duplicate_id_rows": done.duplicate_id_rows, "raw_rows": done.raw_rows, "stats": asdict(done.stats),
            "profile": bundle.profile.to_json(), "quality": asdict(quality),
            "structure": {k: v for k, v in bundle.structure.items() if k != "profile"}}
        self.files.write(f"{key}/manifest-{mine}", json.dumps(manifest, ensure_ascii=False))
        if not self.files.rename(f"{key}/manifest-{mine}", f"{key}/manifest.json"):
            self.files.delete(f"{key}/manifest-{mine}")  # another builder was first
            self.files.delete(f"{key}/data-{mine}")
        self.evict(spare=key)

    def _open(self, key: str, raw: DataFrame) -> AnalysisBundle:
        from pyspark.sql.types import StructType

        lease = f"{key}/leases/{uuid.uuid4().hex}"
        self.files.write(lease, "")
        self.files.write(f"{key}/used", "")
        m = json.loads(self.files.read(f"{key}/manifest.json"))
        schema = StructType.fromJson(json.loads(m["schema"]))
        data = self.spark.read.schema(schema).parquet(f"{self.files.folder}/{key}/{m['data']}")
        stats = _TableStats(**{**m["stats"], "text": {int(i): _TextStats(**t) for i, t in m["stats"]["text"].items()}})
        cleaning = CleaningResult(
            data, CleaningPlan.from_json(m["plan"]), [CleaningAction(**a) for a in m["actions"]], m["rejected_values"],
            m["rejected_counts"], m["duplicate_rows_removed"], m["duplicate_id_rows"], m["raw_rows"], stats)
        profile = Profile.from_json(m["profile"])
        quality = Quality(**{**m["quality"], "issues": [Issue(**i) for i in m["quality"]["issues"]]})
        bundle = AnalysisBundle(raw, data, cleaning, profile, {**m["structure"], "profile": profile}, quality)
        self._leases[id(bundle)] = lease
        return bundle

    def release(self, bundle: AnalysisBundle) -> None:
        """Give up an opened analysis: its table may then be deleted."""
        if lease := self._leases.pop(id(bundle), None):
            self.files.delete(lease)

    def _leased(self, key: str) -> bool:
        return any(self.files.age(f"{key}/leases/{n}") < self.lease_seconds for n in self.files.names(f"{key}/leases"))

    def entries(self) -> list[str]:
        """Keys of the finished entries, the last used first."""
        done = [k for k in self.files.names() if self.files.exists(f"{k}/manifest.json")]
        return sorted(done, key=lambda k: self.files.age(f"{k}/used" if self.files.exists(f"{k}/used") else f"{k}/manifest.json"))

    def evict(self, keep: int | None = None, spare: str = "") -> list[str]:
        """Delete what is past the ``keep`` last used entries and not leased, and builds given up long ago; their keys."""
        known = self.entries()
        gone = [k for k in known[self.keep if keep is None else keep:] if k != spare and not self._leased(k)]
        for name in self.files.names():
            if name not in known and name != spare and self.files.age(name) > self.lease_seconds:
                gone.append(name)
        for name in gone:
            self.files.delete(name)
        return gone
