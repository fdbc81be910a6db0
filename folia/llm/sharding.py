"""Sharding by size-tiered compaction with a versioned manifest.

Arrivals are appended as small immutable runs.  Runs of about the same size
form a tier; a tier that has ``fan_in`` of them is merged into one run of
target-sized files.  Which runs make the table is told by a manifest alone.
Each change writes a new version under a name that must not exist yet, so of
two writers one gets it, and a reader sees the old table or the new one.  Files
of older versions stay readable until ``expire()`` drops those versions.

Reading, merging and writing are DataFrame operations.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import scrambled
from .runtime import free_name, hadoop_path, new_path

#: Times that an append is tried again on what another writer has committed.
ATTEMPTS = 20


class ManifestConflict(RuntimeError):
    """Another writer has committed the version."""


class ShardedTable:
    """A table of immutable Parquet runs under ``root``, a folder of any store Spark writes."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, smallest: int = 1 << 20, fan_in: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.smallest, self.fan_in = target_bytes, smallest, fan_in

    # manifests

    def _files(self, path: str, suffix: str) -> list[tuple[str, int]]:
        fs, p = hadoop_path(self.spark, path)
        if not fs.exists(p):
            return []
        return sorted((str(s.getPath()), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix))

    def versions(self) -> list[int]:
        return [int(f.rsplit("/", 1)[1][1:-5]) for f, _ in self._files(f"{self.root}/manifests", ".json")]

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "runs": []}
        fs, p = hadoop_path(self.spark, f"{self.root}/manifests/v{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, runs: list[dict]) -> dict:
        """Publish ``runs`` as the version after ``base``; raises ManifestConflict if there is one.

        A finished draft gets the version's name by a hard link on local disks,
        and by a rename elsewhere; both leave a name that is taken alone, the
        rename on stores that keep HDFS's rule.  The writer's mark is read back.
        """
        manifest = {"version": base + 1, "mark": uuid.uuid4().hex, "runs": runs}
        fs, final = hadoop_path(self.spark, f"{self.root}/manifests/v{base + 1:012d}.json")
        _, draft = hadoop_path(self.spark, f"{self.root}/drafts/{manifest['mark']}")
        stream = fs.create(draft, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        fs.mkdirs(final.getParent())
        taken = fs.exists(final)
        if not taken and fs.getUri().getScheme() == "file":
            files = self.spark.sparkContext._jvm.java.nio.file
            path = lambda p: files.Paths.get(p.toUri())
            try:
                files.Files.createLink(path(fs.makeQualified(final)), path(fs.makeQualified(draft)))
            except Exception as e:  # the JVM's errors come wrapped
                if "FileAlreadyExists" not in str(e):
                    raise
                taken = True
        elif not taken:
            taken = not fs.rename(draft, final)
        fs.delete(draft, False)
        if taken or self.manifest(base + 1).get("mark") != manifest["mark"]:
            raise ManifestConflict(f"version {base + 1} exists")
        return manifest

    # data

    def _run(self, path: str, level: int, rows: int) -> dict:
        files = self._files(path, ".parquet")
        return {"id": path.rsplit("/", 1)[1], "level": level, "rows": rows, "bytes": sum(n for _, n in files), "files": [f for f, _ in files],
            "sizes": [n for _, n in files]}

    def append(self, arrivals: DataFrame) -> dict:
        """Add the rows as one run."""
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        arrivals.write.parquet(path)
        return self.add(path, self.spark.read.schema(arrivals.schema).parquet(path).count())

    def add(self, path: str, rows: int) -> dict:
        """Add the Parquet files of a folder, ``rows`` rows in all, as one run.  Appends commute, so a conflict is tried again."""
        run = self._run(path, 0, rows)
        for _ in range(ATTEMPTS):
            base = self.manifest()
            try:
                return self.commit(base["version"], base["runs"] + [run])
            except ManifestConflict:
                continue
        raise ManifestConflict("other writers came first each time")

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fan_in)) + 1) if size >= self.smallest else 0

    def full_tiers(self, manifest: dict) -> list[list[dict]]:
        """Runs of the tiers that have ``fan_in`` or more, smallest tier first."""
        tiers: dict[int, list[dict]] = {}
        for run in manifest["runs"]:
            tiers.setdefault(self.tier(run["bytes"]), []).append(run)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in]

    def compact(self) -> dict:
        """Merge full tiers, smallest first, until none is full.

        If another writer commits meanwhile, ManifestConflict leaves the table
        as that writer made it, and what was merged is in no version.
        """
        while True:
            manifest = self.manifest()
            full = self.full_tiers(manifest)
            if not full:
                return manifest
            merged = full[0]
            size, rows, path = sum(r["bytes"] for r in merged), sum(r["rows"] for r in merged), f"{self.root}/runs/{uuid.uuid4().hex}"
            files = [f for r in merged for f in r["files"]]
            if files:
                self.spark.read.schema(self.schema(files)).parquet(*files).coalesce(max(1, math.ceil(size / self.target_bytes))).write.parquet(path)
            gone = {r["id"] for r in merged}
            fresh = [self._run(path, 1 + max(r["level"] for r in merged), rows)] if files else []
            self.commit(manifest["version"], [r for r in manifest["runs"] if r["id"] not in gone] + fresh)

    def expire(self, keep: int = 1) -> None:
        """Drop all versions but the last ``keep``, and the files that only dropped ones name.  Their readers fail."""
        versions = sorted(self.versions())
        old, kept = versions[:-keep], versions[-keep:]
        needed = {f for v in kept for r in self.manifest(v)["runs"] for f in r["files"]}
        for f in sorted({f for v in old for r in self.manifest(v)["runs"] for f in r["files"]} - needed):
            fs, p = hadoop_path(self.spark, f)
            fs.delete(p, False)
        for v in old:
            fs, p = hadoop_path(self.spark, f"{self.root}/manifests/v{v:012d}.json")
            fs.delete(p, False)

    def schema(self, files: list[str]):
        """The columns of all files; types that can't be merged raise."""
        return self.spark.read.option("mergeSchema", "true").parquet(*files).schema

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default; raises ValueError before the first append with rows."""
        files = [f for r in self.manifest(version)["runs"] for f in r["files"]]
        if not files:
            raise ValueError("the table has no rows yet")
        return self.spark.read.schema(self.schema(files)).parquet(*files)


def in_arrivals(table: ShardedTable, documents: DataFrame, arrivals: int = 21) -> int:
    """Append ``documents`` as ``arrivals`` that come one after the other, in three sizes, with a compaction after each.

    The arrivals are written in one pass, by a number drawn from the first
    column, and each with rows is committed by itself.  Versions before the last
    expire as it goes.  Returns how many there were.
    """
    number = free_name("arrival", *documents.columns)
    share = scrambled(F.col(f"`{documents.columns[0].replace('`', '``')}`")) % (4 * arrivals)
    third = arrivals // 3  # the first third is small, and the last arrivals are large
    drawn = F.when(share < third, share).otherwise(F.lit(third) + F.pmod(share, F.lit(max(1, arrivals - third))))
    stage = f"{table.root}/runs/{uuid.uuid4().hex}"
    documents.withColumn(number, drawn.cast("int")).write.partitionBy(number).parquet(stage)
    fs, p = hadoop_path(table.spark, stage)
    folders = {int(str(s.getPath().getName()).split("=")[1]): str(s.getPath()) for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith(number + "=")}
    if not folders:
        return 0
    counts = dict(table.spark.read.parquet(stage).groupBy(number).count().collect())
    for k in sorted(folders):
        table.add(folders[k], counts.get(k, 0))
        table.compact()
        table.expire()
    return len(folders)


def sharded(documents: DataFrame, arrivals: int = 21, root: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The rows of ``documents`` after in_arrivals(), read back by the last manifest, and what it tells.

    That is n_arrivals, version_rows (the rows of its runs), n_full_tiers (tiers
    that still ask to be merged) and n_oversized (files of more than twice the
    target).  Rows come back as they were, repeated ones and nulls included, with
    columns of any names.  An empty table comes back empty.
    """
    table = ShardedTable(documents.sparkSession, root or new_path(documents.sparkSession, "shards"))
    came = in_arrivals(table, documents, arrivals)
    manifest = table.manifest()
    rows = table.read().select(*[F.col(f"`{c.replace('`', '``')}`") for c in documents.columns]) if came else documents.limit(0)
    return rows, {
        "n_arrivals": came, "version_rows": sum(r["rows"] for r in manifest["runs"]), "n_full_tiers": len(table.full_tiers(manifest)),
        "n_oversized": sum(n > 2 * table.target_bytes for r in manifest["runs"] for n in r["sizes"])}


def through_shards(documents: DataFrame, arrivals: int = 21, root: str | None = None) -> DataFrame:
    """The rows of sharded()."""
    return sharded(documents, arrivals, root)[0]
