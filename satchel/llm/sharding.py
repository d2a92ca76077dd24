"""Size-tiered compaction of an append-only table under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Shards of one size tier (a power of the fan-out over the base
size) are merged, once there are enough of them, into files of the target size. Which shards are live is told by
manifests alone: version n+1 appears beside version n as a whole or not at all, and never over an existing one, so a
reader sees one whole version or the other, and of two writers one fails and can try again. Where the store can rename
at once, a finished file is renamed into place on condition that nothing is there; object stores, which copy to rename
but show a file only once it is closed, are asked to create it on that condition.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

BASE_BYTES, TARGET_BYTES, FANOUT = 1 << 20, 64 << 20, 4
#: Schemes of object stores. Seconds after which data that no manifest names was left by a failed writer.
OBJECT_STORES = ("s3a", "s3", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cosn")
ORPHANED = 86_400
#: A shard at least this part of the target is done and not merged again.
FULL = 0.5


class CommitConflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


class ShardStore:
    """A table of shards under root, which any store that Hadoop can reach may hold.

    Rows are kept as they come: nulls, empty and long texts, repeated rows and columns of any name are data like any
    other. An empty arrival makes a version with no new rows; a table that nothing was appended to cannot be read.
    """

    def __init__(self, spark: SparkSession, root: str, base_bytes: int = BASE_BYTES, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> None:
        if not 0 < base_bytes <= target_bytes or fanout < 2:
            raise ValueError("sizes must be positive, base at most target, fan-out two or more")
        self.spark, self.root, self.base, self.target, self.fanout = spark, root.rstrip("/"), base_bytes, target_bytes, fanout
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_manifest"))
        options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._rename_once = spark.sparkContext._gateway.new_array(options, 1)
        self._rename_once[0] = options.NONE
        self._files = None if self._fs.getUri().getScheme() in OBJECT_STORES else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def _qualified(self, path):
        return self._fs.makeQualified(path)

    # manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(self._name(version)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**x) for x in self.manifest(version)["shards"]]

    def _name(self, version: int) -> str:
        return f"{self.root}/_manifest/v{version:012d}.json"

    def _commit(self, after: dict, schema: str, shards: list[Shard], why: str) -> int:
        version = after["version"] + 1
        body = json.dumps({"version": version, "schema": schema, "why": why, "shards": [asdict(x) for x in shards]})
        final = self._path(self._name(version))
        direct = self._fs.getUri().getScheme() in OBJECT_STORES
        part = final if direct else self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}")
        try:
            out = self._fs.create(part, False)
            out.write(bytearray(body.encode()))
            out.close()
            if not direct:
                self._files.rename(self._qualified(part), self._qualified(final), self._rename_once)
        except Py4JJavaError as e:
            if not direct:
                self._fs.delete(part, False)
            if self._fs.exists(final):
                raise CommitConflict(f"version {version} exists") from e
            raise
        return version

    # data

    def _write(self, df: DataFrame, rows_a_file: int = 0) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = df.write.option("maxRecordsPerFile", rows_a_file) if rows_a_file else df.write
        writer.parquet(folder)
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(folder))]
        return [Shard(f"{folder.removeprefix(self.root)}/{n}", size) for n, size in sorted(found) if n.endswith(".parquet")]

    def append(self, df: DataFrame, rows_a_file: int = 2000) -> int:
        """Commit df's rows as new small shards. Nothing is shuffled; an empty df adds a version with no rows."""
        now = self.manifest()
        schema = df.schema.json()
        if now["schema"] not in (None, schema):
            raise ValueError("the arrivals' columns differ from the table's")
        return self._commit(now, schema, [Shard(**x) for x in now["shards"]] + self._write(df, rows_a_file), "append")

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.base, self.fanout)) + 1)

    def due(self, shards: list[Shard]) -> list[Shard]:
        """The shards of the lowest tier that has at least `fanout` of them, without those that are full."""
        tiers: dict[int, list[Shard]] = {}
        for x in shards:
            if x.size < FULL * self.target:
                tiers.setdefault(self.tier(x.size), []).append(x)
        return next((tiers[k] for k in sorted(tiers) if len(tiers[k]) >= self.fanout), [])

    def compact(self) -> int:
        """Merge tiers until none is due; a commit for each merge. Returns the version that is then live."""
        while True:
            now = self.manifest()
            live = [Shard(**x) for x in now["shards"]]
            old = self.due(live)
            if not old:
                return now["version"]
            files = max(1, round(sum(x.size for x in old) / self.target))
            rows = self._load(old, now["schema"])
            merged = self._write(rows.coalesce(files), -(-rows.count() // files))
            gone = {x.path for x in old}
            self._commit(now, now["schema"], [x for x in live if x.path not in gone] + merged, f"merge {len(old)} into {len(merged)}")

    def _load(self, shards: list[Shard], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[self.root + x.path for x in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing has been appended yet")
        return self._load([Shard(**x) for x in now["shards"]], now["schema"])

    def vacuum(self, keep: int = 2, orphaned: int = ORPHANED) -> int:
        """Delete data files that none of the last `keep` versions names, and the manifests before those.

        Folders that no manifest names at all go `orphaned` seconds after they were written: a writer failed before its commit.
        """
        versions = self.versions()
        kept = versions[-keep:]
        live = {x.path for v in kept for x in self.shards(v)}
        known = {x.path for v in versions for x in self.shards(v)}
        dead = known - live
        for x in dead:
            self._fs.delete(self._path(self.root + x), False)
        for v in versions[:-keep]:
            self._fs.delete(self._path(self._name(v)), False)
        folders = {x.rpartition("/")[0].rpartition("/")[2] for x in live}
        data = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else ():
            name, age = s.getPath().getName(), time.time() - s.getModificationTime() / 1000
            if name not in folders and (age > orphaned or any(x.startswith(f"/data/{name}/") for x in dead)):
                self._fs.delete(s.getPath(), True)
        return len(dead)
