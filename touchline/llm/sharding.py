"""An append-only table of immutable Parquet shards with size-tiered compaction.

Every append adds small shards. Compaction takes runs of similar size (the same
tier: sizes within a factor of `fan`), once `fan` of them are there, and merges
them into files of about the target size, without a shuffle. Each change is a new
manifest, a JSON file named by its version; whoever gives a file that name first
has the version, others begin again from it. Readers see one manifest's files. A run is
announced before its data is written and until it is committed, so that vacuum
leaves it alone.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import fresh_dir

#: Stores on which a name is given exclusively: by a hard link, by a rename.
EXCLUSIVE = ("file", "hdfs")


class ShardedTable:
    """path: a folder that the driver and all executors share, on a store of EXCLUSIVE; on others ValueError, as two writers could both think that they were first."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan: int = 4):
        self.spark, self.path, self.target, self.fan = spark, path, target_bytes, fan
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._scheme = self._fs.getUri().getScheme()
        if self._scheme not in EXCLUSIVE:
            raise ValueError(f"{path}: a table's folder must lie on one of {EXCLUSIVE}, where a file takes a name in one exclusive step; {self._scheme} doesn't promise that")

    def _list(self, folder: str) -> list[tuple[str, int]]:
        p = self._path(folder)
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def version(self) -> int:
        """The last version; 0: nothing was committed."""
        return max([0, *(int(n[1:-5]) for n, _ in self._list(f"{self.path}/manifest") if n.startswith("v") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if not v:
            return {"version": 0, "schema": None, "runs": []}
        stream = self._fs.open(self._path(f"{self.path}/manifest/v{v:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, seen: dict, change) -> int:
        """Writes the manifest that follows; if another writer was first, applies the change to theirs. The file is written whole under a name of its own and then takes the version's name, which fails if that is there."""
        while True:
            new = change(seen)
            if new is None:
                return seen["version"]
            new |= {"version": seen["version"] + 1}
            self._fs.mkdirs(self._path(f"{self.path}/manifest"))
            own = self._path(f"{self.path}/manifest/_{uuid.uuid4().hex}")
            out = self._fs.create(own, False)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            first = self._named(own, self._path(f"{self.path}/manifest/v{new['version']:08d}.json"))
            self._fs.delete(own, False)
            if first:
                return new["version"]
            seen = self.manifest()

    def _named(self, own, version) -> bool:
        """Gives the file the version's name too; False if that is taken. On a local or mounted disk by a hard link, on HDFS by a rename that doesn't overwrite: both are one exclusive step there."""
        if self._scheme == "file":
            try:
                os.link(own.toUri().getPath(), version.toUri().getPath())
                return True
            except FileExistsError:
                return False
        jvm = self.spark._jvm
        own, version = self._fs.makeQualified(own), self._fs.makeQualified(version)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(own, version, none)
            return True
        except Exception as e:  # of the Java side
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def _announced(self) -> dict[str, float]:
        """Names of the runs that are written and not yet committed, and when they were announced."""
        p = self._path(f"{self.path}/pending")
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._fs.listStatus(p)} if self._fs.exists(p) else {}

    def _run(self, df: DataFrame) -> dict:
        name = uuid.uuid4().hex
        self._fs.create(self._path(f"{self.path}/pending/{name}"), False).close()
        df.write.parquet(f"{self.path}/data/{name}")
        files = [(f, n) for f, n in self._list(f"{self.path}/data/{name}") if f.endswith(".parquet")]
        return {"name": name, "bytes": sum(n for _, n in files), "files": [f for f, _ in files], "sizes": [n for _, n in files]}

    def _settled(self, run: dict) -> None:
        self._fs.delete(self._path(f"{self.path}/pending/{run['name']}"), False)

    @staticmethod
    def _columns(schema: str) -> list[tuple]:
        return [(f["name"], json.dumps(f["type"])) for f in json.loads(schema)["fields"]]

    def append(self, df: DataFrame) -> int:
        """Adds df's rows, nulls and repeats as they are, as new shards and returns the version that has them. No rows: a run of empty files. Columns of other names, order or types than the table's: ValueError, nothing is added."""
        schema = df.schema.json()

        def same(m: dict) -> dict:
            if m["schema"] and self._columns(m["schema"]) != self._columns(schema):
                raise ValueError(f"{self.path} has the columns {self._columns(m['schema'])}, not {self._columns(schema)}")
            return m

        same(self.manifest())
        run = self._run(df)
        version = self._commit(self.manifest(), lambda m: {"schema": same(m)["schema"] or schema, "runs": [*m["runs"], run]})
        self._settled(run)
        return version

    def tier(self, run: dict) -> int:
        """By the mean size of its files: 0 below target / fan**3, and so on; the last are target-sized and stay."""
        mean = run["bytes"] / max(1, len(run["files"]))
        return max(0, 3 + math.floor(math.log(max(mean, 1) / self.target, self.fan) + 0.5))

    def compact(self) -> int:
        """Merges runs of similar size until no tier has `fan` of them; returns the version."""
        while True:
            seen = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for r in seen["runs"]:
                tiers.setdefault(self.tier(r), []).append(r)
            due = next((rs for t, rs in sorted(tiers.items()) if t < 3 and len(rs) >= self.fan), None)
            if due is None:
                return seen["version"]
            names = {r["name"] for r in due}
            total = sum(r["bytes"] for r in due)
            merged = self._run(self._read(due, seen["schema"]).coalesce(max(1, round(total / self.target))))

            def change(m, names=names, merged=merged):
                if not names <= {r["name"] for r in m["runs"]}:
                    return None  # another writer merged them
                return {"schema": m["schema"], "runs": [r for r in m["runs"] if r["name"] not in names] + [merged]}

            self._commit(seen, change)
            self._settled(merged)

    def vacuum(self, abandoned_after: float = 7 * 86400.0) -> None:
        """Deletes the shards that the last version doesn't name, but for those that another writer has announced in the last abandoned_after seconds. Not while older versions are read.

        The data are listed first and the manifest is read last: what is committed in
        between was announced when the announcements were read, or is in the manifest.
        """
        there = [name for name, _ in self._list(f"{self.path}/data")]
        announced = self._announced()
        live = {r["name"] for r in self.manifest()["runs"]}
        old = {n for n, t in announced.items() if t < time.time() - abandoned_after}
        for name in there:
            if name not in live and (name not in announced or name in old):
                self._fs.delete(self._path(f"{self.path}/data/{name}"), True)
        for name in old:
            self._fs.delete(self._path(f"{self.path}/pending/{name}"), False)

    def _read(self, runs: list[dict], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        files = [f"{self.path}/data/{r['name']}/{f}" for r in runs for f in r["files"]]
        return self.spark.read.schema(kind).parquet(*files) if files else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, nulls and repeats as they were appended; the last version if none is given; the schema of the first append."""
        m = self.manifest(version)
        if not m["version"]:
            raise ValueError(f"{self.path}: nothing was committed")
        return self._read(m["runs"], m["schema"])


def arrivals(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs cut into n arrivals by id: every row is in one."""
    return [docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == i) for i in range(n)]


def sharded(docs: DataFrame, n: int = 4, target_bytes: int = 128 << 20) -> ShardedTable:
    """docs appended in n arrivals to a new table in the shared folder, compacted and vacuumed. All rows, nulls and repeats as they are, whatever the columns; no rows: a table without rows."""
    t = ShardedTable(docs.sparkSession, fresh_dir(docs.sparkSession, "shards"), target_bytes)
    for a in arrivals(docs, n):
        t.append(a)
        t.compact()
    t.vacuum()
    return t
