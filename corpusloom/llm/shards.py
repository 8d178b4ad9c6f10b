"""Size-tiered compaction of a corpus in shards, in DataFrame operations and file metadata only.

A store is a folder of immutable runs (folders of Parquet files) and of manifests, one for each version. A manifest lists runs, not
files, so it stays small; a run is what one Spark job has committed. An arrival is appended as a run of small shards, or several
at once as a run each. When FANOUT runs of one tier are there (tier: how often the target size, divided by FANOUT, can be reached
by powers of FANOUT), all of that tier are merged into files of about the target size and become one run of their new size.

Each change is one new manifest, written aside and renamed to its number; the rename fails where that version is there
already. A writer that finds it so takes the newer manifest and tries again; a merge whose parts another writer has replaced
meanwhile is dropped. Every manifest must hold as many rows as the one before it and the arrivals together. Readers take the
runs of one version, which stays whole until vacuum() is told to remove it: that keeps the last versions and whatever is younger than
an age, and removes all else, what lost or failed writers left among it.

Defined cases: an empty arrival is an empty run, which the next merge of its tier drops; nulls and repeated rows are stored as
they are; runs of one store must have the same columns, or the arrival is refused; an empty store is read as no rows once it knows
its columns, and can not be read before; append_by takes the values in their order, numbers by size and null first.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import scratch

TARGET_BYTES, FANOUT = 128 << 20, 4
#: How often a writer takes a newer manifest and tries again.
ATTEMPTS = 20
#: Versions that vacuum() keeps, and seconds for which it touches nothing.
KEEP_VERSIONS, KEEP_SECONDS = 2, 24 * 3600


class Conflict(RuntimeError):
    """Another writer has made the version."""


class ShardStore:
    """path: a folder in any file system that Spark writes."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target_bytes, fanout
        self.jvm = spark._jvm
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- files ------------------------------------------------------------------------------------------------------------------

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def _listed(self, *parts: str) -> list:
        folder = self._path(self.path, *parts)
        return list(self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._listed("manifests")]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            found = self.versions()
            if not found:
                return {"version": 0, "schema": None, "runs": []}
            version = found[-1]
        stream = self.fs.open(self._path(self.path, "manifests", f"v{version:09d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, old: dict, runs: list[dict], schema: str | None = None) -> dict:
        """The next version after old; Conflict where another writer has made it."""
        new = {"version": old["version"] + 1, "schema": schema or old["schema"], "runs": runs}
        aside, final = self._path(self.path, "aside", uuid.uuid4().hex), self._path(self.path, "manifests", f"v{new['version']:09d}.json")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        self.fs.mkdirs(final.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, final, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self.fs.delete(aside, False)
            raise Conflict(f"version {new['version']} is there already") from e
        return new

    # --- runs -------------------------------------------------------------------------------------------------------------------

    def tier(self, size: int) -> int:
        """0 below target / fanout; then one more for each factor of fanout."""
        return max(0, 1 + math.floor(math.log(size * self.fanout / self.target, self.fanout) + 1e-9)) if size else 0

    def _runs(self, folders: list[str], schema: T.StructType) -> list[dict]:
        """The runs in folders that Spark has committed. One job counts the rows of all, from the files' footers."""
        rows: dict[str, int] = {}
        if folders:
            name = F.element_at(F.split(F.input_file_name(), "/"), -2)  # last folder of the path, as Spark writes it in its URLs
            top = F.element_at(F.split(F.input_file_name(), "/"), -3)
            for r in self.spark.read.schema(schema).parquet(*folders).groupBy(top.alias("top"), name.alias("name")).count().collect():
                rows[f"{r['top']}/{r['name']}"] = r["count"]
        out = []
        for folder in folders:
            size = self.fs.getContentSummary(self._path(folder)).getLength()
            parts = self._path(folder).toUri().getRawPath().split("/")
            n = rows.get("/".join(parts[-2:]), 0)
            out.append({"id": uuid.uuid4().hex, "folder": folder, "bytes": size if n else 0, "rows": n, "tier": self.tier(size) if n else 0, "of": []})
        return out

    def append(self, arrival: DataFrame) -> dict:
        """One run of an arrival; then merges as long as a tier is full."""
        folder = f"{self.path}/runs/{uuid.uuid4().hex}"
        arrival.write.parquet(folder)
        return self._add([folder], arrival.schema)

    def append_by(self, arrivals: DataFrame, by: str) -> dict:
        """One run of each value of a column, which itself is not stored; all are written in one job and committed as one version."""
        folder = f"{self.path}/runs/{uuid.uuid4().hex}"
        arrivals.write.partitionBy(by).parquet(folder)
        found = [f.getPath().toString() for f in self.fs.listStatus(self._path(folder)) if f.isDirectory() and "=" in f.getPath().getName()]

        def order(path: str):
            value = path.rsplit("=", 1)[1]
            try:
                return (0, 0.0, "") if value == "__HIVE_DEFAULT_PARTITION__" else (1, float(value), value)
            except ValueError:
                return 2, 0.0, value

        return self._add(sorted(found, key=order), T.StructType([x for x in arrivals.schema if x.name != by]))

    def _add(self, folders: list[str], schema: T.StructType) -> dict:
        plain = T.StructType([T.StructField(x.name, x.dataType) for x in schema])  # files don't tell what may be null
        runs = self._runs(folders, plain)
        for _ in range(ATTEMPTS):
            now = self.manifest()
            if now["schema"] not in (None, plain.json()):
                raise ValueError("the arrival has other columns than the store")
            try:
                self.commit(now, [*now["runs"], *runs], plain.json())
                return self.compact()
            except Conflict:
                continue
        raise Conflict(f"no version could be made in {ATTEMPTS} attempts")

    # --- merges -----------------------------------------------------------------------------------------------------------------

    def compact(self) -> dict:
        """Merges the runs of each tier that has as many as the fan-out, the lowest first, until none has."""
        for _ in range(ATTEMPTS):
            while True:
                now = self.manifest()
                tiers: dict[int, list[dict]] = {}
                for r in now["runs"]:
                    tiers.setdefault(r["tier"], []).append(r)
                full = [t for t, runs in tiers.items() if len(runs) >= self.fanout]
                if not full:
                    return now
                if not self._merge(now, tiers[min(full)]):
                    break
        raise Conflict(f"no merge could be committed in {ATTEMPTS} attempts")

    def _merge(self, now: dict, parts: list[dict]) -> bool:
        """Whether the merge of parts became a version; it does not where another writer has replaced one of them."""
        run = self.merged(parts, T.StructType.fromJson(json.loads(now["schema"])))
        gone = {r["id"] for r in parts}
        for _ in range(ATTEMPTS):
            if not gone <= {r["id"] for r in now["runs"]}:
                break
            runs = [*(r for r in now["runs"] if r["id"] not in gone), run]
            assert sum(r["rows"] for r in runs) == sum(r["rows"] for r in now["runs"]), "a merge must keep every row of the store"
            try:
                self.commit(now, runs)
                return True
            except Conflict:
                now = self.manifest()
        self.fs.delete(self._path(run["folder"]), True)
        return False

    def merged(self, parts: list[dict], schema: T.StructType) -> dict:
        """parts in one run. The rows are not shuffled: small files are read together up to the target size."""
        folders, size, above = [r["folder"] for r in parts if r["rows"]], sum(r["bytes"] for r in parts), max(r["tier"] for r in parts) + 1
        folder = f"{self.path}/runs/{uuid.uuid4().hex}"
        if folders:
            self.spark.read.schema(schema).parquet(*folders).coalesce(max(1, round(size / self.target))).write.parquet(folder)
            (run,) = self._runs([folder], schema)
        else:
            run = {"id": uuid.uuid4().hex, "folder": folder, "bytes": 0, "rows": 0, "tier": 0, "of": []}
        return run | {"tier": max(run["tier"], above), "of": sorted(r["id"] for r in parts)}

    def vacuum(self, keep: int = KEEP_VERSIONS, older_than: float = KEEP_SECONDS) -> list[str]:
        """Removes, if older than so many seconds: manifests but for the last `keep`, runs that no manifest then names, and what was left aside. Returns the folders."""
        limit = (time.time() - older_than) * 1000
        old = lambda f: f.getModificationTime() <= limit
        versions = self.versions()
        drop = {f"v{v:09d}.json" for v in versions[: -max(1, keep)]}
        for f in self._listed("manifests"):
            if f.getPath().getName() in drop and old(f):
                self.fs.delete(f.getPath(), False)
        used = {self._path(r["folder"]).toUri().getPath() for v in self.versions() for r in self.manifest(v)["runs"]}
        gone = []
        for f in self._listed("runs"):
            top = f.getPath().toUri().getPath()
            inner = [x for x in self.fs.listStatus(f.getPath()) if x.isDirectory() and "=" in x.getPath().getName()]
            if not any(u == top or u.startswith(top + "/") for u in used):
                inner = [f]
            for x in inner:
                if x.getPath().toUri().getPath() not in used and old(x):
                    self.fs.delete(x.getPath(), True)
                    gone.append(x.getPath().toString())
        for f in self._listed("aside"):
            if old(f):
                self.fs.delete(f.getPath(), False)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("the store has no columns yet")
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        folders = [r["folder"] for r in now["runs"] if r["rows"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


def compacted(docs: DataFrame, arrivals: int, target_bytes: int = TARGET_BYTES) -> tuple[ShardStore, DataFrame]:
    """A store of the documents, which arrive in so many lots by a hash of doc_id, and what it holds, with each row's file."""
    store = ShardStore(docs.sparkSession, scratch(docs.sparkSession, "shards"), target_bytes)
    lot = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id").cast("long")), F.lit(arrivals))
    store.append_by(docs.withColumn("__lot", lot), "__lot")
    return store, store.read().withColumn("__file", F.input_file_name())
