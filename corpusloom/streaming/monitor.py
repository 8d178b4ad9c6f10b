"""Monitoring as streams: crawl snapshots that update the stored state, and a clock that finds sites that are due.

The state is kept in versions; the number of the micro-batch is the version, so a batch that is run again after a failure finds its
version there and changes nothing.

Defined cases: an empty batch makes a version like the last; rows without site_id are a site of their own; rows without crawled_at are
never newer than anything and are ignored once their site has a state; snapshots of one site and time are one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import lifecycle
from corpusloom.plans import site
from corpusloom.plans.shared import stored

SNAPSHOT = (
    "site_id string, url string, ord long, canonical_url string, markdown_url string, title string, description string, headings array<string>, content_excerpt string, "
    "content_hash string, category string, importance_score double, included boolean, exclude_reason string, analysis_source string, word_count int, depth int, "
    "status_code int, content_type string, inbound_links long, reused boolean, reason string, crawled_at timestamp"
)
#: Fixed value: how often due sites are looked for.
POLL_SECONDS = 300


#: Buckets of sites, of which a batch rewrites those that it names; versions whose files are kept.
BUCKETS, KEEP = 64, 2


class StateTable:
    """Versions of the state and of its events below a folder of any file system that Spark writes. A version lists, for each bucket of sites, the version
    whose files hold it; that list is written last, and a version without it does not count. retire() removes what the last versions do not list."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, keep: int = KEEP):
        self.spark, self.path, self.buckets, self.keep = spark, path.rstrip("/"), buckets, keep
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, *parts: str) -> list[str]:
        folder = self._path(*parts)
        return [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []

    def versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self._names("lists") if n.startswith("v=") and self.fs.exists(self._path("lists", n, "_SUCCESS")))

    def listed(self, version: int | None = None) -> dict[int, int]:
        """The version that holds each bucket's files; at most as many rows as there are buckets."""
        found = self.versions()
        if not found:
            return {}
        rows = self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/lists/v={found[-1] if version is None else version}").collect()
        return {r.bucket: r.version for r in rows}

    def _state(self, listed: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/state/v={v}/bucket={b}" for b, v in sorted(listed.items())]
        return self.spark.read.schema(lifecycle.STATE).parquet(*paths) if paths else site.no_state(self.spark)

    def read(self, version: int | None = None) -> DataFrame:
        return self._state(self.listed(version))

    def events(self) -> DataFrame:
        return self.spark.read.schema("site_id string, url string, type string, title string, created_at timestamp").option("recursiveFileLookup", "true").parquet(f"{self.path}/events")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("site_id"), F.lit(self.buckets)).cast("int")

    def apply(self, snapshot: DataFrame, version: int) -> None:
        """The state after a batch of snapshots, and its events. Each site's snapshots are applied in the order of their times, each with its own time;
        those that are not newer than the site's state are ignored. Only the buckets of the batch's sites are read and written."""
        if version in self.versions():
            return
        listed = self.listed()
        rows = stored(snapshot.withColumn("__bucket", self._bucket()), "snapshots")
        touched = [r[0] for r in rows.select("__bucket").distinct().collect()]
        state = self._state({b: v for b, v in listed.items() if b in touched})
        newest = state.groupBy("site_id").agg(F.max("last_seen_at").alias("__last"))
        times = rows.select("site_id", "crawled_at").distinct().join(newest, "site_id", "left").where("__last is null or crawled_at > __last")
        turns = stored(times.select("site_id", "crawled_at", F.row_number().over(Window.partitionBy("site_id").orderBy("crawled_at")).alias("turn")), "turns")
        told = state.limit(0).select("site_id", "url", F.lit("").alias("type"), "title", F.col("last_seen_at").alias("created_at"))
        for turn in range(1, (turns.agg(F.max("turn")).first()[0] or 0) + 1):
            now = turns.where(F.col("turn") == turn)
            part = rows.join(now.drop("turn"), ["site_id", "crawled_at"], "left_semi")
            working, out = part.where("reason is null"), part.where("reason is not null")
            at = now.select("site_id", F.col("crawled_at").alias("now"))
            told = told.unionByName(stored(lifecycle.change_events(state, working, out, at), "events"))
            state = stored(lifecycle.next_state(state, working, out, at), "state")
        told.write.mode("overwrite").parquet(f"{self.path}/events/v={version}")
        state.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state/v={version}")
        written = [int(n.split("=")[1]) for n in self._names("state", f"v={version}") if n.startswith("bucket=")]
        after = {b: v for b, v in listed.items() if b not in touched} | dict.fromkeys(written, version)
        self.spark.createDataFrame(sorted(after.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/v={version}")
        self.retire()

    def retire(self) -> None:
        """Removes the lists of all but the last versions, and the files that the others do not name."""
        versions = self.versions()
        kept = versions[-self.keep :]
        used = {(v, b) for k in kept for b, v in self.listed(k).items()}
        for v in versions[: -self.keep]:
            self.fs.delete(self._path("lists", f"v={v}"), True)
        for n in self._names("state"):
            v = int(n[2:])
            if v in versions and v not in kept:
                buckets = [x for x in self._names("state", n) if x.startswith("bucket=")]
                gone = [x for x in buckets if (v, int(x.split("=")[1])) not in used]
                for x in [n] if len(gone) == len(buckets) else [f"{n}/{x}" for x in gone]:
                    self.fs.delete(self._path("state", x), True)


def watch_snapshots(spark: SparkSession, source: str, table: StateTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Applies each batch of snapshot files (Parquet, SNAPSHOT) that appears in a folder to the state."""
    rows = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(source)
    return rows.writeStream.foreachBatch(lambda df, n: table.apply(df, n + 1)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_due(due: DataFrame, run: Callable[[DataFrame], None], depth: int = 0) -> list[tuple[str, str]]:
    """Hands the sites that are due to run() in one job. Where that fails they are dealt in halves by a hash and tried again, so that one failing site takes no
    other with it; (site_id, error) of those that fail alone are returned. run() must be able to see a site twice."""
    if due.isEmpty():
        return []
    try:
        run(due)
        return []
    except Exception as e:  # whatever a site's crawl raises
        few = due.select("site_id").distinct().limit(2).collect()
        if len(few) == 1 or depth == 60:
            return [(r.site_id, str(e)) for r in few]
        bit = F.getbit(F.xxhash64("site_id"), F.lit(depth))
        return [x for half in (0, 1) for x in run_due(due.where(bit == half), run, depth + 1)]


def poll_due(spark: SparkSession, websites: Callable[[], DataFrame], run: Callable[[DataFrame], None], checkpoint: str, seconds: int = POLL_SECONDS, failed: Callable[[list[tuple[str, str]]], None] = print) -> StreamingQuery:
    """At once and then every so often, hands the sites that are due to run(), as run_due() does; failed() is told of those that failed, and the clock goes on."""

    def tick(_: DataFrame, __: int) -> None:
        if errors := run_due(site.crawl_again(websites(), F.current_timestamp()), run):
            failed(errors)

    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def change_counts(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Changes of each type in each site and span of time; events that come later than `late` are not counted."""
    return events.withWatermark("created_at", late).groupBy("site_id", F.window("created_at", every), "type").agg(F.count(F.lit(1)).alias("n"))
