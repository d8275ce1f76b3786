"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable parquet shards. A tier holds the shards whose sizes are within a factor
of RATIO. Compaction merges shards of one tier only, RATIO of them at least, into files of up to the target size,
which belong to a higher tier; so a row is rewritten once a tier at most, and less than RATIO shards of each tier
wait for more of their size. A version is one manifest that names the parts of the list of live shards; parts that
a commit doesn't touch are taken over as they are. The manifest is written beside the others and renamed into
place without overwriting, so a version is there as a whole or not at all, and of two writers one gets an error
and plans anew. Data files and parts are never changed; expire() removes those that only older versions name.

A merge is a narrow read: the shards of one target file are read and written by one task, without a shuffle.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEND_ROWS, fresh, scratch, table

TARGET_BYTES, RATIO = 64 << 20, 4
#: Rows of an arriving shard at most, target files that one job writes at most, and shards of a part of the manifest.
ARRIVAL_ROWS, FILES_PER_JOB, PART_SHARDS = 4096, 256, 10_000


class ConflictError(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """A folder of shards with manifests, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, ratio: int = RATIO):
        self.spark, self.path, self.target, self.ratio = spark, path.rstrip("/"), target_bytes, ratio
        # merges are unions of single partitions, which must stay apart; Spark would zip them into one
        self.apart = spark.newSession()
        self.apart.conf.set("spark.sql.unionOutputPartitioning", "false")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.hadoop.Path("/".join((self.path, *parts)))

    def versions(self) -> list[int]:
        at = self._path("manifests")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _json(self, *parts: str):
        stream = self.fs.open(self._path(*parts))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, content, *parts: str) -> None:
        out = self.fs.create(self._path(*parts), False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, parts, shards: [{file, rows, bytes, part}]}; version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "schema": None, "parts": [], "shards": []}
        held = self._json("manifests", f"v{version:08d}.json")
        return held | {"shards": [s | {"part": p} for p in held["parts"] for s in self._json("parts", p)]}

    def commit(self, base: dict, schema: str | None, added: list[dict], gone: set[str] = frozenset()) -> int:
        """The version after `base` (a manifest), with shards added and files gone; ConflictError if it is there already."""
        version = base["version"] + 1
        touched = {s["part"] for s in base["shards"] if s["file"] in gone}
        rest = [s for s in base["shards"] if s["part"] in touched and s["file"] not in gone] + added
        new = []
        for k in range(0, len(rest), PART_SHARDS):
            new.append(f"{uuid.uuid4().hex}.json")
            self._put([{k: s[k] for k in ("file", "rows", "bytes")} for s in rest[k : k + PART_SHARDS]], "parts", new[-1])
        beside, at = self._path("manifests", name := f".{uuid.uuid4().hex}"), self._path("manifests", f"v{version:08d}.json")
        self._put({"version": version, "schema": schema, "parts": [p for p in base["parts"] if p not in touched] + new}, "manifests", name)
        context = self.hadoop.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(beside), context.makeQualified(at), self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 0))
        except Exception as e:
            for path in (beside, *(self._path("parts", p) for p in new)):
                self.fs.delete(path, False)
            if self.fs.exists(at):
                raise ConflictError(f"version {version} is there already") from e
            raise
        return version

    def _written(self, folder: str) -> list[dict]:
        """The shards of a folder: their bytes from the file system, their rows from the files' footers."""
        sizes = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")}
        if not sizes:
            return []
        rows = self.spark.read.schema("_ int").parquet(f"{self.path}/{folder}").groupBy(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("f")).agg(F.count(F.lit(1)).alias("n"))
        counts = {r.f: r.n for r in rows.collect()}
        return [{"file": f"{folder}/{name}", "rows": counts[name], "bytes": sizes[name]} for name in sorted(sizes) if counts.get(name)]

    def append(self, rows: DataFrame, max_rows: int = ARRIVAL_ROWS) -> int:
        """Rows as new small shards, in a new version. No rows: a version without new shards."""
        folder = f"data/arrival-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", max_rows).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        added = self._written(folder)
        while True:
            held = self.manifest()
            try:
                return self.commit(held, held["schema"] or rows.schema.json(), added)
            except ConflictError:
                continue

    def tier(self, n_bytes: int) -> int:
        return int(math.log(max(n_bytes, 1), self.ratio))

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs to merge: shards below half of the target, of one tier, `ratio` of them at least and the target in sum at most."""
        tiers: dict[int, list[dict]] = {}
        for s in sorted(shards, key=lambda s: s["file"]):
            if 2 * s["bytes"] < self.target:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        runs: list[list[dict]] = []
        for _, own in sorted(tiers.items()):
            run, total = [], 0
            for s in own:
                if run and total + s["bytes"] > self.target:
                    runs.append(run)
                    run, total = [], 0
                run.append(s)
                total += s["bytes"]
            runs.append(run)
        # shards of the highest tiers may fill the target before there are `ratio` of them
        return [r for r in runs if len(r) >= self.ratio or (len(r) > 1 and 2 * sum(s["bytes"] for s in r) >= self.target)]

    def compact(self) -> int:
        """Merges all planned runs, and commits the outcome as one version; the current version if there is nothing to do. What is merged may make runs of a higher tier."""
        while True:
            held = self.manifest()
            runs, made = self.plan(held["shards"]), []
            if not runs:
                return held["version"]
            for at in range(0, len(runs), FILES_PER_JOB):
                folder = f"data/merged-{uuid.uuid4().hex}"
                parts = [self._read(held, run, self.apart).coalesce(1) for run in runs[at : at + FILES_PER_JOB]]
                while len(parts) > 1:
                    parts = [parts[i].unionAll(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
                parts[0].write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
                made += self._written(folder)
            gone = {s["file"] for run in runs for s in run}
            try:
                return self.commit(held, held["schema"], made, gone)
            except ConflictError:
                continue

    def _read(self, held: dict, shards: list[dict], session: SparkSession | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(held["schema"]))
        return (session or self.spark).read.schema(schema).parquet(*[f"{self.path}/{s['file']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with all columns, and `shard`: the shard's place in the manifest; `shard_` if there is such a column."""
        held = self.manifest(version)
        if not held["schema"]:
            raise ValueError("the store has no version yet")
        if not held["shards"]:
            return self._nothing(held)
        places = self.spark.createDataFrame([("/".join(s["file"].split("/")[-2:]), k) for k, s in enumerate(held["shards"])], "file string, shard int")
        rows = self._read(held, held["shards"])
        shard, file = fresh(rows, "shard"), fresh(rows, "file")
        rows = rows.withColumn(file, F.regexp_extract(F.input_file_name(), "[^/]+/[^/]+$", 0))
        few = F.broadcast(places) if len(held["shards"]) <= SEND_ROWS else places
        return rows.join(few.select(F.col("file").alias(file), F.col("shard").alias(shard)), file).drop(file)

    def _nothing(self, held: dict) -> DataFrame:
        from pyspark.sql.types import StructType

        rows = self.spark.createDataFrame([], StructType.fromJson(json.loads(held["schema"])))
        return rows.withColumn(fresh(rows, "shard"), F.lit(None).cast("int"))

    def expire(self, keep: int = 1) -> list[str]:
        """Keeps the last `keep` versions; removes older manifests, and the parts and data folders that no kept version names."""
        versions = self.versions()
        old, kept = ([self.manifest(v) for v in vs] for vs in (versions[:-keep], versions[-keep:]))
        folders = lambda ms: {s["file"].rpartition("/")[0] for m in ms for s in m["shards"]}
        parts = lambda ms: {f"parts/{p}" for m in ms for p in m["parts"]}
        dead = folders(old) - folders(kept)
        for m in old:
            self.fs.delete(self._path("manifests", f"v{m['version']:08d}.json"), False)
        for path in dead | (parts(old) - parts(kept)):
            self.fs.delete(self._path(path), True)
        return sorted(dead)


def shard(rows: DataFrame, path: str, target_bytes: int = TARGET_BYTES, max_rows: int = ARRIVAL_ROWS) -> DataFrame:
    """Appends rows to the store at path, compacts it, drops what is replaced, and gives the last version's rows with `shard` (`shard_` if rows has such a column).

    Rows come back exactly, with repeats, ties, nulls and all columns, whatever their names; the order inside a
    shard is that of arrival. Very long texts stay whole: a shard of one arrival may be over the target and is
    never cut. Less than RATIO shards of a tier stay small until more come. An empty table gives a version
    without shards.
    """
    store = ShardStore(rows.sparkSession, path, target_bytes)
    version = store.append(rows, max_rows)
    while version != (version := store.compact()):
        pass
    store.expire()
    return store.read()


def op8_tiered_shards(spark, sf_dir):
    rows = shard(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return rows.select("doc_id", "lang", "source", "n_chars", "shard", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
