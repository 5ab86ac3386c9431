"""Sharding by size-tiered compaction, with an atomically committed, versioned manifest (DataFrame functions only).

A store is a folder: data/ holds immutable Parquet shards, manifest/ one file a version that lists the shards of that version. An
arrival is written as small shards and committed; when `fanout` shards of one size tier have gathered, they are merged into runs of
about the target size. A merge reads the files of a run into one task and writes one file: no exchange, no key, so a hot source or
group cannot skew it. A version becomes visible by one rename (a link in a local folder) that fails if another writer was first. Files are never changed;
vacuum() deletes those that no kept version lists. The driver holds the manifest only: one short row a shard.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantpanel.llm.common import remove_at_exit

TARGET_BYTES, FANOUT, RUNS_A_JOB = 128 << 20, 4, 200


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """read() gives exactly the rows appended so far: null, repeated, empty and very long ones too; extra columns stay as they are.

    All arrivals must have the columns of the first one, of the same types and in any order; append() raises ValueError otherwise. An
    empty arrival is a version without new shards. Reading a store without any arrival raises ValueError. Any number of writers may append
    and compact at a time: who comes late commits on top of the newest version, and a merge whose inputs another writer has merged
    meanwhile is thrown away and planned anew.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, codec: str = "zstd") -> None:
        self.spark, self.root, self.target, self.fanout, self.codec = spark, root.rstrip("/"), target_bytes, fanout, codec
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    # -------------------------------------------------------------- manifest

    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, shards: [{path, bytes, tier}], note} of a version, the latest if none is named."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "shards": [], "note": "empty"}
        version = known[-1] if version is None else version
        stream = self._fs.open(self._path(f"manifest/v{version:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, base: dict, shards: list[dict], schema: str | None, note: str) -> dict:
        """Writes the file under another name and gives it that of the version, which fails if the version exists.

        A rename does so where it is one step of the store. On a local or mounted folder it looks first and renames then, so that two
        writers may both go through and the later one takes the other's place; there the file is linked, which only one can do.
        """
        made = {"version": base["version"] + 1, "schema": schema, "shards": shards, "note": note}
        draft, final = self._path(f"manifest/.draft-{uuid.uuid4().hex}"), self._path(f"manifest/v{made['version']:012d}.json")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(made).encode()))
        finally:
            stream.close()
        try:
            if self._fs.getScheme() == "file":
                at = [self._fs.pathToFile(p).toPath() for p in (final, draft)]
                self._jvm.java.nio.file.Files.createLink(*at)
                self._fs.delete(draft, False)
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
                kind = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
                options = self.spark.sparkContext._gateway.new_array(kind, 1)
                options[0] = kind.NONE
                context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {made['version']} exists") from e
            raise
        return made

    # -------------------------------------------------------------- shards

    def tier(self, size: int) -> int:
        """0 up to target / fanout ** 4, and one more for each factor of `fanout`."""
        least = max(1, self.target // self.fanout**4)
        return max(0, math.ceil(math.log(max(size, 1) / least, self.fanout) - 1e-9))

    def _written(self, folder: str) -> list[dict]:
        """The shards of a folder just written; parts without rows are not listed."""
        out = []
        for x in self._fs.listStatus(self._path(folder)):
            name = x.getPath().getName()
            if name.endswith(".parquet"):
                out.append({"path": f"{folder}/{name}", "bytes": int(x.getLen()), "tier": self.tier(int(x.getLen()))})
        return sorted(out, key=lambda s: s["path"])

    def append(self, rows: DataFrame, retries: int = 50) -> dict:
        """Adds an arrival as small shards, one a partition of rows; committed as a new version."""
        base = self.manifest()
        rows = self._fitting(rows, base["schema"])
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.option("compression", self.codec).parquet(f"{self.root}/{folder}")
        new, schema = self._written(folder), rows.schema.json()
        for _ in range(retries):
            try:
                return self._commit(base, base["shards"] + new, base["schema"] or schema, "append")
            except Conflict:
                base = self.manifest()
                try:
                    self._fitting(rows, base["schema"])  # the other writer's arrival may have been the first one
                except ValueError:
                    self._fs.delete(self._path(folder), True)
                    raise
        self._fs.delete(self._path(folder), True)
        raise Conflict(f"{retries} other writers were first")

    @staticmethod
    def _fitting(rows: DataFrame, schema: str | None) -> DataFrame:
        """rows with their columns in the store's order; ValueError if they are others."""
        if schema is None:
            return rows
        want = {f["name"]: f["type"] for f in json.loads(schema)["fields"]}
        have = {f.name: f.dataType.jsonValue() for f in rows.schema.fields}
        if want != have or len(rows.columns) != len(want):
            raise ValueError(f"the store's columns are {want}, the arrival's {have}")
        return rows.select(*(F.col(f"`{c}`") for c in want))

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs to merge: in each tier below the target with at least `fanout` shards, similarly sized ones up to the target."""
        runs: list[list[dict]] = []
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target:
                tiers.setdefault(s["tier"], []).append(s)
        for _, members in sorted(tiers.items()):
            if len(members) < self.fanout:
                continue
            run: list[dict] = []
            for s in sorted(members, key=lambda s: (s["bytes"], s["path"])):
                if run and sum(x["bytes"] for x in run) + s["bytes"] > self.target:
                    runs.append(run)
                    run = []
                run.append(s)
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self, retries: int = 50) -> dict:
        """Merges until no tier has a run to merge; every round is committed by itself, so a crash loses one round at most."""
        state, lost = self.manifest(), 0
        while runs := self.plan(state["shards"]):
            folders, made = [], []
            for i in range(0, len(runs), RUNS_A_JOB):
                folders.append(f"data/{uuid.uuid4().hex}")
                merged = reduce(DataFrame.union, (self._read([s["path"] for s in run], state["schema"]).coalesce(1) for run in runs[i : i + RUNS_A_JOB]))
                try:
                    merged.write.option("compression", self.codec).parquet(f"{self.root}/{folders[-1]}")
                except Exception:  # its inputs may have been merged and removed by another writer
                    if self._listed(runs, self.manifest()):
                        raise
                    break
                made += self._written(folders[-1])
            gone = {s["path"] for run in runs for s in run}
            while self._listed(runs, latest := self.manifest()):  # appends that came meanwhile stay
                try:
                    state = self._commit(latest, [s for s in latest["shards"] if s["path"] not in gone] + made, latest["schema"], f"merge of {len(runs)} runs")
                    break
                except Conflict:
                    lost += 1
                    if lost > retries:
                        self._drop(folders)
                        raise
            else:  # another writer has merged some of the inputs: this merge would add their rows once more
                self._drop(folders)
                state, lost = latest, lost + 1
                if lost > retries:
                    raise Conflict(f"{retries} other writers were first")
        return state

    @staticmethod
    def _listed(runs: list[list[dict]], state: dict) -> bool:
        return {s["path"] for run in runs for s in run} <= {s["path"] for s in state["shards"]}

    def _drop(self, folders: list[str]) -> None:
        for folder in folders:
            self._fs.delete(self._path(folder), True)

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.root}/{p}" for p in paths))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        state = self.manifest(version)
        if state["schema"] is None:
            raise ValueError("nothing has been appended yet")
        return self._read([s["path"] for s in state["shards"]], state["schema"])

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last `keep` manifests, and the shards that none of those lists. Not while others write or read old ones."""
        known = self.versions()
        kept = {s["path"] for v in known[-keep:] for s in self.manifest(v)["shards"]}
        gone = 0
        for v in known[:-keep]:
            self._fs.delete(self._path(f"manifest/v{v:012d}.json"), False)
        for folder in self._fs.listStatus(self._path("data")):
            name = f"data/{folder.getPath().getName()}"
            listed = [f"{name}/{x.getPath().getName()}" for x in self._fs.listStatus(folder.getPath())]
            if not any(p in kept for p in listed):
                self._fs.delete(folder.getPath(), True)
                gone += len(listed)
                continue
            for p in listed:
                if p not in kept and p.endswith(".parquet"):
                    self._fs.delete(self._path(p), False)
                    gone += 1
        return gone


def remove_store(store: ShardStore) -> None:
    """Deletes a store's folder, if the session still is there."""
    remove_at_exit(store.spark, store.root)
