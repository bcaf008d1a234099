"""Versioned tables: immutable Parquet snapshots and a catalog that is replaced by compare-and-swap.

``<root>/versions/<n>.json`` lists every table with its metadata and its data folders.  A commit writes the files of
version n + 1 aside and gives it its name, which only one can get, so of two sessions that commit on the same version one has to look
again: where tables it wrote have changed meanwhile, it fails with a serialization error, else its tables are laid
over the newer version.  Readers keep the version they began with.  Files go through the Hadoop file system of the root.
"""

from __future__ import annotations

import copy
import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class SqlError(Exception):
    """An error with its SQLSTATE."""

    def __init__(self, sqlstate: str, message: str) -> None:
        super().__init__(f"{sqlstate}: {message}")
        self.sqlstate = sqlstate


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm, jsc = spark._jvm, spark.sparkContext._jsc
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    def latest(self) -> int:
        found = self._fs.listStatus(self._path(f"{self.root}/versions"))
        numbers = [int(f.getPath().getName()[:-5]) for f in found if f.getPath().getName().endswith(".json") and not f.getPath().getName().startswith(".")]
        return max(numbers, default=0)

    def read(self, version: int) -> dict:
        if version == 0:
            return {"tables": {}, "schemas": ["public"], "roles": {}, "grants": []}
        try:
            stream = self._fs.open(self._path(f"{self.root}/versions/{version}.json"))
        except Py4JJavaError as e:
            raise SqlError("58030", f"version {version} of the catalog cannot be read") from e
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_data(self, df: DataFrame) -> str:
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _put(self, path: str, text: str) -> bool:
        """Make the file path with this text, whole or not at all; False if there is one already.

        It's written aside and then given its name, which a file system does at once: by a link where files are local, which
        fails if the name is taken, else by a rename, which does not replace."""
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        out = self._fs.create(self._path(aside), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                try:
                    os.link(*(self._path(x).toUri().getPath() for x in (aside, path)))
                except FileExistsError:
                    return False
                return True
            return not self._fs.exists(self._path(path)) and self._fs.rename(self._path(aside), self._path(path))
        finally:
            self._fs.delete(self._path(aside), False)

    def commit(self, base: int, before: dict, after: dict) -> int:
        """Publish ``after``, made from ``before`` = version base; returns the new version.

        Of tables and roles, those that this transaction changed must be as it found them; schemas and grants are sets, to which its
        additions and removals apply."""
        while True:
            now = self.latest()
            state = copy.deepcopy(after)
            if now != base:
                state = copy.deepcopy(self.read(now))
                for part in ("tables", "roles"):
                    for k in {*before[part], *after[part]}:
                        if before[part].get(k) == after[part].get(k):
                            continue
                        if state[part].get(k) != before[part].get(k):
                            raise SqlError("40001", f"could not serialize access: {k} was changed by another transaction")
                        if k in after[part]:
                            state[part][k] = after[part][k]
                        else:
                            state[part].pop(k, None)
                for part in ("schemas", "grants"):
                    kept = [x for x in state[part] if x in after[part] or x not in before[part]]
                    state[part] = kept + [x for x in after[part] if x not in before[part] and x not in kept]
            state["time"] = time.time()
            if self._put(f"{self.root}/versions/{now + 1}.json", json.dumps(state)):
                return now + 1

    # -- old versions and backups --------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/versions"))]
        return sorted(int(n[:-5]) for n in found if n.endswith(".json") and not n.startswith("."))

    def at(self, moment: float) -> int:
        """The newest version that was committed at or before a moment (seconds since 1970)."""
        return max((v for v in self.versions() if self.read(v)["time"] <= moment), default=0)

    def vacuum(self, keep: int = 10, age: float = 86_400.0) -> int:
        """Remove all versions but the last ``keep``, and data that none of those names and that are older than ``age`` seconds (younger ones
        may belong to a transaction that is open).  Returns how many data folders went."""
        kept = self.versions()[-max(1, keep) :]
        named = {d.rsplit("/", 1)[1] for v in kept for t in self.read(v)["tables"].values() for d in t["data"]}
        for v in self.versions():
            if v < kept[0]:
                self._fs.delete(self._path(f"{self.root}/versions/{v}.json"), False)
        gone, folder = 0, self._path(f"{self.root}/data")
        for f in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if f.getPath().getName() not in named and f.getModificationTime() / 1000 <= time.time() - age:
                gone += self._fs.delete(f.getPath(), True)
        return gone

    def backup(self, path: str, version: int | None = None) -> int:
        """Copy a version (the newest) and the data it names to another folder, of any file system.  Data are never changed once written,
        so what an earlier backup holds is not copied again: every backup after the first is an increment.  Returns the version."""
        version = self.latest() if version is None else version
        other, state = Store(self.spark, path), self.read(version)
        util, conf = self.spark._jvm.org.apache.hadoop.fs.FileUtil, self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in state["tables"].values():
            for i, d in enumerate(t["data"]):
                t["data"][i] = target = f"{other.root}/data/{d.rsplit('/', 1)[1]}"
                if not other._fs.exists(other._path(f"{target}/_SUCCESS")):
                    util.copy(self._fs, self._path(d), other._fs, other._path(target), False, True, conf)
        if version:
            other._put(f"{other.root}/versions/{version}.json", json.dumps(state))
        return version

    def restore(self, path: str, moment: float | None = None) -> int:
        """Commit what a backup holds, of its newest version or of the newest one committed by a moment, as this store's next version."""
        source = Store(self.spark, path)
        version = source.latest() if moment is None else source.at(moment)
        base = self.latest()
        source.backup(self.root + "/restored", version)
        return self.commit(base, self.read(base), Store(self.spark, self.root + "/restored").read(version))
