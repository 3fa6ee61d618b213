"""An index in a folder: Parquet tables and numbered states that name them. Any file system that Spark can write."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 4
#: Columns by which a table is laid out.
ORDER = {"postings": ("config", "lexeme"), "surface": ("word",), "words": ("folded",)}
TABLES = ("docs", "postings", "surface", "words")


class Outdated(RuntimeError):
    """The folder was written by another version; initialize() rebuilds it."""


class Incomplete(RuntimeError):
    """A table of the current state is gone; initialize() builds it anew from the documents."""


class Conflict(RuntimeError):
    """Another writer has changed the index since this one read it."""


class Snapshot:
    """One state of an index: all tables read through it belong together, whatever is written meanwhile."""

    def __init__(self, store: Store, meta: dict):
        self.store, self.meta = store, meta

    def table(self, name: str) -> DataFrame:
        return self.store.read(self.meta["tables"][name])


class Store:
    """Each state of the index is a numbered file that names its tables. A writer adds tables, then the next number, once for
    all of them; the number is taken by one writer only. Readers keep the state they opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _states(self) -> list[int]:
        folder = self._path(f"{self.path}/_states")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def exists(self) -> bool:
        return bool(self._states())

    def meta(self) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/_states/{self._states()[-1]:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def present(self) -> dict[str, bool]:
        """Whether each table that the current state should have is there."""
        places = self.meta()["tables"]
        return {n: n in places and self._fs.exists(self._path(f"{self.path}/{places[n]}")) for n in TABLES}

    def _current(self) -> dict:
        meta = self.meta()
        if meta["schema"] != SCHEMA_VERSION:
            raise Outdated(f"schema {meta['schema']}, this version writes {SCHEMA_VERSION}")
        return meta

    def check(self) -> dict:
        """The current state, if it is of this version and all its tables are there."""
        meta = self._current()
        gone = [n for n, there in self.present().items() if not there]
        if gone:
            raise Incomplete(f"{self.path} has lost {', '.join(gone)}")
        return meta

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self._current())

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.snapshot().table(name)

    def add(self, tables: Mapping[str, DataFrame]) -> dict[str, str]:
        """Write tables that no state names yet; returns their places. In order of what searches look up, so that row groups can be skipped."""
        folder = uuid.uuid4().hex
        for name, df in tables.items():
            if name in ORDER:
                df = df.repartitionByRange(*ORDER[name]).sortWithinPartitions(*ORDER[name])
            df.write.parquet(f"{self.path}/{folder}/{name}")
        return {name: f"{folder}/{name}" for name in tables}

    def commit(self, base: Snapshot | None, places: Mapping[str, str], **facts: object) -> None:
        """The state after ``base``, with tables and facts replaced; Conflict if another writer has made that one."""
        old = base.meta if base else {"tables": {}, "state": 0}
        state = old.get("state", 0) + 1
        meta = {**old, **facts, "schema": SCHEMA_VERSION, "tables": {**old["tables"], **places}, "state": state}
        fresh = self._path(f"{self.path}/_next-{uuid.uuid4().hex}")
        stream = self._fs.create(fresh, False)
        try:
            stream.write(bytearray(json.dumps(meta).encode()))
        finally:
            stream.close()
        self._fs.mkdirs(self._path(f"{self.path}/_states"))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # without the option to overwrite, so that a number is taken once
            context.rename(fresh, self._path(f"{self.path}/_states/{state:012d}.json"), none)
        except Py4JJavaError as e:
            self._fs.delete(fresh, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"state {state} of {self.path} was written by another") from None
            raise

    def vacuum(self) -> None:
        """Remove what the current state does not use, older states too; for times without writers, and without readers of those."""
        states = self._states()
        used = {t.split("/")[0] for t in self.meta()["tables"].values()} | {"_states"}
        for number in states[:-1]:
            self._fs.delete(self._path(f"{self.path}/_states/{number:012d}.json"), False)
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name not in used and (status.isDirectory() or name.startswith("_next-")):
                self._fs.delete(status.getPath(), True)

    def drop(self) -> None:
        self._fs.delete(self._path(self.path), True)
