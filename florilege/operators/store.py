"""The stored index: tables as Parquet folders, changed in transactions that become visible all at once or not at all.

A store is a folder. `tables/<name>-<transaction>` holds one version of a table and is never written again; `CURRENT` names
the version of each table together with its schema. A transaction stages new versions and ends by renaming a new `CURRENT`
over the old one, so a reader sees either all of its tables or none, and a job that dies half-way leaves nothing that is
read. A transaction that began before another one was committed is refused, not merged.

An empty store has no tables; a table that was never written is an error to read. Rows with null keys are one key.
"""

from __future__ import annotations

import json
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from florilege.operators.ingest import first, latest


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, inside: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{inside}" if inside else self.root)

    def _current(self) -> dict:
        at = self._path("CURRENT")
        if not self._files.exists(at):
            return {"version": "", "tables": {}}
        stream = self._files.open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        fresh = self._path(f"CURRENT-{state['version']}")
        out = self._files.create(fresh, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context.rename(fresh, self._path("CURRENT"), how)

    def tables(self) -> list[str]:
        return sorted(self._current()["tables"])

    def read(self, table: str) -> DataFrame:
        """The table as of the last commit; no job is needed for its schema."""
        entry = self._current()["tables"].get(table)
        if entry is None:
            raise ValueError(f"no table {table} in {self.root}")
        return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{self.root}/tables/{entry['folder']}")

    def begin(self) -> "Transaction":
        return Transaction(self)

    def vacuum(self) -> None:
        """Delete the versions that no table has any more. Readers of an older state must be done."""
        kept = {e["folder"] for e in self._current()["tables"].values()}
        at = self._path("tables")
        if self._files.exists(at):
            for status in self._files.listStatus(at):
                if status.getPath().getName() not in kept:
                    self._files.delete(status.getPath(), True)


class Transaction:
    """Use as a context manager: leaving it commits, an exception rolls back."""

    def __init__(self, store: Store):
        self.store, self.state, self.id, self.staged = store, store._current(), uuid.uuid4().hex[:12], {}

    def __enter__(self) -> "Transaction":
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.rollback() if kind else self.commit()

    def read(self, table: str) -> DataFrame:
        """The table as this transaction left it."""
        entry = self.staged.get(table) or self.state["tables"].get(table)
        if entry is None:
            raise ValueError(f"no table {table} in {self.store.root}")
        return self.store.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{self.store.root}/tables/{entry['folder']}")

    def write(self, table: str, df: DataFrame) -> None:
        """Replace the table."""
        folder = f"{table}-{self.id}-{sum(f.startswith(table) for f in self.staged)}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(f"{self.store.root}/tables/{folder}")
        self.staged[table] = {"folder": folder, "schema": json.loads(df.schema.json())}

    def upsert(self, table: str, df: DataFrame, keys: list[str], order: str) -> None:
        """Of each key the row with the greatest `order` is kept, rows of df before those already there (last writer wins)."""
        self._merge(table, latest(df, keys, order).drop(order), keys, theirs=True)

    def insert(self, table: str, df: DataFrame, keys: list[str], order: str) -> None:
        """Rows whose key the table has not yet; of several in df the one with the smallest `order`."""
        self._merge(table, first(df, keys, order).drop(order), keys, theirs=False)

    def _merge(self, table: str, rows: DataFrame, keys: list[str], theirs: bool) -> None:
        if table in self.staged or table in self.state["tables"]:
            old = self.read(table)
            same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
            rows = rows.unionByName(old.join(rows, same(old, rows), "left_anti")) if theirs else old.unionByName(rows.join(old, same(rows, old), "left_anti"))
        self.write(table, rows)

    def commit(self) -> None:
        if self.store._current()["version"] != self.state["version"]:
            self.rollback()
            raise RuntimeError(f"{self.store.root} was changed by another transaction")
        self.store._publish({"version": self.id, "tables": {**self.state["tables"], **self.staged}})

    def rollback(self) -> None:
        for entry in self.staged.values():
            self.store._files.delete(self.store._path(f"tables/{entry['folder']}"), True)
        self.staged = {}
