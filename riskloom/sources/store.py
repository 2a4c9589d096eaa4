"""Versioned Parquet snapshots with an atomic, multi-table commit.

Each version of a table is a folder that is written once. A commit file lists the current version of every table
and is replaced by a rename, so readers see all tables of a commit or none. File access goes through Spark's
file systems only, so the root may be in any store that Spark reaches.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

POINTER, LOCK = "current.json", "lock"


class SnapshotStore:
    """timeout: seconds after which a writer's lock counts as left behind."""

    def __init__(self, spark: SparkSession, root: str, timeout: float = 1800) -> None:
        self.spark, self.root, self.timeout = spark, root.rstrip("/"), timeout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _read_text(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        return "".join(r["value"] for r in self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect())

    def _write_text(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def versions(self) -> dict[str, list[str]]:
        """The folders of each table's current version: one, and one more for each append since."""
        text = self._read_text(POINTER)
        return json.loads(text) if text else {}

    def exists(self, table: str) -> bool:
        return table in self.versions()

    def read(self, table: str) -> DataFrame:
        return self.read_folders(self.versions()[table])

    def read_folders(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def create(self, table: str, schema: StructType) -> bool:
        """An empty table of this schema unless it is there already; whether it was made. ValueError if it is there with other columns."""
        if self.exists(table):
            have = [(f.name, f.dataType) for f in self.read(table).schema]
            if have != [(f.name, f.dataType) for f in schema]:
                raise ValueError(f"{table} has other columns")
            return False
        self.commit({table: self.spark.createDataFrame([], schema)})
        return True

    def catalog(self) -> DataFrame:
        """One row a table: table_name, folders, files, bytes, columns, changed_at (of its newest folder)."""
        rows = []
        for name, folders in sorted(self.versions().items()):
            files = [f for folder in folders for f in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if f.getPath().getName().startswith("part-")]
            changed = max(self._fs.getFileStatus(self._path(f"{self.root}/{f}")).getModificationTime() for f in folders)
            rows.append((name, len(folders), len(files), sum(f.getLen() for f in files), [f"{n} {t}" for n, t in self.read_folders(folders).dtypes], changed / 1000))
        return self.spark.createDataFrame(rows, "table_name string, folders int, files int, bytes long, columns array<string>, changed_at double")

    def history(self, table: str) -> DataFrame:
        """One row a folder of the table that still exists: folder, is_current, changed_at; the newest first."""
        current = set(self.versions().get(table, []))
        base = self._path(f"{self.root}/{table}")
        found = self._fs.listStatus(base) if self._fs.exists(base) else []
        rows = [(f"{table}/{x.getPath().getName()}", f"{table}/{x.getPath().getName()}" in current, x.getModificationTime() / 1000) for x in found]
        return self.spark.createDataFrame(sorted(rows, key=lambda r: (-r[2], r[0])), "folder string, is_current boolean, changed_at double")

    def stage(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """Write a frame to a folder of its own, which no reader sees before it is committed."""
        folder = f"{table}/v={uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{folder}")
        return folder

    def _acquire(self) -> str:
        """Take the lock; one that its owner has left for longer than ``timeout`` seconds is taken over."""
        lock, owner = self._path(f"{self.root}/{LOCK}"), uuid.uuid4().hex
        for _ in range(2):
            if self._fs.createNewFile(lock):
                self._write_text(LOCK, json.dumps({"owner": owner, "since": time.time()}))
                return owner
            if time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000 <= self.timeout:
                break
            self._fs.delete(lock, False)
        raise RuntimeError("another writer holds the store")

    def _release(self, owner: str) -> None:
        text = self._read_text(LOCK)
        if text and json.loads(text)["owner"] == owner:
            self._fs.delete(self._path(f"{self.root}/{LOCK}"), False)

    def commit_staged(self, replaced: dict[str, list[str]], appended: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
        """Make staged folders current together, in place of a table's folders or beside them."""
        owner = self._acquire()
        try:
            versions = self.versions() | replaced
            for table, folders in (appended or {}).items():
                versions[table] = [*versions.get(table, []), *folders]
            fresh = f"next-{uuid.uuid4().hex}.json"
            self._write_text(fresh, json.dumps(versions, sort_keys=True))
            self._replace(fresh, POINTER)
            return versions
        finally:
            self._release(owner)

    def _replace(self, name: str, target: str) -> None:
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        old, new = self._path(f"{self.root}/{target}"), self._path(f"{self.root}/{name}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri() if old.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._fs.makeQualified(new), self._fs.makeQualified(old), options)

    def commit(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
        """Write new versions of these tables and make them current together."""
        return self.commit_staged({name: [self.stage(name, df, (partition_by or {}).get(name))] for name, df in tables.items()})

    def append(self, table: str, df: DataFrame) -> None:
        """Add these rows; what the table holds already is neither read nor written."""
        self.commit_staged({}, {table: [self.stage(table, df)]})

    def compact(self, table: str) -> None:
        """One folder in place of a table's many appends."""
        self.commit({table: self.read(table)})

    def prune(self, older_than: float = 24 * 3600) -> list[str]:
        """Delete the folders that no current version names and that haven't changed for so many seconds."""
        current, dropped = {f for folders in self.versions().values() for f in folders}, []
        for table in sorted({f.split("/")[0] for f in current}):
            for status in self._fs.listStatus(self._path(f"{self.root}/{table}")):
                folder = f"{table}/{status.getPath().getName()}"
                if folder not in current and time.time() - status.getModificationTime() / 1000 >= older_than:
                    self._fs.delete(status.getPath(), True)
                    dropped.append(folder)
        return dropped
