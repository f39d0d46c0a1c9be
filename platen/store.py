"""A copy-on-write table store on plain Parquet: snapshots, constraints, migrations.

Each commit writes new files for the tables it changes under a fresh version
and then one manifest; readers follow the newest manifest, so a commit of
several tables is seen whole or not at all. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema


class Refused(ValueError):
    """A commit that would break a constraint, or a store newer than this library."""


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    # Manifests go through Hadoop's file systems: the store may lie wherever Spark can write.
    def _versions(self) -> list[int]:
        found = self._fs.listStatus(self._path(f"{self.root}/manifests"))
        return sorted(int(s.getPath().getName().split(".")[0]) for s in found if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "schema": schema.SCHEMA_VERSION, "tables": {}}
        text = self.spark.read.text(f"{self.root}/manifests/{version or versions[-1]:010d}.json", wholetext=True).first()[0]
        found = json.loads(text)
        if found["schema"] > schema.SCHEMA_VERSION:
            raise Refused(f"the store has schema {found['schema']}, newer than {schema.SCHEMA_VERSION}")
        return found

    def table(self, name: str, version: int | None = None) -> DataFrame:
        tables = self.manifest(version)["tables"]
        if name not in tables:
            return self.spark.createDataFrame([], schema.table(name))
        return self.spark.read.schema(schema.table(name)).parquet(f"{self.root}/{tables[name]}")

    def commit(self, changes: dict[str, DataFrame], check: bool = True) -> int:
        """Writes the tables given whole; refuses, changing nothing, if a constraint would break."""
        before = self.manifest()
        tables = dict(before["tables"])
        for name, df in changes.items():
            place = f"data/{name}-{uuid.uuid4().hex}"
            cast = [F.col(f.name).cast(f.dataType) for f in schema.table(name)]
            df.select(*cast).write.parquet(f"{self.root}/{place}")
            tables[name] = place
        if check and (faults := self.faults(tables, set(changes))):
            for name in changes:
                self._fs.delete(self._path(f"{self.root}/{tables[name]}"), True)
            raise Refused("; ".join(faults))
        version = before["version"] + 1
        out = self._fs.create(self._path(f"{self.root}/manifests/{version:010d}.json"), False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema.SCHEMA_VERSION, "tables": tables}).encode()))
        out.close()
        return version

    def faults(self, tables: dict[str, str], changed: set[str] | None = None) -> list[str]:
        """Broken primary keys, unique keys and references, by counts and anti joins."""

        def read(name: str) -> DataFrame:
            if name not in tables:
                return self.spark.createDataFrame([], schema.table(name))
            return self.spark.read.schema(schema.table(name)).parquet(f"{self.root}/{tables[name]}")

        found = []
        for name in tables:
            for kind, keys in (("key", schema.PRIMARY.get(name)), ("unique key", schema.UNIQUE.get(name))):
                if keys and (changed is None or name in changed) and not read(name).groupBy(*keys).count().where("count > 1").isEmpty():
                    found.append(f"{name}: {kind} {', '.join(keys)} repeats")
            for column, other in schema.FOREIGN.get(name, []):
                if changed is None or {name, other} & changed:
                    asked = read(name).where(F.col(column).isNotNull()).select(F.col(column).alias("id"))
                    if not asked.join(read(other).select("id"), "id", "left_anti").isEmpty():
                        found.append(f"{name}: {column} names no row of {other}")
        return found

    def check(self) -> list[str]:
        return self.faults(self.manifest()["tables"])

    def deleted(self, name: str, gone: DataFrame) -> dict[str, DataFrame]:
        """The changes that deleting rows (ids in ``gone``) makes, in the table and all that refer to it."""
        changes: dict[str, DataFrame] = {}
        todo = [(name, gone.select("id"))]
        while todo:
            table, ids = todo.pop()
            rows = changes.get(table, self.table(table))
            changes[table] = rows.join(ids, "id", "left_anti")
            for other, refers in schema.FOREIGN.items():
                for column, to in refers:
                    if to != table or other == table:
                        continue
                    left = changes.get(other, self.table(other))
                    lost = left.join(ids.select(F.col("id").alias(column)), column, "left_semi")
                    changes[other] = left.join(ids.select(F.col("id").alias(column)), column, "left_anti")
                    if "id" in left.columns:
                        todo.append((other, lost.select("id")))
        return changes


def migrated(store: TableStore, steps: list[tuple[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]], current: int) -> int:
    """Applies the migrations above ``current`` in order, each in one commit; their numbers must have no gap."""
    numbers = [n for n, _ in steps]
    if numbers != list(range(numbers[0], numbers[0] + len(numbers))):
        raise Refused("migrations have a gap")
    if current > numbers[-1]:
        raise Refused(f"the store is at {current}, newer than {numbers[-1]}")
    for number, step in steps:
        if number > current:
            store.commit(step({n: store.table(n) for n in schema.TABLES}))
            current = number
    return current
