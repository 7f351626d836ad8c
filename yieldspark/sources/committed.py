"""Tables changed by commits: data folders are written first, then one log file makes them the next version.

A store is a folder with `data/<table>/<id>` (Parquet) and `log/<version>.json`; a log file names the folders
and the schema of every table as of its version, so several tables change in one commit. A log file appears
whole or not at all and never replaces another: a job lost before that leaves the last version as it was,
and of two writers that began at one version the second fails. Readers of a version are not disturbed until
`vacuum` removes it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from yieldspark.sources.staging import stage

DIGITS = 20


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


@dataclass
class Store:
    spark: SparkSession
    root: str

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root.rstrip("/"), *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that can be read, in order."""
        path, fs = self._path("log")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:DIGITS]) for n in names if n.endswith(".json") and n[:DIGITS].isdigit())

    def tables(self, version: int | None = None) -> dict[str, dict]:
        """name: schema and folders, as of a version (the last one if none is given; none before the first commit)."""
        if version is None:
            known = self.versions()
            if not known:
                return {}
            version = known[-1]
        path, fs = self._path("log", f"{version:0{DIGITS}d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"]
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._frame(self.tables(version), name)

    def _frame(self, tables: dict[str, dict], name: str) -> DataFrame:
        if name not in tables:
            raise ValueError(f"no table {name}")
        schema = StructType.fromJson(tables[name]["schema"])
        if not tables[name]["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root.rstrip('/')}/{f}" for f in tables[name]["folders"]))

    def begin(self) -> Transaction:
        known = self.versions()
        version = known[-1] if known else -1
        return Transaction(self, version, self.tables(version) if known else {})

    def _publish(self, version: int, content: str) -> None:
        """Writes a log file aside and names it in one step that fails where the name is taken."""
        jvm, (target, fs) = self.spark._jvm, self._path("log", f"{version:0{DIGITS}d}.json")
        aside, _ = self._path("log", f".{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            if target.toUri().getScheme() in (None, "file") and fs.getUri().getScheme() == "file":  # a local rename would replace
                local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(local(target), local(aside))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, target, none)
        except Exception as x:
            if "AlreadyExists" in str(x):
                raise Conflict(f"version {version} of {self.root} has been written by another") from None
            raise
        finally:
            fs.delete(aside, False)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all but the last `keep` versions, and the folders that only removed ones name; returns those.

        Folders that no version names stay, as a writer may be about to commit them.
        """
        known = self.versions()
        old, kept = known[: len(known) - max(keep, 1)], known[len(known) - max(keep, 1) :]
        of = lambda versions: {f for v in versions for t in self.tables(v).values() for f in t["folders"]}
        gone = sorted(of(old) - of(kept))
        for v in old:
            path, fs = self._path("log", f"{v:0{DIGITS}d}.json")
            fs.delete(path, False)
        for f in gone:
            path, fs = self._path(f)
            fs.delete(path, True)
        return gone


@dataclass
class Transaction:
    """Changes that become one version, or none: reads see the state at the beginning and this writer's changes."""

    store: Store
    version: int
    tables: dict[str, dict]
    done: bool = field(default=False)

    def read(self, name: str) -> DataFrame:
        return self.store._frame(self.tables, name)

    def create(self, name: str, schema: str | StructType) -> None:
        """An empty table; one that is there with the same columns stays, another schema raises."""
        kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        plain = lambda s: [(f.name, f.dataType.simpleString()) for f in s.fields]
        if name not in self.tables:
            self.tables[name] = {"schema": json.loads(kind.json()), "folders": []}
        elif plain(StructType.fromJson(self.tables[name]["schema"])) != plain(kind):
            raise ValueError(f"{name} has another schema")

    def _written(self, name: str, df: DataFrame) -> str:
        """df under the table's columns and types, in a folder of its own."""
        schema = StructType.fromJson(self.tables[name]["schema"])
        if missing := [f.name for f in schema.fields if f.name not in df.columns]:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        folder = f"data/{name}/{uuid.uuid4().hex}"
        df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields)).write.parquet(f"{self.store.root.rstrip('/')}/{folder}")
        return folder

    def _set(self, name: str, folders: list[str]) -> None:
        self.tables[name] = {**self.tables[name], "folders": folders}

    def refresh(self, name: str, df: DataFrame) -> None:
        """df in place of all rows; it may read the table itself."""
        if name not in self.tables:
            self.create(name, df.schema)
        self._set(name, [self._written(name, df)])

    def append(self, name: str, rows: DataFrame, key: str | None = None) -> None:
        """rows beside the others. With a key, one that is null, comes twice or is there already raises."""
        if key:
            rows = stage(rows, "append")  # checked and written alike
            if not rows.where(F.col(key).isNull()).isEmpty() or not rows.groupBy(key).count().where("count > 1").isEmpty():
                raise ValueError(f"{key} is null or comes twice")
            if not rows.join(self.read(name).select(key), key, "left_semi").isEmpty():
                raise ValueError(f"{key} exists already")
        self._set(name, [*self.tables[name]["folders"], self._written(name, rows)])

    def _rewrite(self, name: str, hit: DataFrame | None, condition: Column | None, change) -> None:
        """Replaces only the folders that hold a hit row, by change(their rows)."""
        held: set[str] = set()
        if self.tables[name]["folders"]:
            paths = self.read(name).select("*", F.col("_metadata.file_path").alias("path__"))
            found = paths.join(hit, list(hit.columns), "left_semi") if hit is not None else paths.where(condition)
            part = F.regexp_extract("path__", rf"(data/{name}/[0-9a-f]{{32}})/[^/]*$", 1)
            held = {r[0] for r in found.select(part).distinct().collect()}  # a row a folder
        stay = [f for f in self.tables[name]["folders"] if f not in held]
        inner = {**self.tables, name: {**self.tables[name], "folders": sorted(held)}}
        self._set(name, [*stay, self._written(name, change(self.store._frame(inner, name)))])

    def upsert(self, name: str, rows: DataFrame, key: str) -> None:
        """rows in place of those of their key; columns that rows lack are null. A key that comes twice raises."""
        columns = self.read(name).columns
        rows = stage(self.read(name).limit(0).unionByName(rows, allowMissingColumns=True).select(*columns), "upsert")
        if not rows.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} comes twice")
        keys = rows.select(key)
        self._rewrite(name, keys, None, lambda old: old.join(keys, key, "left_anti").select(*columns).unionByName(rows))

    def update(self, name: str, condition: Column, values: dict[str, Column]) -> None:
        """New values in the rows that meet the condition."""
        self._rewrite(name, None, condition, lambda old: old.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, name: str, condition: Column) -> None:
        self._rewrite(name, None, condition, lambda old: old.where(~F.coalesce(condition, F.lit(False))))

    def commit(self) -> int:
        """The new version's number; raises Conflict, and changes nothing, if another has committed since begin."""
        if self.done:
            raise RuntimeError("this transaction is over")
        known = self.store.versions()
        if known and known[-1] != self.version:
            raise Conflict(f"{self.store.root} is at version {known[-1]}, this writer began at {self.version}")
        self.store._publish(self.version + 1, json.dumps({"tables": self.tables}))
        self.done = True
        return self.version + 1


def retire(change: Transaction, name: str, columns: list[str], note: str) -> None:
    """Registry columns excluded, with the note, as part of a commit; never a dropped column."""
    change.update(name, F.col("column_name").isin(*columns), {"status": F.lit("excluded"), "notes": F.lit(note)})
