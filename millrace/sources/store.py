"""A committed table: versions of immutable files, one small pointer that is swapped when a version is complete.

Rows lie in buckets by a hash of their keys. A commit writes the buckets that it touches as new files, then a manifest that names
the files of every bucket, then swaps the pointer by one rename. Readers follow the pointer once, so they see a whole version,
the old or the new; a commit that is tried again under its token changes nothing. One writer at a time, any number of readers.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Tokens of past commits that a manifest remembers.
TOKENS = 10_000


def positioned(rows: DataFrame, order: str | None, name: str = "__order") -> DataFrame:
    """rows with what tells the last of equal keys: the column `order`, or else the place in the table."""
    return rows.withColumn(name, F.col(order) if order else F.monotonically_increasing_id())


def last_of(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The last row of each key, by `order` or else by its place in the table; nulls among the keys are equal."""
    placed = positioned(rows, order)
    chosen = placed.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), "__order").alias("__r"))
    return chosen.select("__r.*")


class TableStore:
    """A table of rows with unique keys in `folder`, a URI that driver and executors reach."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 32):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self.fs, self.root = fs.FileSystem.from_uri(self.folder)

    def _read_json(self, name: str) -> dict | None:
        if self.fs.get_file_info(f"{self.root}/{name}").type != fs.FileType.File:
            return None
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return json.loads(f.read())

    def _write_json(self, name: str, value: dict) -> None:
        """Under another name first: whoever reads `name` finds the old content or the new one."""
        self.fs.create_dir(f"{self.root}/{name}".rpartition("/")[0], recursive=True)
        hidden = f"{self.root}/.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(hidden) as f:
            f.write(json.dumps(value).encode())
        self.fs.move(hidden, f"{self.root}/{name}")

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of; the current one if none is named."""
        if version is None:
            pointer = self._read_json("current.json")
            version = pointer["version"] if pointer else 0
        if not version:
            return {"version": 0, "schema": None, "buckets": {}, "tokens": []}
        found = self._read_json(f"versions/{version:012d}.json")
        if found is None:
            raise ValueError(f"{self.folder} has no version {version}")
        if (found["keys"], found["n_buckets"]) != (self.keys, self.buckets):
            raise ValueError(f"{self.folder} has keys {found['keys']} in {found['n_buckets']} buckets")
        return found

    def version(self) -> int:
        return self.manifest()["version"]

    def read(self, version: int | None = None, schema: str | None = None) -> DataFrame:
        """The rows of a version, by default of the current one; without a version an empty table of `schema`."""
        return self._rows(self.manifest(version), None, schema)

    def _rows(self, manifest: dict, buckets: list[int] | None, schema: str | StructType | None) -> DataFrame:
        kept = StructType.fromJson(manifest["schema"]) if manifest["schema"] else schema
        if kept is None:
            raise ValueError(f"{self.folder} has no version yet")
        paths = [f"{self.folder}/{p}" for k, p in sorted(manifest["buckets"].items()) if buckets is None or int(k) in buckets]
        return self.spark.read.schema(kept).parquet(*paths) if paths else self.spark.createDataFrame([], kept)

    def upsert(self, rows: DataFrame, token: str | None = None, order: str | None = None, replace: bool = True, remove: Column | None = None) -> int:
        """Commits rows: the last one of each key replaces the one that is there, or with replace=False is left out if one is there. The version that holds them.

        remove: a condition on which rows of the buckets that this commit touches leave the table.

        A token that was committed before changes nothing. Rows must have the table's columns; those of the first commit are the
        table's. No rows make a version, too.
        """
        now = self.manifest()
        if token is not None and token in now["tokens"]:
            return now["version"]
        schema = StructType.fromJson(now["schema"]) if now["schema"] else rows.schema
        if set(schema.names) != set(rows.columns):
            raise ValueError(f"columns are {rows.columns}, not {schema.names}")
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("__bucket")
        part = f"data/{now['version'] + 1:012d}-{uuid.uuid4().hex}"
        incoming = f"{self.folder}/{part}/incoming"
        last_of(rows, self.keys, order).select(*[F.col(f.name).cast(f.dataType) for f in schema], bucket).write.parquet(incoming)
        new = self.spark.read.schema(StructType.fromJson(schema.jsonValue()).add("__bucket", IntegerType())).parquet(incoming)
        touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # as many as there are buckets at most
        old = self._rows(now, touched, schema).withColumn("__bucket", bucket)
        same = self._same("o", "n")
        if replace:
            merged = old.alias("o").join(new.alias("n"), same, "left_anti").unionByName(new)
        else:
            merged = old.unionByName(new.alias("n").join(old.alias("o"), same, "left_anti"))
        merged = merged if remove is None else merged.where(~F.coalesce(remove, F.lit(False)))
        merged.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{part}/rows")
        there = {i.base_name for i in self.fs.get_file_info(fs.FileSelector(f"{self.root}/{part}/rows", allow_not_found=True))}
        names = {str(k): f"{part}/rows/__bucket={k}" for k in touched if f"__bucket={k}" in there}
        made = {"version": now["version"] + 1, "schema": schema.jsonValue(), "keys": self.keys, "n_buckets": self.buckets, "buckets": {k: p for k, p in now["buckets"].items() if int(k) not in touched} | names, "tokens": [*now["tokens"], *([token] if token is not None else [])][-TOKENS:]}
        self._write_json(f"versions/{made['version']:012d}.json", made)
        self._write_json("current.json", {"version": made["version"]})
        self.fs.delete_dir(f"{self.root}/{part}/incoming")
        return made["version"]

    def _same(self, one: str, two: str) -> Column:
        """Equal keys, nulls being equal."""
        found = F.lit(True)
        for k in self.keys:
            found = found & F.col(f"{one}.{k}").eqNullSafe(F.col(f"{two}.{k}"))
        return found

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the files that none of the last `keep` versions has, and what commits that failed have left; the number of folders."""
        now = self.version()
        kept = [self.manifest(v) for v in range(max(1, now - keep + 1), now + 1)]
        used = {p.split("/")[1] for m in kept for p in m["buckets"].values()}
        gone = [i for i in self.fs.get_file_info(fs.FileSelector(f"{self.root}/data", allow_not_found=True)) if i.base_name not in used]
        for i in gone:
            self.fs.delete_dir(i.path)
        for i in self.fs.get_file_info(fs.FileSelector(f"{self.root}/versions", allow_not_found=True)):
            if int(i.base_name.partition(".")[0]) < now - keep + 1:
                self.fs.delete_file(i.path)
        return len(gone)
