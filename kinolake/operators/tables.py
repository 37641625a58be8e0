"""Keyed tables: the verbs of a key-value store over DataFrames, and versioned storage.

A stored table is a list of parts; each version is a small numbered file that names them. A
commit writes one new part, an append adds a part to those of the version before, and the
version file is created last and never changed, so that a reader always finds a whole
table. The newest versions are kept, what only older ones name is removed.
"""

from __future__ import annotations

import fnmatch
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinolake.session import cut_lineage


def all_keys(table: DataFrame, key: str = "id") -> DataFrame:
    return table.select(key)


def get_by_id(table: DataFrame, value, key: str = "id") -> DataFrame:
    """The row of a key, or no row."""
    return table.filter(F.col(key) == F.lit(value))


def get_by_ids(table: DataFrame, wanted: DataFrame, key: str = "id", position: str = "pos", fields: list[str] | None = None) -> DataFrame:
    """One row for each wanted (position, key), nulls where the key is missing; the same key may be wanted twice.

    ``table`` has unique keys. Order by ``position`` when showing.
    """
    columns = [c for c in (fields or table.columns) if c not in (key, position)]
    return wanted.select(position, key).join(table.select(key, *columns), key, "left").select(position, key, *columns)


def missing_keys(keys: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """The keys that the table doesn't have, once; null keys are left out."""
    return keys.select(key).filter(F.col(key).isNotNull()).join(table.select(key), key, "left_anti").distinct()


def only_new(rows: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key the table doesn't have yet."""
    return rows.join(table.select(key), key, "left_anti")


def last_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the last in ``order`` (which must be total). Combined before the shuffle."""
    columns = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return best.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The table with whole rows replaced or added; ``rows`` has unique keys."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def merge_attributes(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with attributes overwritten where the new row has a value; unknown keys are added."""
    names = [c for c in dict.fromkeys([*table.columns, *rows.columns]) if c not in key]
    old = table.select(*key, *[F.col(c).alias(f"_o_{c}") for c in table.columns if c not in key])
    new = rows.select(*key, *[F.col(c).alias(f"_n_{c}") for c in rows.columns if c not in key])
    joined = old.join(new, key, "full")
    pick = lambda c: [F.col(p + c) for p, t in (("_n_", rows), ("_o_", table)) if c in t.columns]
    return joined.select(*key, *[F.coalesce(*pick(c)).alias(c) for c in names])


def merge_manifest(tasks: DataFrame, old: DataFrame, key: str = "key") -> DataFrame:
    """New tasks with the values that an older manifest has for them; older tasks that are gone stay out."""
    kept = [c for c in old.columns if c != key and c in tasks.columns]
    joined = tasks.join(old.select(key, *[F.col(c).alias(f"_o_{c}") for c in kept]), key, "left")
    return joined.select(*[F.coalesce(F.col(f"_o_{c}"), F.col(c)).alias(c) if c in kept else F.col(c) for c in tasks.columns])


class Store:
    """Named tables in a folder (any file system Spark can reach). One writer a table; readers at any time."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 4, most_parts: int = 64):
        self.spark, self.folder, self.keep, self.most_parts = spark, folder.rstrip("/"), max(2, keep), most_parts

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, name: str) -> list[str]:
        fs, folder = self._fs(f"{self.folder}/{name}")
        return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []

    def _versions(self, name: str) -> list[int]:
        return sorted(int(f[2:-5]) for f in self._names(name) if f.startswith("v-") and f.endswith(".json"))

    def _parts(self, name: str, version: int) -> list[str]:
        text = self.spark.read.text(f"{self.folder}/{name}/v-{version:010d}.json", wholetext=True).first()[0]
        return json.loads(text)["parts"]

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def tables(self) -> list[str]:
        fs, folder = self._fs(self.folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.isDirectory() and self.exists(f.getPath().getName())) if fs.exists(folder) else []

    def read(self, name: str, schema=None) -> DataFrame | None:
        """The current version; an empty table of the schema, or None, where there is none."""
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], schema) if schema is not None else None
        parts = [f"{self.folder}/{name}/{p}" for p in self._parts(name, versions[-1])]
        return self.spark.read.option("mergeSchema", len(parts) > 1).parquet(*parts)

    def _point(self, name: str, parts: list[str]) -> None:
        versions = self._versions(name)
        fs, file = self._fs(f"{self.folder}/{name}/v-{(versions[-1] if versions else 0) + 1:010d}.json")
        out = fs.create(file, False)  # fails if another writer made this version
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()
        for old in versions[: -(self.keep - 1)]:
            fs.delete(self._fs(f"{self.folder}/{name}/v-{old:010d}.json")[1], False)
        named = {p for v in self._versions(name) for p in self._parts(name, v)}
        for part in self._names(name):
            if part.startswith("p-") and part not in named:
                fs.delete(self._fs(f"{self.folder}/{name}/{part}")[1], True)

    def _write(self, name: str, table: DataFrame) -> str:
        part = "p-" + uuid.uuid4().hex
        table.write.parquet(f"{self.folder}/{name}/{part}")
        return part

    def commit(self, name: str, table: DataFrame) -> None:
        """A new version of the whole table."""
        self._point(name, [self._write(name, table)])

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows; what is stored is not rewritten, but for every ``most_parts`` appends."""
        versions = self._versions(name)
        parts = [*(self._parts(name, versions[-1]) if versions else []), self._write(name, rows)]
        self._point(name, parts)
        if len(parts) > self.most_parts:
            self.commit(name, self.read(name))

    def upsert(self, name: str, rows: DataFrame, key: str = "id") -> None:
        """Rows of unique keys; only added where the table has none of the keys, else the table is written anew."""
        rows = cut_lineage(rows)
        known = self.read(name)
        if known is None or known.join(rows.select(key), key, "left_semi").isEmpty():
            self.append(name, rows)
        else:
            self.commit(name, upsert(known, rows, key))

    def drop(self, name: str) -> None:
        """An empty table of the same columns."""
        table = self.read(name)
        if table is not None:
            self.commit(name, table.limit(0))

    def reset(self, pattern: str = "*") -> list[str]:
        """Removes the tables whose name fits a pattern (``*``, ``?``) with all versions; their names."""
        gone = [t for t in self.tables() if fnmatch.fnmatchcase(t, pattern)]
        for name in gone:
            fs, folder = self._fs(f"{self.folder}/{name}")
            fs.delete(folder, True)
        return gone


def newest(rows: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The ``n`` newest rows."""
    return rows.orderBy(F.desc_nulls_last(by), tie).limit(n)


def first_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")


def global_rank(rows: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """The rows with their place in ``order`` over the whole table, from 0.

    Sorted by ranges and numbered within each; only the number of rows of each range is
    gathered. The sorted rows are written once to the checkpoint folder, which also keeps
    the numbers the same for every reader; lineage ends there.
    """
    kept = cut_lineage(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = kept.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row a partition
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(starts), part == F.col("_p")).withColumn(out, F.col("_before") + inside).drop("_m", "_p", "_before")


def for_each(rows: DataFrame, values: DataFrame, most: int = 10_000) -> DataFrame:
    """Every row with every distinct row of a short list; more than ``most`` of these are an error, not a truncation."""
    listed = values.distinct().limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} values")
    shape = values.schema.simpleString()
    if not listed:
        return rows.limit(0).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in values.schema])
    items = F.array(*[F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in values.schema]) for r in sorted(listed, key=repr)]).cast(f"array<{shape}>")
    return rows.withColumn("_v", F.explode(items)).select(*rows.columns, "_v.*")
