"""Stored tables: keyed upsert, scoped refresh, append, and widening migration, all on Parquet.

A keyed or scoped table lies in BUCKETS buckets by a hash of its scope (if that is part of its key) or its key. A version is a manifest:
for each bucket, in which write its files are. A change writes the buckets that it touches, as one more write, and
then its manifest; the other buckets' files stay as they are. The manifest counts once Spark has committed it, so a failed change
leaves the table as it was. The version before stays for readers that have begun; files that no manifest of the last two names go.
Facts, and tables without key or scope, are one folder that is appended to. Tables of versions without manifests (`v000000000` and so on), as written
before, are read, and become buckets with their first change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum import schema

BUCKETS = 64
_BUCKET = "_bucket"


class Tables:
    """The declared tables under one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _names(self, pattern: str) -> list[str]:
        """What lies at a pattern under the root, by path from there."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
        depth = pattern.count("/") + 1
        return sorted("/".join(x.getPath().toString().split("/")[-depth:]) for x in found)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def versions(self, name: str) -> list[int]:
        """The committed versions, in order."""
        return [int(x.split("/")[-2]) for x in self._names(f"{name}/manifest/*/_SUCCESS")]

    def manifest(self, name: str, version: int) -> dict[int, int]:
        """In which write each bucket lies; a bucket without rows is in none."""
        rows = self.spark.read.schema("bucket int, at long").parquet(f"{self.root}/{name}/manifest/{version:09d}").collect()
        return {r["bucket"]: r["at"] for r in rows}

    def _old(self, name: str) -> list[str]:
        return [x.removesuffix("/_SUCCESS") for x in self._names(f"{name}/v*/_SUCCESS")]

    def _paths(self, name: str, only: set[int] | None = None) -> list[str]:
        """Where the table's rows are; `only`: those of some buckets."""
        have = self.versions(name)
        if have:
            places = self.manifest(name, have[-1])
            return [f"{self.root}/{name}/data/{at:09d}/{_BUCKET}={b}" for b, at in sorted(places.items()) if only is None or b in only]
        single = self._old(name)[-1:] or [x.removesuffix("/_SUCCESS") for x in self._names(f"{name}/rows/_SUCCESS")]
        return [f"{self.root}/{p}" for p in single]

    def read(self, name: str) -> DataFrame:
        """The table in its declared schema; columns that older files lack are null."""
        return self._rows(name, self._paths(name))

    def _rows(self, name: str, paths: list[str]) -> DataFrame:
        want = schema.table_schema(name)
        if not paths:
            return self.spark.createDataFrame([], want)
        return schema.align(self.spark.read.option("mergeSchema", "true").parquet(*paths), want)

    def append(self, name: str, rows: DataFrame) -> None:
        folder = (self._old(name)[-1:] or [f"{name}/rows"])[0]
        schema.align(rows, schema.table_schema(name)).write.mode("append").parquet(f"{self.root}/{folder}")

    def _by(self, name: str) -> list[str]:
        """The columns that a row's bucket depends on."""
        scope, keys = schema.SCOPED.get(name), schema.KEYS.get(name)
        return [scope] if scope and (not keys or scope in keys) else keys

    def _bucket(self, by: list[str]):
        return F.pmod(F.xxhash64(*by), F.lit(self.buckets)).cast("int")

    def _touched(self, name: str, rows: DataFrame) -> set[int]:
        """The buckets of `rows`, of which there are BUCKETS at most; all of a table that has no buckets yet."""
        if not self.versions(name):
            return set(range(self.buckets))
        return {r[0] for r in rows.select(self._bucket(self._by(name))).distinct().collect()}

    def _change(self, name: str, touched: set[int], rows: DataFrame) -> None:
        """`rows`, which may come from the table itself, become all rows of the touched buckets."""
        have = self.versions(name)
        new = have[-1] + 1 if have else 0
        data = f"{name}/data/{new:09d}"
        placed = rows.withColumn(_BUCKET, self._bucket(self._by(name))).hint("rebalance", _BUCKET)
        placed.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.root}/{data}")
        places = {b: at for b, at in (self.manifest(name, have[-1]) if have else {}).items() if b not in touched}
        places |= {int(x.split("=")[-1]): new for x in self._names(f"{data}/{_BUCKET}=*")}
        listed = self.spark.createDataFrame(sorted(places.items()), "bucket int, at long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}/manifest/{new:09d}")
        self._clear(name)

    def _clear(self, name: str) -> None:
        have = self.versions(name)
        kept = {at for v in have[-2:] for at in self.manifest(name, v).values()}
        for path in self._names(f"{name}/data/*"):
            if int(path.split("/")[-1]) not in kept | {have[-1]}:
                self._delete(path)
        for v in have[:-2]:
            self._delete(f"{name}/manifest/{v:09d}")
        for path in self._old(name) if len(have) > 1 else []:
            self._delete(path)

    def upsert(self, name: str, rows: DataFrame, order: str | None = None) -> None:
        """Insert or replace by key: of new rows with one key the last by `order` stays. Tables without a key are appended to."""
        keys = schema.KEYS.get(name)
        if name in schema.FACTS or not keys:
            return self.append(name, rows)
        new = schema.align(rows, schema.table_schema(name))
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order) if order else F.desc(F.xxhash64(*new.columns))))
        new = new.withColumn("_last", last).where("_last = 1").drop("_last")
        touched = self._touched(name, new)
        kept = self._rows(name, self._paths(name, touched)).join(new.select(*keys), keys, "left_anti")
        self._change(name, touched, kept.unionByName(new, allowMissingColumns=True))

    def refresh(self, name: str, rows: DataFrame, scopes: DataFrame | None = None) -> None:
        """Replace what the table holds of `scopes` (a column of dockets or documents; default: those of `rows`) by `rows`.

        Of a scope that is named and has no new rows nothing stays.
        """
        scope = schema.SCOPED[name]
        new = schema.align(rows, schema.table_schema(name))
        named = new.select(scope) if scopes is None else scopes.toDF(scope).unionByName(new.select(scope))
        touched = self._touched(name, named) if self._by(name) == [scope] else set(range(self.buckets))
        kept = self._rows(name, self._paths(name, touched)).join(named.distinct(), scope, "left_anti")
        self._change(name, touched, kept.unionByName(new, allowMissingColumns=True))

    def log(self, stage: str, detail: str) -> None:
        self.append("runlog", self.spark.sql("select cast(current_timestamp() as timestamp_ntz) as ts, ? as stage, ? as detail", args=[stage, detail]))
