"""A table that changes by touched parts: buckets by the hash of a column, each a folder of Parquet files, and a log of which folders hold."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .versions import VersionLog


#: Files of a bucket at most, dealt by the hash of the key: else every task of a shuffle would write one, and a bucket with a frequent value
#: in `by` is not one task.
FILES = 4


class TableStore:
    """Rows are in the bucket of the column `by`, which must not change in a row; `key` names a row.

    A change writes new folders for the buckets that it touches and then puts the next version of the log, which names a folder a bucket. A
    crash before that leaves the version before; what it has written is nobody's and goes with vacuum(). Of two writers at once the second
    takes the first one's folders over if they touch different buckets, and else does its change anew.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, by: str, key: str, buckets: int = 64):
        self.spark, self.folder, self.by, self.key = spark, folder.rstrip("/"), by, key
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.log = VersionLog(spark, f"{self.folder}/versions")
        _, now = self.log.latest()
        self.buckets = now.get("buckets", buckets)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.by)), F.lit(self.buckets)).cast("int")

    def _read(self, parts: dict[str, str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{p}" for p in parts.values()))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is, or as a version had it."""
        return self._read((self.log.latest()[1] if version is None else self.log.read(version)).get("parts", {}))

    def _touched(self, rows: DataFrame) -> list[str]:
        """The buckets of rows: at most as many as the table has."""
        return sorted(str(r[0]) for r in rows.select(self.bucket()).distinct().collect())

    def beside(self, rows: DataFrame) -> DataFrame:
        """The rows of the table in the buckets that rows fall into: all that can have to do with them."""
        parts = self.log.latest()[1].get("parts", {})
        return self._read({b: parts[b] for b in self._touched(rows) if b in parts})

    def lacking(self, rows: DataFrame) -> DataFrame:
        """The rows whose key the table has not, of each key one; only their buckets are read."""
        return rows.dropDuplicates([self.key]).join(self.beside(rows).select(self.key), self.key, "left_anti")

    def upsert(self, rows: DataFrame) -> int:
        """Rows (once a key) replace the table's rows of their keys, or are added. Returns the version. rows is computed more than once."""
        return self._change(rows, lambda old, new: old.join(new.select(self.key), self.key, "left_anti").unionByName(new))

    def insert(self, rows: DataFrame) -> int:
        """Adds the rows whose key the table has not."""
        return self._change(rows, lambda old, new: old.unionByName(new.dropDuplicates([self.key]).join(old.select(self.key), self.key, "left_anti")))

    def delete(self, rows: DataFrame) -> int:
        """Takes the rows of these keys out; rows needs the columns by and key."""
        return self._change(rows, lambda old, new: old.join(new.select(self.key).distinct(), self.key, "left_anti"))

    def _change(self, rows: DataFrame, after, tries: int = 20) -> int:
        touched = self._touched(rows)
        if not touched:
            return self.log.latest()[0]
        names = [f.name for f in self.schema]
        for _ in range(tries):
            number, base = self.log.latest()
            parts = base.get("parts", {})
            place = f"data/{uuid.uuid4().hex}"
            changed = after(self._read({b: parts[b] for b in touched if b in parts}), rows)
            dealt = changed.select(*names).withColumn("bucket", self.bucket()).repartition("bucket", F.pmod(F.xxhash64(F.col(self.key)), F.lit(FILES)))
            dealt.write.partitionBy("bucket").parquet(f"{self.folder}/{place}")
            written = self._buckets_in(place)
            while True:
                now = {b: p for b, p in parts.items() if b not in touched} | {b: f"{place}/bucket={b}" for b in written}
                if self.log.put(number + 1, {"buckets": self.buckets, "parts": now}):
                    return number + 1
                number, base = self.log.latest()
                theirs = base.get("parts", {})
                if any(theirs.get(b) != parts.get(b) for b in touched):
                    break  # it has changed what we have read
                parts = theirs
        raise RuntimeError(f"{tries} other writers were first in {self.folder}")

    def _buckets_in(self, place: str) -> list[str]:
        path = self.log._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{place}")
        return [n.split("=")[1] for f in self.log._fs.listStatus(path) if (n := f.getPath().getName()).startswith("bucket=")]

    def vacuum(self, versions: int = 1) -> int:
        """Deletes the folders that none of the last versions names, with what crashes left; not while others write. Returns how many."""
        keep = {p for n in self.log.numbers()[-versions:] for p in self.log.read(n).get("parts", {}).values()}
        fs, path, gone = self.log._fs, self.log._jvm.org.apache.hadoop.fs.Path, 0
        if not fs.exists(path(f"{self.folder}/data")):
            return 0
        for place in (f"data/{f.getPath().getName()}" for f in fs.listStatus(path(f"{self.folder}/data"))):
            held = [b for b in self._buckets_in(place) if f"{place}/bucket={b}" in keep]
            for b in self._buckets_in(place):
                if b not in held:
                    gone += bool(fs.delete(path(f"{self.folder}/{place}/bucket={b}"), True))
            if not held:
                fs.delete(path(f"{self.folder}/{place}"), True)
        return gone
