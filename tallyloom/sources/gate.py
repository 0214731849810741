"""The gate of texts by their hash as a lookup: a store by buckets of the hash, and Bloom filters that tell most new hashes without it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chat_hash
from .store import TableStore
from .versions import VersionLog

#: A block of a Bloom filter is eight words of 64 bits; a hash sets one bit in each word of its one block.
WORDS = tuple(f"w{i}" for i in range(8))
#: Hashes that a block is made for: some 16 bits each, so that about one in a thousand new hashes has to be looked up.
PER_BLOCK = 32
STORED = "chat_hash string, id string, batch string"


class HashGate:
    """Hashes that have been admitted, with an id and the batch that brought them.

    folder holds the store (rows in the bucket of their hash) and a second store with the filters, of each bucket `blocks` blocks at most. A
    batch's hashes meet the blocks that they fall into; only those whose bits are all set are looked up, in their buckets. The bits are
    written before the rows, so a crash between both leaves bits too many, never too few. More hashes than expected make more lookups, not
    other results; rebuild() makes wider filters.
    """

    def __init__(self, spark: SparkSession, folder: str, expected: int = 1 << 22, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.store = TableStore(spark, f"{self.folder}/rows", STORED, by="chat_hash", key="chat_hash", buckets=buckets)
        self.shape = VersionLog(spark, f"{self.folder}/shape")
        if not self.shape.numbers():
            self.shape.put(1, {"blocks": max(1, -(-expected // (PER_BLOCK * self.store.buckets))), "filters": "filters-1"})
        self._open()

    def _open(self) -> None:
        now = self.shape.latest()[1]
        self.blocks = now["blocks"]
        schema = "home int, block_id long, " + ", ".join(f"{w} long" for w in WORDS)
        self.filters = TableStore(self.spark, f"{self.folder}/{now['filters']}", schema, by="home", key="block_id", buckets=self.store.buckets)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows with the bucket of their hash (home), the block (once in the whole gate) and a bit for each of its words."""
        h = lambda salt: F.xxhash64(F.col("chat_hash"), F.lit(salt))
        placed = rows.withColumn("home", self.store.bucket())
        placed = placed.withColumn("block_id", F.col("home").cast("long") * F.lit(self.blocks) + F.pmod(h(1), F.lit(self.blocks)))
        return placed.withColumns({f"_{w}": _one_bit(h(2), i) for i, w in enumerate(WORDS)})

    def _maybe(self, rows: DataFrame) -> DataFrame:
        """The rows (of each hash one) that the filters do not rule out."""
        placed = self._placed(rows)
        held = F.lit(True)
        for w in WORDS:
            held = held & (F.col(w).bitwiseAND(F.col(f"_{w}")) != 0)
        return placed.join(self.filters.beside(placed.select("home").distinct()).drop("home"), "block_id").where(held).select(*rows.columns)

    def _lacking(self, first: DataFrame) -> DataFrame:
        """Those whose hash is not there. first: of each hash one row."""
        maybe = self._maybe(first)
        there = self.store.beside(maybe).select("chat_hash").join(maybe.select("chat_hash"), "chat_hash", "left_semi")
        return first.join(there, "chat_hash", "left_anti")

    @staticmethod
    def firsts(incoming: DataFrame, text: str = "chat_text", seq: str = "seq") -> DataFrame:
        """chat_hash and id (seq as text): of each hash the row of the least seq; a null text is an empty one."""
        return incoming.groupBy(chat_hash(F.coalesce(F.col(text), F.lit(""))).alias("chat_hash")).agg(F.min(seq).cast("string").alias("id"))

    def new(self, incoming: DataFrame, text: str = "chat_text", seq: str = "seq") -> DataFrame:
        """chat_hash and id of the texts that have not been admitted, of each hash the first."""
        return self._lacking(self.firsts(incoming, text, seq))

    def admit(self, incoming: DataFrame, batch: str, text: str = "chat_text", seq: str = "seq") -> DataFrame:
        """Admits what is new, and returns what this batch has brought: chat_hash and id. The same batch again, after a crash too, returns the
        same. Texts that are known write nothing. incoming is computed once: its hashes are written beside the store while this runs."""
        with self._staged(self.firsts(incoming, text, seq)) as first:
            with self._staged(self._lacking(first).select("chat_hash", "id", F.lit(batch).alias("batch"))) as rows:
                self._note(rows)
                self.store.insert(rows)
            brought = self.store.beside(first).where(F.col("batch") == batch)
        return brought.select("chat_hash", "id")

    @contextmanager
    def _staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """rows as a written table, which goes afterwards."""
        place = f"{self.folder}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(place)
        try:
            yield self.spark.read.schema(rows.schema).parquet(place)
        finally:
            self.shape._fs.delete(self.shape._jvm.org.apache.hadoop.fs.Path(place), True)

    def _note(self, rows: DataFrame) -> None:
        """Sets the bits of rows."""
        added = self._placed(rows).groupBy("home", "block_id").agg(*(F.bit_or(f"_{w}").alias(w) for w in WORDS))
        both = lambda old, new: old.unionByName(new).groupBy("home", "block_id").agg(*(F.bit_or(w).alias(w) for w in WORDS))
        self.filters._change(added, both)

    def find(self, text: str) -> str | None:
        """The id of one text, or None. A text that the filters rule out reads no row; another one's bucket is read with the hash pushed
        down to its files."""
        one = self.spark.createDataFrame([(text,)], "t string").select(chat_hash(F.col("t")).alias("chat_hash"))
        value = one.first()[0]
        if self._maybe(one).isEmpty():
            return None
        got = self.store.beside(one).where(F.col("chat_hash") == value).select("id").first()
        return got[0] if got else None

    def rebuild(self, expected: int) -> None:
        """Filters for so many hashes, from the rows; not while others write."""
        number, _ = self.shape.latest()
        self.shape.put(number + 1, {"blocks": max(1, -(-expected // (PER_BLOCK * self.store.buckets))), "filters": f"filters-{number + 1}"})
        self._open()
        self._note(self.store.read())


def _one_bit(bits: Column, word: int) -> Column:
    """A word with the one bit that six bits of a hash choose."""
    at = F.shiftrightunsigned(bits, 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)
