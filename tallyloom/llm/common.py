"""What the operators share: the shared folder, streaming over Arrow batches, places in the order of ids."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel takes at a time, which bounds a Python worker's memory.
CHUNK = 1 << 18
#: Bytes of a batch that goes to a Python worker (a session setting, as long texts would make batches of many rows large).
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset and all is one machine (tests), one of our
    own; on a cluster that is an error, as no executor would see another's files."""
    sc, place = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not place and not sc.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="tallyloom-"))
    return place or sc._jsc.sc().getCheckpointDir().get()


def clear(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours on whatever file system it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that later jobs neither compute it anew nor lose it with an executor.

    The steps before it are done with then: the JVM's collector is asked to run, which is when Spark drops their shuffle files.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def drop_shuffles(spark: SparkSession) -> None:
    """Asks the JVM's collector to run, so that Spark deletes the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidied(fn: Callable) -> Callable:
    """fn, a generator over batches, which gives the memory that it freed back to the machine when a task ends: workers are used again,
    and what one step held must not stay beside the next one's."""

    def run(batches):
        import ctypes

        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 4 << 20)  # arrays of 4 MB and more are mapped, and so go back at once
            libc.mallopt(-1, 16 << 20)  # up to 16 MB stay for the next arrays: to map and clear them anew takes longer than to fill them
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return run


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow for functions that yield a dict of columns (arrays or lists) at a time. Batches go to Python by BATCH_BYTES."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = _parse_datatype_string(schema)
    arrow = to_arrow_schema(spark_schema)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(tidied(run), spark_schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; a longer text stands alone."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def keep_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def in_id_order(docs: DataFrame, id_col: str = "doc_id", buckets: int | None = None) -> tuple[DataFrame, int]:
    """docs with `bucket` (int): ranges of the id in its order, null ids in the first, and how many there are.

    The cuts are quantiles of all ids; one long a bucket goes to the executors, so their size follows the number of partitions,
    not the rows.  Copies of one id share a bucket.
    """
    spark = docs.sparkSession
    n = buckets or 2 * width(spark)
    cuts = docs.select(F.percentile_approx(id_col, [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0] if n > 1 else None
    cuts = spark.sparkContext.broadcast(np.unique(np.array(cuts or [], np.int64)))

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts.value, ids.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    return docs.withColumn("bucket", bucket(F.coalesce(F.col(id_col), F.lit(-(1 << 63))))), len(cuts.value) + 1
