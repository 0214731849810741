"""Models behind one interface: a folder is found, loaded once a worker with retries, and scores texts batch by batch over Arrow.

No weights belong to the library.  A loader is a function from a folder to a scorer; a scorer takes lists of texts and returns a
probability or a label each.  Without a loader the rules of plans.matching and functions.rules stand in.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import EVENT_GATE, event_from_words

#: Texts that a scorer gets at a time.
BATCH = 32


def find_model(spark: SparkSession, root: str, wanted: str = "config.json") -> str | None:
    """The folder to load from: root itself if it holds `wanted`, else its checkpoint with the greatest step that does; None without."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    holds = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, wanted))
    if not fs.exists(path):
        return None
    if holds(path):
        return root
    steps = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("checkpoint-") and name[11:].isdigit() and holds(status.getPath()):
            steps.append((int(name[11:]), status.getPath().toString()))
    return max(steps)[1] if steps else None


def labels_of(spark: SparkSession, folder: str) -> dict[int, str]:
    """A model's labels by id, from its config.json; empty where there is none."""
    rows = spark.read.text(f"{folder}/config.json", wholetext=True)
    known = rows.select(F.from_json("value", "id2label map<string,string>")["id2label"].alias("m")).first()
    return {int(k): v for k, v in ((known and known.m) or {}).items() if k.isdigit()}


def loaded(load: Callable, folder: str, tries: int = 3, wait: float = 0.5):
    """load(folder), tried again when it fails, as shared folders do fail now and then; the last failure is raised."""
    for k in range(tries):
        try:
            return load(folder)
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(wait * (k + 1))


def score(rows: DataFrame, load: Callable, folder: str, texts: list[str], result: str, kind: str = "double", batch: int = BATCH) -> DataFrame:
    """rows with a column `result`: what the scorer says of the columns `texts`, `batch` rows at a time. Null texts are empty. The model is
    loaded once a task; rows stream, so memory holds a batch and the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for part in batches:
            scorer = scorer or loaded(load, folder)
            columns = [[t or "" for t in part.column(part.schema.get_field_index(c)).to_pylist()] for c in texts]
            out = [x for a in range(0, part.num_rows, batch) for x in scorer(*(c[a : a + batch] for c in columns))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64() if kind == "double" else pa.string())], [*part.schema.names, result])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField(result, DoubleType() if kind == "double" else StringType())])
    return rows.mapInArrow(run, schema)


def score_pairs(pairs: DataFrame, load: Callable, folder: str, a: str = "text_a", b: str = "text_b", threshold: float = 0.5) -> DataFrame:
    """p_match and predicted by a loaded pair model; a blank side never matches, whatever the model says."""
    from ..functions.text import filled

    scored = score(pairs, load, folder, [a, b], "_p")
    return scored.withColumn("p_match", F.when(filled(F.col(a)) & filled(F.col(b)), F.col("_p")).otherwise(0.0)).drop("_p").withColumn("predicted", F.when(F.col("p_match") >= threshold, "MATCH").otherwise("NO_MATCH"))


def classify_events(messages: DataFrame, text: str, load: Callable | None = None, folder: str = "") -> DataFrame:
    """event_label of each message (by the model, else by its words), its score, and whether it may go on as an order."""
    from ..functions.rules import event_label, passes_event_gate

    rows = score(messages, load, folder, [text], "_l", "string") if load else messages.withColumn("_l", event_from_words(F.col(text)))
    label = F.coalesce(event_label(F.col("_l")), F.col("_l"))
    out = rows.withColumn("event_label", label).drop("_l")
    return out.withColumn("passes", passes_event_gate(F.col("event_label"), F.lit(EVENT_GATE if load is None else 1.0)))
