"""Pairs of many records: against a plain model, without tables in the driver."""

from pyspark.sql import functions as F

from tallyloom.functions.identity import ROW_FIELDS
from tallyloom.plans import datasets


def test_pairs_without_broadcast(spark):
    fields = [c for c in ROW_FIELDS if c not in ("pickup", "driver")]
    r = spark.range(60).select(F.col("id").alias("record_id"), F.concat(F.lit("G"), F.col("id") % 7).alias("pickup"), F.concat(F.lit("S"), F.floor(F.col("id") / 2)).alias("driver"), *(F.lit("x").alias(c) for c in fields), F.when(F.col("id") % 5 > 0, "said").alias("original_text"))
    r = r.withColumn("route_key", F.when(F.col("record_id") % 7 < 6, F.col("pickup"))).withColumn("signature", datasets.signature_key())
    found = datasets.pair_dataset(r)
    rows = found.collect()
    of = {x.record_id: x for x in r.withColumn("a", datasets.candidate_text()).withColumn("b", datasets.revision_text()).collect()}
    by_text = {}
    for x in of.values():
        by_text.setdefault(x.a, set()).add(x.signature)
    kinds = {k: sorted(x.source_id for x in rows if x.pair_kind == k) for k in ("revision", "original", "hard", "random")}
    assert kinds["revision"] == kinds["random"] == sorted(of) and kinds["original"] == [i for i in sorted(of) if i % 5]
    assert kinds["hard"] == [i for i in sorted(of) if i % 7 < 6]  # a record without a route has none
    for x in rows:
        own = of[x.source_id]
        assert x.pair_id == f"{x.pair_kind}-{x.source_id}" and x.label == ("MATCH" if x.pair_kind in ("revision", "original") else "NO_MATCH")
        if x.pair_kind in ("hard", "random"):
            assert x.text_a == own.b and own.signature not in by_text[x.text_b]
            assert x.pair_kind == "random" or f"Lokasi: {own.pickup}" in x.text_b
        else:
            assert (x.text_a, x.text_b) == ((own.a, own.b) if x.pair_kind == "revision" else (own.original_text, own.a))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
