"""Evaluation: confusion metrics, entity counts, coverage, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import evaluation_status, prf, ratio


def binary_metrics(rows: DataFrame, expected: Column, predicted: Column, *by: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 of both classes, and F1 averaged over the classes that occur. expected and
    predicted are booleans; rows with a null are left out."""
    r = rows.withColumn("_e", expected).withColumn("_p", predicted).where("_e is not null and _p is not null")
    counts = r.groupBy(*by).agg(F.count_if(F.expr("_e and _p")).alias("tp"), F.count_if(F.expr("not _e and _p")).alias("fp"), F.count_if(F.expr("_e and not _p")).alias("fn"), F.count_if(F.expr("not _e and not _p")).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    p, q, f = prf(tp, fp, fn)
    np_, nr, nf = prf(tn, fn, fp)
    present = [((tp + fn) > 0) | ((tp + fp) > 0), ((tn + fp) > 0) | ((tn + fn) > 0)]
    classes = sum((x.cast("int") for x in present), F.lit(0))
    macro = sum((F.when(x, v).otherwise(F.lit(0.0)) for x, v in zip(present, (f, nf))), F.lit(0.0)) / F.greatest(classes, F.lit(1))
    return counts.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), p.alias("precision"), q.alias("recall"), f.alias("f1"), np_.alias("precision_no"), nr.alias("recall_no"), nf.alias("f1_no"), macro.alias("macro_f1"))


def entity_counts(truth: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Multiset counts by keys: tp is what both have, fp what was found too often, fn too rarely, duplicate_fp the repeats of found values."""
    t = truth.groupBy(*keys, value).agg(F.count("*").alias("t"))
    f = found.groupBy(*keys, value).agg(F.count("*").alias("f"))
    both = t.join(f, [*keys, value], "full_outer").fillna(0, ["t", "f"])
    counts = both.groupBy(*keys).agg(
        F.sum(F.least("t", "f")).alias("tp"), F.sum(F.greatest(F.col("f") - F.col("t"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("t") - F.col("f"), F.lit(0))).alias("fn"),
        F.sum(F.greatest(F.col("f") - 1, F.lit(0))).alias("duplicate_fp"),
    )
    return counts.withColumn("status", evaluation_status(F.col("tp"), F.col("fp"), F.col("fn"), None, F.col("duplicate_fp")))


def attribute_scores(cards: DataFrame, attribute: str, order: dict[str, int]) -> DataFrame:
    """Sums by attribute in the attributes' own order, those without cards included, with precision, recall and F1."""
    sums = cards.groupBy(attribute).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    dim = cards.sparkSession.createDataFrame(list(order.items()), f"{attribute} string, position int")
    all_ = F.broadcast(dim).join(sums, attribute, "left").fillna(0, ["tp", "fp", "fn"])
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return all_.select(attribute, "position", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def durations(cards: DataFrame, run: str, elapsed: str, *by: str) -> DataFrame:
    """The longest time of each run, then their number, sum and mean, of all or by some columns."""
    runs = cards.groupBy(*by, run).agg(F.max(elapsed).alias("ms"))
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"))


def coverage(rows: DataFrame, by: str, status: str, p: str) -> DataFrame:
    return rows.groupBy(by).agg(
        F.count("*").alias("cases"), F.count_if(F.col(status) == "PASS").alias("passed"), F.count_if(F.col(status) == "FALSE_MATCH").alias("false_match"),
        F.count_if(F.col(status) == "FALSE_NO_MATCH").alias("false_no_match"), F.avg(p).alias("mean_p"), F.avg((F.col(status) == "PASS").cast("double")).alias("pass_rate"),
    )


def top_event(history: DataFrame, key: str, rank: Column) -> DataFrame:
    """The best row of each key and how many there are."""
    w = Window.partitionBy(key)
    return history.withColumn("_n", F.row_number().over(w.orderBy(rank.desc(), F.asc("event_id")))).withColumn("group_size", F.count("*").over(w)).where("_n = 1").drop("_n")


def timelines(events: DataFrame, key: str, seq: str, summary: str, least: int = 1, merged: str | None = None) -> DataFrame:
    """Events of an order: number, first and last, the last summary that is not null; only orders with at least `least` events (and, if
    merged is named, with a merge)."""
    g = events.groupBy(key).agg(
        F.count("*").alias("n_events"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.max_by(summary, F.when(F.col(summary).isNotNull(), F.col(seq))).alias("summary"),
        (F.bool_or(merged) if merged else F.lit(True)).alias("has_merge"),
    )
    return g.where((F.col("n_events") >= least) & F.col("has_merge"))


def span_values(spans: DataFrame, keys: list[str], label: str, text: str, seq: str) -> DataFrame:
    """Tokens with B-, I- and O labels as entities: a B- starts one, as does an I- that does not go on with its label."""
    w = Window.partitionBy(*keys).orderBy(seq)
    kind, name = F.substring(label, 1, 2), F.regexp_replace(label, "^[BI]-", "")
    before = F.lag(label).over(w)
    starts = (kind == "B-") | ((kind == "I-") & (F.coalesce(F.regexp_replace(before, "^[BI]-", ""), F.lit("O")) != name))
    rows = spans.withColumn("_start", starts.cast("int")).withColumn("_no", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(label) != "O")
    return rows.groupBy(*keys, "_no").agg(F.first(name).alias("entity"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text]), " ").alias("value")).drop("_no")


def chunk_quality(rows: DataFrame, chunk: str, captured: str, confidence: str) -> DataFrame:
    """0.55 of the share of attributes captured and 0.45 of the mean confidence."""
    g = rows.groupBy(chunk).agg(F.avg(F.col(captured).cast("double")).alias("completeness"), F.coalesce(F.avg(F.when(F.col(captured), F.col(confidence))), F.lit(0.0)).alias("mean_confidence"))
    return g.withColumn("quality", 0.55 * F.col("completeness") + 0.45 * F.col("mean_confidence"))


def progress(events: DataFrame, key: str, seq: str, fill: str, target: str) -> DataFrame:
    """Slots filled after each event, never above the target."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("progress", F.least(F.sum(fill).over(w), F.col(target)))


def session_name(rows: DataFrame, key: str, day: str) -> DataFrame:
    """A name for the days of a session: one day, days of one month, months of one year or years; and the most frequent month."""
    names = F.array(*map(F.lit, ("Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember")))
    d = rows.where(F.col(day).isNotNull()).select(key, F.col(day).cast("date").alias("d"))
    months = d.groupBy(key, F.year("d").alias("y"), F.month("d").alias("m")).agg(F.count("*").alias("n"), F.min("d").alias("a"), F.max("d").alias("b"))
    g = months.groupBy(key).agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max(F.struct("n", "y", "m")).alias("x"))
    name = lambda c: F.element_at(names, F.month(c))
    text = (
        F.when(F.col("a") == F.col("b"), F.format_string("Order %02d %s %d", F.dayofmonth("a"), name("a"), F.year("a")))
        .when((F.year("a") == F.year("b")) & (F.month("a") == F.month("b")), F.format_string("Order %02d-%02d %s %d", F.dayofmonth("a"), F.dayofmonth("b"), name("a"), F.year("a")))
        .when(F.year("a") == F.year("b"), F.format_string("Order %s-%s %d", name("a"), name("b"), F.year("a")))
        .otherwise(F.format_string("Order %d-%d", F.year("a"), F.year("b")))
    )
    return g.select(key, text.alias("name"), F.col("a").alias("start_date"), F.col("b").alias("end_date"), F.col("x.m").alias("dominant_month"), F.col("x.y").alias("dominant_year"))
