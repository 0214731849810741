"""The best candidate orders of a message by context score, without meeting all of them: an inverted index over the context fields.

A candidate's score depends on which of its fields are blank, which agree with the message's and which differ. The index has a list for
every combination of (fields that the candidate fills, some of these, their values): the k earliest candidates. A message looks up all
combinations that its own fields allow, 81 at most; that of a combination scores at least what the named fields give and the others cost.
A candidate among the message's k best is in the list of the fields in which it agrees: else k earlier ones there score no less.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import norm_key
from ..functions.identity import CONTEXT
from ..functions.text import filled

#: What a context field adds to a candidate's score where it agrees, and costs where it differs.
WEIGHTS = {"tgl_ro": 2, "pickup": 3, "tujuan": 3, "type_truck": 2}
MASKS = range(1 << len(CONTEXT))


def _fields(mask: int) -> list[int]:
    return [i for i in range(len(CONTEXT)) if mask >> i & 1]


def _keyed(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, _has (the mask of filled context fields) and _k, the forms in which the fields are compared."""
    has = F.zip_with(F.array(*map(F.col, CONTEXT)), F.array(*(F.lit(1 << i) for i in range(len(CONTEXT)))), lambda c, bit: F.when(filled(c), bit).otherwise(0))
    return df.select(*columns, F.aggregate(has, F.lit(0), lambda a, x: a + x).alias("_has"), F.transform(F.array(*map(F.col, CONTEXT)), lambda c: norm_key(c)).alias("_k"))


def _values(mask: int) -> str:
    """SQL: the values of the named fields."""
    return "concat_ws('|'" + "".join(f", _k[{i}]" for i in _fields(mask)) + ")"


def context_index(orders: DataFrame, k: int = 8) -> DataFrame:
    """orders: candidate_key, first_seq and the context fields. A row a combination: fills and agrees (masks of fields), values, and the k
    earliest candidates, of equals those of the lesser key. Of each whole context the k earliest orders take part, before they go into its 16
    lists; the limit goes before the shuffle, so that a list that all orders belong to gathers k rows a task."""
    whole = Window.partitionBy("_has", "_k").orderBy("first_seq", "candidate_key")
    keyed = _keyed(orders, "candidate_key", "first_seq").withColumn("_n", F.row_number().over(whole)).where(F.col("_n") <= k)
    own = F.expr(f"filter(array({', '.join(f'struct({m} AS agrees, {_values(m)} AS values)' for m in MASKS)}), x -> _has & x.agrees = x.agrees)")
    entries = keyed.select(F.col("_has").alias("fills"), F.explode(own).alias("x"), "first_seq", "candidate_key").select("fills", "x.*", "first_seq", "candidate_key")
    by = Window.partitionBy("fills", "agrees", "values").orderBy("first_seq", "candidate_key")
    first = entries.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k)
    return first.groupBy("fills", "agrees", "values").agg(F.collect_list(F.struct("first_seq", "candidate_key")).alias("candidates"))


def ranked_candidates(incoming: DataFrame, orders: DataFrame, event: str, k: int = 8) -> DataFrame:
    """The k best orders of each message by context score, of equals the earliest: event, candidate_key, context_score, rank (from 1).

    incoming: event and the context fields, any of which may be blank; orders: candidate_key (once each), first_seq and the context fields.
    All orders are ranked, also those whose score is negative. Messages of one context are looked up once. Of its lookups, those that
    promise less than the best list of k candidates are left out before their lists are opened.
    """
    told = _keyed(incoming, event)
    asked = told.select(F.struct("_has", "_k").alias("_m")).distinct().select("_m", "_m.*")
    ways = ", ".join(f"struct({fills} AS fills, {agrees} AS agrees, {_values(agrees)} AS values, {_promise(fills, agrees)} AS score)" for fills in MASKS for agrees in MASKS if fills & agrees == agrees)
    lookups = asked.select("_m", F.expr(f"explode(filter(array({ways}), w -> _has & w.agrees = w.agrees))").alias("w")).select("_m", "w.*")
    met = lookups.join(context_index(orders, k), ["fills", "agrees", "values"])
    floor = F.max(F.when(F.size("candidates") >= k, F.col("score"))).over(Window.partitionBy("_m"))
    opened = met.withColumn("_floor", floor).where("_floor is null or score >= _floor").select("_m", "score", F.explode("candidates").alias("c"))
    best = opened.groupBy("_m", "c").agg(F.max("score").alias("context_score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("_m").orderBy(F.desc("context_score"), "c.first_seq", "c.candidate_key"))).where(F.col("rank") <= k)
    return told.select(event, F.struct("_has", "_k").alias("_m")).join(ranked, "_m").select(event, "c.candidate_key", "context_score", "rank")


def _promise(fills: int, agrees: int) -> str:
    """SQL: what a lookup promises: the weights of the fields that agree, less those of the others that both sides fill."""
    weights = list(WEIGHTS.values())
    gains = sum(weights[i] for i in _fields(agrees))
    return " - ".join([str(gains), *(f"if(_has & {1 << i} > 0, {weights[i]}, 0)" for i in _fields(fills & ~agrees))])
