"""Entity resolution: candidate orders, context scores, top-k, unit matching, decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions import rules
from ..functions.identity import CONTEXT, IDENTITY, ROW_FIELDS, candidate_score, complete_identity, context_key, has_identity, has_payload, row_context_key, same_unit, signature
from ..functions.text import filled, let
from ..operators.distinct import sorted_stream


def candidates(orders: DataFrame, seq: str = "seq") -> DataFrame:
    """One row an order with open slots: its key, quantity, filled and empty slots, the first filled value of each context field and
    a snapshot of its rows. Rows whose key is all blank are no order.

    Rows are counted by their contexts as written, so that keys, with their date rewriting, are made once for each spelling; only rows of
    orders with open slots are gathered into snapshots.
    """
    status = rules.status_or_derived(F.col("status_unit"), rules.status(*(F.col(c) for c in ROW_FIELDS)))
    written = [f"_w_{c}" for c in CONTEXT]
    rows = orders.withColumns({w: F.coalesce(c, F.lit("")) for w, c in zip(written, CONTEXT)}).withColumn("_open", rules.is_open(F.col("status_unit"), status))
    spelled = rows.groupBy(*written).agg(F.count("*").alias("qty"), F.count_if("_open").alias("empty"), F.min(seq).alias("first_seq"))
    spelled = spelled.withColumn("candidate_key", context_key(*map(F.col, written))).where(F.col("candidate_key") != "|||")
    first = [F.min_by(w, F.when(filled(F.col(w)), F.col("first_seq"))).alias(c) for w, c in zip(written, CONTEXT)]
    open_ = spelled.groupBy("candidate_key").agg(
        F.sum("qty").alias("qty"), (F.sum("qty") - F.sum("empty")).alias("filled"), F.sum("empty").alias("empty"), F.min("first_seq").alias("first_seq"), *first
    ).where("empty > 0")
    mine = rows.join(spelled.join(open_.select("candidate_key"), "candidate_key").select("candidate_key", *written), written)
    snapshots = mine.groupBy("candidate_key").agg(F.sort_array(F.collect_list(F.struct(seq, *ROW_FIELDS))).alias("snapshot"))
    return open_.join(snapshots, "candidate_key")


def state_text(c: DataFrame) -> DataFrame:
    """Adds the order's state as the text that the matcher reads."""
    parts = [F.lit("ORDER_STATE")] + [
        F.format_string(f"{label}: %s", F.coalesce(F.col(col).cast("string"), F.lit("-")))
        for label, col in (("Tanggal request", "tgl_ro"), ("Qty target", "qty"), ("Sisa slot", "empty"), ("Unit", "type_truck"), ("Lokasi", "pickup"), ("Rute/tujuan", "tujuan"))
    ]
    return c.withColumn("state_text", F.concat_ws(" | ", *parts, F.format_string("Terisi: %d/%d", F.col("filled"), F.col("qty"))))


def top_candidates(incoming: DataFrame, orders: DataFrame, block: str, k: int = 8) -> DataFrame:
    """The k best candidates of each incoming batch by context score, of equals the earliest.

    incoming: incoming_id and in_ context columns; orders: candidate_key, first_seq and ca_ context columns. Both carry `block`, an
    equi-join key (the normalised pickup, say), so that no batch meets every order. Scores depend on contexts alone: of each context of a
    block the k earliest orders take part, and each different incoming context meets them once, for all batches that have it.
    """
    theirs, own = ([p + c for c in CONTEXT] for p in ("ca_", "in_"))
    early = orders.withColumn("_n", F.row_number().over(Window.partitionBy(block, *theirs).orderBy("first_seq"))).where(F.col("_n") <= k).drop("_n")
    asked = incoming.select(block, *own).distinct()
    scored = asked.join(early, block).withColumn("context_score", candidate_score("ca_", "in_"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy(block, *own).orderBy(F.desc("context_score"), "first_seq"))).where(F.col("rank") <= k)
    best = best.select(F.col(block).alias("_block"), *(F.col(c).alias(f"_{c}") for c in own), *(c for c in orders.columns if c != block), "context_score", "rank")
    same = [F.col(block) == F.col("_block")] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own]
    return incoming.join(best, same).drop("_block", *(f"_{c}" for c in own))


def duplicates_anti(incoming: DataFrame, existing: DataFrame, scope: list[str]) -> DataFrame:
    """Incoming units that duplicate no existing one of their scope: not the plate, nor two of driver, plate and phone. Two equi
    anti-joins: two fields of which one is the plate agree only where the plate does."""
    out = incoming.withColumn("_sig", signature())
    old = existing.select(*scope, signature().alias("_old"))
    for names in (("no_plat",), ("driver", "kontak_driver")):
        side = old.select(*(F.col(s).alias(f"_s{i}") for i, s in enumerate(scope)), *(F.col("_old")[c].alias(f"_o_{c}") for c in names))
        side = side.where(" and ".join(f"_o_{c} <> ''" for c in names)).distinct()
        condition = [F.col(s) == F.col(f"_s{i}") for i, s in enumerate(scope)] + [F.col("_sig")[c] == F.col(f"_o_{c}") for c in names]
        out = out.join(side, condition, "left_anti")
    return out.drop("_sig")


def unit_counts(pairs: DataFrame, incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """pairs: incoming_id, candidate_key. Adds complete, duplicates and new: how many complete incoming units the candidate has, in any of
    its rows, or lacks."""
    units = incoming.where(complete_identity()).select("incoming_id", "unit_no", signature().alias("sig"))
    old = existing.where(has_identity()).select("candidate_key", signature().alias("old"))
    met = pairs.select("incoming_id", "candidate_key").join(units, "incoming_id", "left").join(old, "candidate_key", "left")
    each = met.groupBy("incoming_id", "candidate_key", "unit_no").agg(F.max(F.coalesce(same_unit(F.col("sig"), F.col("old")), F.lit(False))).alias("dup"))
    counts = each.groupBy("incoming_id", "candidate_key").agg(F.count("unit_no").alias("complete"), F.count_if("dup").alias("duplicates"))
    return pairs.join(counts.withColumn("new", F.col("complete") - F.col("duplicates")), ["incoming_id", "candidate_key"])


def decide(pairs: DataFrame) -> DataFrame:
    """pairs: complete, duplicates, new, empty, predicted, p_match, date_conflict, conflict. Adds fill, overflow and the decision."""
    fill = F.least(F.col("new"), F.greatest(F.lit(0), F.col("empty")))
    out = pairs.withColumn("fill", fill).withColumn("overflow", F.greatest(F.lit(0), F.col("new") - F.greatest(F.lit(0), F.col("empty"))))
    d = rules.decision(*(F.col(c) for c in ("date_conflict", "complete", "new", "duplicates", "predicted", "p_match", "conflict", "fill", "overflow")))
    return out.withColumn("_d", d).select("*", "_d.*").drop("_d")


def score_pairs(pairs: DataFrame, a: str = "text_a", b: str = "text_b", threshold: float = 0.5, scorer=None) -> DataFrame:
    """Adds p_match and predicted. scorer: two pandas Series of texts to one of probabilities; the default is the share of words that
    the texts have in common, weighted to the shorter, which needs no model and stays in the JVM. A blank side never matches."""
    if scorer is not None:
        score = F.pandas_udf(scorer, "double")(F.col(a), F.col(b))
    else:
        words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
        share = lambda x, y: F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))).otherwise(F.lit(0.0))
        score = let(F.struct(words(a).alias("a"), words(b).alias("b")), lambda w: share(w["a"], w["b"]))
    p = F.when(filled(F.col(a)) & filled(F.col(b)), score).otherwise(F.lit(0.0))
    return pairs.withColumn("p_match", p).withColumn("predicted", F.when(F.col("p_match") >= threshold, "MATCH").otherwise("NO_MATCH"))


def select_output(pairs: DataFrame, event: str, seq: str = "seq") -> DataFrame:
    """The row to show of each event: the greatest rank, of equals the first."""
    rank = rules.output_rank(F.col("ready"), F.col("predicted"), ~F.col("date_conflict"), F.col("overflow"), F.col("fill"), F.col("p_match"), F.col(seq))
    return pairs.groupBy(event).agg(F.max_by(F.struct(*pairs.columns), rank).alias("x")).select("x.*")


def preview_order(pairs: DataFrame) -> DataFrame:
    """Conflicts first, then what can be acted on, then agreeing dates, then the likelier."""
    return pairs.orderBy(F.desc(F.col("decision_status") == "CONFLICT"), F.desc(F.col("decision_status") == "SIAP_ISI_SLOT"), F.col("date_conflict"), F.desc("p_match"), "seq")


#: What a field that two units share counts.
WEIGHTS = {"no_plat": 4, "kontak_driver": 3, "driver": 2}


def whole_scopes(batches):
    """A stream that is sorted by _scope as tables that end where a scope ends, so that memory holds a batch and one scope."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("_scope")
        last = names[-1].as_py()
        start = batch.num_rows - (names.null_count if last is None else pc.sum(pc.equal(names, last)).as_py())
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = [batch.slice(start)]
        elif held and held[-1].column("_scope")[-1].as_py() != last:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def found_again(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole scopes' rows (_scope, _old, and the fields of WEIGHTS behind a _), each scope's incoming ones first: the places of the
    existing rows that are found again, of the incoming ones that they take, and the scores.

    Where each field's value leads to one row of a side at most, and a unit's fields to the same one, there is nothing to choose, and all such
    scopes go together; the others go a row at a time, looking only at units that share a field."""
    code = lambda c: rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    scope, old, weights = code("_scope"), rows.column("_old").to_numpy(), np.array(list(WEIGHTS.values()))
    new, tangled, keys, near = np.flatnonzero(~old), np.zeros(scope[-1] + 1, bool), [], []
    for c in WEIGHTS:
        values = code(f"_{c}")
        _, key = np.unique(scope * (values.max() + 1) + values, return_inverse=True)
        olds, news, at = np.bincount(key[old], minlength=key.max() + 1), np.bincount(key[new], minlength=key.max() + 1), np.full(key.max() + 1, -1)
        at[key[new]] = new
        tangled[scope[((olds > 0) & (news > 0) & (olds + news > 2))[key]]] = True
        keys.append(key)
        near.append(np.where(old, at[key], -1))
    near = np.stack(near)
    best = near.max(axis=0)
    tangled[scope[((near >= 0) & (near != best)).any(axis=0)]] = True
    met = np.flatnonzero(best >= 0)
    tangled[scope[met[np.bincount(best[met], minlength=len(scope))[best[met]] > 1]]] = True
    easy = met[~tangled[scope[met]]]
    out = [(easy, best[easy], weights @ (near[:, easy] >= 0))]

    hard = np.flatnonzero(tangled[scope])
    scope_at, found, taken, pairs = None, {}, set(), []
    for i, s, is_old, *own in zip(hard.tolist(), scope[hard].tolist(), old[hard].tolist(), *(k[hard].tolist() for k in keys)):
        if s != scope_at:
            scope_at, found, taken = s, {}, set()
        if not is_old:
            for c in enumerate(own):
                found.setdefault(c, []).append(i)
            continue
        scores: dict[int, int] = {}
        for c, w in zip(enumerate(own), WEIGHTS.values()):
            if left := [j for j in found.get(c, ()) if j not in taken]:
                found[c] = left
                for j in left:
                    scores[j] = scores.get(j, 0) + w
        if scores:
            first = min(scores, key=lambda j: (-scores[j], j))
            taken.add(first)
            pairs.append((i, first, scores[first]))
    out.append(np.array(pairs, np.int64).reshape(-1, 3).T)
    return tuple(np.concatenate(x) for x in zip(*out))


def _sides(existing: DataFrame, incoming: DataFrame, scope: str, *more: str) -> DataFrame:
    """The complete units of both as found_again() reads them; the incoming ones with more columns."""

    def side(df: DataFrame, old: bool, *more: str) -> DataFrame:
        sig = signature()
        return df.where(complete_identity()).select(*more, F.col(scope).cast("string").alias("_scope"), F.lit(old).alias("_old"), F.col("seq").cast("long").alias("_seq"), *(sig[c].alias(f"_{c}") for c in IDENTITY))

    return sorted_stream(side(existing, True).unionByName(side(incoming, False, *more), allowMissingColumns=True), ["_scope"], ["_old", "_seq"])


def match_units(existing: DataFrame, incoming: DataFrame, scope: str) -> DataFrame:
    """Registered units found again: each complete existing unit, in order, takes the best incoming one not yet taken (plate 4, phone 3,
    driver 2; the first of equals). The choice is sequential within a scope, so a kernel runs over a stream of sorted rows, whole scopes at
    a time."""
    schema = "scope string, existing_seq long, incoming_seq long, score int"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for rows in whole_scopes(batches):
            old, new, score = found_again(rows)
            seq = rows.column("_seq")
            pairs = pa.Table.from_arrays([rows.column("_scope").take(old), seq.take(old), seq.take(new), pa.array(score, pa.int32())], names=arrow.names)
            yield from pairs.cast(arrow).to_batches()

    return _sides(existing, incoming, scope).mapInArrow(run, schema)


def left_over(existing: DataFrame, incoming: DataFrame, scope: str) -> DataFrame:
    """The complete incoming units, with all columns, that no existing one takes by match_units(). Units without a scope or seq stay."""
    schema = incoming.schema

    def run(batches):
        for rows in whole_scopes(batches):
            keep = ~rows.column("_old").to_numpy()
            taken = found_again(rows)[1]
            keep[taken] = pc.or_(pc.is_null(rows.column("_scope")), pc.is_null(rows.column("_seq"))).to_numpy()[taken]
            yield from rows.select(schema.names).filter(pa.array(keep)).to_batches()

    return _sides(existing, incoming, scope, *schema.names).mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in schema]))


def history(orders: DataFrame, chats: DataFrame) -> DataFrame:
    """Orders with their chats, in the total order of the table (nulls first), rows without payload left out."""
    joined = orders.join(chats.select("raw_chat_id", "chat_text", F.col("created_at").alias("chat_created_at")), "raw_chat_id", "left")
    return joined.where(has_payload()).orderBy(F.asc_nulls_first("chat_created_at"), F.asc_nulls_first("batch_row_order"), F.asc_nulls_first("created_at"), F.asc_nulls_first("id"))


def merge_match_events(events: DataFrame) -> DataFrame:
    """MATCH events of one candidate as one: largest quantity and empty count, least p_match, all labels MATCH, reasons in order, each once;
    other events stay."""
    matched = events.where("predicted = 'MATCH'").groupBy("candidate_key").agg(
        F.count("*").alias("n_events"), F.max("qty").alias("qty"), F.max("empty").alias("empty"), F.min("p_match").alias("p_match"), F.sum("new").alias("new"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "reason"))), lambda x: x["reason"])).alias("reasons"),
    )
    matched = matched.withColumn("fill", F.least("new", "empty")).withColumn("overflow", F.greatest(F.lit(0), F.col("new") - F.col("empty")))
    others = events.where("predicted <> 'MATCH'").select("candidate_key", F.lit(1).cast("long").alias("n_events"), "qty", "empty", "p_match", "new", F.array("reason").alias("reasons"), F.least("new", "empty").alias("fill"), F.greatest(F.lit(0), F.col("new") - F.col("empty")).alias("overflow"))
    return matched.unionByName(others)


def incoming_key(incoming: DataFrame, event: str, seq: str) -> DataFrame:
    """The context key of a batch, from the first filled value of each field."""
    first = {c: F.min_by(c, F.when(filled(F.col(c)), F.col(seq))) for c in CONTEXT}
    return incoming.groupBy(event).agg(*(v.alias(c) for c, v in first.items())).withColumn("context_key", context_key(*map(F.col, CONTEXT)))


def proof_rows(pairs: DataFrame, names: dict[str, tuple[str, str]], key) -> DataFrame:
    """Evidence, a row a field: both values and whether they agree (Cocok), differ (Beda) or one is missing (-)."""

    def verdict(a: Column, b: Column) -> Column:
        return F.when(~filled(a) | ~filled(b), "-").when(key(a) == key(b), "Cocok").otherwise("Beda")

    rows = [F.struct(F.lit(n).alias("field"), F.col(a).cast("string").alias("candidate"), F.col(b).cast("string").alias("incoming"), verdict(F.col(a), F.col(b)).alias("status")) for n, (a, b) in names.items()]
    return pairs.withColumn("_e", F.explode(F.array(*rows))).select("*", "_e.*").drop("_e")


def segment_of(row: Column, segments: Column) -> Column:
    """The number of the one segment that shares the most identity fields with the row; null without any, and in a tie."""
    from ..functions.identity import overlap

    def of(scores: Column) -> Column:
        best = F.array_max(scores)
        return F.when((best > 0) & (F.size(F.filter(scores, lambda s: s == best)) == 1), F.array_position(scores, best) - 1)

    return let(F.transform(segments, lambda s: overlap(row, s)), of)


def join_texts(events: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """The different texts of a key's events, each with its number among all of them."""
    w = Window.partitionBy(key).orderBy(seq)
    numbered = events.select(key, seq, F.trim(F.coalesce(text, F.lit(""))).alias("t"), F.row_number().over(w).alias("n"))
    first = numbered.where("t <> ''").groupBy(key, "t").agg(F.min("n").alias("n"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: F.concat(F.lit("Order Susulan #"), x["n"].cast("string"), F.lit("\n"), x["t"]))
    return first.groupBy(key).agg(F.array_join(said, "\n\n").alias("texts"))


def truth_labels(pairs: DataFrame, truth: DataFrame, a: str = "text_a", b: str = "text_b", least: float = 0.95) -> DataFrame:
    """Adds truth: the label of the truth's pair of the same texts, either way round, without white space and in lower case; else that of
    the most like pair (of equals the first by its texts), if the mean of difflib's ratios reaches `least`; else the empty text.

    Equal pairs meet by an equi-join. Of others a mean of `least` needs a side whose own ratio reaches it, and ratios of 2 * least - 1 on
    both: candidates of all texts of both sides come from one index of pieces (likeness.candidate_pairs), as the truth has each text on
    either side, and are compared in Arrow batches. Neither table is collected.
    """
    from difflib import SequenceMatcher

    from ..functions.text import compact
    from .likeness import candidate_pairs, fits
    from .numbering import kept

    low = 2 * least - 1
    known = truth.select(compact(F.col("text_a")).alias("_x"), compact(F.col("text_b")).alias("_y"), F.upper(F.trim("label")).alias("_l")).where("_x <> '' and _y <> ''")
    both = known.unionByName(known.select(F.col("_y").alias("_x"), F.col("_x").alias("_y"), "_l")).groupBy("_x", "_y").agg(F.min("_l").alias("_l"))
    keyed = pairs.withColumns({"_p": compact(F.col(a)), "_q": compact(F.col(b))})
    texts = keyed.where("_p <> '' and _q <> ''").select("_p", "_q").distinct()
    exact = texts.join(both.hint("merge"), (F.col("_p") == F.col("_x")) & (F.col("_q") == F.col("_y"))).select("_p", "_q", "_l")
    rest = kept(texts.join(exact.select("_p", "_q").hint("merge"), ["_p", "_q"], "left_anti"))
    like = kept(candidate_pairs(rest.select(F.col("_p").alias("_t")).union(rest.select("_q")), both.select(F.col("_x").alias("_u")), "_t", "_u", least))
    near = None
    for own, theirs in (("_p", "_x"), ("_q", "_y")):
        part = rest.join(like.withColumnsRenamed({"_t": own, "_u": theirs}).hint("merge"), own).join(both.hint("merge"), theirs).select("_p", "_q", "_x", "_y", "_l")
        near = part if near is None else near.unionByName(part)
    size = F.length
    near = near.where(fits(size("_p"), size("_x"), low) & fits(size("_q"), size("_y"), low)).distinct()

    @F.pandas_udf("double")
    def likeness(p: pd.Series, q: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s: str, t: str) -> float:
            m = SequenceMatcher(None, t, s)
            return 0.0 if m.quick_ratio() < low else m.ratio()

        return pd.Series([(u + one(h, k)) / 2 if (u := one(g, j)) >= low else 0.0 for g, h, j, k in zip(p, q, x, y)])

    scored = near.withColumn("_s", likeness("_p", "_q", "_x", "_y")).where(F.col("_s") >= least)
    best = scored.groupBy("_p", "_q").agg(F.min_by("_l", F.struct(-F.col("_s"), "_x", "_y")).alias("_l"))
    return keyed.join(exact.unionByName(best).hint("merge"), ["_p", "_q"], "left").withColumn("truth", F.coalesce("_l", F.lit(""))).drop("_p", "_q", "_l")
