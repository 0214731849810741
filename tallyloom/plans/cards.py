"""Match events and evaluation cards as tables: which are shown, how they are grouped, and the reports on them and on models.

Events carry predicted, truth, p_match, decision_status, ready and applied; cards carry source, chunk, batch_id and batch_index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, rules
from ..functions.dates import norm_key
from ..functions.identity import IDENTITY, ROW_FIELDS, clean_entity_value, complete_identity
from ..functions.text import clean_cell, distinct_by, distinct_filled, filled, metric_text, strip
from ..operators.distinct import first_told
from .matching import duplicates_anti

#: The choices of the detail filter, as buckets of the confusion matrix.
DETAIL = {"True Positive (MATCH Benar)": "TP", "True Negative (NO_MATCH Benar)": "TN", "False Positive (Salah Deteksi)": "FP", "False Negative (Gagal Deteksi)": "FN"}
#: Rows of a preview that go to the audit table.
AUDITED = 5


def has_merge() -> Column:
    return F.col("ready") | (F.coalesce("applied", F.lit(0)) > 0)


def is_confident_merge() -> Column:
    return (F.col("predicted") == "MATCH") & (F.coalesce("p_match", F.lit(0.0)) >= rules.STRONG) & has_merge()


def is_clear_new_order() -> Column:
    label = rules.operator_label(F.col("decision_status"), F.col("action"), F.coalesce("applied", F.lit(0)), F.coalesce("duplicates", F.lit(0)))
    return (label == "ORDER BARU") & (F.col("predicted") == "NO_MATCH") & (F.coalesce("p_match", F.lit(0.0)) < rules.CLEAR_NEW)


def without_candidate(rows: DataFrame, key: str | None) -> DataFrame:
    """Rows of other orders than the one that has taken the message; all without a key."""
    return rows.where(F.col("candidate_key") != key) if (key or "").strip() else rows


def without_applied(rows: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """As without_candidate(), but of the order's rows only those go whose unit the order has taken: a complete unit of the rows after that
    stood there before or belongs to the order."""
    complete = after.where(complete_identity()).withColumn("_of", F.lit(key))
    old = before.where(complete_identity()).withColumn("_of", F.lit(key))
    fresh = duplicates_anti(complete, old, ["_of"])
    repeated = complete.join(fresh.select("_of", *IDENTITY).distinct(), ["_of", *IDENTITY], "left_anti")
    taken = repeated.unionByName(complete.where(F.col("candidate_key") == key)).distinct()
    other, mine = rows.where(F.col("candidate_key") != key), rows.where(F.col("candidate_key") == key)
    kept = duplicates_anti(mine.where(complete_identity()).withColumn("_of", F.lit(key)), taken, ["_of"]).drop("_of")
    return other.unionByName(mine.where(~complete_identity())).unionByName(kept.select(*rows.columns))


def evaluated(events: DataFrame) -> DataFrame:
    """Adds bucket and status: Benar where the prediction is the truth, else Salah."""
    return events.withColumns({"bucket": rules.confusion_bucket(F.col("truth"), F.col("predicted")), "status": F.when(F.col("truth") == F.col("predicted"), "Benar").otherwise("Salah")})


def detail_rows(events: DataFrame, choice: str) -> DataFrame:
    """The events that a choice of the detail filter shows; all for any other text."""
    rows = evaluated(events)
    if choice == "MATCH benar + Semua Kesalahan":
        return rows.where("bucket = 'TP' or status = 'Salah'")
    if choice in DETAIL:
        return rows.where(F.col("bucket") == DETAIL[choice])
    return rows.where(F.col("status") == choice) if choice in ("Benar", "Salah") else rows


def model_errors(events: DataFrame) -> DataFrame:
    return evaluated(events).where("status = 'Salah'")


def event_key() -> Column:
    """The key that an event is shown once by: its id, else its chat and candidate."""
    own = strip(F.col("id").cast("string"))
    return F.when(own != "", F.concat(F.lit("id:"), own)).otherwise(F.concat(F.lit("pair:"), strip(F.col("raw_chat_id")), F.lit("|"), strip(F.col("candidate_key"))))


def with_errors(shown: DataFrame, events: DataFrame) -> DataFrame:
    """The events shown, and the model's errors among all events that are not, each once."""
    more = model_errors(events).select(*shown.columns).withColumn("_k", event_key()).dropDuplicates(["_k"])
    return shown.unionByName(more.join(shown.select(event_key().alias("_k")).distinct(), "_k", "left_anti").drop("_k"))


def evaluation_table(events: DataFrame, place: str = "seq") -> DataFrame:
    """Nine columns a pair: its id (else its candidate, else its number), summary, labels, status, error, and whether three fields agree."""
    number = F.concat(F.lit("pair_"), F.col(place).cast("string"))
    named = F.coalesce(*(F.nullif(strip(F.col(c).cast("string")), F.lit("")) for c in ("id", "candidate_key")), number)
    verdict = lambda c: F.when(filled(F.col(f"ca_{c}")) & filled(F.col(f"in_{c}")) & (norm_key(F.col(f"ca_{c}")) == norm_key(F.col(f"in_{c}"))), "OK").otherwise("BEDA/KOSONG")
    rows = evaluated(events)
    error = F.when(F.col("bucket") == "FP", "False Positive").when(F.col("bucket") == "FN", "False Negative").otherwise("-")
    return rows.select(
        named.alias("pair_id"), F.coalesce(F.nullif(strip(F.col("candidate_summary")), F.lit("")), F.lit("-")).alias("candidate_summary"), F.col("truth").alias("ground_truth"), "predicted", "status",
        error.alias("error_type"), *(verdict(c).alias(c) for c in ("tgl_ro", "pickup", "type_truck")),
    )


def official_metrics(metrics: DataFrame) -> DataFrame:
    """binary_metrics() as three rows: each class's counts and rates, and the macro row of summed counts and mean rates."""
    one = lambda name, tp, fp, fn, p, r, f: F.struct(F.lit(name).alias("class"), *(x.alias(n) for x, n in ((tp, "tp"), (fp, "fp"), (fn, "fn"), (p, "precision"), (r, "recall"), (f, "f1"))))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    mean = lambda a, b: (F.col(a) + F.col(b)) / 2
    rows = F.array(
        one("MATCH", tp, fp, fn, F.col("precision"), F.col("recall"), F.col("f1")),
        one("NO_MATCH", tn, fn, fp, F.col("precision_no"), F.col("recall_no"), F.col("f1_no")),
        one("macro", tp + tn, fp + fn, fn + fp, mean("precision", "precision_no"), mean("recall", "recall_no"), F.col("macro_f1")),
    )
    return metrics.select(F.inline(rows))


# ---- cards -----------------------------------------------------------------------------------------------------------------------


def card_identity() -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("batch_id", "batch_index", "chunk")), F.substring(norm_key(F.col("source")), 1, 80))


def card_groups(cards: DataFrame, events: DataFrame, order: str = "seq") -> DataFrame:
    """Orders (candidate_key) whose confident merges' texts, of the order and of the follow-up, are those of two different cards or more:
    summary, n_cards and card_ids in the order in which they come. Texts meet by their key; cards without text meet nothing."""
    sure = events.where(is_confident_merge())
    said = sure.select("candidate_key", "candidate_summary", F.col(order).alias("_o"), F.posexplode(F.array("candidate_chat_text", "incoming_text")).alias("_side", "_t"))
    keyed = said.withColumn("_k", norm_key(F.col("_t"))).where("_k <> ''")
    own = cards.select(norm_key(F.col("source")).alias("_k"), card_identity().alias("card_id")).where("_k <> ''").distinct()
    met = keyed.join(own, "_k").groupBy("candidate_key", "card_id").agg(F.min(F.struct("_o", "_side", "card_id")).alias("_at"), F.max_by("candidate_summary", "_o").alias("summary"))
    groups = met.groupBy("candidate_key").agg(F.max("summary").alias("summary"), F.count("*").alias("n_cards"), F.transform(F.array_sort(F.collect_list("_at")), lambda x: x["card_id"]).alias("card_ids"))
    return groups.where("n_cards >= 2")


def is_order_state(text: Column) -> Column:
    return strip(text).startswith("ORDER_STATE")


def candidate_chat_texts(events: DataFrame, orders: DataFrame, order: str = "seq") -> DataFrame:
    """Adds chat_text: the event's own candidate text, else its state text, else the first chat of the candidate's rows; a text that only
    states the order does not count."""
    real = lambda c: F.when(filled(F.col(c)) & ~is_order_state(F.col(c)), strip(F.col(c)))
    first = orders.groupBy("candidate_key").agg(F.min_by("raw_chat_text", F.when(real("raw_chat_text").isNotNull(), F.col(order))).alias("_chat"))
    return events.join(first, "candidate_key", "left").withColumn("chat_text", F.coalesce(real("candidate_chat_text"), real("order_state_text"), strip(F.col("_chat")), F.lit(""))).drop("_chat")


def audit_rows(preview: DataFrame, orders: DataFrame, event: str = "event_id", rank: str = "rank") -> DataFrame:
    """The first AUDITED rows of each preview as they go to the audit table: the state's text gives way to the candidate's chat."""
    top = preview.where(F.col(rank) <= AUDITED)
    told = candidate_chat_texts(top, orders)
    shown = F.when(F.col("chat_text") != "", F.col("chat_text"))
    return told.withColumns({"candidate_chat_text": F.coalesce(shown, "candidate_chat_text"), "order_state_text": F.coalesce(shown, "order_state_text")}).drop("chat_text")


def merged_attributes(rows: DataFrame, truth_items: str = "truth_items", found_items: str = "found_items") -> DataFrame:
    """rows: group, attribute, items of the truth and of the extraction, label_swap. An order's chunks evaluated as one: by group and
    attribute the values that differ once normalised, counted against each other, with scores and status. Rows without group or attribute
    count nothing. Values of both sides meet in one aggregate and not in joins, and are dealt to a stated number of
    tasks: by an aggregate's own shuffle they would first fill maps in the tasks that read, and then go to as few tasks as there are cores."""

    sides = F.array(*(F.struct(F.lit(bit).alias("side"), F.col(c).alias("items")) for bit, c in ((1, truth_items), (2, found_items))))
    said = rows.select("group", "attribute", F.coalesce("label_swap", F.lit(False)).alias("label_swap"), F.explode(sides).alias("_s"))
    each = said.select("group", "attribute", "label_swap", F.col("_s.side").alias("side"), F.posexplode_outer("_s.items").alias("at", "v"))
    counted = filled(F.col("v")) & F.col("group").isNotNull() & F.col("attribute").isNotNull()
    first = (F.col("side") == 1) & (F.coalesce("at", F.lit(0)) == 0)  # stays without a value too, so that its group does
    each = each.where(counted | first).withColumn("_text", F.when(counted, clean_cell(F.col("v")))).withColumn("_key", clean_entity_value(F.col("attribute"), F.col("_text")))
    value = F.when(F.col("_text").isNotNull(), F.when(F.col("_key") != "", F.col("_key")).otherwise(F.lower("_text")))
    dealt = each.select("group", "attribute", "label_swap", "side", value.alias("value")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group", "value")  # an attribute that is one literal would leave no key to meet by
    met = dealt.groupBy("group", "attribute", "value").agg(F.bit_or("side").alias("sides"), F.bool_or("label_swap").alias("label_swap"))
    of = lambda sides: F.count_if((F.col("sides") == sides) & F.col("value").isNotNull())
    out = met.groupBy("group", "attribute").agg(F.bool_or("label_swap").alias("label_swap"), of(3).alias("tp"), of(2).alias("fp"), of(1).alias("fn")).withColumn("duplicate_fp", F.lit(0).cast("long"))
    p, r, f = rules.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    status = rules.evaluation_status(F.col("tp"), F.col("fp"), F.col("fn"), F.col("label_swap"), F.col("duplicate_fp"))
    return out.select("*", p.alias("precision"), r.alias("recall"), f.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"), (F.col("tp") + F.col("fp")).alias("predicted"), status.alias("status"))


def attribute_rows(rows: DataFrame, attribute: str = "Semua atribut", outcome: str = "Semua hasil") -> DataFrame:
    """Attribute rows of cards by attribute and outcome, as the page's two filters choose them."""
    mine = rows if attribute == "Semua atribut" else rows.where(F.col("attribute") == attribute)
    tests = {
        "Benar": "upper(status) = 'CORRECT'", "Ada masalah": "upper(status) not in ('CORRECT', 'EMPTY')", "Tidak terekstrak": "fn > 0 and fp = 0", "Salah / berlebih": "fp > 0",
        "Parsial": "upper(status) = 'PARTIAL'", "Atribut tertukar": "label_swap", "Duplikasi": "duplicate_fp > 0", "Kosong": "upper(status) = 'EMPTY'",
    }
    return mine.where(tests.get(outcome, "true"))


def card_rows(cards: DataFrame, status: str = "Semua status", condition: str = "Semua") -> DataFrame:
    """Cards by order status (Lengkap or not) and whether they are problematic (OK, Bermasalah)."""
    if status != "Semua status":
        cards = cards.where(F.col("order_status") == ("LENGKAP" if status == "Lengkap" else "BELUM LENGKAP"))
    return cards.where({"OK": "not problematic", "Bermasalah": "problematic"}.get(condition, "true"))


def shown(cards: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """The first n cards of a page (5, 10, 20 or 50), or all."""
    ordered = cards.orderBy(order)
    return ordered if n is None else ordered.limit(n)


def is_common(values: Column) -> Column:
    """At most one different value, in whatever case."""
    return F.size(F.array_distinct(F.transform(F.filter(values, lambda x: filled(x)), lambda x: F.lower(clean_cell(x))))) <= 1


def output_values(rows: DataFrame, by: str, column: str, order: str) -> DataFrame:
    """By block: the number of rows, slots (the filled values of a column, in order) and values (each once)."""
    cell = clean_cell(F.coalesce(F.col(column).cast("string"), F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cell.alias("v")))), lambda x: x["v"])
    g = rows.groupBy(by).agg(F.count("*").cast("string").alias("quantity"), F.filter(ordered, lambda x: filled(x)).alias("slots"))
    return g.withColumn("values", distinct_filled(F.col("slots")))


def cell_key(row: Column, column: str) -> Column:
    return F.concat(row.cast("string"), F.lit(f"::{column}"))


def red_cells(rows: DataFrame, column: str, row: str) -> DataFrame:
    """Keys of the cells that are marked where an attribute is missing: of an identity field and the loading date, only where the unit has
    another identity field."""
    names = {"Driver": "driver", "No. Plat": "no_plat", "Kontak Driver": "kontak_driver", "Tgl Muat": "tgl_muat", "Tgl RO": "tgl_ro", "Pickup": "pickup", "Tujuan": "tujuan", "Type Truck": "type_truck"}
    own = names[column]
    peers = [c for c in IDENTITY if c != own] if own in (*IDENTITY, "tgl_muat") else []
    wanted = F.lit(True) if not peers else sum((filled(F.col(c)).cast("int") for c in peers), F.lit(0)) > 0
    return rows.where(~filled(F.col(own)) & wanted).select(cell_key(F.col(row), column).alias("cell"))


def needs_border(attribute: str, value: Column) -> Column:
    """A request date with a year only or too much, a loading time whose date has no year."""
    text = clean_cell(F.coalesce(value, F.lit("")))
    if attribute == "Tgl RO":
        return (text != "") & (text.rlike(r"(^|\s)-\d{2,4}\b") | dates.needs_flag(text))
    if attribute == "Tgl Muat":
        return text.rlike(r"\b\d{1,2}\s*[:.;]\s*\d{2}\s+\d{1,2}[-/]\d{1,2}\b(?![-/]\d{2,4})")
    return F.lit(False)


# ---- stages of a fill ------------------------------------------------------------------------------------------------------------


def complete_units(rows: DataFrame, key: str = "candidate_key", *order: str) -> DataFrame:
    """An order's complete units, each once."""
    return first_told(rows.where("false"), rows, [key], list(order or ("seq",)))


def stage_units(candidate: DataFrame, stages: DataFrame, key: str = "candidate_key") -> DataFrame:
    """Complete units of the stages (key, stage, seq) that the order did not have before: not its own, nor one of an earlier row."""
    return first_told(candidate.where(complete_identity()), stages, [key], ["stage", "seq"])


def final_units(candidate: DataFrame, stages: DataFrame, unmatched: DataFrame, key: str = "candidate_key") -> DataFrame:
    """The order's complete units after its stages (key, stage, seq), its own first; those without stages take the unmatched units (key,
    seq). Columns: key, stage (0: its own, null: unmatched), seq and the units' fields."""
    fields_ = [c for c in ROW_FIELDS if c in candidate.columns]
    of = lambda df, stage: df.select(key, stage.alias("stage"), "seq", *fields_)
    late = of(unmatched.join(stages.select(key).distinct(), key, "left_anti"), F.lit(None).cast("int"))
    every = of(candidate, F.lit(0)).unionByName(of(stages, F.col("stage").cast("int"))).unionByName(late)
    return complete_units(every.withColumn("_late", F.coalesce("stage", F.lit(1 << 30))), key, "_late", "seq").drop("_late")


def _joined(values: Column) -> Column:
    """The filled values, each once by its key, or a dash."""
    shown = distinct_by(F.filter(F.transform(values, strip), lambda v: filled(v)), norm_key)
    return F.when(F.size(shown) > 0, F.array_join(shown, " | ")).otherwise("-")


def cumulative_units(candidate: DataFrame, stages: DataFrame, column: str, key: str = "candidate_key") -> DataFrame:
    """A line a stage: the values of a column of all units that the order has by then, each once, its own first; of an order with a single
    stage, the values alone. An order's lines are made from one array of its units, so stages meet no units of others."""
    own = complete_units(candidate, key).select(key, F.lit(0).alias("stage"), "seq", column)
    every = own.unionByName(stage_units(candidate, stages, key).select(key, F.col("stage").cast("int").alias("stage"), "seq", column))
    units = every.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("stage", "seq", F.col(column).alias("v")))).alias("units"))
    told = stages.groupBy(key).agg(F.array_sort(F.collect_set(F.col("stage").cast("int"))).alias("stages")).join(units, key, "left")
    rows = told.select(key, F.size("stages").alias("n"), F.explode("stages").alias("stage"), "units")
    text = F.when(F.col("units").isNull(), "-").otherwise(_joined(F.transform(F.filter(F.col("units"), lambda u: u["stage"] <= F.col("stage")), lambda u: u["v"])))
    return rows.select(key, "stage", F.when(F.col("n") > 1, F.concat(F.format_string("Susulan #%d: ", "stage"), text)).otherwise(text).alias("line"))


def unit_label(*columns: str) -> Column:
    """A unit's driver and plate, or the given columns, as far as they say something."""
    return F.concat_ws(" | ", *(F.when(filled(F.col(c)), strip(F.col(c))) for c in columns or ("driver", "no_plat")))


def unit_list(rows: DataFrame, key: str = "candidate_key", seq: str = "seq") -> DataFrame:
    """An order's complete units as a numbered list of driver, plate and phone."""
    labels = F.transform(F.array_sort(F.collect_list(F.struct(seq, unit_label("driver", "no_plat", "kontak_driver").alias("l")))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["l"]))
    return rows.where(complete_identity()).groupBy(key).agg(F.array_join(labels, "\n").alias("units"))


def progress_labels(stages: DataFrame, fallback: DataFrame, key: str = "candidate_key") -> DataFrame:
    """Labels of the complete units of an order's stages, in order; where the stages have none, those of the fallback rows."""
    labels = lambda df, *o: df.where(complete_identity()).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*o, unit_label().alias("l")))), lambda x: x["l"]).alias("labels"))
    a, b = labels(stages, "stage", "seq"), labels(fallback, "seq").withColumnRenamed("labels", "_f")
    return a.join(b, key, "full_outer").select(key, F.coalesce("labels", "_f").alias("labels"))


def context_chats(rows: DataFrame, event: str, chat: str, order: str, *columns: str) -> DataFrame:
    """The rows of each chat of an event, nested, for events of several chats; events of one chat are left out."""
    one = rows.groupBy(event, chat).agg(F.min(order).alias("_o"), F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))
    return one.groupBy(event).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "rows"))), lambda x: x["rows"]).alias("chats")).where(F.size("chats") > 1)


# ---- reports on models -----------------------------------------------------------------------------------------------------------

#: How measures are called in reports.
MEASURES = {
    "eval_accuracy": "Accuracy", "eval_f1": "F1-score", "eval_precision": "Precision", "eval_recall": "Recall", "eval_f1_macro": "F1 macro", "eval_precision_macro": "Precision macro",
    "eval_recall_macro": "Recall macro", "eval_f1_match": "F1 MATCH", "eval_precision_match": "Precision MATCH", "eval_recall_match": "Recall MATCH", "eval_loss": "Validation loss",
}


def measure_name(name: str) -> str:
    return MEASURES.get(name, name.replace("eval_", "").replace("_", " ").title())


def best_row(logs: DataFrame, preferred: list[str], order: str = "step") -> DataFrame:
    """logs: step, log (map). The row with the most of the first preferred measure that any row has, of equals the first; without any, the
    last row. Columns: metric (null without), best, latest (both the row's map)."""
    value = lambda m: F.when(~F.isnan(F.col("log")[m]), F.col("log")[m])
    has = [F.count(value(m)) > 0 for m in preferred]
    top = [F.max_by("log", F.when(value(m).isNotNull(), F.struct(value(m), -F.col(order)))) for m in preferred]
    last = F.max_by("log", order)
    metric, best = F.lit(None).cast("string"), last
    for m, h, t in reversed(list(zip(preferred, has, top))):
        metric, best = F.when(h, F.lit(m)).otherwise(metric), F.when(h, t).otherwise(best)
    return logs.agg(metric.alias("metric"), best.alias("best"), last.alias("latest"))


def report_row(best: DataFrame, title: str, task: str, checkpoint: str | None = None) -> DataFrame:
    """best_row() as a row of the models' report: seven texts."""
    names = F.create_map(*(F.lit(x) for pair in MEASURES.items() for x in pair))
    plain = F.initcap(F.replace(F.replace("metric", F.lit("eval_"), F.lit("")), F.lit("_"), F.lit(" ")))
    said = lambda row: F.when(F.col("metric").isNull(), "-").otherwise(metric_text(F.col("metric"), F.try_element_at(F.col(row), F.col("metric"))))
    return best.select(
        F.lit(title).alias("Model"), F.lit(task).alias("Tugas"), F.lit(checkpoint or "-").alias("Checkpoint terbaik"),
        F.coalesce(F.col("best")["step"].cast("long").cast("string"), F.lit("-")).alias("Step terbaik"), F.coalesce(F.try_element_at(names, F.col("metric")), plain, F.lit("-")).alias("Metrik utama"),
        said("best").alias("Nilai terbaik"), said("latest").alias("Evaluasi terakhir"),
    )


def label_summary(labels: Column) -> Column:
    """A map of ids to labels as text, numeric ids in their order first."""
    key = lambda e: F.struct(e["key"].try_cast("int").isNull().alias("a"), e["key"].try_cast("int").alias("b"), e["key"].alias("c"), e["value"].alias("v"))
    sorted_ = F.array_sort(F.transform(F.map_entries(labels), key))
    return F.when(F.size(labels) > 0, F.array_join(F.transform(sorted_, lambda x: x["v"]), ", ")).otherwise("-")


def label_of(labels: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(F.try_element_at(labels, number.cast("string")), F.lit("")), number.cast("string"))


def match_number(labels: Column) -> Column:
    """The id of MATCH in a map of ids to labels; 1 if it is not there."""
    hits = F.filter(F.map_entries(labels), lambda e: F.upper(e["value"]) == "MATCH")
    return F.coalesce(F.get(hits, 0)["key"].try_cast("int"), F.lit(1))


def short_path(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(strip(path) == "", "-").when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)
