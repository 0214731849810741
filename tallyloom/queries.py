"""The registered queries of the order engine, each with its oracle in DuckDB's SQL beside it where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates, fields, identity, rules, text
from .operators import distinct, merge
from .plans import alignment, annotate, blocks, cards, datasets, evaluate, evidence, generate, matching, parse, ranking, report, spans, splits, sync, vary
from .plans.numbering import numbered
from .render import ROWS_SQL, chats, lines, order_messages, order_rows, phone, plate, table, word_date
from .sources import gate, io, store, versions
from .streaming import fills

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# ---- parsing ---------------------------------------------------------------------------------------------------------------------


@query("""
WITH u AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
SELECT 'GUDANG ' || (o_custkey % 20) AS location, count(*) AS orders, CAST(sum(n) AS BIGINT) AS declared_units, CAST(sum(n) AS BIGINT) AS listed_plates,
       strftime(min(o_orderdate), '%Y-%m-%d') AS first_request
FROM orders JOIN u ON o_orderkey = l_orderkey GROUP BY 1
""")
def parse_orders_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits chats into order blocks, reads their fields and reports by location."""
    parsed = parse.parse_chunks(parse.split_chats(chats(spark, sf_dir)))
    return parsed.groupBy(F.col("pickup").alias("location")).agg(
        F.count("*").alias("orders"), F.sum(F.col("qty").cast("long")).alias("declared_units"), F.sum(F.size("plates").cast("long")).alias("listed_plates"), F.min("tgl_ro").alias("first_request"),
    )


@query(f"""
WITH {ROWS_SQL}, o AS (
  SELECT o_custkey AS chat_id, l_orderkey, strftime(any_value(o_orderdate), '%Y-%m-%d') AS tgl_ro, CAST(count(*) AS INTEGER) AS qty, any_value(type_truck) AS type_truck, any_value(pickup) AS pickup,
    string_agg(plate, '|' ORDER BY l_linenumber) AS plates, string_agg(drv, '|' ORDER BY l_linenumber) AS drivers, string_agg('08:00 ' || strftime(l_shipdate, '%-d/%-m/%Y'), '|' ORDER BY l_linenumber) AS loadings FROM rows GROUP BY 1, 2
)
SELECT chat_id, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY l_orderkey) - 1 AS INTEGER) AS chunk_no, tgl_ro, qty, type_truck, pickup, plates, drivers, loadings FROM o
""")
def parsed_blocks(spark, sf_dir):
    """What every order block of every chat says."""
    p = parse.parse_chunks(parse.split_chats(chats(spark, sf_dir)))
    return p.select("chat_id", "chunk_no", "tgl_ro", "qty", "type_truck", "pickup", *(F.array_join(c, "|").alias(c) for c in ("plates", "drivers", "loadings")))


@query("""
SELECT l_orderkey AS o_orderkey, count(*) AS chunks, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS units, count(*) AS with_head FROM lineitem GROUP BY 1
""")
def split_multi_unit_chunks(spark, sf_dir):
    """A message with several unit lines becomes a block for each, with the head repeated."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    line = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" UNIT CDD\nNopol : "), plate(F.col("l_orderkey"), F.col("l_linenumber")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("s")))), lambda x: x["s"]), "\n")
    msgs = li.groupBy("l_orderkey").agg(F.concat(F.lit("REQUEST order "), F.col("l_orderkey").cast("string"), F.lit("\nLokasi : GUDANG\n"), lines).alias("chat_text"))
    chunks = parse.split_chats(msgs.withColumnRenamed("l_orderkey", "chat_id"))
    return chunks.groupBy(F.col("chat_id").alias("o_orderkey")).agg(
        F.count("*").alias("chunks"), F.sum(fields.declared_units(F.col("chunk")).cast("long")).alias("units"), F.count_if(F.col("chunk").startswith("REQUEST")).alias("with_head"),
    )


@query(f"""
WITH {ROWS_SQL}
SELECT o_custkey AS chat_id, strftime(o_orderdate, '%Y-%m-%d') AS tgl_ro, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS slot_no, type_truck, pickup,
       'BEKASI - KOTA ' || (l_suppkey % 7) AS tujuan, day(l_shipdate) || '-' || substr((['JANUARI','FEBRUARI','MARET','APRIL','MEI','JUNI','JULI','AGUSTUS','SEPTEMBER','OKTOBER','NOVEMBER','DESEMBER'])[month(l_shipdate)], 1, 3) || '-' || year(l_shipdate) AS tgl_muat,
       drv AS driver, plate AS no_plat, '08' || lpad(CAST(seq AS VARCHAR), 10, '1') AS kontak_driver
FROM rows
""")
def unit_slot_explode(spark, sf_dir):
    """A row a unit, with the i-th driver, plate, phone, route and loading date."""
    return parse.unit_rows(parse.parse_chunks(parse.split_chats(chats(spark, sf_dir))), "chat_id")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Nopol : B ' || event_id || ' X' WHEN 3 THEN 'order ' || event_id ELSE '' END AS clean, event_id % 4 = 1 AS noise FROM events
""")
def clean_message_lines(spark, sf_dir):
    """Heads of messages and courtesies go; label misspellings get their one spelling."""
    kind, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    line = F.when(kind == 0, F.concat(F.lit("NOPL: B "), n, F.lit(" X"))).when(kind == 1, "mohon bantu pak").when(kind == 2, "").otherwise(F.concat(F.lit("[08.15, 1/2/2024] Budi: order "), n))
    e = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return e.select("event_id", fields.prepared(F.col("line")).alias("clean"), fields.is_noise(F.col("line")).alias("noise"))


@query("""
WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '[' || lpad(CAST(turn AS VARCHAR), 2, '0') || '.30, 1/2/2024]' END AS head FROM conversations)
SELECT conv_id, turn, last_value(head IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS timestamp_head FROM m
""")
def timestamp_carry(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    chunk = F.when(F.col("role") == "user", F.format_string("[%02d.30, 1/2/2024] A: REQUEST", F.col("turn"))).otherwise("REQUEST")
    return parse.carry_timestamps(c.select("conv_id", "turn", chunk.alias("chunk")), "conv_id", "turn").select("conv_id", "turn", "timestamp_head")


@query("""
SELECT o_orderkey, o_orderkey % 3 = 0 AS marked, CASE WHEN o_orderkey % 3 = 0 THEN 'B' || o_orderkey || 'X,B' || (o_orderkey + 1) || 'Y' ELSE 'B' || o_orderkey || 'X' END AS plates FROM orders
""")
def revision_segments(spark, sf_dir):
    """The loading segments of a chat with their plates, and whether one is marked as a revision."""
    k = F.col("o_orderkey")
    seg = lambda n, c: F.concat(F.lit("Waktu loading : 08:00\nNopol : B "), n.cast("string"), F.lit(f" {c}\n"))
    t = F.when(k % 3 == 0, F.concat(F.lit("REQUEST\n"), seg(k, "x"), F.lit("Lokasi : A\n"), seg(k + 1, "y"), F.lit("revisi nopol : B 2 Y\n"))).otherwise(F.concat(F.lit("REQUEST\nLokasi : A\n"), seg(k, "x")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("chunk"))
    plates = F.array_join(F.transform(parse.segment_identities(F.col("chunk")), lambda x: x["no_plat"]), ",")
    return o.select("o_orderkey", (F.size(parse.marked_segments(F.col("chunk"))) > 0).alias("marked"), plates.alias("plates"))


# ---- scalars ---------------------------------------------------------------------------------------------------------------------

_MONTHS_SQL = "(['JANUARI','FEBRUARI','MARET','APRIL','MEI','JUNI','JULI','AGUSTUS','SEPTEMBER','OKTOBER','NOVEMBER','DESEMBER'])"


def _spellings(day, key):
    """Six spellings of a date."""
    k = key % 6
    short = F.element_at(F.array(*map(F.lit, ("Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des"))), F.month(day))
    return (
        F.when(k == 0, F.date_format(day, "d/M/yyyy"))
        .when(k == 1, F.date_format(day, "dd-MM-yyyy"))
        .when(k == 2, word_date(day))
        .when(k == 3, F.concat_ws("-", F.dayofmonth(day).cast("string"), short, F.year(day).cast("string")))
        .when(k == 4, F.concat(F.lit("tgl "), F.date_format(day, "d "), short, F.lit(" "), F.year(day).cast("string"), F.lit(" pagi")))
        .otherwise(F.date_format(day, "d/M/yyyy").substr(1, 20))
    )


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 4 THEN 'tgl ' ELSE '' END || strftime(o_orderdate, '%d') || ' ' || {_MONTHS_SQL}[month(o_orderdate)] || ' ' || year(o_orderdate) || CASE WHEN o_orderkey % 6 = 4 THEN ' pagi' ELSE '' END AS spelled,
  strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d%m%Y') AS ddmmyyyy,
  CASE WHEN o_orderkey % 6 = 4 THEN 'tgl' ELSE '' END || strftime(o_orderdate, '%d') || lower({_MONTHS_SQL}[month(o_orderdate)]) || year(o_orderdate) || CASE WHEN o_orderkey % 6 = 4 THEN 'pagi' ELSE '' END AS norm_key,
  CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
  day(o_orderdate) || '-' || substr({_MONTHS_SQL}[month(o_orderdate)], 1, 3) || '-' || year(o_orderdate) AS canonical
FROM orders
""")
def date_normalise(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", _spellings(F.col("o_orderdate"), F.col("o_orderkey")).alias("t"))
    return o.select("o_orderkey", dates.date_forms(F.col("t")).alias("x")).select("o_orderkey", "x.*")


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d ') || lower({_MONTHS_SQL}[month(o_orderdate)]) || strftime(o_orderdate, ' %Y')
  WHEN o_orderkey % 3 = 1 THEN {_MONTHS_SQL}[month(o_orderdate) % 12 + 1] || strftime(o_orderdate, ' %Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS repaired FROM orders
""")
def request_date_repair(spark, sf_dir):
    """A request date of month and year takes its day from a header that agrees."""
    d = F.col("o_orderdate")
    name = F.element_at(F.array(*map(F.lit, dates.NAMES)), F.month(d))
    other = F.element_at(F.array(*map(F.lit, dates.NAMES)), F.month(d) % 12 + 1)
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws(" ", name, F.year(d).cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.concat_ws(" ", other, F.year(d).cast("string"))).otherwise(F.date_format(d, "dd/MM/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.repair_request_date(said, F.concat(F.lit("REQUEST UNIT ON CALL "), word_date(d))).alias("repaired"))


@query("""
SELECT c_custkey, '08' || lpad(CAST(c_custkey AS VARCHAR), 9, '1') AS merged, CASE WHEN c_custkey % 4 IN (0, 1, 2) THEN '08' || lpad(CAST(c_custkey AS VARCHAR), 9, '1') ELSE '8' || lpad(CAST(c_custkey AS VARCHAR), 9, '1') END AS report,
  CASE c_custkey % 4 WHEN 0 THEN '628' WHEN 1 THEN '628' WHEN 2 THEN '08' ELSE '8' END || lpad(CAST(c_custkey AS VARCHAR), 9, '1') AS signature FROM customer
""")
def phone_normalise(spark, sf_dir):
    """The three rules for phones, kept apart."""
    k = F.col("c_custkey")
    n = F.lpad(k.cast("string"), 9, "1")
    t = F.when(k % 4 == 0, F.concat(F.lit("+62 8"), n)).when(k % 4 == 1, F.concat(F.lit("628-"), n)).when(k % 4 == 2, F.concat(F.lit("08 "), n)).otherwise(F.concat(F.lit("8"), n))
    return table(spark, sf_dir, "customer").select("c_custkey", identity.norm_phone(t).alias("merged"), identity.report_phone(t).alias("report"), identity.plain_phone(t).alias("signature"))


@query("""
SELECT p_partkey, 'B' || p_partkey || 'XY' AS plate, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'B ' || p_partkey || ' XY' END AS clean, 'BEKASI, KOTA, ' || (p_partkey % 9) AS route,
  CASE WHEN p_size > 40 THEN 'TRONTON' WHEN p_size > 25 THEN 'CDDL' WHEN p_size > 10 THEN 'CDD' ELSE 'BOX' END AS truck FROM part
""")
def plate_route_truck(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    raw = F.format_string(" b-%d.xy ", k)
    cell = F.when(k % 5 == 0, "B 0000").otherwise(F.format_string("b  %d xy", k))
    kind = F.when(s > 40, F.format_string("Tronton %d cbm", s)).when(s > 25, "cddl long").when(s > 10, F.format_string("CDD %d CBM", s)).otherwise(F.format_string("box %dcbm 2", s))
    return table(spark, sf_dir, "part").select("p_partkey", identity.norm_plate(raw).alias("plate"), identity.clean_plate(cell).alias("clean"), identity.route_text(F.concat(F.lit("Bekasi – kota / "), (k % 9).cast("string"))).alias("route"), identity.truth_key("Type Truck", kind).alias("truck"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id % 90 AS VARCHAR) WHEN 1 THEN '08' || lpad(CAST(event_id AS VARCHAR), 8, '0') WHEN 2 THEN 'B' || event_id || 'XY'
  WHEN 3 THEN strftime(ts, '%d-%m-%Y') ELSE 'kota ' || event_id || ',jalan/2' END AS value FROM events
""")
def entity_values(spark, sf_dir):
    """Extracted values in the form in which they are counted, by attribute."""
    i, d = F.col("event_id"), F.col("ts")
    attr = F.element_at(F.array(*map(F.lit, ("UNIT_QTY", "PHONE", "PLATE", "RO_DATE", "ORIGIN"))), (i % 5 + 1).cast("int"))
    value = F.when(i % 5 == 0, F.concat((i % 90).cast("string"), F.lit(" unit"))).when(i % 5 == 1, F.concat(F.lit("+62-8"), F.lpad(i.cast("string"), 8, "0"))).when(i % 5 == 2, F.format_string("b %d-xy", i)).when(i % 5 == 3, F.date_format(d, "d/M/yyyy")).otherwise(F.format_string(" KOTA  %d ,  Jalan / 2 ", i))
    return table(spark, sf_dir, "events").select("event_id", identity.entity_value(attr, value).alias("value"))


@query("""
SELECT event_id, CASE WHEN value <= 0 THEN '-' WHEN value < 1000 THEN printf('%.0f ms', value) ELSE printf('%.2f dtk', value / 1000) END AS took, printf('%.1f%%', value / 100 * 100) AS share FROM (SELECT event_id, CAST(CAST(value AS INTEGER) AS DOUBLE) AS value FROM events)
""")
def number_texts(spark, sf_dir):
    v = F.rint("value")
    return table(spark, sf_dir, "events").select("event_id", text.duration_text(v).alias("took"), text.percent(v / 100).alias("share"))


# ---- blocks and windows ----------------------------------------------------------------------------------------------------------

_SHEET = """sheet AS (
  SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 4 AS VARCHAR) || ' unit' ELSE '' END AS unit_qty, CASE WHEN event_id % 3 = 0 THEN event_id % 4 ELSE 0 END AS q,
    CASE WHEN event_id % 4 = 0 THEN event_type END AS destination, CASE WHEN event_id % 5 = 0 THEN event_type END AS origin, CASE WHEN event_id % 2 = 0 THEN event_type END AS unit_type,
    CASE WHEN event_id % 7 < 5 THEN 'SOPIR ' || event_id ELSE '' END AS driver
  FROM events
)"""


def _sheet(spark, sf_dir):
    i, t = F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.when(i % 3 == 0, F.concat((i % 4).cast("string"), F.lit(" unit"))).otherwise("").alias("unit_qty"), F.when(i % 4 == 0, t).alias("destination"), F.when(i % 5 == 0, t).alias("origin"),
        F.when(i % 2 == 0, t).alias("unit_type"), F.when(i % 7 < 5, F.concat(F.lit("SOPIR "), i.cast("string"))).otherwise("").alias("driver"),
    )


@query(f"""
WITH {_SHEET}
SELECT user_id, event_id, {", ".join(f"CASE WHEN unit_qty <> '' THEN coalesce({c}, lead({c}, 1) OVER w, lead({c}, 2) OVER w, lead({c}, 3) OVER w) ELSE {c} END AS {c}" for c in ("destination", "origin", "unit_type"))}
FROM sheet WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def lookahead_fill(spark, sf_dir):
    return blocks.repair_headers(_sheet(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "destination", "origin", "unit_type")


@query(f"""
WITH {_SHEET}, b AS (SELECT *, sum(CASE WHEN q > 1 OR (q = 1 AND unit_type IS NOT NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS block_id FROM sheet)
SELECT user_id, event_id, CAST(block_id AS BIGINT) AS block_id, last_value(origin IGNORE NULLS) OVER w AS origin, last_value(destination IGNORE NULLS) OVER w AS destination
FROM b WINDOW w AS (PARTITION BY user_id, block_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)
""")
def order_block_running(spark, sf_dir):
    """Running blocks, and a forward fill inside them."""
    marked = blocks.mark_blocks(_sheet(spark, sf_dir), "user_id", "event_id")
    return blocks.fill_blocks(marked, "user_id", "event_id", ("origin", "destination")).select("user_id", "event_id", "block_id", "origin", "destination")


@query(f"""
WITH {_SHEET}, b AS (SELECT *, sum(CASE WHEN q > 1 OR (q = 1 AND unit_type IS NOT NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS block_id FROM sheet),
h AS (SELECT user_id, block_id, greatest(max(q), 1) AS target, coalesce(max_by(event_id, event_id) FILTER (WHERE q > 1), min(event_id)) AS head FROM b WHERE block_id > 0 GROUP BY 1, 2),
s AS (SELECT user_id, block_id, head, unnest(range(1, target + 1)) AS slot_no FROM h),
u AS (SELECT user_id, block_id, row_number() OVER (PARTITION BY user_id, block_id ORDER BY event_id) AS slot_no, driver, unit_type FROM b WHERE block_id > 0 AND q <= 1 AND driver <> '')
SELECT s.user_id, CAST(s.block_id AS BIGINT) AS block_id, CAST(s.slot_no AS INTEGER) AS slot_no, coalesce(u.unit_type, hb.unit_type) AS unit_type, coalesce(u.driver, '') AS driver
FROM s JOIN b hb ON hb.user_id = s.user_id AND hb.event_id = s.head LEFT JOIN u ON u.user_id = s.user_id AND u.block_id = s.block_id AND u.slot_no = s.slot_no
""")
def block_quota(spark, sf_dir):
    """Each block emits as many rows as it asks for: its units, then blank slots."""
    marked = blocks.mark_blocks(_sheet(spark, sf_dir), "user_id", "event_id")
    return blocks.enforce_quota(marked, "user_id", "event_id", ("unit_type",), ("driver",))


@query("""
WITH s AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) OR row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS st FROM events)
SELECT user_id, event_id, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM s
""")
def loading_islands(spark, sf_dir):
    return blocks.islands(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").select("user_id", "event_id", "island")


@query("""
WITH r AS (SELECT event_type AS k, max_by(value, event_id) FILTER (WHERE event_id % 3 <> 0) AS v, max_by(user_id, event_id) FILTER (WHERE event_id % 5 <> 0) AS u FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT event_id, CAST(CAST(coalesce(r.v, value) AS INTEGER) AS VARCHAR) AS value_text, CAST(coalesce(r.u, user_id) AS VARCHAR) AS user_text FROM events LEFT JOIN r ON event_type = k
""")
def revision_last_wins(spark, sf_dir):
    """Rows take each column's last filled revision of their key."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.rint("value").cast("int").cast("string").alias("value_text"), F.col("user_id").cast("string").alias("user_text"))
    i = F.col("event_id")
    rev = e.where(i % 2 == 0).select("event_type", i.alias("seq"), F.when(i % 3 != 0, F.col("value_text")).otherwise("-").alias("value_text"), F.when(i % 5 != 0, F.col("user_text")).otherwise("").alias("user_text"))
    return blocks.apply_revisions(e, rev, "event_type", ("value_text", "user_text")).select("event_id", "value_text", "user_text")


@query("""
SELECT o_custkey, o_orderkey, least(CAST(sum(o_orderkey % 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT), 5) AS progress FROM orders
""")
def fill_progress(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3).alias("fill"), F.lit(5).cast("long").alias("target"))
    return evaluate.progress(o, "o_custkey", "o_orderkey", "fill", "target").select("o_custkey", "o_orderkey", "progress")


# ---- joins, matching, decisions --------------------------------------------------------------------------------------------------


@query("""
WITH g AS (SELECT sha256(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS chat_hash, doc_id FROM documents)
SELECT chat_hash, min(doc_id) AS doc_id FROM g WHERE doc_id % 10 <> 0 AND chat_hash NOT IN (SELECT chat_hash FROM g WHERE doc_id % 10 = 0) GROUP BY 1
""")
def chat_hash_dedup(spark, sf_dir):
    """The gate of chats: of each hash the first, and only those not stored yet."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = d.where("doc_id % 10 = 0").select(text.chat_hash(F.col("text")).alias("chat_hash"))
    return merge.new_chats(d.where("doc_id % 10 <> 0"), stored, "text", "doc_id").select("chat_hash", "doc_id")


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, upper(l_returnflag) || '|' || upper(l_linestatus) || '|||||' || CAST(l_suppkey % 3 AS VARCHAR) || '||' AS k FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, k ORDER BY l_linenumber) AS occurrence FROM b)
SELECT l_orderkey, l_linenumber, CAST(occurrence AS INTEGER) AS occurrence, sha256(l_orderkey || '|' || k || '|occ:' || occurrence) AS row_hash FROM n
""")
def occurrence_row_hash(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    empty = F.lit("")
    rows = li.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("tgl_ro"), F.col("l_linestatus").alias("tgl_muat"), *(empty.alias(c) for c in ("pickup", "tujuan", "no_plat", "type_truck", "kontak_driver", "status_unit")), (F.col("l_suppkey") % 3).cast("string").alias("driver"))
    return merge.number_repeats(rows, "l_linenumber", F.col("l_orderkey").cast("string")).select("l_orderkey", "l_linenumber", "occurrence", "row_hash")


@query("""
SELECT o_orderkey, c_name AS chat_text, CAST(row_number() OVER (ORDER BY CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderdate END NULLS FIRST, o_orderkey) AS INTEGER) AS place
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0 WHERE o_orderstatus <> 'P'
""")
def history_left_join(spark, sf_dir):
    """Orders with their chats where there are any, in the table's total order, rows without payload left out."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("raw_chat_id"), F.col("o_orderkey").alias("batch_row_order"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).otherwise("-").alias("pickup"), *(F.lit("").alias(x) for x in identity.ROW_FIELDS if x != "pickup"))
    seen = o.where("o_custkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("t"))
    chat = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("raw_chat_id"), F.col("c_name").alias("chat_text"), F.lit(None).cast("timestamp").alias("created_at"))
    joined = matching.history(rows, chat).join(seen, F.col("id") == F.col("k"), "left")
    return numbered(joined, F.asc_nulls_first("t"), "id").select(F.col("id").alias("o_orderkey"), "chat_text", F.col("place").cast("int").alias("place"))


@query(f"""
WITH {ROWS_SQL}, g AS (
  SELECT tgl_ro, pickup, tujuan, type_truck, count(*) AS qty, count(*) FILTER (WHERE l_linestatus = 'F') AS filled, count(*) FILTER (WHERE l_linestatus <> 'F') AS empty, min(seq) AS first_seq FROM rows GROUP BY 1, 2, 3, 4
)
SELECT strftime(o_orderdate, '%d') || lower({_MONTHS_SQL}[month(o_orderdate)]) || year(o_orderdate) || '|' || lower(replace(g.pickup, ' ', '')) || '|' || lower(replace(g.tujuan, ' ', '')) || '|' || lower(g.type_truck) AS candidate_key,
  qty, filled, empty, first_seq, g.pickup, CAST(qty AS INTEGER) AS snapshot_rows
FROM g JOIN rows r ON r.seq = g.first_seq WHERE empty > 0
""")
def candidate_groups(spark, sf_dir):
    """Orders with open slots, from their rows."""
    c = matching.candidates(order_rows(spark, sf_dir))
    return c.select("candidate_key", "qty", "filled", "empty", "first_seq", "pickup", F.size("snapshot").alias("snapshot_rows"))


@query("""
WITH i AS (SELECT s_suppkey, s_nationkey, 'KOTA ' || (s_suppkey % 7) AS tujuan, 'T' || (s_suppkey % 3) AS truck FROM supplier),
o AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'kota ' || (c_custkey % 7) END AS tujuan, 't' || (c_custkey % 3) AS truck FROM customer),
s AS (SELECT s_suppkey, c_custkey, 3 + CASE WHEN o.tujuan = '' THEN 0 WHEN lower(i.tujuan) = o.tujuan THEN 3 ELSE -3 END + CASE WHEN lower(i.truck) = o.truck THEN 2 ELSE -2 END AS score FROM i JOIN o ON s_nationkey = c_nationkey)
SELECT s_suppkey, c_custkey, CAST(score AS INTEGER) AS context_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) AS rank FROM s) WHERE rank <= 8
""")
def context_score_topk(spark, sf_dir):
    """The eight best candidates of each incoming batch."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    place_ = lambda k: F.concat(F.lit("NATION "), F.col(k).cast("string"))
    inc = s.select(F.col("s_suppkey").alias("incoming_id"), F.col("s_nationkey").alias("block"), F.lit("").alias("in_tgl_ro"), place_("s_nationkey").alias("in_pickup"), F.concat(F.lit("KOTA "), (F.col("s_suppkey") % 7).cast("string")).alias("in_tujuan"), F.concat(F.lit("T"), (F.col("s_suppkey") % 3).cast("string")).alias("in_type_truck"))
    k = F.col("c_custkey")
    old = c.select(F.col("c_nationkey").alias("block"), k.alias("first_seq"), F.lit("-").alias("ca_tgl_ro"), place_("c_nationkey").alias("ca_pickup"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("kota "), (k % 7).cast("string"))).alias("ca_tujuan"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("ca_type_truck"))
    return matching.top_candidates(inc, old, "block").select(F.col("incoming_id").alias("s_suppkey"), F.col("first_seq").alias("c_custkey"), "context_score", "rank")


@query("""
WITH i AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN 'd' || s_suppkey % 5 ELSE '' END AS a, CASE WHEN s_suppkey % 3 > 0 THEN 'n' || s_nationkey ELSE '' END AS b,
    CASE WHEN s_suppkey % 7 > 1 THEN 'k' || s_suppkey % 7 ELSE '' END AS c, CASE WHEN s_suppkey % 5 > 1 THEN 't' || s_suppkey % 3 ELSE '' END AS d FROM supplier),
o AS (SELECT c_custkey, CASE WHEN c_custkey % 6 > 0 THEN 'd' || c_custkey % 5 ELSE '' END AS a, CASE WHEN c_custkey % 11 > 0 THEN 'n' || c_nationkey ELSE '' END AS b,
    CASE WHEN c_custkey % 8 > 0 THEN 'k' || c_custkey % 7 ELSE '' END AS c, CASE WHEN c_custkey % 9 > 1 THEN 't' || c_custkey % 3 ELSE '' END AS d FROM customer),
s AS (SELECT s_suppkey, c_custkey, CASE WHEN i.a = '' OR o.a = '' THEN 0 WHEN i.a = o.a THEN 2 ELSE -2 END + CASE WHEN i.b = '' OR o.b = '' THEN 0 WHEN i.b = o.b THEN 3 ELSE -3 END
    + CASE WHEN i.c = '' OR o.c = '' THEN 0 WHEN i.c = o.c THEN 3 ELSE -3 END + CASE WHEN i.d = '' OR o.d = '' THEN 0 WHEN i.d = o.d THEN 2 ELSE -2 END AS score FROM i CROSS JOIN o),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) AS rank FROM s)
SELECT s_suppkey, c_custkey, CAST(score AS INTEGER) AS context_score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8
""")
def ranked_candidates(spark, sf_dir):
    """The eight best of all candidates of each batch, where either side leaves fields blank; brute force in the SQL."""

    def said(key, nation, blanks):
        some = lambda m, least, v: F.when(F.col(key) % m > least, v).otherwise("")
        part = lambda letter, m: F.concat(F.lit(letter), (F.col(key) % m).cast("string"))
        values = (part("d", 5), F.concat(F.lit("n"), F.col(nation).cast("string")), part("k", 7), part("t", 3))
        return [some(*b, v).alias(c) for b, v, c in zip(blanks, values, identity.CONTEXT)]

    i = table(spark, sf_dir, "supplier").select("s_suppkey", *said("s_suppkey", "s_nationkey", ((4, 0), (3, 0), (7, 1), (5, 1))))
    o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_key"), F.col("c_custkey").alias("first_seq"), *said("c_custkey", "c_nationkey", ((6, 0), (11, 0), (8, 0), (9, 1))))
    return ranking.ranked_candidates(i, o, "s_suppkey").withColumnRenamed("candidate_key", "c_custkey")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'F' WHEN o_orderkey % 3 = 1 THEN o_orderstatus || '2' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 2 THEN 3 WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END AS last_change
FROM orders WHERE o_orderkey % 5 > 0 OR o_orderkey % 3 = 2
""")
def stored_orders(spark, sf_dir):
    """A store of orders after four changes: all are put in, a third changes, a fifth goes, a third is put in or changed, and some are put in
    again that are there."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kept_ = store.TableStore(spark, f"{versions.shared_folder(spark)}/orders-{uuid.uuid4().hex}", "o_custkey long, o_orderkey long, status string, last_change int", by="o_custkey", key="o_orderkey", buckets=16)
    rows = lambda status, n: o.select("o_custkey", "o_orderkey", status.alias("status"), F.lit(n).alias("last_change"))
    kept_.upsert(rows(F.col("o_orderstatus"), 1))
    kept_.upsert(rows(F.concat("o_orderstatus", F.lit("2")), 2).where(k % 3 == 1))
    kept_.delete(o.where(k % 5 == 0))
    kept_.upsert(rows(F.lit("F"), 3).where(k % 3 == 2))
    kept_.insert(rows(F.lit("never"), 4).where((k % 3 == 2) | (k % 7 == 0) & (k % 5 > 0)))
    return kept_.read().select("o_orderkey", "status", "last_change")


@query("""
SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, CAST(l_quantity AS INTEGER) % 5 DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1
""")
def best_match_argmax(spark, sf_dir):
    """Of each order the line of the greatest rank, of equals the first."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("a"), (F.col("l_quantity").cast("int") % 5).alias("b"))
    return li.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("a", "b", -F.col("l_linenumber"))).alias("l_linenumber"))


def _units(spark, sf_dir):
    """Units of the lines: the plate is the order's for every third line, drivers repeat, phones are the line's."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    ok, n = F.col("l_orderkey"), F.col("l_linenumber")
    return li.select("l_orderkey", (ok * 10 + n).alias("seq"), "l_linenumber", F.concat(F.lit("Sopir "), (F.col("l_suppkey") % 4).cast("string")).alias("driver"), F.concat(F.lit("B "), F.when(n % 3 == 0, F.lit("0")).otherwise(n.cast("string")), F.lit(" X")).alias("no_plat"), F.concat(F.lit("08"), (n % 2).cast("string"), F.lit("1234567")).alias("kontak_driver"))


_UNITS_SQL = """u AS (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS seq, l_linenumber, l_suppkey % 4 AS d, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber END AS p, l_linenumber % 2 AS t FROM lineitem)"""


@query(f"""
WITH {_UNITS_SQL}
SELECT seq FROM u i WHERE l_linenumber > 3 AND NOT EXISTS (SELECT 1 FROM u e WHERE e.l_orderkey = i.l_orderkey AND e.l_linenumber <= 3 AND (e.p = i.p OR (e.d = i.d AND e.t = i.t)))
""")
def duplicate_unit_anti(spark, sf_dir):
    """Units that duplicate none of their order's first three: not the plate, nor two of driver, plate and phone."""
    u = _units(spark, sf_dir)
    return matching.duplicates_anti(u.where("l_linenumber > 3"), u.where("l_linenumber <= 3"), ["l_orderkey"]).select("seq")


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS scope, l_orderkey * 10 + l_linenumber AS existing_seq, l_orderkey * 10 + l_linenumber + 5 AS incoming_seq, CAST(CASE WHEN l_linenumber = 2 THEN 4 ELSE 9 END AS INTEGER) AS score FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
""")
def registered_unit_match(spark, sf_dir):
    """Each existing unit finds the incoming one of its plate; plates are unique, so no ties."""
    return _same_plates(lines(spark, sf_dir))


def _same_plates(li):
    """Units of the lines against the same units told again, line 2 with another driver and phone."""
    ok, n = F.col("l_orderkey"), F.col("l_linenumber")
    old = li.select("l_orderkey", (ok * 10 + n).alias("seq"), F.concat(F.lit("S"), n.cast("string")).alias("driver"), plate(ok, n).alias("no_plat"), phone(ok, n).alias("kontak_driver"))
    changed = lambda c, v: F.when(n == 2, v).otherwise(c)
    new = li.select("l_orderkey", (ok * 10 + n + 5).alias("seq"), changed(F.concat(F.lit("s "), n.cast("string")), F.lit("other")).alias("driver"), F.lower(plate(ok, n)).alias("no_plat"), changed(phone(ok, n), F.lit("0899")).alias("kontak_driver"))
    return matching.match_units(old, new, "l_orderkey")


def _letters_sql(column: str) -> str:
    """text.norm_text() in DuckDB's SQL. Its upper() leaves letters alone that become two or three, as the sharp s does."""
    for letters, c in (("SS", "ß"), ("N", "ŉ"), ("J", "ǰ"), ("H", "ẖ"), ("T", "ẗ"), ("W", "ẘ"), ("Y", "ẙ"), ("A", "ẚ"), ("FF", "ﬀ"), ("FI", "ﬁ"), ("FL", "ﬂ"), ("FFI", "ﬃ"), ("FFL", "ﬄ"), ("ST", "ﬅ"), ("ST", "ﬆ")):
        column = f"replace({column}, '{c}', '{letters}')"
    return f"regexp_replace(upper(coalesce({column}, '')), '[^A-Z0-9]+', '', 'g')"


@query(f"""
WITH d AS (SELECT doc_id, {_letters_sql('text')} AS t, {_letters_sql('lang')} AS l FROM documents)
SELECT i.doc_id FROM d i WHERE i.doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM d e WHERE e.doc_id % 2 = 0 AND e.t = i.t AND e.l = i.l)
""")
def exact_duplicate_semi(spark, sf_dir):
    """Rows that no stored row equals in the eight fields."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("pickup"), F.col("lang").alias("tujuan"), *(F.lit("").alias(c) for c in identity.ROW_FIELDS if c not in ("pickup", "tujuan")))
    return merge.exact_duplicates(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")).select("doc_id")


@query(f"""
WITH {ROWS_SQL}, s AS (SELECT seq, l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY seq) AS k FROM rows WHERE l_linestatus <> 'F'),
i AS (SELECT seq + 7 AS seq, l_orderkey, 'Z' || seq AS plate, row_number() OVER (PARTITION BY l_orderkey ORDER BY seq) AS k FROM rows WHERE l_linenumber <= 2)
SELECT r.seq, CASE WHEN l_linestatus = 'F' THEN r.plate ELSE coalesce(i.plate, '') END AS no_plat, CASE WHEN l_linestatus = 'F' THEN 'ASSIGNED' WHEN i.seq IS NOT NULL THEN 'ASSIGNED' ELSE 'PARTIAL' END AS status_unit, i.seq AS filled_from
FROM rows r LEFT JOIN s USING (seq) LEFT JOIN i ON i.l_orderkey = s.l_orderkey AND i.k = s.k
""")
def slot_fill_zip(spark, sf_dir):
    """The k-th new unit of an order goes into its k-th open slot."""
    rows = order_rows(spark, sf_dir)
    inc = rows.where("l_linenumber <= 2").select("l_orderkey", (F.col("seq") + 7).alias("seq"), "tgl_ro", F.lit("1/2/2024").alias("tgl_muat"), "pickup", "tujuan", "type_truck", F.concat(F.lit("Z"), F.col("seq").cast("string")).alias("no_plat"), F.concat(F.lit("D"), F.col("seq").cast("string")).alias("driver"), F.concat(F.lit("0877"), F.col("seq").cast("string")).alias("kontak_driver"))
    return merge.fill_slots(rows, inc, "l_orderkey").select("seq", "no_plat", "status_unit", "filled_from")


#: The lines of an order as units that repeat each other, in turn: whether one is new, and the units taken so far.
_TOLD_SQL = """u AS (
  SELECT l_orderkey, l_linenumber AS n, l_orderkey * 10 + l_linenumber AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k,
    {'d': min(l_suppkey) % 4, 'p': CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber END, 't': l_linenumber % 2} AS unit FROM lineitem GROUP BY l_orderkey, l_linenumber
)"""
_IS_TAKEN = "len(list_filter(taken, lambda x: x.p = unit.p OR (x.d = unit.d AND x.t = unit.t))) > 0"


def _told(spark, sf_dir):
    """_TOLD_SQL's units as rows."""
    li = lines(spark, sf_dir)
    ok, n = F.col("l_orderkey"), F.col("l_linenumber")
    said = {"driver": F.concat(F.lit("Sopir "), (F.col("l_suppkey") % 4).cast("string")), "no_plat": F.concat(F.lit("B "), F.when(n % 3 == 0, F.lit("0")).otherwise(n.cast("string")), F.lit(" X")), "kontak_driver": F.concat(F.lit("08"), (n % 2).cast("string"), F.lit("1234567"))}
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    blank = {c: F.lit("") for c in identity.ROW_FIELDS if c not in said}
    return li.select("l_orderkey", "l_linenumber", (ok * 10 + n).alias("seq"), k.alias("k"), *(c.alias(a) for a, c in {**said, **blank}.items()))


@query(f"""
WITH RECURSIVE {_TOLD_SQL}, r AS (
  SELECT l_orderkey, seq, k, TRUE AS new, [unit] AS taken FROM u WHERE k = 1
  UNION ALL SELECT l_orderkey, seq, k, NOT dup, CASE WHEN dup THEN taken ELSE list_append(taken, unit) END FROM (SELECT u.*, taken, {_IS_TAKEN} AS dup FROM r JOIN u ON u.l_orderkey = r.l_orderkey AND u.k = r.k + 1)
)
SELECT l_orderkey, seq FROM r WHERE new AND k > 1
""")
def units_told_once(spark, sf_dir):
    """The units of an order that are neither its first one nor one told before, by plate or two of three fields; each is compared with those
    that were taken."""
    u = _told(spark, sf_dir)
    return distinct.first_told(u.where("k = 1"), u.where("k > 1"), ["l_orderkey"], ["l_linenumber"]).select("l_orderkey", "seq")


@query(f"""
WITH RECURSIVE {_TOLD_SQL}, r AS (
  SELECT l_orderkey, seq, k, '' AS outcome, 0 AS used, [unit] AS taken FROM u WHERE k = 1
  UNION ALL SELECT l_orderkey, seq, k, outcome, CASE WHEN outcome = 'filled' THEN used + 1 ELSE used END, CASE WHEN outcome = 'filled' THEN list_append(taken, unit) ELSE taken END FROM (
    SELECT u.*, used, taken, CASE WHEN {_IS_TAKEN} THEN 'duplicate' WHEN used < u.l_orderkey % 4 THEN 'filled' ELSE 'skipped' END AS outcome FROM r JOIN u ON u.l_orderkey = r.l_orderkey AND u.k = r.k + 1)
)
SELECT l_orderkey, seq AS filled_from, outcome, CASE WHEN outcome = 'filled' THEN l_orderkey * 10 + used END AS slot FROM r WHERE k > 1
""")
def slot_fill_repeats(spark, sf_dir):
    """Units that repeat drivers, plates and phones go into the open slots of their order (none to three), one after the other."""
    stored, told = _slots_and_units(spark, sf_dir)
    return distinct.fill_outcomes(stored, told, "l_orderkey").select("l_orderkey", "filled_from", "outcome", "slot")


def _slots_and_units(spark, sf_dir):
    u = _told(spark, sf_dir)
    heads = u.where("k = 1").drop("l_linenumber", "k")
    slots = heads.select("l_orderkey", F.explode(F.sequence(F.lit(0), (F.col("l_orderkey") % 4).cast("int"))).alias("j"), *(c for c in heads.columns if c not in ("l_orderkey", "seq")))
    stored = slots.select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("j")).alias("seq"), *(F.when(F.col("j") == 0, F.col(c)).otherwise("").alias(c) for c in identity.ROW_FIELDS), F.when(F.col("j") == 0, "ASSIGNED").otherwise("UNASSIGNED").alias("status_unit"))
    return stored, u.where("k > 1")


@query(ORACLES["slot_fill_repeats"])
def slot_fill_stream(spark, sf_dir):
    """The same fills from a stream of files: odd units come first, then the even ones, late, then some again; the stream is started twice on
    one checkpoint."""
    stored, told = _slots_and_units(spark, sf_dir)
    folder, columns = f"{versions.shared_folder(spark)}/fills-{uuid.uuid4().hex}", ["l_orderkey", "told", "seq", *identity.ROW_FIELDS, "status_unit"]
    units = told.withColumns({"told": F.lit(True), "status_unit": F.lit("")})
    first = stored.withColumn("told", F.lit(False)).select(*columns).unionByName(units.where("l_linenumber % 2 = 1").select(*columns))
    stream_of = lambda: spark.readStream.schema(first.schema).parquet(f"{folder}/in")
    first.write.parquet(f"{folder}/in")
    fills.run_fills(stream_of(), "l_orderkey", folder)
    units.where("l_linenumber % 2 = 0 or l_orderkey % 3 = 0").select(*columns).write.mode("append").parquet(f"{folder}/in")
    fills.run_fills(stream_of(), "l_orderkey", folder)
    return fills.filled_so_far(spark, folder, "l_orderkey")


@query(f"""
WITH RECURSIVE {_TOLD_SQL}, r AS (
  SELECT l_orderkey, n, k, TRUE AS new, [unit] AS taken FROM u WHERE k = 1
  UNION ALL SELECT l_orderkey, n, k, NOT dup, CASE WHEN dup THEN taken ELSE list_append(taken, unit) END FROM (SELECT u.*, taken, {_IS_TAKEN} AS dup FROM r JOIN u ON u.l_orderkey = r.l_orderkey AND u.k = r.k + 1)
), s AS (SELECT DISTINCT l_orderkey, n // 2 AS stage FROM r WHERE k > 1), c AS (SELECT l_orderkey, count(*) AS stages FROM s GROUP BY 1),
t AS (SELECT s.l_orderkey, s.stage, string_agg('B ' || (CASE WHEN n % 3 = 0 THEN 0 ELSE n END) || ' X', ' | ' ORDER BY k) AS v FROM s JOIN r ON r.l_orderkey = s.l_orderkey AND new AND (k = 1 OR n // 2 <= s.stage) GROUP BY 1, 2)
SELECT l_orderkey, CAST(stage AS INTEGER) AS stage, CASE WHEN stages > 1 THEN 'Susulan #' || stage || ': ' || v ELSE v END AS line FROM t JOIN c USING (l_orderkey)
""")
def stage_texts(spark, sf_dir):
    """The plates that an order has after each of its follow-ups."""
    u = _told(spark, sf_dir).withColumn("stage", F.floor(F.col("l_linenumber") / 2).cast("int"))
    return cards.cumulative_units(u.where("k = 1"), u.where("k > 1"), "no_plat", "l_orderkey")


@query(f"""
WITH {_TOLD_SQL} SELECT u.l_orderkey, u.seq FROM u WHERE k % 2 = 0
""")
def unmatched_after_registration(spark, sf_dir):
    """Of a follow-up that tells each registered unit and a new one after each, what the pairing of registered units leaves over."""
    u = _told(spark, sf_dir).withColumn("no_plat", plate(F.col("l_orderkey"), F.col("l_linenumber"))).withColumn("driver", F.col("no_plat")).withColumn("kontak_driver", F.concat(F.lit("08"), F.col("seq").cast("string")))
    units = u.select("l_orderkey", "seq", *identity.IDENTITY)
    return sync.unmatched_units(units, u.where("k % 2 = 1"), "l_orderkey").select("l_orderkey", "seq")


_LADDER = """l AS (
  SELECT o_orderkey, o_orderkey % 11 = 0 AS date_conflict, o_orderkey % 5 AS complete, o_orderkey % 3 AS dup0, o_orderkey % 7 / 6.0 AS p, o_orderkey % 13 = 0 AS conflict, o_orderkey % 4 AS empty FROM orders
), l2 AS (SELECT *, least(dup0, complete) AS duplicates, complete - least(dup0, complete) AS new, CASE WHEN p >= 0.5 THEN 'MATCH' ELSE 'NO_MATCH' END AS predicted FROM l),
l3 AS (SELECT *, least(new, empty) AS fill, greatest(0, new - empty) AS overflow FROM l2),
l4 AS (SELECT *, CASE WHEN date_conflict THEN 'SIMPAN_SEBAGAI_ORDER_BARU' WHEN complete = 0 THEN 'CHAT_TIDAK_MEMBAWA_UNIT_LENGKAP' WHEN new <= 0 AND duplicates > 0 THEN 'ABAIKAN_DUPLIKAT'
    WHEN predicted = 'NO_MATCH' AND p < 0.2 AND duplicates = 0 THEN 'SIMPAN_SEBAGAI_ORDER_BARU' WHEN conflict THEN 'TAHAN_AUDIT_CONFLICT' WHEN predicted <> 'MATCH' OR p < 0.5 THEN 'SIMPAN_SEBAGAI_ORDER_BARU'
    WHEN fill > 0 AND overflow = 0 THEN 'REKOMENDASI_ISI_SLOT_ORDER_LAMA' ELSE 'REVIEW_MANUAL' END AS action FROM l3),
l5 AS (SELECT *, CASE action WHEN 'SIMPAN_SEBAGAI_ORDER_BARU' THEN 'TIDAK_COCOK' WHEN 'ABAIKAN_DUPLIKAT' THEN 'DUPLIKAT' WHEN 'TAHAN_AUDIT_CONFLICT' THEN 'CONFLICT' WHEN 'REKOMENDASI_ISI_SLOT_ORDER_LAMA' THEN 'SIAP_ISI_SLOT' ELSE 'PERLU_REVIEW' END AS decision_status FROM l4)"""


def _ladder(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k, "o_custkey", (k % 11 == 0).alias("date_conflict"), (k % 5).alias("complete"), F.least(k % 3, k % 5).alias("duplicates"), (k % 7 / F.lit(6.0)).alias("p_match"), (k % 13 == 0).alias("conflict"), (k % 4).alias("empty"))
    o = o.withColumn("new", F.col("complete") - F.col("duplicates")).withColumn("predicted", rules.predicted_label(F.lit(""), F.col("p_match")))
    return matching.decide(o)


@query(f"WITH {_LADDER} SELECT o_orderkey, decision_status, action, action IN ('CHAT_TIDAK_MEMBAWA_UNIT_LENGKAP', 'TAHAN_AUDIT_CONFLICT', 'REVIEW_MANUAL') AS review_required, CAST(fill AS BIGINT) AS fill, CAST(overflow AS BIGINT) AS overflow FROM l5")
def decision_ladder(spark, sf_dir):
    return _ladder(spark, sf_dir).select("o_orderkey", "decision_status", "action", "review_required", "fill", "overflow")


@query(f"""
WITH {_LADDER} SELECT o_orderkey, CASE WHEN (predicted = 'MATCH' AND p >= 0.85 AND action LIKE 'REKOM%') OR date_conflict THEN '' WHEN decision_status = 'CONFLICT' THEN 'Conflict atribut unit lama' WHEN predicted = 'NO_MATCH' AND p < 0.2 THEN ''
  WHEN overflow > 0 THEN 'Konflik slot' WHEN complete <= 0 THEN 'Data unit belum lengkap' WHEN predicted = 'MATCH' AND action NOT LIKE 'REKOM%' THEN CASE WHEN duplicates > 0 AND fill <= 0 THEN 'Duplikat unit lama' ELSE 'MATCH tidak aman' END
  WHEN decision_status = 'PERLU_REVIEW' THEN 'Perlu audit' WHEN p >= 0.2 AND p < 0.85 THEN 'Model ragu' ELSE '' END AS anomaly,
  CASE WHEN decision_status = 'DUPLIKAT' OR o_orderkey % 17 = 0 THEN CASE WHEN o_orderkey % 19 = 0 THEN 'GABUNG OTOMATIS' ELSE 'DUPLIKAT' END WHEN o_orderkey % 19 = 0 THEN 'GABUNG OTOMATIS' WHEN decision_status = 'SIAP_ISI_SLOT' THEN 'SIAP GABUNG' WHEN decision_status = 'CONFLICT' THEN 'CONFLICT'
  WHEN decision_status = 'TIDAK_COCOK' THEN 'ORDER BARU' WHEN action LIKE 'CHAT%' THEN 'DATA KURANG' ELSE 'CEK MANUAL' END AS operator_label FROM l5
""")
def anomaly_labels(spark, sf_dir):
    d = _ladder(spark, sf_dir)
    c, k = F.col, F.col("o_orderkey")
    merged = c("decision_status") == "SIAP_ISI_SLOT"
    a = rules.anomaly(c("decision_status"), F.lit(""), c("predicted"), c("p_match"), merged, c("date_conflict"), c("complete"), c("overflow"), c("duplicates"), c("fill"))
    return d.select(k, a.alias("anomaly"), rules.operator_label(c("decision_status"), c("action"), (k % 19 == 0).cast("int"), (k % 17 == 0).cast("int")).alias("operator_label"))


@query(f"""
WITH {_LADDER}, j AS (SELECT l5.*, o_custkey, decision_status = 'SIAP_ISI_SLOT' AND fill > 0 AND overflow <= 0 AS ready FROM l5 JOIN orders USING (o_orderkey))
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ready DESC, predicted = 'MATCH' DESC, date_conflict, overflow, fill DESC, p DESC, o_orderkey) AS n FROM j) WHERE n = 1
""")
def output_select(spark, sf_dir):
    """The row to show of each event."""
    d = _ladder(spark, sf_dir)
    d = d.withColumn("ready", rules.ready(F.col("decision_status"), F.col("fill"), F.col("overflow"), F.col("review_required"), F.lit("k"))).withColumn("seq", F.col("o_orderkey"))
    return matching.select_output(d, "o_custkey").select("o_custkey", "o_orderkey")


@query(f"""
WITH {_LADDER}, j AS (SELECT l5.*, o_custkey FROM l5 JOIN orders USING (o_orderkey)),
m AS (SELECT o_custkey, count(*) AS n_events, max(empty) AS empty, min(p) AS p_match, sum(new) AS new FROM j WHERE predicted = 'MATCH' GROUP BY 1 UNION ALL SELECT o_custkey, 1, empty, p, new FROM j WHERE predicted <> 'MATCH')
SELECT o_custkey, n_events, empty, round(p_match, 6) AS p_match, CAST(least(new, empty) AS BIGINT) AS fill, CAST(greatest(0, new - empty) AS BIGINT) AS overflow FROM m
""")
def combine_match_events(spark, sf_dir):
    """MATCH events of a candidate as one, others as they are."""
    d = _ladder(spark, sf_dir).select(F.col("o_custkey").alias("candidate_key"), "predicted", F.col("empty").alias("qty"), "empty", "p_match", "new", F.col("o_orderkey").alias("seq"), F.col("action").alias("reason"))
    return matching.merge_match_events(d).select(F.col("candidate_key").alias("o_custkey"), "n_events", "empty", F.round("p_match", 6).alias("p_match"), "fill", "overflow")


@query("""
SELECT c_custkey, array_to_string([x FOR x IN [CASE WHEN c_custkey % 3 = 0 THEN 'Pickup: ' || c_mktsegment || ' -> GUDANG' END, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN 'Tujuan: KOTA A -> KOTA B' END] IF x IS NOT NULL], '; ') AS messages FROM customer
""")
def conflict_messages(spark, sf_dir):
    k = F.col("c_custkey")
    pairs = {"Pickup": (F.col("c_mktsegment"), F.when(k % 3 == 0, "GUDANG").otherwise(F.lower("c_mktsegment"))), "Tujuan": (F.lit("KOTA A"), F.when(k % 8 == 0, "-").when(k % 4 == 0, "KOTA B").otherwise("kota-a"))}
    return table(spark, sf_dir, "customer").select(k, F.array_join(rules.conflict_messages(pairs, dates.norm_key), "; ").alias("messages"))


@query("""
SELECT c_custkey, CAST(n AS INTEGER) AS filled, CASE WHEN n >= 8 THEN 'ASSIGNED' WHEN n >= 3 THEN 'PARTIAL' ELSE 'UNASSIGNED' END AS status FROM (SELECT c_custkey, c_custkey % 9 AS n FROM customer)
""")
def status_classify(spark, sf_dir):
    blanks = ("", "-", "null", " NaN ", "undefined", "None", "-", "")
    cells = [F.when(F.col("c_custkey") % 9 > i, F.lit(f"v{i}")).otherwise(F.lit(b)) for i, b in enumerate(blanks)]
    return table(spark, sf_dir, "customer").select("c_custkey", text.count_filled(*cells).alias("filled"), rules.status(*cells).alias("status"))


@query("""
SELECT c_custkey, CASE WHEN s_suppkey IS NULL OR c_custkey % 4 = 1 THEN CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE c_name END WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN s_name ELSE c_name END AS name
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey
""")
def fill_or_overwrite(spark, sf_dir):
    """Blanks take what comes; other values give way only where that is allowed."""
    c, s, k = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), F.col("c_custkey")
    j = c.join(s, k == F.col("s_suppkey"), "left")
    current, incoming = F.when(k % 3 == 0, "-").otherwise(F.col("c_name")), F.when(k % 4 == 1, "").otherwise(F.coalesce("s_name", F.lit("null")))
    return j.select(k, rules.fill_or_overwrite(current, incoming, k % 2 == 0).alias("name"))


@query("""
SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'O' THEN 0.0 ELSE round(o_totalprice, 2) END AS price FROM orders
""")
def upsert_replace(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("price"), "o_orderstatus")
    new = o.where("o_orderstatus = 'O'").withColumn("price", F.lit(0.0))
    return merge.upsert(o, new, ["o_orderkey"]).select("o_orderkey", "o_orderpriority", "price")


@query("""
SELECT c_nationkey AS k, min(c_custkey) AS v, 'customer' AS source FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, min(s_suppkey), 'supplier' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer) GROUP BY 1
""")
def union_first_wins(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_custkey").alias("v")).withColumn("source", F.lit("customer"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_suppkey").alias("v")).withColumn("source", F.lit("supplier"))
    return merge.union_first_wins(c, s, "k")


@query(f"""
WITH {ROWS_SQL}, t AS (SELECT *, l_linestatus = 'F' AS done FROM rows), old AS (
  SELECT l_orderkey, 'stored' AS origin, seq, plate AS no_plat, 'ASSIGNED' AS status_unit, CASE WHEN done THEN 'kept' ELSE 'updated' END AS outcome FROM t
), more AS (SELECT l_orderkey, max(seq) AS seq FROM t GROUP BY 1)
SELECT CAST(l_orderkey AS VARCHAR) AS scope, origin, seq, no_plat, status_unit, outcome FROM old
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'incoming', seq + 1000000000, 'Z ' || l_orderkey, 'ASSIGNED', 'inserted' FROM more
""")
def smart_merge_kernel(spark, sf_dir):
    """The sequential merge of a follow-up into the rows of its order: it repeats the units that are there, with plates and phones spelled
    otherwise, fills each open slot of its loading date, and adds a unit that fits none."""
    li = lines(spark, sf_dir)
    own = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("l_shipdate"), F.min("l_suppkey").alias("s"))
    rows = order_rows(spark, sf_dir).join(own, ["l_orderkey", "l_linenumber"]).withColumn("scope", F.col("l_orderkey").cast("string")).withColumn("tgl_muat", F.date_format("l_shipdate", "d/M/yyyy"))
    ok, n = F.col("l_orderkey"), F.col("l_linenumber")
    said = rows.withColumns({
        "no_plat": F.lower(F.replace(plate(ok, n), F.lit(" "), F.lit("-"))), "driver": F.concat(F.lit("sopir "), F.col("s").cast("string")), "kontak_driver": F.replace(phone(ok, n), F.lit("+62 "), F.lit("0")),
        "status_unit": F.lit(""),
    })
    last = said.groupBy("scope").agg(F.max_by(F.struct(*said.columns), "seq").alias("x")).select("x.*")
    extra = last.withColumns({"seq": F.col("seq") + 1000000000, "no_plat": F.concat(F.lit("Z "), ok.cast("string")), "driver": F.lit("TAMBAHAN"), "kontak_driver": F.concat(F.lit("09"), ok.cast("string"))})
    merged = merge.smart_merge(rows, said.unionByName(extra))
    return merged.select("scope", "origin", "seq", F.regexp_replace(F.upper("no_plat"), "-", " ").alias("no_plat"), "status_unit", "outcome")


# ---- evaluation ------------------------------------------------------------------------------------------------------------------

_RATIO = "CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"


@query(f"""
WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels),
m AS (SELECT *, {_RATIO.format(a='tp', b='tp + fp')} AS p, {_RATIO.format(a='tp', b='tp + fn')} AS r, {_RATIO.format(a='tn', b='tn + fn')} AS p0, {_RATIO.format(a='tn', b='tn + fp')} AS r0 FROM c)
SELECT tp, fp, fn, tn, round({_RATIO.format(a='tp + tn', b='tp + fp + fn + tn')}, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
  round((CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END + CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END) / 2, 6) AS macro_f1 FROM m
""")
def metric_bundle_binary(spark, sf_dir):
    m = evaluate.binary_metrics(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return m.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "macro_f1")))


@query("""
WITH t AS (SELECT l_orderkey, l_returnflag AS v, count(*) AS t FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2), f AS (SELECT l_orderkey, l_returnflag AS v, count(*) AS f FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1, 2),
b AS (SELECT coalesce(t.l_orderkey, f.l_orderkey) AS k, coalesce(t, 0) AS t, coalesce(f, 0) AS f FROM t FULL JOIN f ON t.l_orderkey = f.l_orderkey AND t.v = f.v),
c AS (SELECT k, sum(least(t, f)) AS tp, sum(greatest(f - t, 0)) AS fp, sum(greatest(t - f, 0)) AS fn, sum(greatest(f - 1, 0)) AS d FROM b GROUP BY 1)
SELECT k AS l_orderkey, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(d AS BIGINT) AS duplicate_fp,
  CASE WHEN tp = 0 AND fp = 0 AND fn = 0 THEN 'EMPTY' WHEN fp = 0 AND fn = 0 THEN 'CORRECT' WHEN d > 0 AND fn = 0 THEN 'DUPLICATE' WHEN tp = 0 AND fp = 0 THEN 'MISSING' WHEN tp = 0 AND fn = 0 THEN 'SPURIOUS' WHEN tp > 0 AND fn = 0 THEN 'OVEREXTRACTED' WHEN tp > 0 AND fp = 0 THEN 'UNDEREXTRACTED' WHEN tp > 0 THEN 'MIXED' ELSE 'WRONG' END AS status FROM c
""")
def entity_multiset_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return evaluate.entity_counts(li.where("l_linenumber <= 4"), li.where("l_linenumber >= 2"), ["l_orderkey"], "l_returnflag")


@query("""
WITH d AS (SELECT unnest(['click', 'view', 'purchase', 'signup', 'logout', 'none']) AS event_type, unnest(range(6)) AS position), s AS (SELECT event_type, sum(event_id % 5) AS tp, sum(event_id % 3) AS fp, sum(event_id % 2) AS fn FROM events GROUP BY 1),
c AS (SELECT d.event_type, position, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM d LEFT JOIN s USING (event_type)), m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS r FROM c)
SELECT event_type, CAST(position AS INTEGER) AS position, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM m
""")
def attribute_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", *((F.col("event_id") % k).alias(c) for c, k in (("tp", 5), ("fp", 3), ("fn", 2))))
    m = evaluate.attribute_scores(e, "event_type", {x: i for i, x in enumerate(("click", "view", "purchase", "signup", "logout", "none"))})
    return m.select("event_type", "position", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""
WITH r AS (SELECT event_type, user_id, max(CAST(value AS INTEGER)) AS ms FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS runs, CAST(sum(ms) AS BIGINT) AS total_ms, round(avg(ms), 6) AS mean_ms FROM r GROUP BY 1
""")
def duration_two_level(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "user_id", F.rint("value").cast("int").alias("ms"))
    return evaluate.durations(e, "user_id", "ms", "event_type").select("event_type", "runs", "total_ms", F.round("mean_ms", 6).alias("mean_ms"))


@query("""
WITH j AS (SELECT lang, quality = 1 AS e, n_chars % 2 = 0 AS p, n_chars % 10 / 10.0 AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT lang, s, CASE WHEN e = p THEN 'PASS' WHEN p THEN 'FALSE_MATCH' ELSE 'FALSE_NO_MATCH' END AS st FROM j)
SELECT lang, count(*) AS cases, count(*) FILTER (WHERE st = 'PASS') AS passed, count(*) FILTER (WHERE st = 'FALSE_MATCH') AS false_match, count(*) FILTER (WHERE st = 'FALSE_NO_MATCH') AS false_no_match, round(avg(s), 6) AS mean_p, round(avg(CASE WHEN st = 'PASS' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM r GROUP BY 1
""")
def suite_coverage_groupby(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    name = lambda c: F.when(c, "MATCH").otherwise("NO_MATCH")
    r = j.select("lang", rules.result(name(F.col("quality") == 1), name(F.col("n_chars") % 2 == 0)).alias("status"), (F.col("n_chars") % 10 / F.lit(10.0)).alias("p"))
    m = evaluate.coverage(r, "lang", "status", "p")
    return m.select("lang", "cases", "passed", "false_match", "false_no_match", F.round("mean_p", 6).alias("mean_p"), F.round("pass_rate", 6).alias("pass_rate"))


@query("""
SELECT user_id, event_id, event_type, group_size FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(value AS INTEGER) DESC, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS group_size FROM events) WHERE n = 1
""")
def top_event_per_key(spark, sf_dir):
    return evaluate.top_event(table(spark, sf_dir, "events"), "user_id", F.rint("value").cast("int")).select("user_id", "event_id", "event_type", "group_size")


@query("""
SELECT user_id, count(*) AS n_events, min(event_id) AS first_seq, max(event_id) AS last_seq, max_by(event_type, event_id) FILTER (WHERE event_id % 3 <> 0) AS summary FROM events GROUP BY 1 HAVING count(*) >= 2 AND bool_or(event_type = 'purchase')
""")
def timeline_groups_having(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("summary"), (F.col("event_type") == "purchase").alias("merged"))
    return evaluate.timelines(e, "user_id", "event_id", "summary", 2, "merged").drop("has_merge")


@query("""
SELECT user_id, round(0.55 * avg(CASE WHEN event_id % 3 <> 0 THEN 1.0 ELSE 0.0 END) + 0.45 * coalesce(avg(CASE WHEN event_id % 3 <> 0 THEN event_id % 10 / 10.0 END), 0), 6) AS quality FROM events GROUP BY 1
""")
def chunk_quality(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3 != 0).alias("captured"), (F.col("event_id") % 10 / F.lit(10.0)).alias("confidence"))
    return evaluate.chunk_quality(e, "user_id", "captured", "confidence").select("user_id", F.round("quality", 6).alias("quality"))


@query("""
WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders), m AS (SELECT o_custkey, year(d) AS y, month(d) AS m, count(*) AS n, min(d) AS a, max(d) AS b FROM d GROUP BY 1, 2, 3),
g AS (SELECT o_custkey, min(a) AS a, max(b) AS b, arg_max({'y': y, 'm': m}, {'n': n, 'y': y, 'm': m}) AS x FROM m GROUP BY 1),
t AS (SELECT *, ['Januari','Februari','Maret','April','Mei','Juni','Juli','Agustus','September','Oktober','November','Desember'] AS l FROM g)
SELECT o_custkey, CASE WHEN a = b THEN 'Order ' || strftime(a, '%d') || ' ' || l[month(a)] || ' ' || year(a) WHEN year(a) = year(b) AND month(a) = month(b) THEN 'Order ' || strftime(a, '%d') || '-' || strftime(b, '%d') || ' ' || l[month(a)] || ' ' || year(a)
  WHEN year(a) = year(b) THEN 'Order ' || l[month(a)] || '-' || l[month(b)] || ' ' || year(a) ELSE 'Order ' || year(a) || '-' || year(b) END AS name, CAST(x.m AS INTEGER) AS dominant_month, CAST(x.y AS INTEGER) AS dominant_year FROM t
""")
def session_auto_name(spark, sf_dir):
    return evaluate.session_name(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").select("o_custkey", "name", "dominant_month", "dominant_year")


# ---- datasets, JSON --------------------------------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT p_partkey, unnest(range(len(string_split(p_name, ' ')))) AS i, unnest(string_split(p_name, ' ')) AS w FROM part), b AS (SELECT p_partkey, i // 2 AS g, string_agg(w, ' ' ORDER BY i) AS value FROM t WHERE i % 4 < 3 OR true GROUP BY 1, 2)
SELECT p_partkey, CASE WHEN g % 2 = 0 THEN 'DRIVER' ELSE 'PLATE' END AS entity, value FROM b
""")
def bio_merge(spark, sf_dir):
    """Tokens with B- and I- labels as entities: words in twos, drivers and plates in turn."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("seq", "word"))
    label = F.concat(F.when(F.col("seq") % 2 == 0, "B-").otherwise("I-"), F.when(F.floor(F.col("seq") / 2) % 2 == 0, "DRIVER").otherwise("PLATE"))
    return evaluate.span_values(p.withColumn("label", label), ["p_partkey"], "label", "word", "seq")


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS listed FROM events
""")
def json_edge(spark, sf_dir):
    """JSON text as structs; a list of objects or, where it is none, the empty list."""
    e = table(spark, sf_dir, "events")
    bad = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise("no json")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.size(io.json_list(bad)).alias("listed"))


@query("""
WITH d AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) // 2 AS h, c_nationkey, c_name FROM customer)
SELECT a.c_nationkey, a.k AS place, a.c_name AS text_a, b.c_name AS text_b FROM d a JOIN d b ON a.c_nationkey = b.c_nationkey AND b.k = a.k + a.h WHERE a.k <= a.h
""")
def zip_halves(spark, sf_dir):
    z = datasets.zip_halves(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name"), "c_nationkey", "c_custkey", "c_name")
    return z.select("c_nationkey", F.col("place").cast("long").alias("place"), "text_a", "text_b")


@query("""
SELECT p_partkey, array_to_string([CASE WHEN i % 2 = 0 THEN '081234567890' ELSE 'abc' || p_partkey END FOR i IN range(4)], ' ') AS tokens, 'B-PHONE O B-PHONE O' AS tags FROM part
""")
def tag_cleaning(spark, sf_dir):
    """Long 08 numbers are cut and tagged as phones, stutters lose a half."""
    half = F.concat(F.lit("abc"), F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.lit("081234567890123"), F.concat(half, half), F.lit("081234567890"), half).alias("tokens"), F.array(*map(F.lit, ("B-DRIVER", "O", "B-RO_DATE", "O"))).alias("ner_tags"))
    return datasets.clean_tags(rows).select("p_partkey", F.array_join("tokens", " ").alias("tokens"), F.array_join("ner_tags", " ").alias("tags"))


def _records(spark, sf_dir):
    k = F.col("p_partkey")
    r = table(spark, sf_dir, "part").select(k.alias("record_id"), F.col("p_brand").alias("pickup"), F.col("p_type").alias("tujuan"), F.lit("CDD").alias("type_truck"), F.lit("1/2/2024").alias("tgl_ro"), F.lit("").alias("tgl_muat"), F.concat(F.lit("S "), k.cast("string")).alias("driver"), F.format_string("B %d X", k).alias("no_plat"), F.lit("-").alias("kontak_driver"), F.col("p_name").alias("original_text"))
    return r.withColumn("route_key", F.upper("pickup")).withColumn("signature", datasets.signature_key())


@query("""
WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), k AS (SELECT count(*) AS n FROM part)
SELECT 'MATCH' AS label, 'original' AS pair_kind, n FROM k UNION ALL SELECT 'MATCH', 'revision', n FROM k UNION ALL SELECT 'NO_MATCH', 'hard', CAST(sum(n) AS BIGINT) FROM n WHERE n > 1
UNION ALL SELECT 'NO_MATCH', 'random', n FROM k WHERE n > 1
""")
def pair_dataset(spark, sf_dir):
    """Positive and negative pairs, counted by label and kind."""
    return datasets.label_counts(datasets.pair_dataset(_records(spark, sf_dir)), "label", "pair_kind")


@query("""
WITH n AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n, count(*) OVER () AS k FROM part), r AS (
  SELECT p_partkey, unnest(['original', 'revision', 'hard', 'random']) AS pair_kind, n, k FROM n
)
SELECT pair_kind || '-' || p_partkey AS pair_id, CASE WHEN pair_kind IN ('hard', 'random') THEN 'NO_MATCH' ELSE 'MATCH' END AS label, pair_kind, p_partkey AS source_id, true AS differs
FROM r WHERE pair_kind IN ('original', 'revision') OR (pair_kind = 'hard' AND n > 1) OR (pair_kind = 'random' AND k > 1)
""")
def pair_dataset_all(spark, sf_dir):
    """Every pair by its id; the texts of both sides differ in each."""
    p = datasets.pair_dataset(_records(spark, sf_dir))
    return p.select("pair_id", "label", "pair_kind", "source_id", (F.col("text_a") != F.col("text_b")).alias("differs"))


@query()
def augmented_templates(spark, sf_dir):
    """Every part as a template, with other dates, clock times, plates and phones; 25 rows a template on average."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("template_id"), F.concat(F.lit("REQUEST 1/2/2024 08:00 B 1234 XY 081234567890 "), "p_name").alias("text"))
    return datasets.augmented(t, 25 * t.count())


@query()
def pair_scores(spark, sf_dir):
    """The default scorer over each part and its brand-mates' hard negative."""
    pairs = datasets.pair_dataset(_records(spark, sf_dir))
    return matching.score_pairs(pairs).select("pair_id", "label", "p_match", "predicted")


@query("""
SELECT event_type, count(*) AS n FROM events GROUP BY 1
""")
def event_label_counts(spark, sf_dir):
    return datasets.label_counts(table(spark, sf_dir, "events"), "event_type")


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'UPDATE' WHEN event_id % 4 = 1 THEN 'NON_ORDER' ELSE 'NEW_ORDER' END AS label, event_id % 4 <> 1 OR event_id % 8 <> 1 AS passes, event_id % 4 = 3 AS junk FROM events
""")
def event_gate(spark, sf_dir):
    """Event labels by words, the gate of scores, and messages without any word of an order."""
    k = F.col("event_id") % 4
    t = F.when(k == 0, "revisi order unit").when(k == 1, "info order unit cancel").when(k == 2, "request 3 unit loading").otherwise("order?")
    e = table(spark, sf_dir, "events").select("event_id", t.alias("t"), F.when(F.col("event_id") % 8 == 1, 0.9).otherwise(0.5).alias("score"))
    label = rules.event_from_words(F.col("t"))
    return e.select("event_id", label.alias("label"), rules.passes_event_gate(label, F.col("score")).alias("passes"), rules.is_junk(F.col("t")).alias("junk"))


@query("""
SELECT o_orderkey, 'REQUEST' AS first_word, CAST(n AS INTEGER) AS slots, CAST(n AS INTEGER) AS phones FROM orders JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
""")
def message_phones(spark, sf_dir):
    m = order_messages(spark, sf_dir)
    return m.select("o_orderkey", F.regexp_extract("message", r"^(\w+)", 1).alias("first_word"), F.size(parse.loading_segments(F.col("message"))).alias("slots"), F.size(fields.phones(F.col("message"))).alias("phones"))


# ---- reports, evidence, annotation -----------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), c AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1)
SELECT r.user_id, event_id, CAST(b.i AS INTEGER) AS batch_index, CAST(n AS INTEGER) AS row_no FROM r JOIN (SELECT user_id, row_number() OVER (ORDER BY t, user_id) AS i FROM c) b USING (user_id)
""")
def replay_numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    first = e.groupBy("user_id").agg(F.min("ts").alias("created"))
    return report.number_batches(e.join(first, "user_id"), "user_id", "created", "event_id", "event_id").select("user_id", "event_id", F.col("batch_index").cast("int").alias("batch_index"), "row_no")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'BLOCK: tanggal request beda; ' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN 'BLOCK: lokasi beda; ' ELSE '' END
  || CASE WHEN p_partkey % 5 = 0 THEN 'REVIEW: pesan susulan tidak punya driver terisi; ' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN 'REVIEW: angka qty beda; ' ELSE '' END AS advisory,
  CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 'NO_MATCH' ELSE 'MATCH' END AS expected FROM part
""")
def pair_checks(spark, sf_dir):
    """What the operational rules advise on pairs of texts."""
    k = F.col("p_partkey")
    text_ = lambda d, p, q, who: F.concat(F.lit("REQUEST UNIT ON CALL "), d, F.lit("\n"), q, F.lit(" UNIT CDD\nLokasi : "), p, F.lit("\ndriver : "), who, F.lit("\n"))
    a = text_(F.lit("1 Mei 2024"), F.lit("GUDANG A"), F.lit("3"), F.lit("ani"))
    b = text_(F.when(k % 2 == 0, "2 Mei 2024").otherwise("1/5/2024"), F.when(k % 3 == 0, "GUDANG B").otherwise("gudang a"), F.when(k % 7 == 0, "4").otherwise("3"), F.when(k % 5 == 0, "-").otherwise("budi"))
    p = evidence.pair_checks(table(spark, sf_dir, "part").select(k, a.alias("text_a"), b.alias("text_b")))
    advisory = F.when(F.col("rule_advisory") == "OK", "").otherwise(F.concat("rule_advisory", F.lit("; ")))
    return p.select(k, advisory.alias("advisory"), "expected")


@query(f"""
WITH {ROWS_SQL}, e AS (
  SELECT l_orderkey, l_linenumber, unnest([
    {{'label': 'DRIVER', 'value': drv}}, {{'label': 'PLATE', 'value': plate}}, {{'label': 'PHONE', 'value': tel}}, {{'label': 'TIME', 'value': '08:00'}}, {{'label': 'DESTINATION', 'value': 'BEKASI - KOTA ' || (l_suppkey % 7)}},
    {{'label': 'LOAD_DATE', 'value': strftime(l_shipdate, '%-d/%-m/%Y')}}]) AS x FROM rows
), h AS (SELECT l_orderkey, any_value(tgl_ro) AS ro, any_value(pickup) AS pickup, any_value(type_truck) AS truck, count(*) AS n FROM rows GROUP BY 1), one AS (
  SELECT l_orderkey, unnest([{{'label': 'RO_DATE', 'value': ro}}, {{'label': 'ORIGIN', 'value': pickup}}, {{'label': 'UNIT_TYPE', 'value': truck}}, {{'label': 'UNIT_QTY', 'value': CAST(n AS VARCHAR)}}]) AS x FROM h
)
SELECT l_orderkey AS o_orderkey, x.label AS label, string_agg(x.value, '|' ORDER BY l_linenumber) AS "values" FROM e GROUP BY 1, 2 UNION ALL SELECT l_orderkey, x.label, x.value FROM one
""")
def annotated_entities(spark, sf_dir):
    """The annotator's entities of every message, by label, in the order in which they stand there."""
    a = annotate.annotate(order_messages(spark, sf_dir).select("o_orderkey", F.col("message").alias("text")))
    return annotate.grouped(a, ["o_orderkey"]).select("o_orderkey", "label", F.array_join("values", "|").alias("values"))


@query()
def office_report(spark, sf_dir):
    """The office report of the sheet that the block queries use, a batch a user."""
    i = F.col("event_id")
    rows = _sheet(spark, sf_dir).withColumns({
        "plate": F.format_string("b %d xy", i), "phone": F.format_string("+62 8%09d", i), "time": F.when(i % 6 == 0, "8").when(i % 6 == 1, "SEGERA").otherwise("09.30"),
        "date": F.when(i % 4 == 0, "5 mei").when(i % 4 == 1, "10.00").otherwise("1/2/2024"), "text": F.when(i % 9 == 0, "revisi jam").otherwise("driver 1: ani\ndriver 2: budi"),
    })
    return report.office_report(rows, "user_id", "event_id", 2026)


# ---- cards, plans and generated messages ---------------------------------------------------------------------------------------------


def _match_events(spark, sf_dir):
    """An event an order: the customer is the candidate, whose chat is that of the first order."""
    o = table(spark, sf_dir, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    chat = lambda c: F.concat(F.lit("Chat  nomor-"), c.cast("string"))
    state = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("ORDER_STATE | "), F.col("o_custkey").cast("string"))).otherwise(chat(F.col("first")))
    return o.join(first, "o_custkey").select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("candidate_key"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("candidate_summary"), chat(F.col("o_orderkey")).alias("incoming_text"),
        state.alias("candidate_chat_text"), F.lit("ORDER_STATE | x").alias("order_state_text"), F.when(F.col("o_orderkey") % 5 == 0, "NO_MATCH").otherwise("MATCH").alias("predicted"), F.when(F.col("o_orderkey") % 7 == 0, "NO_MATCH").otherwise("MATCH").alias("truth"),
        ((F.col("o_orderkey") % 100) / 100).alias("p_match"), (F.col("o_orderkey") % 2 == 0).alias("ready"), F.lit(0).alias("applied"), "first",
    )


@query("""
WITH f AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1), e AS (
  SELECT o_orderkey, o.o_custkey, first FROM orders o JOIN f USING (o_custkey) WHERE o_orderkey % 5 <> 0 AND o_orderkey % 100 >= 85 AND o_orderkey % 2 = 0
), t AS (SELECT o_custkey, o_orderkey AS k, o_orderkey AS seq FROM e UNION ALL SELECT o_custkey, first, o_orderkey FROM e WHERE o_orderkey % 4 <> 0)
SELECT CAST(o_custkey AS VARCHAR) AS candidate_key, 'order ' || max(seq) AS summary, count(DISTINCT k) AS n_cards FROM t GROUP BY o_custkey HAVING count(DISTINCT k) >= 2
""")
def card_groups(spark, sf_dir):
    """Evaluation cards that belong to one order, by the texts of its confident merges."""
    o = table(spark, sf_dir, "orders")
    own = o.select(F.concat(F.lit("chat nomor "), F.col("o_orderkey").cast("string")).alias("source"), F.col("o_orderkey").alias("chunk"), F.lit("b").alias("batch_id"), F.lit(1).alias("batch_index"))
    e = _match_events(spark, sf_dir).withColumn("candidate_summary", F.col("seq"))
    return cards.card_groups(own, e).select("candidate_key", F.concat(F.lit("order "), F.col("summary").cast("string")).alias("summary"), "n_cards")


@query("""
WITH f AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1), r AS (SELECT o_orderkey, o_custkey, first, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders JOIN f USING (o_custkey))
SELECT o_custkey AS event_id, rank, 'Chat  nomor-' || first AS order_state_text FROM r WHERE rank <= 5
""")
def match_previews(spark, sf_dir):
    """The five best rows of each preview as they are audited, with the candidate's chat in place of its state."""
    e = _match_events(spark, sf_dir)
    p = e.withColumn("event_id", F.col("candidate_key").cast("long")).withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy("seq")))
    orders = e.select("candidate_key", "seq", F.when(F.col("seq") % 4 == 0, F.lit("ORDER_STATE | y")).otherwise("").alias("raw_chat_text")).union(e.select("candidate_key", F.lit(10**12), F.concat(F.lit("Chat  nomor-"), F.col("first").cast("string"))))
    return cards.audit_rows(p, orders).select("event_id", "rank", "order_state_text")


@query("""
SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 7 <> 0 THEN 'TP' ELSE 'FP' END ELSE 'FN' END AS bucket FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0)
""")
def pair_detail_rows(spark, sf_dir):
    """Matches found, and all errors."""
    return cards.detail_rows(_match_events(spark, sf_dir), "MATCH benar + Semua Kesalahan").select("seq", "bucket")


@query(f"""
WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels),
k AS (SELECT 'MATCH' AS class, tp, fp, fn FROM c UNION ALL SELECT 'NO_MATCH', tn, fn, fp FROM c),
r AS (SELECT *, {_RATIO.format(a='tp', b='tp + fp')} AS precision, {_RATIO.format(a='tp', b='tp + fn')} AS recall FROM k), f AS (SELECT *, {_RATIO.format(a='2 * precision * recall', b='precision + recall')} AS f1 FROM r)
SELECT class, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f
UNION ALL SELECT 'macro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9) FROM f
""")
def official_metrics(spark, sf_dir):
    m = evaluate.binary_metrics(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    out = cards.official_metrics(m)
    return out.select("class", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey % 50 AS v FROM lineitem), t AS (SELECT DISTINCT l_orderkey, l_suppkey % 50 AS v FROM lineitem WHERE l_linenumber <> 2), f AS (SELECT DISTINCT l_orderkey, l_suppkey % 50 AS v FROM lineitem WHERE l_linenumber <> 1),
g AS (SELECT l_orderkey, count(*) FILTER (WHERE t.v IS NOT NULL AND f.v IS NOT NULL) AS tp, count(*) FILTER (WHERE t.v IS NULL AND f.v IS NOT NULL) AS fp, count(*) FILTER (WHERE t.v IS NOT NULL AND f.v IS NULL) AS fn FROM l LEFT JOIN t USING (l_orderkey, v) LEFT JOIN f USING (l_orderkey, v) GROUP BY 1)
SELECT l_orderkey AS "group", tp, fp, fn, CASE WHEN tp + fp + fn = 0 THEN 'EMPTY' WHEN fp = 0 AND fn = 0 THEN 'CORRECT' WHEN tp = 0 AND fp = 0 THEN 'MISSING' WHEN tp = 0 AND fn = 0 THEN 'SPURIOUS' WHEN tp > 0 AND fn = 0 THEN 'OVEREXTRACTED' WHEN tp > 0 AND fp = 0 THEN 'UNDEREXTRACTED' WHEN tp > 0 THEN 'MIXED' ELSE 'WRONG' END AS status FROM g
""")
def merged_attributes(spark, sf_dir):
    """An order's chunks evaluated as one: values that differ once normalised, of the truth and of the extraction."""
    li = table(spark, sf_dir, "lineitem")
    value = lambda spelled: F.concat(F.lit(f"B {spelled}"), (F.col("l_suppkey") % 50).cast("string"), F.lit(" x"))
    rows = li.select(F.col("l_orderkey").alias("group"), F.lit("PLATE").alias("attribute"), F.when(F.col("l_linenumber") != 2, F.array(value(""), value("- "))).otherwise(F.array().cast("array<string>")).alias("truth_items"),
                     F.when(F.col("l_linenumber") != 1, F.array(F.upper(value("")), F.lit("-"))).otherwise(F.array(F.lit(""))).alias("found_items"), F.lit(False).alias("label_swap"))
    return cards.merged_attributes(rows).select("group", *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")), "status")


@query(f"""
WITH {ROWS_SQL}, s AS (SELECT l_orderkey, seq, l_linestatus = 'F' AS done, row_number() OVER (PARTITION BY l_orderkey, l_linestatus = 'F' ORDER BY seq) AS k FROM rows)
SELECT l_orderkey, seq, CASE WHEN NOT done AND k <= 2 THEN 'BARU' ELSE '' END AS marker, CASE WHEN NOT done AND k <= 2 THEN l_orderkey * 10 + k END AS filled_from FROM s
""")
def after_snapshots(spark, sf_dir):
    """What orders would look like after a follow-up with two new units and a repeated one."""
    rows = order_rows(spark, sf_dir).withColumn("candidate_key", F.col("l_orderkey").cast("string"))
    ok = F.col("l_orderkey")
    known = F.min(F.when(F.col("status_unit") == "ASSIGNED", F.struct("seq", "no_plat", "driver", "kontak_driver")))
    units = rows.groupBy("l_orderkey", "candidate_key").agg(known.alias("x")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    said = lambda c, new: F.when(F.col("k") == 0, F.coalesce(F.col("x")[c], F.lit(""))).otherwise(new)
    k = F.col("k").cast("string")
    new = {"no_plat": F.concat(F.lit("Z "), ok.cast("string"), F.lit(" "), k), "driver": F.concat(F.lit("BARU "), k), "kontak_driver": F.concat(F.lit("09"), ok.cast("string"), k)}
    blank = {c: F.lit("") for c in identity.ROW_FIELDS if c not in new}
    inc = units.select((ok * 10 + F.col("k")).alias("seq"), "candidate_key", *(said(c, v).alias(c) for c, v in new.items()), *(v.alias(c) for c, v in blank.items()))
    return sync.after_snapshot(rows, inc).select("l_orderkey", "seq", "marker", "filled_from")


@query("""
WITH p AS (SELECT o_custkey AS path, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)
SELECT path, CAST(place AS INTEGER) AS place, 'ORDER_STATE | RO=5 MARET 2026; target=2; complete=1; empty=1; truck=CDD; pickup=GUDANG ' || o_orderkey || '; route=A - B; existing_driver=08:00 ANI B 1 X 0811' AS text_a, 'REQUEST susulan ' || o_orderkey || ' Nopol : B 2 Y' AS text_b, 'MATCH' AS label FROM p
""")
def pairs_from_text(spark, sf_dir):
    """Files of parents and as many follow-ups as training pairs."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    parent = F.concat(F.lit("REQUEST ON CALL 5 MARET 2026\n2 UNIT CDD\nLokasi : GUDANG "), k, F.lit("\nRute/tujuan : A - B\nWaktu loading : 08:00\nDriver : ANI\nNopol : B 1 X\nNo hp : 0811"))
    follow = F.concat(F.lit("REQUEST susulan "), k, F.lit("\nNopol : B 2 Y"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", c.alias("t")))), lambda x: x["t"]), "\n")
    files = o.groupBy(F.col("o_custkey").alias("path")).agg(F.concat(joined(parent), F.lit("\n"), joined(follow)).alias("chat_text"))
    return generate.pairs_from_text(files)


@query("SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS pairs, count(*) AS parents, count(*) AS follow_ups FROM orders GROUP BY 1")
def generated_pairs(spark, sf_dir):
    """A made-up parent and follow-up for each order, by month, and how many are read back with the quantities and units that were put in."""
    o = table(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("month"), F.col("o_orderkey").alias("k"))
    p = generate.order_pairs(o)
    listed = lambda c: F.size(F.filter(fields.slot_values(F.col(c), "nopol"), lambda v: text.filled(v)))
    right = lambda c, n: F.count_if((listed(c) == n) & (fields.unit_quantity(F.col(c)) == F.col("total")))
    return p.groupBy("month").agg(F.count("*").alias("pairs"), right("parent_text", F.col("filled")).alias("parents"), right("follow_text", F.col("total")).alias("follow_ups"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'MATCH' WHEN p_partkey % 3 = 1 THEN 'NO_MATCH' ELSE '' END AS truth FROM part
""")
def truth_lookup(spark, sf_dir):
    """Labels of pairs by a truth table: a third stand there turned round and spelled otherwise, a third with a letter changed, the others not."""
    k = F.col("p_partkey")
    text_ = lambda n, size: F.substring(F.repeat(F.sha2(n.cast("string"), 256), 8), F.lit(1), size.cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", text_(k, 40 + k % 400).alias("a"), text_(k + 10**9, 40 + k * 7 % 400).alias("b"))
    truth = p.where(k % 3 == 0).select(F.upper("b").alias("text_a"), F.concat(F.lit(" "), F.col("a")).alias("text_b"), F.lit("match ").alias("label"))
    truth = truth.union(p.where(k % 3 == 1).select(F.concat(F.substring("a", F.lit(1), F.length("a") - 1), F.lit("x")), "b", F.lit("NO_MATCH")))
    return matching.truth_labels(p.withColumnsRenamed({"a": "text_a", "b": "text_b"}), truth).select("p_partkey", "truth")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS r, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey, side ORDER BY l_linenumber) AS pos, side, CASE WHEN side = 1 AND s % 5 = 0 THEN 'O' WHEN side = 1 AND s % 7 = 0 THEN 'I-A' WHEN r = 'N' THEN 'O' WHEN l_linenumber % 2 = 1 THEN 'B-' || r ELSE 'I-' || r END AS tag FROM l, (VALUES (0), (1)) v(side)),
b AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) END AS type, lag(tag) OVER (PARTITION BY l_orderkey, side ORDER BY pos) AS prev FROM t),
n AS (SELECT *, sum(CASE WHEN tag = 'O' OR tag LIKE 'B-%' OR prev IS NULL OR prev = 'O' OR substr(prev, 3) <> type THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, side ORDER BY pos) AS k FROM b),
e AS (SELECT l_orderkey, side, any_value(type) AS type, min(pos) AS a, max(pos) AS z FROM n WHERE type IS NOT NULL GROUP BY l_orderkey, side, k),
m AS (SELECT type, l_orderkey, a, z, sum(side) AS f, sum(1 - side) AS t FROM e GROUP BY 1, 2, 3, 4), c AS (SELECT coalesce(type, 'micro') AS type, CAST(sum(t * f) AS BIGINT) AS tp, CAST(sum(f - t * f) AS BIGINT) AS fp, CAST(sum(t - t * f) AS BIGINT) AS fn FROM m GROUP BY GROUPING SETS ((type), ()))
SELECT type, tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c
""")
def entity_metric(spark, sf_dir):
    """Entities with exact boundaries: an order's lines as tagged tokens, against tags of which some are lost or broken."""
    li, r, s_, n = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey"), F.col("r"), F.col("l_suppkey"), F.col("l_linenumber")
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("r"))
    told = F.when(r == "N", "O").when(n % 2 == 1, F.concat(F.lit("B-"), r)).otherwise(F.concat(F.lit("I-"), r))
    seen = F.when(s_ % 5 == 0, "O").when(s_ % 7 == 0, "I-A").otherwise(told)
    tags = F.array_sort(F.collect_list(F.struct("l_linenumber", told.alias("t"), seen.alias("f"))))
    rows = li.join(flags, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(tags.alias("x")).select("l_orderkey", F.col("x.t").alias("truth"), F.col("x.f").alias("found"))
    return spans.entity_metric(rows, "l_orderkey", "truth", "found").select("type", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("""
WITH t AS (SELECT event_id, upper(event_type) AS label, md5('42/' || event_id) AS h FROM events), c AS (SELECT label, count(*) AS n FROM t GROUP BY 1), a AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(ceil(sum(n) / 5) AS BIGINT) AS tests FROM c),
q AS (SELECT label, n * tests // total AS whole, n * tests % total AS rest, tests FROM c, a), k AS (SELECT label, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= tests - (SELECT sum(whole) FROM q) THEN 1 ELSE 0 END AS k FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, event_id) AS nth FROM t), i AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM c)
SELECT event_id, label, label_id, CASE WHEN nth <= k THEN 'test' ELSE 'train' END AS split FROM r JOIN k USING (label) JOIN i USING (label)
""")
def stratified_split(spark, sf_dir):
    """Events as labelled rows, a fifth of each class for tests."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("text"), F.concat(F.lit(" "), F.col("event_type")).alias("label"))
    return splits.stratified_split(splits.labelled(e), "label", "event_id").select("event_id", "label", "label_id", "split")


@query("""
WITH w AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(p_name || ', ' || p_type), '[a-z0-9]+')) AS b FROM part),
s AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) END AS p FROM w)
SELECT p_partkey, round(p, 9) AS p_match, CASE WHEN p >= 0.5 THEN 'MATCH' ELSE 'NO_MATCH' END AS predicted FROM s
""")
def word_scores(spark, sf_dir):
    """The default pair scorer: the share of the words that both texts have; a blank side never matches."""
    p = table(spark, sf_dir, "part")
    pairs = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("text_a"), F.when(F.col("p_partkey") % 10 == 0, "-").otherwise(F.concat_ws(", ", "p_name", "p_type")).alias("text_b"))
    return matching.score_pairs(pairs).select("p_partkey", F.round("p_match", 9).alias("p_match"), "predicted")


@query("""
WITH u AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1),
g AS (SELECT o_orderkey, n, split('O O O O B-RO_DATE I-RO_DATE I-RO_DATE O B-UNIT_QTY O B-UNIT_TYPE O O B-ORIGIN I-ORIGIN', ' ')
  || flatten(list_transform(range(n), lambda i: split('O O O B-TIME B-LOAD_DATE O O B-DESTINATION I-DESTINATION I-DESTINATION I-DESTINATION O O B-DRIVER I-DRIVER O O B-PLATE I-PLATE I-PLATE O O O B-PHONE I-PHONE', ' '))) AS tags
  FROM orders JOIN u ON o_orderkey = l_orderkey),
v AS (SELECT list(t ORDER BY t <> 'O', t) AS names FROM (SELECT DISTINCT unnest(tags) AS t FROM g))
SELECT o_orderkey, len(tags) AS n_tokens, array_to_string(list_slice(list_transform(tags, lambda t: CAST(list_position(names, t) - 1 AS VARCHAR)) || list_transform(range(128), lambda i: '-100'), 1, 128), ' ') AS labels FROM g, v
""")
def label_alignment(spark, sf_dir):
    """The annotator's spans of every message as tags of its words, and as label ids of one length."""
    rows = annotate.annotate(order_messages(spark, sf_dir).select("o_orderkey", F.col("message").alias("text")))
    a = alignment.aligned(alignment.tokenized(rows)).select("o_orderkey", "ner_tags")
    labels = alignment.label_ids(F.col("ner_tags"), alignment.vocabulary(a))
    return a.select("o_orderkey", F.size("ner_tags").cast("long").alias("n_tokens"), F.array_join(labels.cast("array<string>"), " ").alias("labels"))


@query("""
WITH r AS (SELECT p_partkey AS k, unnest([0, 1, 2]) AS v FROM part), d AS (SELECT *, CAST('0x' || substr(md5('42/' || k || '/' || v || '/1'), 1, 8) AS BIGINT) AS a, CAST('0x' || substr(md5('42/' || k || '/' || v || '/5'), 1, 8) AS BIGINT) AS b FROM r),
w AS (SELECT *, CASE WHEN v > 0 AND a % 2 = 1 THEN (['muat di', 'dari', 'posisi', 'ambil di', 'loading di'])[a // 2 % 5 + 1] ELSE ':' END AS x, CASE WHEN v > 0 AND b % 2 = 1 THEN (['driver', 'sopir', 'sama pak', 'drivernya', 'supir'])[b // 2 % 5 + 1] ELSE ':' END AS y,
  CASE WHEN v > 0 THEN k + 9000 ELSE k END AS id FROM d)
SELECT id, v AS variant, row_number() OVER (ORDER BY md5('42/' || id || '/' || v)) AS place, 'Lokasi ' || x || ' GUDANG ' || k || ' driver ' || y || ' SOPIR : akhir' AS text,
  'O ' || regexp_replace(x, '[^ ]+', 'O', 'g') || ' B-ORIGIN I-ORIGIN O ' || regexp_replace(y, '[^ ]+', 'O', 'g') || ' B-DRIVER O O' AS tags,
  '0 ' || regexp_replace(x, '[^ ]+', '1', 'g') || ' 2 3 4 ' || regexp_replace(y, '[^ ]+', '5', 'g') || ' 6 7 8' AS from_places FROM w
""")
def varied_tags(spark, sf_dir):
    """Every part as a tagged text with its two variants, shuffled."""
    k = F.col("p_partkey")
    t = F.array(F.lit("Lokasi"), F.lit(":"), F.lit("GUDANG"), k.cast("string"), *map(F.lit, ("driver", ":", "SOPIR", ":", "akhir")))
    g = F.array(*map(F.lit, "O O B-ORIGIN I-ORIGIN O O B-DRIVER O O".split()))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), t.alias("tokens"), g.alias("ner_tags")).withColumn("original_text", F.array_join("tokens", " "))
    v = vary.shuffled(vary.varied(rows), ["id", "variant"])
    return v.select("id", "variant", F.col("place").cast("long").alias("place"), F.col("original_text").alias("text"), F.array_join("ner_tags", " ").alias("tags"), F.array_join(F.col("from_places").cast("array<string>"), " ").alias("from_places"))


@query("""
WITH g AS (SELECT sha256(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS chat_hash, doc_id, CASE WHEN doc_id % 10 = 0 THEN 'first' WHEN doc_id % 10 < 6 THEN 'second' ELSE 'third' END AS batch FROM documents),
b AS (SELECT chat_hash, min(batch) AS batch FROM g GROUP BY 1)
SELECT chat_hash, batch, CAST(min(doc_id) AS VARCHAR) AS id FROM g JOIN b USING (chat_hash, batch) GROUP BY 1, 2
""")
def hash_gate(spark, sf_dir):
    """The gate as a lookup: three batches of documents, and what each of them has brought."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = gate.HashGate(spark, f"{versions.shared_folder(spark)}/gate-{uuid.uuid4().hex}", expected=1 << 20)
    last = F.col("doc_id") % 10
    out = None
    for batch, these in (("first", last == 0), ("second", last.between(1, 5)), ("third", last > 5)):
        brought = held.admit(d.where(these), batch, "text", "doc_id").withColumn("batch", F.lit(batch))
        out = brought if out is None else out.unionByName(brought)
    return out
