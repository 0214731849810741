"""Order messages written from the base tables, so that parsing is tested on texts whose contents are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import month_name

#: Truck types of the rendered messages.
TYPES = ("TRONTON", "CDDL", "CDD", "FUSO", "ENGKEL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(key: Column) -> Column:
    return F.concat(F.lit("GUDANG "), (key % 20).cast("string"))


def truck(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TYPES)), (key % len(TYPES) + 1).cast("int"))


def plate(order: Column, line: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.concat(F.lit("B "), text(order), F.lit(" X"), text(F.substring(F.lit("ABCDEFGHIJ"), line.cast("int") + 1, 1)))


def phone(order: Column, line: Column) -> Column:
    return F.concat(F.lit("+62 8"), F.lpad((order * 10 + line).cast("string"), 10, "1"))


def word_date(d: Column) -> Column:
    return F.concat_ws(" ", F.dayofmonth(d).cast("string"), month_name(F.month(d)), F.year(d).cast("string"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of orders, each number once."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_shipdate").alias("l_shipdate"), F.min("l_linestatus").alias("l_linestatus"))


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message an order: o_orderkey, o_custkey, message."""
    li = lines(spark, sf_dir)
    ok, n = F.col("l_orderkey"), F.col("l_linenumber")
    segment = F.concat(
        F.date_format("l_shipdate", "'Waktu loading : '08:00 d/M/yyyy"), F.lit("\nRute/tujuan : BEKASI - KOTA "), (F.col("l_suppkey") % 7).cast("string"),
        F.lit("\ndriver : SOPIR "), F.col("l_suppkey").cast("string"), F.lit("\nNopol : "), plate(ok, n), F.lit("\nNo hp : "), phone(ok, n),
    )
    units = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", segment.alias("s")))), lambda x: x["s"]), "\n").alias("units"), F.count("*").alias("qty"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(units, F.col("o_orderkey") == F.col("l_orderkey"))
    head = F.concat(F.lit("REQUEST UNIT ON CALL "), word_date(F.col("o_orderdate")), F.lit(" :\n"), F.col("qty").cast("string"), F.lit(" UNIT "), truck(F.col("o_orderkey")), F.lit("\nLokasi : "), place(F.col("o_custkey")))
    return o.select("o_orderkey", "o_custkey", F.concat(head, F.lit("\n"), F.col("units"), F.lit("\n")).alias("message"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat a customer: chat_id and all their messages in the order of their keys."""
    m = order_messages(spark, sf_dir)
    return m.groupBy(F.col("o_custkey").alias("chat_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "message"))), lambda x: x["message"]), "\n\n").alias("chat_text"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored order rows, one a line: shipped lines (linestatus F) have their unit, open ones are empty slots."""
    li, o = lines(spark, sf_dir), table(spark, sf_dir, "orders")
    j = li.join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    done = F.col("l_linestatus") == "F"
    unit = lambda c: F.when(done, c).otherwise("")
    ok, n = F.col("l_orderkey"), F.col("l_linenumber")
    return j.select(
        (ok * 10 + n).alias("seq"), "l_orderkey", "l_linenumber", "l_suppkey", word_date(F.col("o_orderdate")).alias("tgl_ro"), unit(F.date_format("l_shipdate", "d/M/yyyy")).alias("tgl_muat"),
        place(F.col("o_custkey")).alias("pickup"), F.concat(F.lit("KOTA "), (F.col("o_custkey") % 7).cast("string")).alias("tujuan"), truck(ok).alias("type_truck"),
        unit(plate(ok, n)).alias("no_plat"), unit(F.concat(F.lit("SOPIR "), F.col("l_suppkey").cast("string"))).alias("driver"), unit(phone(ok, n)).alias("kontak_driver"),
        F.when(done, "ASSIGNED").otherwise("PARTIAL").alias("status_unit"),
    )


#: The same rows in DuckDB's SQL, from the base tables, as a CTE.
ROWS_SQL = """
li AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_shipdate) AS l_shipdate, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2),
rows AS (
  SELECT l_orderkey * 10 + l_linenumber AS seq, l_orderkey, l_linenumber, l_suppkey, l_linestatus, o_custkey, o_orderdate, l_shipdate,
    CAST(day(o_orderdate) AS VARCHAR) || ' ' || (['JANUARI','FEBRUARI','MARET','APRIL','MEI','JUNI','JULI','AGUSTUS','SEPTEMBER','OKTOBER','NOVEMBER','DESEMBER'])[month(o_orderdate)] || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS tgl_ro,
    'GUDANG ' || (o_custkey % 20) AS pickup, 'KOTA ' || (o_custkey % 7) AS tujuan, (['TRONTON','CDDL','CDD','FUSO','ENGKEL'])[l_orderkey % 5 + 1] AS type_truck,
    'B ' || l_orderkey || ' X' || substr('ABCDEFGHIJ', l_linenumber + 1, 1) AS plate, 'SOPIR ' || l_suppkey AS drv,
    '+62 8' || lpad(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), 10, '1') AS tel,
    'B' || l_orderkey || 'X' || substr('ABCDEFGHIJ', l_linenumber + 1, 1) AS plate_key
  FROM li JOIN orders ON l_orderkey = o_orderkey
)"""
