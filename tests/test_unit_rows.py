"""A row a unit, however many units an order has."""

import duckdb
from pyspark.sql import functions as F

from tallyloom import queries
from tallyloom.plans import parse


def test_an_order_of_many_units_keeps_them_all(spark):
    """The last unit is there whether it is listed or only asked for, also where the numbers take more than one array."""
    listed = "REQUEST UNIT ON CALL 1 Mei 2024\n90 UNIT CDD\nLokasi : GUDANG 1\n" + "".join(f"driver : SOPIR {i}\nNopol : B {i} X\n" for i in range(100))
    asked = "REQUEST UNIT ON CALL 1 Mei 2024\nqty target : {}\nLokasi : GUDANG 1\nNopol : B 1 X\n"
    sizes = {1: 100, 2: 81, 3: parse.UNITS, 4: parse.UNITS + 1, 5: 1}
    chats = [(1, listed), *((k, asked.format(n)) for k, n in sizes.items() if k in (2, 3, 4)), (5, "REQUEST UNIT ON CALL 1 Mei 2024\nqty target : 0\n")]
    rows = parse.unit_rows(parse.parse_chunks(parse.split_chats(spark.createDataFrame(chats, "chat_id long, chat_text string"))), "chat_id").cache()
    count = {r.chat_id: (r.n, r.least, r.most) for r in rows.groupBy("chat_id").agg(F.countDistinct("slot_no").alias("n"), F.min("slot_no").alias("least"), F.max("slot_no").alias("most")).collect()}
    assert count == {k: (n, 0, n - 1) for k, n in sizes.items()} and rows.count() == sum(sizes.values())
    assert [(r.driver, r.no_plat) for r in rows.where("chat_id = 1 and slot_no = 99").collect()] == [("SOPIR 99", "B 99 X")]


def test_orders_of_over_eighty_lines_equal_the_sql(spark, tmp_path):
    db = duckdb.connect()
    for name, sql in {
        "orders": "SELECT i AS o_orderkey, 7 AS o_custkey, TIMESTAMP '2024-05-01' AS o_orderdate FROM range(2) t(i)",
        "lineitem": "SELECT CAST(i % 2 AS BIGINT) AS l_orderkey, i // 2 AS l_linenumber, i % 9 AS l_suppkey, TIMESTAMP '2024-05-02' AS l_shipdate, 'F' AS l_linestatus FROM range(190) t(i)",
    }.items():
        db.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
        db.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    units = queries.unit_slot_explode(spark, str(tmp_path))
    got = sorted(tuple(r) for r in units.collect())
    assert len(got) == 190 and got == sorted(db.execute(f"SELECT {', '.join(units.columns)} FROM ({queries.ORACLES['unit_slot_explode']})").fetchall())
