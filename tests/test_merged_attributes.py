"""The values of an order's chunks evaluated as one: what counts, and that no join gathers them."""

from tallyloom.plans import cards

SCHEMA = "group long, attribute string, truth_items array<string>, found_items array<string>, label_swap boolean"
ROWS = [
    (1, "PLATE", ["B 1 X", "b-1-x"], ["B1X", "-"], False), (1, "PLATE", ["B 2 X"], [""], None), (1, "PHONE", ["-", None], None, False), (1, "PHONE", ["+62 811"], ["0811", "0812"], True),
    (2, "PLATE", [], ["B 3 X"], False), (3, "PLATE", None, None, True), (4, "PLATE", ["***"], ["***", "+++"], False), (None, "PLATE", ["B 4 X"], ["B 4 X"], False), (5, None, ["B 5 X"], [], True),
]


def test_values_are_counted_once_by_group_and_attribute(spark):
    out = cards.merged_attributes(spark.createDataFrame(ROWS, SCHEMA))
    got = {(r.group, r.attribute): (r.tp, r.fp, r.fn, r.duplicate_fp, r.label_swap, r.support, r.predicted, r.status) for r in out.collect()}
    assert got == {
        (1, "PLATE"): (1, 0, 1, 0, False, 2, 1, "UNDEREXTRACTED"), (1, "PHONE"): (1, 1, 0, 0, True, 1, 2, "LABEL_SWAP"), (2, "PLATE"): (0, 1, 0, 0, False, 0, 1, "SPURIOUS"),
        (3, "PLATE"): (0, 0, 0, 0, True, 0, 0, "EMPTY"), (4, "PLATE"): (1, 1, 0, 0, False, 1, 2, "OVEREXTRACTED"), (None, "PLATE"): (0, 0, 0, 0, False, 0, 0, "EMPTY"), (5, None): (0, 0, 0, 0, True, 0, 0, "EMPTY"),
    }


def test_no_join_gathers_the_values(spark):
    """Also where the attribute is one literal, which Spark takes out of the keys: the values are dealt once, and by number."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("attribute", F.lit("PLATE"))
    plan = cards.merged_attributes(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2 and plan.count("REPARTITION_BY_NUM") == 1
