"""Queries against their SQL on tables that the given ones do not hold."""

import duckdb

from tallyloom import queries


def test_exact_duplicates_state_one_rule(spark, tmp_path):
    """A sharp s and ligatures become several letters, a null or blank language is one like any other, and languages are compared by letters."""
    rows = [(0, "Straße 1", "de"), (1, "STRASSE-1", "de"), (2, "Stra e 2", "de"), (3, "Straße 2", "de"), (4, "ein", None), (5, "EIN", None), (6, "two", "en"), (7, "Two!", "EN "), (8, "ﬁn", "x"), (9, "fin", "x"), (10, None, "y"), (11, "--", "y"), (13, "own", "y"), (15, "ein", "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(r[0] for r in queries.exact_duplicate_semi(spark, str(tmp_path)).collect())
    assert got == [3, 13] == sorted(r[0] for r in db.execute(queries.ORACLES["exact_duplicate_semi"]).fetchall())
