"""The default pair scorer."""

from tallyloom.plans import matching


def test_words_are_taken_once(spark):
    pairs = [("Ab, cd-EF 1", "cd  ab", 1.0), ("x y z", "Z q", 0.5), ("--", "a", 0.0), ("a", "", 0.0), (None, "a", 0.0), ("a!", "é a a", 1.0), (".,", "?!", 0.0)]
    scored = matching.score_pairs(spark.createDataFrame(pairs, "text_a string, text_b string, want double"))
    assert [(x.p_match, x.predicted) for x in scored.collect()] == [(w, "MATCH" if w >= 0.5 else "NO_MATCH") for *_, w in pairs]
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 2
