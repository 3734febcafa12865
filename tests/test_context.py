"""What is recalled for a question, and text blocks, with ties, nothing stored and everything asked for."""

from pyspark.sql import functions as F

from laplens.operators import tags


def recalled(spark, insights, general, summaries, **asked):
    out = tags.recall_context(
        spark.createDataFrame(insights, "circuit string, rider string, entry string, at int"), spark.createDataFrame(general, "entry string, at int"),
        spark.createDataFrame(summaries, "circuit string, entry string, at int"), **asked)
    return sorted((r.part, r.circuit, r.rider, r.recency, r.entry) for r in out.collect())


INSIGHTS = [("A", "r", f"i{n}", n) for n in range(7)] + [("A", "s", "other rider", 1), ("B", "r", "other place", 9)]
SUMMARIES = [("A", "a1", 1), ("A", "a2", 2), ("B", "b3", 3), ("All", "w4", 4), ("B", "b5", 5), ("A", "a6", 6), ("A", "a7", 7)]


def test_parts_for_one_rider(spark):
    got = recalled(spark, INSIGHTS, [("tie", 1), ("also", 1)], SUMMARIES, circuit="A", rider="r")
    assert [x for x in got if x[0] == "insights"] == [("insights", "A", "r", k + 1, f"i{6 - k}") for k in range(5)]
    assert [x[3:] for x in got if x[0] == "general"] == [(1, "also"), (2, "tie")]
    assert [x[1::2] + x[4:] for x in got if x[0] == "summaries"] == [("A", 1, "a7"), ("A", 2, "a6"), ("All", 3, "w4")]


def test_summaries_come_from_the_latest_six_only(spark):
    old = [("A", "old", 0)] + [("B", f"b{n}", n) for n in range(1, 7)]
    assert recalled(spark, INSIGHTS, [], old, circuit="A", rider="x") == []


def test_everything_asked_for(spark):
    got = recalled(spark, INSIGHTS, [], SUMMARIES)
    assert [x[3:] for x in got] == [(1, "a7"), (2, "a6"), (3, "b5")]


def test_text_block(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "n int, t string")
    assert tags.text_block(df, [F.col("n")], 2, F.col("t"), "x", ", ").first().x == "a, b"
    assert tags.text_block(df.filter("n > 5"), [F.col("n")], 2, F.col("t"), "x").first().x == ""
