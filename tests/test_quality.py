"""Means over places, made without an array of them."""

from pyspark.sql import functions as F

from segmentry.operators import junctions


def test_mean_at_is_the_mean_of_the_array_and_looks_only_inside(spark):
    rows = spark.createDataFrame([(3, 2, 4, 10), (7, 0, 1, 1), (9, 5, 3000, 4000)], "r long, lt int, n int, q_len int")
    at = lambda i: (i * 7 + F.col("r")) % 41
    whole = F.transform(F.sequence(F.lit(0), F.col("q_len") - 1), at)
    x = rows.select(junctions.mean_quality(whole, F.col("lt"), F.col("q_len") - F.col("lt") - F.col("n")).alias("a"), junctions.mean_quality_at(at, F.col("lt"), F.col("n")).alias("b")).collect()
    assert [r.a for r in x] == [r.b for r in x]
    # A place outside of the part would raise an error.
    strict = lambda i: F.when((i >= F.col("lt")) & (i < F.col("lt") + F.col("n")), i).otherwise(F.raise_error(F.lit("outside")).cast("int"))
    assert rows.select(junctions.mean_quality_at(strict, F.col("lt"), F.col("n")).alias("b")).collect()[0].b == 3.5
