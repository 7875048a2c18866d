"""Narrow tables: rows, not bytes, decide how many tasks share them."""

from corvane.plans import views


def test_rows_are_spread_by_number(spark):
    few = spark.range(10).coalesce(1)
    many = spark.range(views.TASK_ROWS * 3 + 1).coalesce(1)
    assert views.spread(few, "id").rdd.getNumPartitions() == 1
    out = views.spread(many, "id")
    assert out.rdd.getNumPartitions() == 4
    assert out.count() == views.TASK_ROWS * 3 + 1
