from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.operators import skew


def test_shuffles_grow_with_the_input(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    advisory = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    try:
        assert session.size_shuffles(spark, 100 * 1024**4) == 819_200
        assert session.size_shuffles(spark, 1) == 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        if advisory is None:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        else:
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)


def test_best_row_combines_before_the_shuffle(spark):
    frame = spark.range(100).select((F.col("id") % 3).alias("k"), "id", (-F.col("id")).alias("v"))
    best = skew.best_row(frame, ["k"], [F.col("id")])
    assert sorted(tuple(r) for r in best.collect()) == [(0, 99, -99), (1, 97, -97), (2, 98, -98)]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_halo_copies_only_the_seam(spark):
    frame = spark.range(20).withColumnRenamed("id", "at")
    rows = skew.with_halo(frame, F.col("at"), 3, 10).collect()
    assert sum(r["__home"] for r in rows) == 20
    assert sorted((r.at, r["__bucket"]) for r in rows if not r["__home"]) == [(7, 1), (8, 1), (9, 1), (17, 2), (18, 2), (19, 2)]
