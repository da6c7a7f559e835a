from metrolith import io


def test_stored_tables_are_released(spark, tmp_path):
    io.release(spark)
    df = io.stored(spark.range(10))
    assert df.count() == 10 and io.release(spark) == 1 and io.release(spark) == 0


def test_shared_dir(spark):
    """The session's own where it names one; else one for the whole context."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert io.shared_dir(spark) == io.shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir())
    assert io.cut(spark.range(3)).count() == 3


def test_cut_has_no_estimate_that_grows(spark):
    """Each round joins what the one before it cut: estimates that multiply would double their digits every time."""
    from pyspark.sql import functions as F

    from metrolith.io import cut

    d = cut(spark.range(20).select((F.col("id") % 7).alias("u"), "id"))
    for _ in range(6):
        d = cut(d.join(d.select(F.col("u").alias("v"), F.col("id").alias("i")), F.col("u") == F.col("v")).groupBy("u").agg(F.max("i").alias("id")))
    assert len(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 30
    assert {(r.u, r.id) for r in d.collect()} == {(u, max(i for i in range(20) if i % 7 == u)) for u in range(7)}
