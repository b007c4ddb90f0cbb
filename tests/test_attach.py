from pyspark.sql import functions as F

from steadfield.operators import correct


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parameters_are_broadcast_only_up_to_a_bound(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        field = spark.range(1000).select((F.col("id") % 10).cast("string").alias("field_id"), F.col("id").cast("float").alias("xh"))
        params = field.groupBy("field_id").agg(F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))
        small = correct.attach(field, params)
        assert "BroadcastHashJoin" in plan(small) and small.count() == 1000
        monkeypatch.setattr(correct, "BROADCAST_ROWS", 5)
        large = correct.attach(field, params)
        assert "SortMergeJoin" in plan(large) and sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_decoding_with_stored_params_has_no_shuffle(spark):
    field = spark.range(1000).select(F.lit("f").alias("field_id"), F.col("id").alias("i"), F.col("id").cast("float").alias("xh"))
    params = spark.createDataFrame([("f", 2.0, 1.0)], "field_id string, a double, b double")
    done = correct.apply_affine(field, params)
    assert "Exchange hashpartitioning" not in plan(done) and done.agg(F.max("xc")).first()[0] == 1999.0
