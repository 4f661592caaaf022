"""The pool is joined with the selection log where it lies; it is not shuffled in every round."""

from pyspark.sql import functions as F

from labelflow.operators import active as A


def test_selection_log_is_sent_to_the_pool(spark, tmp_path):
    rows = spark.range(600).select(F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("category"),
                                   F.concat(*[F.sha2(F.concat(F.col("id"), F.lit(f":{i}")), 512) for i in range(8)]).alias("text"),
                                   F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25)).alias("probs"))
    rows.write.parquet(f"{tmp_path}/pool")
    pool = spark.read.parquet(f"{tmp_path}/pool")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # less than the pool, more than the log
    try:
        res = A.active_learning_run(pool, 5, 4, 3, 20)
        assert res.log.count() == 15 + 12
        for df in (A.remaining_pool(pool, res.log), A.training_rows(pool, res.log), res.pool_with_selections):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert res.pool_with_selections.where("selected").count() == 27
