from pyspark.sql import functions as F

from glyphmill.operators import sampling


def quotas(df):
    return {r[0]: r[1] for r in df.collect()}


def test_largest_remainder_and_proportional(spark):
    w = spark.createDataFrame([("short", 0.25, 1), ("medium", 0.25, 2), ("long", 0.5, 3)], "key string, weight double, ord int")
    assert quotas(sampling.largest_remainder(w, 10)) == {"short": 3, "medium": 2, "long": 5}
    a = spark.createDataFrame([("a", 3, 1), ("b", 4, 2), ("c", 100, 3)], "key string, n int, ord int")
    assert quotas(sampling.proportional_allocation(a, 10)) == {"a": 0, "b": 1, "c": 9}
    assert quotas(sampling.proportional_allocation(a, 200)) == {"a": 3, "b": 4, "c": 100}


def test_take_by_quota_is_exact_in_hot_groups(spark):
    rows = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g")).withColumn("u", sampling.uniform(F.col("id")))
    q = spark.createDataFrame([("hot", 1234), ("g1", 7), ("g2", 100000), ("none", 5)], "g string, quota bigint")
    got = sampling.take_by_quota(rows, q, ["g"], "u", "id")
    counts = {r["g"]: r["count"] for r in got.groupBy("g").count().collect()}
    assert counts["hot"] == 1234 and counts["g1"] == 7 and counts["g2"] == rows.filter("g = 'g2'").count() and "none" not in counts
    limit = sorted(r[0] for r in rows.filter("g = 'hot'").select("u").collect())[1233]
    assert got.filter("g = 'hot'").agg(F.max("u")).first()[0] == limit


def test_stratified_split_folds_and_balance(spark):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 5).alias("s"))
    drawn = sampling.stratified(df, ["y", "s"], 41, "k")
    assert {r["y"]: r["count"] for r in drawn.groupBy("y").count().collect()} == {0: 21, 1: 20}
    parts = sampling.train_test(df, "y", "k").groupBy("y", "part").count().collect()
    assert {(r["y"], r["part"]): r["count"] for r in parts} == {(0, "test"): 60, (0, "train"): 240, (1, "test"): 20, (1, "train"): 80}
    assert {r["count"] for r in sampling.folds(df, "y", "k").groupBy("fold").count().collect()} == {80}
    assert {r["actual"] for r in sampling.balance(df, ["y"]).collect()} == {0.25, 0.75}


def test_running_sums_over_partitions(spark):
    from glyphmill.operators import ranking

    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    rows = ranking.running_sums(df, ["k"], {"n": F.lit(1), "total": F.col("k")}).collect()
    assert all(r["n"] == r["k"] and r["total"] == r["k"] * (r["k"] - 1) // 2 for r in rows)
    assert ranking.numbered(df.limit(0), ["k"], "n").count() == 0
