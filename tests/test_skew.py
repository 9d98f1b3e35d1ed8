"""Operators on tables where one key holds most rows, against plain formulations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tuneprep.operators import ranking as RK
from tuneprep.operators.sample import preview_even, split_train_val


def skewed(spark, n=5000):
    """Key 0 holds two thirds of the rows."""
    key = F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50)
    return spark.range(n).select(key.alias("k"), F.col("id").alias("ord"),
                                 (F.hash("id") % 1000).alias("v"))


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_top_k(spark):
    rows = skewed(spark)
    order = [F.col("v").desc(), F.col("ord")]
    w = Window.partitionBy("k").orderBy(*order)
    want = rows.withColumn("r", F.row_number().over(w)).filter("r <= 7")
    same(RK.top_k_per_key(rows, ["k"], order, 7, rank="r"), want)
    same(RK.top_k_per_key(rows.repartition(13), ["k"], order, 7, rank="r", salts=3), want)


def test_keep_first(spark):
    rows = skewed(spark)
    want = rows.groupBy("k").agg(F.min("ord").alias("ord"))
    same(RK.keep_first(rows, ["ord"], {"_k": F.col("k")}).select("k", "ord"), want)


def test_salted_join(spark):
    rows = skewed(spark)
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    for how in ("inner", "left_anti"):
        want = rows.join(one, "k", how)
        same(RK.salted_join(rows, one, "k", ["ord"], how, salts=5, hot_rows=100), want)
        same(RK.salted_join(rows, one, "k", ["ord"], how), want)


def test_blocked_lag(spark):
    rows = skewed(spark).drop("v").withColumn("x", F.col("ord") * 3)
    w = Window.partitionBy("k").orderBy("ord")
    want = rows.withColumn("p", F.lag("x").over(w))
    for width in (1, 17, 100000):
        same(RK.blocked_lag(rows, "k", "ord", "x", "p", width), want)


def test_exact_rank(spark):
    w = Window.orderBy("ord")
    for rows in (skewed(spark), skewed(spark).withColumn("ord", F.col("ord") * F.col("ord") * 99991)):
        want = rows.withColumn("pos", F.row_number().over(w) - 1)
        got = RK.exact_rank(RK.with_ord_bucket(rows, "ord"), [F.col("ord")]).drop("n")
        same(got, want)


def test_outlier_id_does_not_fill_one_bucket(spark):
    rows = spark.range(2000).select("id").union(spark.range(1).select(F.lit(2 ** 60).alias("id")))
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # else tiny ranges are put together
    spark.conf.set(merge, "false")
    try:
        sizes = RK.with_ord_bucket(rows, "id").groupBy("_bucket").count()
        assert sizes.agg(F.max("count")).first()[0] < 1500
    finally:
        spark.conf.set(merge, "true")


def clustered(spark):
    """99 % of the ids lie within a sliver of the range, the rest is spread over all of BIGINT."""
    return spark.range(9900).select((F.col("id") * 3 + 7).alias("ord")).union(
        spark.range(100).select(((F.col("id") - 50) * (2 ** 63 // 51)).alias("ord")))


def test_clustered_ids(spark, monkeypatch):
    monkeypatch.setattr(RK, "BUCKET_ROWS", 40)
    rows = clustered(spark)
    bucketed = RK.with_ord_bucket(rows, "ord")
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("n"), F.min("ord").alias("lo"),
                                            F.max("ord").alias("hi")).orderBy("_bucket").collect()
    assert sum(r.n for r in sizes) == 10_000 and max(r.n for r in sizes) <= 40
    assert all(r._bucket <= r.lo for r in sizes)
    assert all(a.hi < b._bucket for a, b in zip(sizes, sizes[1:]))
    assert "Exchange hashpartitioning(_bucket" not in bucketed._jdf.queryExecution().toString()
    w = Window.orderBy("ord")
    same(RK.exact_rank(bucketed, [F.col("ord")]).drop("n"),
         rows.withColumn("pos", F.row_number().over(w) - 1))


def test_positions_on_clustered_ids(spark, monkeypatch):
    monkeypatch.setattr(RK, "BUCKET_ROWS", 40)
    rows = clustered(spark)
    order = sorted(r.ord for r in rows.collect())
    split = split_train_val(rows, 0.7, shuffle=False)
    assert sorted(r.ord for r in split.filter("split = 'train'").collect()) == order[:7000]
    got = {r.pos: r.ord for r in preview_even(rows, 9).collect()}
    assert got == {i * 10_000 // 9: order[i * 10_000 // 9] for i in range(9)}


def test_repeated_ids_end_the_search(spark, monkeypatch):
    monkeypatch.setattr(RK, "BUCKET_ROWS", 10)
    rows = spark.range(300).select(F.when(F.col("id") < 200, 5).otherwise(F.col("id") * 10 ** 9).alias("ord"))
    assert RK.with_ord_bucket(rows, "ord").groupBy("_bucket").count().agg(F.max("count")).first()[0] == 200
