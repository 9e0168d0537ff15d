import random

from pyspark.sql import Window, functions as F

from ticketlake.plans.prefix import running


def test_running_sum_and_max_match_plain_window(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), s, rnd.randint(-3, 5)) for s in rnd.sample(range(10_000), 600)]
    df = spark.createDataFrame(rows, "k long, seq long, v long")
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    expect = df.select("k", "seq", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"))
    got = running(running(df, "k", "seq", "v", "s", how="sum", bits=5), "k", "seq", "v", "m", how="max", bits=5)
    assert sorted(got.select("k", "seq", "s", "m").collect()) == sorted(expect.collect())


def test_several_columns_in_one_pass_read_the_rows_twice(spark):
    """running_all gives what one pass after the other gives, from fewer reads of its input."""
    from ticketlake.plans.prefix import running_all
    rows = spark.createDataFrame([(i % 3, i * 7 % 200, i % 5) for i in range(200)], "k long, o long, v long")
    one = running(running(rows, "k", "o", "v", "s", bits=3), "k", "o", "v", "m", how="max", bits=3)
    both = running_all(rows, "k", "o", {"s": ("v", "sum"), "m": ("v", "max")}, bits=3)
    assert sorted(map(tuple, both.select(one.columns).collect())) == sorted(map(tuple, one.collect()))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans(both) == 2 < scans(one)
