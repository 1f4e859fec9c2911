"""Chunked windows equal the plain ones, whatever the chunk size and with one dominant key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewell.operators import keyed as k


@pytest.fixture
def rows(spark):
    rng = random.Random(5)
    data = []
    for key, n in (("hot", 60), ("b", 9), ("c", 1)):
        for i in range(n):
            v = None if rng.random() < 0.2 else round(rng.uniform(-5, 5), 3)
            data.append((key, i * 3 + rng.randrange(3), v))
    rng.shuffle(data)
    return spark.createDataFrame(data, "key string, at int, v double")


def placed(rows):
    return k.ordinal(rows, ["key"], ["at"], F.floor(F.col("at") / 20))


def same(a, b):
    cols = sorted(a.columns)
    ra, rb = (sorted(map(tuple, d.select(*cols).collect()), key=repr) for d in (a, b))
    assert len(ra) == len(rb)
    for x, y in zip(ra, rb):
        assert [pytest.approx(p) if isinstance(p, float) else p for p in x] == list(y)


def test_ordinal(rows, small_chunks):
    w = Window.partitionBy("key").orderBy("at")
    same(placed(rows).select("key", "at", "_rn"), rows.select("key", "at", F.row_number().over(w).cast("bigint").alias("_rn")))


def test_rolling(rows, small_chunks):
    w = Window.partitionBy("key").orderBy("at")
    got = k.rolling(
        placed(rows), ["key"],
        lambda f, w: {"s": F.sum("v").over(f(-4, 0)), "n": F.lead("v", 2).over(w)}, lambda f, w: {"t": F.max("s").over(f(-3, 0))}, back=7, fwd=2)
    want = rows.withColumn("s", F.sum("v").over(w.rowsBetween(-4, 0))).withColumn("n", F.lead("v", 2).over(w))
    want = want.withColumn("t", F.max("s").over(w.rowsBetween(-3, 0)))
    same(got.drop("_rn"), want)


def test_running(rows, small_chunks):
    w = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    got = k.running(placed(rows), ["key"], {"s": ("sum", "v"), "m": ("max", "v"), "lo": ("min", "v"), "c": ("count", "v"), "l": ("last", "v")})
    want = rows.withColumns({"s": F.sum("v").over(w), "m": F.max("v").over(w), "lo": F.min("v").over(w), "c": F.count("v").over(w), "l": F.last("v", True).over(w)})
    same(got.drop("_rn"), want)


def test_drawdown(rows, small_chunks):
    g = rows.withColumn("g", 1 + F.coalesce("v", F.lit(0.0)) / 20)
    w = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    got = k.drawdown(placed(g), ["key"], "g", seed=1.0).select("key", "at", "equity", "drawdown")
    want = g.withColumn("equity", F.product("g").over(w)).withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    same(got, want.select("key", "at", "equity", (F.col("equity") / F.col("peak") - 1).alias("drawdown")))


def test_quantiles(rows):
    got = k.quantiles(rows, ["key"], "v", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0})
    want = rows.filter("v is not null").groupBy("key").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in (("a", 0.5), ("b", 0.95), ("c", 0.0), ("d", 1.0))])
    same(got, want)


def test_keep_best(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), ("b", 0, "w")], "k string, o int, v string")
    assert {tuple(r) for r in k.keep_best(df, ["k"], ["o"]).collect()} == {("a", 2, "y"), ("b", 0, "w")}


def test_asof(spark, small_chunks):
    left = spark.createDataFrame([("s", f"2024-01-{d:02d}") for d in range(1, 29)], "symbol string, day string").withColumn("ts", F.col("day").cast("timestamp"))
    right = spark.createDataFrame([("s", "2024-01-05", 1), ("s", "2024-01-05", 2), ("s", "2024-01-20", 3)], "symbol string, d string, v int").withColumn("at", F.col("d").cast("timestamp"))
    got = {r.day: r.v for r in k.asof_backward(left, right, ["symbol"], "ts", "at", ["v"], 86_400, right_tie=["v"]).collect()}
    assert got["2024-01-04"] is None and got["2024-01-05"] == 2 and got["2024-01-19"] == 2 and got["2024-01-20"] == 3 and got["2024-01-28"] == 3
