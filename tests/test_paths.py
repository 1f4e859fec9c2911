"""Rank buckets that the data split, allocation in order, the turnover cap and the insider sweep against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tapewell.operators import execution as ex
from tapewell.operators import insiders as ins
from tapewell.operators import keyed as k
from tapewell.operators import metrics as mt
from tapewell.operators import portfolio as pf


def test_quantiles_of_values_that_lie_close(spark):
    n, limit = 200_000, 500
    df = spark.range(n).select(F.lit("hot").alias("key"), (0.03 + 0.0001 * F.rand(3)).alias("v")).unionByName(
        spark.createDataFrame([("wide", v) for v in (-1e300, -1e-300, 0.0, 5e-324, 1e-300, 1.0, 1e300)], "key string, v double"))
    counted = df.groupBy("key", "v").agg(F.count("*").alias("n"))
    seen = []
    buckets = k.rank_buckets
    k.rank_buckets = lambda *a, **b: seen.append(out := buckets(*a, **b)) or out
    try:
        got = {r.key: r for r in k.quantiles(df, ["key"], "v", {"a": 0.5, "b": 0.95, "c": 0.0}, limit).collect()}
    finally:
        k.rank_buckets = buckets
    want = {r.key: r for r in df.groupBy("key").agg(*[F.percentile("v", F.lit(p)).alias(c) for c, p in (("a", 0.5), ("b", 0.95), ("c", 0.0))]).collect()}
    for key in want:
        assert [got[key][c] for c in "abc"] == [pytest.approx(want[key][c], rel=1e-12) for c in "abc"]
    assert seen[0].groupBy("key", "_p", "_b").count().agg(F.max("count")).first()[0] <= limit
    values = sorted(r.v for r in counted.where("key = 'hot'").collect())
    stat = mt.order_statistic(counted.where("key = 'hot'"), ["key"], "v", "n", {"x": 0.05}).first()
    assert stat.x == values[int(0.05 * len(values))]


def test_quantiles_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert [tuple(r) for r in k.quantiles(df, [], "v", {"m": 0.5}).collect()] == [(1.5,)]
    assert k.quantiles(df.where("false"), ["v"], "v", {"m": 0.5}).count() == 0


def fold(orders, cash):
    out = {}
    for o in sorted((o for o in orders if o[3] == "BUY"), key=lambda o: (-o[4] * o[5], o[2])):
        n = min(o[4], max((cash + 1e-9) // o[5], 0))
        cash -= n * o[5]
        out[o[2]] = n
    return out


def test_allocation_in_order(spark):
    rng = random.Random(8)
    orders, cash, want = [], [], {}
    for step in range(60):
        rows = [(1, step, f"s{j:02d}", rng.choice(["BUY", "BUY", "SELL"]), float(rng.randint(1, 40)), rng.choice([1.0, 2.5, 7.0, 30.0, 101.0])) for j in range(rng.randint(1, 25))]
        sold = sum(r[4] * r[5] for r in rows if r[3] == "SELL")
        asked = sum(r[4] * r[5] for r in rows if r[3] == "BUY")
        money = rng.choice([0.0, asked - sold, asked, 0.3 * asked, 13.0])
        orders += rows
        cash.append((1, step, money))
        want |= {(step, s): n for s, n in fold(rows, max(money + sold, 0.0)).items()}
    df = spark.createDataFrame(orders, "run_id long, step long, symbol string, side string, qty double, price double")
    df = df.withColumn("notional", F.col("qty") * F.col("price")).withColumn("reason", F.lit(None).cast("string"))
    rows = ex.fund_buys(df, spark.createDataFrame(cash, "run_id long, step long, cash double")).collect()
    assert len(rows) == len(orders)
    for r in rows:
        n = want[r.step, r.symbol] if r.side == "BUY" else r.qty
        assert (r.filled_qty, r.reason) == (n, None if n == r.qty else "insufficient_cash" if n <= 0 else "partial_fill_due_to_cash")


def test_many_buys_of_one_step_take_linear_time(spark):
    def run(n):
        df = spark.range(n).select(F.lit(1).cast("long").alias("run_id"), F.lit(1).cast("long").alias("step"), F.col("id").cast("string").alias("symbol"), F.lit("BUY").alias("side"),
                                   F.lit(3.0).alias("qty"), (1.0 + F.pmod("id", F.lit(97))).alias("price"), F.lit(None).cast("string").alias("reason"))
        df = df.withColumn("notional", F.col("qty") * F.col("price"))
        cash = spark.createDataFrame([(1, 1, 50.0 * n)], "run_id long, step long, cash double")
        began = time.time()
        spent = ex.fund_buys(df, cash).agg(F.sum(F.col("filled_qty") * F.col("price"))).first()[0]
        return time.time() - began, spent

    run(100)
    took, spent = run(100_000)
    assert spent == pytest.approx(5_000_000, abs=100) and took < 30


def test_turnover_cap_that_always_binds(spark):
    limits = pf.RiskLimits(max_weight=0.25, exposure_cap=0.4, min_cash=0.1, max_turnover=0.05)
    rng = random.Random(2)
    rows = [(run, step, s, rng.random()) for run in (1, 2) for step in range(400) for s in rng.sample("abcdef", 4)]

    def bound(v):
        v = {s: min(max(w, 0.0), 0.25) for s, w in v.items()}
        total = sum(v.values())
        return {s: w * 0.4 / total for s, w in v.items()} if total > 0.4 else v

    want = {}
    for run in (1, 2):
        prev = dict.fromkeys("abcdef", 0.0)
        for step in range(400):
            target = bound({**dict.fromkeys("abcdef", 0.0), **{s: w for r, t, s, w in rows if (r, t) == (run, step)}})
            moved = sum(abs(target[s] - prev[s]) for s in prev)
            prev = bound({s: prev[s] + 0.05 / moved * (target[s] - prev[s]) for s in prev}) if moved > 0.05 else target
            want |= {(run, step, s): w for s, w in prev.items() if w > 1e-12}
    got = pf.cap_turnover(spark.createDataFrame(rows, "run_id long, step long, symbol string, weight double").repartition(5), limits).collect()
    assert {(r.run_id, r.step, r.symbol) for r in got} == set(want)
    assert all(r.weight == pytest.approx(want[r.run_id, r.step, r.symbol], abs=1e-9) for r in got)


@pytest.mark.parametrize("span", [7, 512])
def test_insider_sweep(spark, span):
    rng = random.Random(9)
    trades = [("A" if rng.random() < 0.8 else "B", rng.choice(["ann", " ann ", "bob", "cy", "", None]), rng.randint(1, 120), i, rng.choice([0.0, 10.0, 20.0, 40.0, None]), rng.choice([5.0, 15.0, 60.0, None])) for i in range(400)]
    chosen = spark.createDataFrame(trades, "symbol string, name string, _rn long, id long, before double, after double")
    sessions = spark.createDataFrame([(s, r) for s in "AB" for r in range(1, 161)], "symbol string, _rn long")
    got = {(r.symbol, r["_rn"]): r.delta for r in ins.ownership_delta(chosen.repartition(3), sessions, 30, span).collect()}
    assert len(got) == 320
    for symbol, at in got:
        seen = {}
        for s, name, rn, i, before, after in trades:
            if s == symbol and (name or "").strip() and before is not None and after is not None and at - 29 <= rn <= at:
                seen.setdefault(name.strip(), []).append((rn, i, before, after))
        deltas = sorted((max(t, key=lambda x: (x[0], -x[1]))[3] - b) / b for t in seen.values() if (b := min(t)[2]) > 0)
        want = (deltas[(len(deltas) - 1) // 2] + deltas[len(deltas) // 2]) / 2 if deltas else 0.0
        assert got[symbol, at] == pytest.approx(want)
