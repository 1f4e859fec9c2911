"""Paths, regimes, quality and caps of runs whose rows come together once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tapewell.operators import execution as ex, metrics as mt, portfolio as pf
from tapewell.operators.keyed import quantiles, quantiles_beside
from tapewell.plans import catalog, q_port
from tapewell.session import job
from tapewell.sources.tables import Tables


def targets_of(spark, runs=3, days=40):
    rnd = random.Random(5)
    rows = [(r, d, s, rnd.random()) for r in range(runs) for d in range(days) for s in "abcd" if rnd.random() < 0.4]
    return rows, spark.createDataFrame([(r, d, s, w) for r, d, s, w in rows], "run_id long, d int, symbol string, weight double").select(
        "run_id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("day"), "symbol", "weight")


def test_books_and_paths_equal_a_plain_loop(spark):
    rows, df = targets_of(spark)
    returns = df.select("symbol", "day").distinct().withColumn("ret", F.lit(0.01))
    got = pf.rollout(df.repartition(5), returns, 10.0)
    have = {(r.run_id, r.step, r.symbol): (round(r.weight, 12), round(r.prev_weight, 12), r.held) for r in pf.positions(got).collect()}
    want, figures = {}, {}
    for run in sorted({r[0] for r in rows}):
        held = {}
        for step, day in enumerate(sorted({d for r, d, _, _ in rows if r == run})):
            now = {s: w for r, d, s, w in rows if (r, d) == (run, day)} if step else {}
            for s in now.keys() | held.keys():
                want[run, step, s] = (round(now.get(s, 0.0), 12), round(held.get(s, 0.0), 12), s in now)
            figures[run, step] = sum(abs(now.get(s, 0.0) - held.get(s, 0.0)) for s in now.keys() | held.keys()), sum(now.values())
            held = now
    assert have == want
    assert {(r.run_id, r.step): (pytest.approx(r.turnover), pytest.approx(r.exposure)) for r in got.collect()} == figures
    a = mt.constraints(pf.positions(got), pf.RiskLimits(max_weight=0.5, exposure_cap=0.9, max_turnover=0.8))
    b = mt.path_constraints(got, pf.RiskLimits(max_weight=0.5, exposure_cap=0.9, max_turnover=0.8))
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and b.filter("constraint_violations_count > 0").count() > 0


def test_quantiles_beside_rows_equal_the_joined_ones(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 11 != 0, F.col("id") * 37 % 101 / 7.0).alias("v"))
    probs = {"a": 0.33, "b": 0.5, "c": 0.95}
    beside = quantiles_beside(df, ["k"], "v", probs).select("k", *probs).distinct()
    assert sorted(beside.collect()) == sorted(quantiles(df, ["k"], "v", probs).select("k", *probs).collect())


@pytest.mark.parametrize("each", [True, False])
def test_quality_of_large_runs_equals_that_of_small_ones(spark, each):
    n = F.col("id")
    lines = spark.range(0, 600).select(
        (n % 3 + F.when(n < 450, 0).otherwise(1)).alias("run_id"), n.cast("string").alias("order_id"), F.element_at(F.array(F.lit("x"), F.lit("y")), (n % 2 + 1).cast("int")).alias("bucket"),
        (n % 9 + 1).cast("double").alias("qty"), (n % 7 == 0).alias("rejected"), F.when((n % 7 != 0) & (n % 5 != 0), (n % 9 + 1) / F.when(n % 4 == 0, 2.0).otherwise(1.0)).alias("filled"),
        (100 + n * 13 % 17).cast("double").alias("price"), F.lit(105.0).alias("reference"), F.lit("buy").alias("side"), (n / 10).alias("fees"))
    fills = lines.filter("filled is not null").select("run_id", "order_id", F.col("filled").alias("qty"), "price", "reference", "side", "fees", "bucket")
    known = ex.execution_quality(lines.select("run_id", "order_id", "qty", "rejected", "bucket"), fills)

    def rows(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(known.columns)).filter("true" if each else "bucket = 'all'").collect())

    assert rows(known) == rows(ex.line_quality(lines, each=each)) == rows(ex.line_quality(lines, each=each, limit=150))
    more = lines.select("run_id").unionByName(lines.filter("run_id = 1").select("run_id"))  # lines that a join has dropped, say
    assert rows(known) == rows(ex.line_quality(lines, each=each, limit=150, sized=more))


def explained(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def moved(df):
    """Column lists of the rows that a query's exchanges move."""
    text = explained(df)
    return [[c.split("#")[0].strip() for c in cols.split(",")] for cols in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)]


def test_turnovers_alone_come_together_for_their_quantiles(spark):
    """Before: every column of the trading figures, 7 of them."""
    _, df = targets_of(spark)
    df = df.withColumn("run_id", F.when(F.col("run_id") > 0, F.col("run_id")))  # a run without a number stays one
    path = pf.rollout(df, df.select("symbol", "day").distinct().withColumn("ret", F.lit(0.01)))
    got = mt.trading(path)
    assert [len(cols) for cols in moved(got) if "_t" in cols] == [2]
    want = path.groupBy("run_id").agg(F.expr("percentile(if(step > 0, turnover, null), 0.95)").alias("p95"), F.avg("hhi").alias("hhi"))
    rows = {r.run_id: (pytest.approx(r.p95), pytest.approx(r.hhi)) for r in want.collect()}
    assert len(rows) == 3 and {r.run_id: (r.turnover_1d_p95, r.hhi_mean) for r in got.collect()} == rows


def test_daily_returns_move_the_close_alone(spark):
    """Before: open, high, low and volume too, and the keys of a line twice."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = Tables(spark, "/root/testdata/sf0.001")
        joined = [cols for cols in moved(t.bars_d().select("symbol", "ts", "close")) if "l_orderkey" in cols or "tick" in cols]
        assert joined and all("tick" not in cols and "l_quantity" not in cols for cols in joined)
        assert q_port.day_returns(t).count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_capped_runs_do_not_depend_on_batches(spark):
    _, df = targets_of(spark, runs=9)
    weights = pf.positions(pf.rollout(df, df.select("symbol", "day").distinct().withColumn("ret", F.lit(0.0)))).filter("held")
    limits = pf.RiskLimits(max_weight=0.6, exposure_cap=0.8, max_turnover=0.2)
    found = []
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted((r.run_id, r.step, r.symbol, round(r.weight, 12)) for r in pf.cap_turnover(weights, limits).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and len(found[0]) > 500


@pytest.mark.parametrize("name, tables", [("a29_regime_slices", 4), ("t06_risk_checks", 4), ("t03_turnover_cap", 3), ("t10_mode_rule", 4), ("t14_regression_gates", 6)])
def test_step_tables_of_runs(spark, name, tables):
    """Before: a29 8, t06 5, t14 11; not counted for t03 and t10."""
    catalog.load()
    with job(spark) as written:
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        assert len(written) <= tables


def test_capped_runs_do_not_depend_on_how_many_rows_are_held(spark, monkeypatch):
    """Before: each batch was a matrix of its own."""
    _, df = targets_of(spark, runs=9)
    weights = pf.positions(pf.rollout(df, df.select("symbol", "day").distinct().withColumn("ret", F.lit(0.0)))).filter("held")
    limits = pf.RiskLimits(max_weight=0.6, exposure_cap=0.8, max_turnover=0.2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    found = []
    try:
        for rows in (1, 40, 65_536):
            monkeypatch.setattr(pf, "HELD_ROWS", rows)
            found.append(sorted((r.run_id, r.step, r.symbol, round(r.weight, 12)) for r in pf.cap_turnover(weights, limits).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2] and len(found[0]) > 500


def test_capped_weights_are_rounded_without_decimals(spark):
    """Before: a decimal per row and rounding."""
    catalog.load()
    with job(spark):
        plan = explained(catalog.QUERIES["t03_turnover_cap"](spark, "/root/testdata/sf0.001"))
    assert "rint" in plan.lower() and not re.search(r"round\([^()]*, 12\)", plan)


def test_a_path_orders_its_rows_once_and_moves_them_once(spark):
    """Before: rows were doubled to be taken off a step later, and put in order by run, by symbol and by step."""
    _, df = targets_of(spark)
    returns = df.select("symbol", "day").distinct().withColumn("ret", F.lit(0.01))
    plans = []

    def seen(path):
        plans.append(explained(path))
        return path

    with pytest.MonkeyPatch.context() as m:
        m.setattr(pf, "checkpointed", seen)
        pf.rollout(df.repartition("run_id"), F.broadcast(returns))
    assert "Generate" not in plans[0] and len(re.findall(r"\) Sort\nInput", plans[0])) <= 2
    assert len([cols for cols in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plans[0]) if "run_id" in cols]) == 1


def test_books_of_null_symbols_and_gaps(spark):
    """A symbol without a name links to no step before; a null weight is held as 0 and isn't taken off."""
    d = [("2024-01-01", "a", 0.3), ("2024-01-02", "a", 0.2), ("2024-01-02", None, 0.1), ("2024-01-03", None, 0.4), ("2024-01-03", "b", None), ("2024-01-04", "c", -0.2)]
    df = spark.createDataFrame([(1, day, s, w) for day, s, w in d], "run_id long, day string, symbol string, weight double").withColumn("day", F.col("day").cast("date"))
    path = pf.rollout(df, df.select("symbol", "day").distinct().withColumn("ret", F.lit(0.01)))
    have = sorted(((r.step, r.symbol or "", r.weight, r.prev_weight, r.held) for r in pf.positions(path).collect()))
    assert have == [
        (1, "", 0.1, 0.0, True), (1, "a", 0.2, 0.0, True), (2, "", 0.0, 0.1, False), (2, "", 0.4, 0.0, True), (2, "a", 0.0, 0.2, False), (2, "b", 0.0, 0.0, True),
        (3, "", 0.0, 0.4, False), (3, "c", -0.2, 0.0, True)]
    rows = {r.step: r for r in path.collect()}
    assert rows[2].turnover == pytest.approx(0.7) and rows[3].turnover == pytest.approx(0.6) and rows[3].max_weight == 0.0


def test_closes_equal_those_of_the_bars(spark, tmp_path):
    """Orders of several lines a day, of one number in two places, and without a number."""
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1, 2, 3, 2**62]), rnd.choice([None, 1, 2]), rnd.randrange(6), k, rnd.choice([0.0, 1.0, 2.0]), float(k), None) for k in range(300)]
    lines = spark.createDataFrame(rows, line).withColumn("l_shipdate", F.when(F.col("l_suppkey") % 7 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_suppkey") % 7).cast("int"))).cast("timestamp"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, [None, "A", "B"][k % 3]) for k in range(6)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    t = Tables(spark, str(tmp_path))
    a, b = t.bars_d().select("symbol", "ts", "close"), t.closes_d().select("symbol", "ts", "close")
    assert a.count() > 15 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
