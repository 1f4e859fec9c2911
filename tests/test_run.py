"""Step tables of a run: written once, handed on, dropped at the end of the job."""

import os

from pyspark.sql import functions as F

from tapewell.operators.keyed import RN, ordinal, step_bucket
from tapewell.session import Run, checkpointed, job, step_table

calls = []


@step_table
def numbers(run):
    calls.append("numbers")
    return run.spark.range(100).withColumn("k", F.col("id") % 3)


@step_table
def totals(run):
    calls.append("totals")
    return numbers(run).groupBy("k").agg(F.sum("id").alias("total"))


class Held(Run):
    def __init__(self, spark):
        super().__init__()
        self.spark = spark


def local(path):
    return path.removeprefix("file:")


def test_step_tables_are_built_once_per_run_and_dropped_with_the_job(spark):
    calls.clear()
    with job(spark) as written:
        run = Held(spark)
        both = numbers(run).join(totals(run), "k").groupBy("k").agg(F.max("total").alias("t"), F.count("*").alias("n"))
        assert {(r.k, r.t, r.n) for r in both.collect()} == {(0, 1683, 34), (1, 1617, 33), (2, 1650, 33)}
        assert numbers(run) is numbers(run)
        assert calls == ["numbers", "totals"] and len(written) == 2
        assert all(os.path.isdir(local(p)) for p in written)
        numbers(Held(spark))
        assert calls == ["numbers", "totals", "numbers"] and len(written) == 3
    assert not any(os.path.exists(local(p)) for p in written)


def test_inner_jobs_drop_their_own_tables_only(spark):
    with job(spark) as outer:
        kept = checkpointed(spark.range(5))
        with job(spark) as inner:
            checkpointed(spark.range(3))
        assert len(outer) == len(inner) == 1 and not os.path.exists(local(inner[0]))
        assert kept.count() == 5


def test_a_failed_job_drops_its_tables_too(spark):
    try:
        with job(spark) as written:
            checkpointed(spark.range(3))
            raise RuntimeError("lost")
    except RuntimeError:
        pass
    assert len(written) == 1 and not os.path.exists(local(written[0]))


def test_stored_numbering_equals_the_written_one(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 % 20_011).alias("step"))
    rows = [{(r.k, r.step): r[RN] for r in ordinal(df, ["k"], ["step"], step_bucket("step"), stored=s).collect()} for s in (False, True)]
    assert rows[0] == rows[1] and sorted(v for (k, _), v in rows[0].items() if k == 0) == list(range(1, 10_001))
