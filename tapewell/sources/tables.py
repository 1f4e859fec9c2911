"""Views of the given tables as market data: bars, vendors, options, filings, insiders, fills, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewell.session import Run, checkpointed

HOUR = 3_600
DAY = 86_400


class Tables(Run):
    """Lazy access to one data folder, each property an unread scan, with the step tables of one run."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__()
        self.spark = spark
        self.root = root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def ticks(self) -> DataFrame:
        """events as trades: symbol, ts, id, price."""
        return self.events.select(
            F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_id").alias("id"), F.col("value").alias("price"), "user_id",
        )

    def bars_h(self) -> DataFrame:
        """Hourly bars of the five event types."""
        t = self.ticks().withColumn("tick", F.struct("ts", "id"))
        return (
            t.groupBy("symbol", F.date_trunc("hour", "ts").alias("ts"))
            .agg(
                F.min_by("price", "tick").alias("open"), F.max("price").alias("high"),
                F.min("price").alias("low"), F.max_by("price", "tick").alias("close"),
                F.count(F.lit(1)).cast("double").alias("volume"),
            )
        )

    def bars_d(self, *extra_keys: str) -> DataFrame:
        """Daily bars per brand from lineitem unit prices; days without trades are gaps."""
        part = self.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
        li = self.lineitem.select(
            "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("ts"),
            F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity"),
        )
        return (
            li.join(part, "l_partkey")
            .withColumn("tick", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))  # here, or the join moves its keys twice
            .withColumn("vendor", F.concat(F.lit("v"), (F.col("l_suppkey") % 3).cast("string")))
            .groupBy("symbol", "ts", *extra_keys)
            .agg(
                F.min_by("price", "tick").alias("open"), F.max("price").alias("high"),
                F.min("price").alias("low"), F.max_by("price", "tick").alias("close"),
                F.sum("l_quantity").alias("volume"),
            )
        )

    def closes_d(self) -> DataFrame:
        """The closes of ``bars_d`` alone.  A day's last order is a maximum, which is hashed where bars are sorted; only the lines of
        those orders, a few per symbol and day, are then compared as a whole."""
        part = self.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
        ts = F.col("l_shipdate").cast("timestamp").alias("ts")
        last = checkpointed(self.lineitem.select("l_partkey", "l_orderkey", ts).join(part, "l_partkey").groupBy("symbol", "ts").agg(F.max("l_orderkey").alias("_order")))
        li = self.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", ts.alias("_ts"), F.try_divide("l_extendedprice", "l_quantity").alias("price"))
        of = F.col("l_orderkey").eqNullSafe(F.col("_order")) & F.col("_ts").eqNullSafe(F.col("ts"))
        own = part.select(F.col("l_partkey").alias("_part"), F.col("symbol").alias("_symbol"))
        lines = li.join(last, of).join(own, (F.col("l_partkey") == F.col("_part")) & F.col("symbol").eqNullSafe(F.col("_symbol")))
        return lines.groupBy("symbol", "ts").agg(F.max_by("price", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("close"))

    def vendor_bars(self) -> DataFrame:
        """Daily bars kept apart by vendor (three vendors, v0 preferred)."""
        return self.bars_d("vendor")

    def option_reference(self) -> DataFrame:
        p = self.part
        return p.select(
            F.concat(F.lit("O:"), F.col("p_partkey").cast("string")).alias("option_symbol"),
            F.col("p_brand").alias("underlying"),
            F.when(F.col("p_size") % 7 == 0, F.lit(None).cast("string"))
            .when(F.col("p_size") % 2 == 0, "call").otherwise("put").alias("option_type"),
            F.col("p_retailprice").alias("strike"),
        )

    def option_interest(self) -> DataFrame:
        """Open interest and volume per contract and day, from lineitem quantities."""
        return (
            self.lineitem.groupBy(
                F.concat(F.lit("O:"), F.col("l_partkey").cast("string")).alias("option_symbol"),
                F.col("l_shipdate").cast("date").alias("date"),
            ).agg(F.sum("l_quantity").alias("open_interest"), F.count(F.lit(1)).cast("double").alias("volume"))
        )

    def filings(self) -> DataFrame:
        """Quarterly and annual statements per market segment, filed 45 or 90 days after the period."""
        o = self.orders.select(
            F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("d"), "o_totalprice", "o_orderstatus",
        )
        c = self.customer.select("c_custkey", F.col("c_mktsegment").alias("symbol"))
        facts = o.join(c, "c_custkey")

        def period(unit: str, label: str, lag: int) -> DataFrame:
            start = F.trunc("d", unit)
            months = 3 if unit == "quarter" else 12
            return (
                facts.groupBy("symbol", F.date_sub(F.add_months(start, months), 1).alias("report_date"))
                .agg(
                    F.sum("o_totalprice").alias("revenue"),
                    F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("net_income"),
                    F.count(F.lit(1)).cast("double").alias("total_assets"),
                )
                .withColumn("period", F.lit(label))
                .withColumn("filing_date", F.date_add("report_date", lag))
            )

        return period("quarter", "quarterly", 45).unionByName(period("year", "annual", 90))

    def insider_trades(self) -> DataFrame:
        """orders as insider transactions of the buyer's market segment."""
        o = self.orders.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("filing_date"),
            F.col("o_totalprice").alias("value"), "o_orderstatus", "o_orderpriority",
        )
        c = self.customer.select("c_custkey", F.col("c_mktsegment").alias("symbol"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
        return o.join(c, "c_custkey").select(
            "symbol", "id", "filing_date", "name", "value",
            F.when(F.col("o_orderstatus") == "F", -F.col("value")).otherwise(F.col("value")).alias("shares"),
            F.when(F.col("o_orderpriority").startswith("1"), "Chief Executive Officer (CEO)")
            .when(F.col("o_orderpriority").startswith("2"), "CFO")
            .when(F.col("o_orderpriority").startswith("3"), "COO").otherwise("Analyst").alias("title"),
            F.col("o_orderpriority").startswith("4").alias("is_board_director"),
            F.when(F.col("o_orderstatus") == "P", "Preferred").otherwise("Common Stock").alias("security_title"),
            (F.col("bal") + 1000.0).alias("before"), (F.col("bal") + 1000.0 + F.col("id") % 97).alias("after"),
        )

    def segment_bars(self) -> DataFrame:
        """Daily bars of the market segments, the equity side of filings and insider trades."""
        o = self.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey"), F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
        c = self.customer.select("c_custkey", F.col("c_mktsegment").alias("symbol"))
        return (
            o.join(c, "c_custkey").groupBy("symbol", "day")
            .agg(F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        )

    def fills(self) -> DataFrame:
        """lineitem as executions: supplier = run, ship date = step, part price = reference."""
        part = self.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"), F.col("p_retailprice").alias("reference"))
        li = self.lineitem.select(
            "l_partkey", F.col("l_suppkey").alias("run_id"), "l_orderkey", "l_linenumber",
            F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("qty"),
            F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_discount").alias("fee_rate"),
            F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"), F.col("l_returnflag").alias("bucket"), "l_tax",
        )
        return li.join(part, "l_partkey")

    def run_targets(self) -> DataFrame:
        """Weight proposals per run (supplier), day and symbol (brand), lying by run: what is left of it is a row per day and symbol."""
        w = self.fills().groupBy("run_id", "day", "symbol").agg(F.sum("qty").alias("raw")).repartition("run_id")
        # in the order that the path needs, so that it isn't put in another one before
        day = Window.partitionBy("run_id", "day").orderBy("symbol").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        total = F.sum("raw").over(day)
        return w.select("run_id", "day", "symbol", (F.col("raw") / (total + 25.0)).alias("weight"))
