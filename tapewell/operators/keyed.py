"""Ordered work per key that holds when one key owns a large share of the rows.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends a whole key to one task.  Here every key is
cut into chunks of a fixed number of consecutive rows:

* ``ordinal``   gives each row its exact position within its key (counts per time bucket, prefix
                sums over the small bucket table, ``row_number`` inside a bucket only);
* ``rolling``   evaluates bounded ROWS frames per chunk, with the neighbouring rows copied in;
* ``running``   evaluates unbounded-preceding frames as local scan + carry of earlier chunks;
* ``quantiles`` finds exact interpolated quantiles by counting into buckets that the data split;
* ``quantiles_beside`` gives them beside each row where a key is small;
* ``keep_best`` picks one row per key with a partial aggregate instead of a ranked window.

All results equal those of the plain windows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, WindowSpec
from pyspark.sql import functions as F

from tapewell.session import checkpointed

CHUNK_CONF = "spark.tapewell.chunk.rows"
CHUNK_ROWS = 131_072
BUCKET_ROWS = 8_192

RN = "_rn"

Exprs = Mapping[str, Column]


def chunk_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(CHUNK_CONF, str(CHUNK_ROWS)))


def time_bucket(ts: Column | str, step_seconds: int) -> Column:
    """Bucket number of a timestamp: at most ``BUCKET_ROWS`` grid points of ``step_seconds`` each."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_timestamp(col.cast("timestamp")) / (step_seconds * BUCKET_ROWS))


def step_bucket(step: Column | str) -> Column:
    col = F.col(step) if isinstance(step, str) else step
    return F.floor(col / BUCKET_ROWS)


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, *, stored: bool = False) -> DataFrame:
    """Add ``_rn``, the 1-based position of each row within its key.

    ``bucket`` must not decrease along ``order``; it spreads one key over many tasks.  ``stored``: ``df`` is a step table
    or as cheap to read, so its buckets are counted from it instead of from numbered rows written out once more.
    """
    keys = list(keys)
    local = Window.partitionBy(*keys, "_ord_b").orderBy(*order)
    placed = df.withColumn("_ord_b", bucket)
    numbered = placed.withColumn("_ord_lr", F.row_number().over(local))
    if not stored:
        placed = numbered = checkpointed(numbered)
    sizes = placed.groupBy(*keys, "_ord_b").agg(F.count(F.lit(1)).alias("_ord_n"))
    before = Window.partitionBy(*keys).orderBy("_ord_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_ord_b", F.coalesce(F.sum("_ord_n").over(before), F.lit(0)).alias("_ord_start"))
    return (
        numbered.join(starts, [*keys, "_ord_b"])
        .withColumn(RN, F.col("_ord_start") + F.col("_ord_lr"))
        .drop("_ord_b", "_ord_lr", "_ord_start")
    )


def _home(rows: int) -> Column:
    return F.floor((F.col(RN) - 1) / rows)


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    *stages: Callable[[Callable[[int, int], WindowSpec], WindowSpec], Exprs],
    back: int = 0,
    fwd: int = 0,
) -> DataFrame:
    """Add columns computed from the ``back`` rows before and ``fwd`` rows after each row.

    Each stage gets ``(frame, w)``: ``frame(lo, hi)`` is a ROWS frame, ``w`` the bare ordered window
    for lag and lead.  Later stages may use columns of earlier ones; ``back`` and ``fwd`` must cover
    the sum of what the stages reach for.
    """
    rows = max(chunk_rows(df), back + fwd + 1)
    home, pos = _home(rows), (F.col(RN) - 1) % rows
    copies = [home]
    if back:
        copies.append(F.when(pos >= rows - back, home + 1))
    if fwd:
        copies.append(F.when((pos < fwd) & (home > 0), home - 1))
    out = df.withColumn("_chunk", F.explode(F.array_compact(F.array(*copies))))
    w = Window.partitionBy(*keys, "_chunk").orderBy(RN)

    def frame(lo: int, hi: int) -> WindowSpec:
        return w.rowsBetween(lo, hi)

    for stage in stages:
        out = out.withColumns(dict(stage(frame, w)))
    return out.filter(F.col("_chunk") == home).drop("_chunk")


_LOCAL = {"sum": F.sum, "max": F.max, "min": F.min, "product": F.product, "count": F.count}


def _total(kind: str, col: str) -> Column:
    if kind == "last":
        return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(RN)))
    return _LOCAL[kind](col)


def _scan(kind: str, col: str, w: WindowSpec) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True).over(w)
    return _LOCAL[kind](col).over(w)


def _merge(kind: str, carry: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(carry + here)
    if kind == "product":
        return F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(carry * here)
    if kind == "max":
        return F.greatest(carry, here)
    if kind == "min":
        return F.least(carry, here)
    return F.coalesce(here, carry)


def running(df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add running (unbounded preceding .. current row) ``{out: (kind, column)}`` columns.

    Kinds: sum, count, max, min, product, last (last non-null).  Only one row per chunk is carried
    between chunks.  ``df`` is read twice, so pass something already checkpointed or cheap.
    """
    keys = list(keys)
    rows = chunk_rows(df)
    chunked = df.withColumn("_chunk", _home(rows))
    totals = chunked.groupBy(*keys, "_chunk").agg(*[_total(k, c).alias(f"_t_{o}") for o, (k, c) in specs.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry_kind = {"count": "sum"}
    carries = []
    for out, (kind, _) in specs.items():
        if kind == "last":
            carries.append(F.last(f"_t_{out}", ignorenulls=True).over(before).alias(f"_c_{out}"))
        else:
            carries.append(_LOCAL[carry_kind.get(kind, kind)](f"_t_{out}").over(before).alias(f"_c_{out}"))
    carried = totals.select(*keys, "_chunk", *carries)
    here = Window.partitionBy(*keys, "_chunk").orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
    scanned = chunked.withColumns({f"_l_{o}": _scan(k, c, here) for o, (k, c) in specs.items()})
    joined = scanned.join(carried, [*keys, "_chunk"], "left")
    out = joined.withColumns({o: _merge(k, F.col(f"_c_{o}"), F.col(f"_l_{o}")) for o, (k, _) in specs.items()})
    return out.drop("_chunk", *[f"_{p}_{o}" for o in specs for p in ("c", "l")])


def drawdown(df: DataFrame, keys: Sequence[str], growth: str, *, seed: float | None = None) -> DataFrame:
    """Add ``equity`` (running product of ``growth``), ``peak`` and ``drawdown`` = equity/peak - 1.

    ``seed`` is a floor under the peak (1.0 = the curve starts at 1).  Both scans are carried in one
    pass, since the peak of a later chunk is its local peak times the product before it.
    """
    keys = list(keys)
    rows = chunk_rows(df)
    here = Window.partitionBy(*keys, "_chunk").orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_chunk", _home(rows)).withColumn("_le", F.product(growth).over(here))
    local = local.withColumn("_lp", F.max("_le").over(here))
    totals = local.groupBy(*keys, "_chunk").agg(
        F.max_by("_le", RN).alias("_te"), F.max("_le").alias("_tp"),
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    step = totals.withColumn("_ce", F.coalesce(F.product("_te").over(before), F.lit(1.0)))
    step = step.withColumn("_cp", F.max(F.col("_ce") * F.col("_tp")).over(before))
    joined = local.join(step.select(*keys, "_chunk", "_ce", "_cp"), [*keys, "_chunk"])
    tops = [F.col("_cp"), F.col("_ce") * F.col("_lp")]
    if seed is not None:
        tops.append(F.lit(float(seed)))
    return (
        joined.withColumn("equity", F.col("_ce") * F.col("_le"))
        .withColumn("peak", F.greatest(*tops))
        .withColumn("drawdown", F.try_divide(F.col("equity"), F.col("peak")) - 1.0)
        .drop("_chunk", "_le", "_lp", "_ce", "_cp")
    )


_K = 2_097_152
_PER_OCTAVE = 1024


def value_bucket(v: Column) -> Column:
    """A bucket number that grows with ``v``: 1024 buckets per factor of two, either sign."""
    mag = _K + F.floor(F.log2(F.abs(v)) * _PER_OCTAVE)
    return F.when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0)).cast("bigint")


SORT_ROWS = 65_536
SPLITS = 1_024


def rank_buckets(
    counted: DataFrame, keys: Sequence[str], value: str, weight: str, holds: Callable[[Column, Column, Column, Column], Column], limit: int = SORT_ROWS,
) -> DataFrame:
    """Rows of the value buckets that hold a wanted rank, with bucket names ``_p``, ``_b``, the weight ``_start`` before the
    bucket and the key's ``_total``.

    ``counted`` has one row per key and value, and is read several times.  ``holds(start, size, total, last)`` tells
    whether a bucket is wanted; ``last`` marks the last one of those it was split from.  Buckets begin with value ranges;
    a wanted one of more than ``limit`` values is split evenly between its own least and greatest value, until none is
    left.  A range of doubles is spent after six such splits.
    """
    keys = list(keys)
    rows = counted.withColumns({"_p": F.lit(""), "_b": value_bucket(F.col(value)), "_from": F.lit(0)})
    totals = F.sum("_n").over(Window.partitionBy(*keys))
    while True:
        held = [] if "_total" not in rows.columns else [F.max("_total").alias("_total")]
        sizes = rows.groupBy(*keys, "_p", "_b").agg(
            F.sum(weight).alias("_n"), F.count(F.lit(1)).alias("_rows"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.max("_from").alias("_from"), *held)
        order = Window.partitionBy(*keys, "_p").orderBy("_b")
        start = F.col("_from") + F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes = sizes.select(
            *keys, "_p", "_b", "_n", "_rows", "_lo", "_hi", start.alias("_start"), F.lead("_b").over(order).isNull().alias("_last"), "_total" if held else totals.alias("_total"))
        seen = Observation()
        wanted = sizes.filter(holds(F.col("_start"), F.col("_n"), F.col("_total"), F.col("_last"))).drop("_n", "_last")
        wanted = checkpointed(wanted.observe(seen, F.count_if(F.col("_rows") > limit).alias("large")))
        rows = rows.drop("_from", "_total").join(wanted, [*keys, "_p", "_b"])
        if not seen.get["large"]:
            return rows.drop("_rows", "_lo", "_hi")
        part = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SPLITS)
        rows = checkpointed(rows.select(
            *counted.columns, F.concat_ws("/", "_p", "_b").alias("_p"), F.when(F.col("_rows") > limit, F.least(part, F.lit(SPLITS - 1))).otherwise(0).cast("bigint").alias("_b"),
            F.col("_start").alias("_from"), "_total"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], limit: int = SORT_ROWS) -> DataFrame:
    """One row per key with exact linearly interpolated quantiles ``{name: p}`` of ``value``.

    Equal values are counted together first; buckets split by the data locate the wanted ranks; only the rows of the
    buckets that hold one are ordered, ``limit`` of them at most.
    """
    keys = list(keys)
    counted = checkpointed(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_q_v"))
        .agg(F.count(F.lit(1)).alias("_q_n"))
    )

    def ranks(total: Column) -> dict[str, tuple[Column, Column, Column]]:
        at = {name: F.lit(float(p)) * (total - 1) for name, p in probs.items()}
        return {name: (F.floor(a), F.ceil(a), a - F.floor(a)) for name, a in at.items()}

    def holds(start: Column, size: Column, total: Column, last: Column) -> Column:
        hit = F.lit(False)
        for lo, hi, _ in ranks(total).values():
            for r in (lo, hi):
                hit = hit | ((r >= start) & (r < start + size))
        return hit

    inside = Window.partitionBy(*keys, "_p", "_b").orderBy("_q_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rank_buckets(counted, keys, "_q_v", "_q_n", holds, limit).withColumn("_q_hi", F.col("_start") + F.sum("_q_n").over(inside))
    rows = rows.withColumn("_q_lo", F.col("_q_hi") - F.col("_q_n"))
    picks = []
    for name, (lo, hi, frac) in ranks(F.col("_total")).items():
        picks.append(F.min(F.when((lo >= F.col("_q_lo")) & (lo < F.col("_q_hi")), F.col("_q_v"))).alias(f"_a_{name}"))
        picks.append(F.min(F.when((hi >= F.col("_q_lo")) & (hi < F.col("_q_hi")), F.col("_q_v"))).alias(f"_z_{name}"))
        picks.append(F.max(frac).alias(f"_f_{name}"))
    found = rows.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"_a_{n}") + (F.col(f"_z_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probs
        ],
    )


def quantiles_beside(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Each row with the exact interpolated quantiles ``{name: p}`` of its key, for keys of bounded size (a row per day):
    windows of one partitioning, so rows that already lie by some of ``keys`` aren't moved."""
    whole = Window.partitionBy(*keys)
    at = {name: F.lit(float(p)) * (F.col("_q_c") - 1) for name, p in probs.items()}
    out = df.withColumns({"_q_r": F.row_number().over(whole.orderBy(F.col(value).asc_nulls_last())) - 1, "_q_c": F.count(value).over(whole)})
    out = out.withColumns({f"_{end}_{n}": F.max(F.when(F.col("_q_r") == to(a), F.col(value).cast("double"))).over(whole) for n, a in at.items() for end, to in (("a", F.floor), ("z", F.ceil))})
    found = {n: F.col(f"_a_{n}") + (F.col(f"_z_{n}") - F.col(f"_a_{n}")) * (a - F.floor(a)) for n, a in at.items()}
    return out.withColumns(found).drop("_q_r", "_q_c", *[f"_{end}_{n}" for n in probs for end in "az"])


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], *, first: bool = False) -> DataFrame:
    """One row per key: the one with the greatest (``first``: smallest) order tuple.

    Runs as a partial aggregate, so a key with very many copies is reduced before the shuffle.
    Nulls in the order tuple count as smallest.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def asof_backward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str], step_seconds: int,
    right_tie: Sequence[str] = (),
) -> DataFrame:
    """For each left row attach the ``values`` of the latest right row with ``right_ts <= left_ts``.

    Both sides are merged into one ordered stream per key and the last right row is carried forward;
    a right row at the same instant counts as known.  ``right_tie`` orders right rows of one instant.
    """
    keys = list(keys)
    lcols = [c for c in left.columns if c not in keys]
    tie = F.struct(*right_tie) if right_tie else F.lit(0)
    a = left.select(*keys, F.col(left_ts).cast("timestamp").alias("_t"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_left"))
    b = keep_best(
        right.select(*keys, F.col(right_ts).cast("timestamp").alias("_t"), F.struct(*values).alias("_right"), tie.alias("_tie"))
        .filter(F.col("_t").isNotNull()),
        [*keys, "_t"], ["_tie"],
    ).drop("_tie").withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    placed = ordinal(both, keys, ["_t", "_side"], time_bucket("_t", step_seconds))
    carried = running(placed, keys, {"_known": ("last", "_right")})
    return carried.filter(F.col("_side") == 1).select(*keys, "_left.*", *[F.col(f"_known.{v}").alias(v) for v in values])
