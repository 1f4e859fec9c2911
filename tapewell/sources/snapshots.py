"""Tables of hash buckets behind a snapshot: an upsert rewrites the buckets it touches and nothing else.

``data/<id>/bucket=<n>`` holds rows, ``snapshots/<version>`` lists for each bucket its folder, row count and digest parts.
A writer puts new folders beside the old ones and makes them visible by one rename of a finished snapshot; a job lost before
that leaves the table as it was.  Writers of one table take turns; a second one with the same version fails.

Digest parts (count, xor and sum of row hashes) add up, so a table's digest comes from its snapshot, and an upsert hashes
only what it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tapewell.operators.health import combine_digests, digest_parts, row_text
from tapewell.session import checkpointed, files

BUCKETS = 64
_FIELDS = "bucket int, folder string, rows long, x long, s decimal(38,0), buckets int"

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def latest(spark: SparkSession, path: str) -> int | None:
    """The newest version of the table; None if there is none."""
    fs, make = files(spark, path)
    folder = make(f"{path}/snapshots")
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=None)


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    version = latest(spark, path) if version is None else version
    return None if version is None else spark.read.schema(_FIELDS).parquet(f"{path}/snapshots/{version}")


def read(spark: SparkSession, path: str, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """The table, or some of its buckets, with the columns of all its files; None if there is nothing."""
    listed = snapshot(spark, path, version)
    if listed is None:
        return None
    folders = [f"{path}/{r.folder}" for r in listed.collect() if buckets is None or r.bucket in buckets]  # one per bucket
    return spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None


def _all_fields(columns: Sequence[str]) -> Column:
    """A row's fields by name; nulls don't count, so a column that comes later leaves older rows' hashes alone."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]))


def upsert(incoming: DataFrame, path: str, key: str, merge: Merge, order: Sequence[str], digest: Sequence[str] | None = None, buckets: int = BUCKETS) -> int:
    """Merge ``incoming`` into the buckets of its keys and commit a new version, whose number is returned.

    ``merge(existing, incoming)`` gets the touched buckets' rows (None if there are none).  The number of buckets is fixed by
    the first write.  ``digest`` names the columns that are hashed; unset, all of them.
    """
    spark = incoming.sparkSession
    version = latest(spark, path)
    old = None if version is None else checkpointed(snapshot(spark, path, version))
    first = None if old is None else old.select("buckets").first()
    buckets = first.buckets if first else buckets
    home = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), F.lit(buckets)).cast("int")
    incoming = checkpointed(incoming)
    touched = [r[0] for r in incoming.select(home).distinct().collect()]
    merged = merge(None if old is None else read(spark, path, version, touched), incoming)
    name = f"data/{uuid.uuid4().hex}"
    rows = merged.withColumn("bucket", home)
    # the hint splits a bucket that holds very many rows over several files
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/{name}")
    text = row_text(digest) if digest else _all_fields(merged.columns)
    written = spark.read.schema(rows.schema).parquet(f"{path}/{name}")
    parts = digest_parts(written, text, ["bucket"]).select(
        "bucket", F.concat(F.lit(f"{name}/bucket="), F.col("bucket").cast("string")).alias("folder"), "rows", "x", "s", F.lit(buckets).alias("buckets"))
    if old is not None:
        parts = old.filter(~F.col("bucket").isin(touched)).unionByName(parts)
    return _commit(parts, path, 0 if version is None else version + 1)


def _commit(parts: DataFrame, path: str, version: int) -> int:
    spark = parts.sparkSession
    fs, make = files(spark, path)
    draft, final = make(f"{path}/drafts/{uuid.uuid4().hex}"), make(f"{path}/snapshots/{version}")
    parts.coalesce(1).write.parquet(draft.toString())  # a row per bucket
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"version {version} of {path} was written meanwhile")
    return version


def digest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(rows, digest) of the table, added up from its snapshot without reading a row."""
    return combine_digests(snapshot(spark, path, version))


def expire(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove all but the newest ``keep`` versions and the folders that only they name; the number of versions removed."""
    fs, make = files(spark, path)
    newest = latest(spark, path)
    if newest is None:
        return 0
    versions = sorted(int(s.getPath().getName()) for s in fs.listStatus(make(f"{path}/snapshots")) if s.getPath().getName().isdigit())
    gone, stay = versions[:-keep], versions[-keep:]
    named = {r.folder for v in stay for r in snapshot(spark, path, v).collect()}  # one per bucket and version
    lost = {r.folder for v in gone for r in snapshot(spark, path, v).collect()} - named
    for v in gone:
        fs.delete(make(f"{path}/snapshots/{v}"), True)
    for folder in lost:
        fs.delete(make(f"{path}/{folder}"), True)
    return len(gone)


def write_run(
    rows: DataFrame, write: Callable[[DataFrame], None], path: str, run_id: str, output: str, inputs: Sequence[str], day: str, vendors: Sequence[str],
) -> DataFrame:
    """Write ``rows`` and a manifest of what went by, with a lineage row per input; returns both, read back and joined.

    Counts, date range and vendor use are observed while ``write`` runs, so nothing is read again.  Manifest and lineage
    have a folder per run, which a repeated run replaces.
    """
    spark = rows.sparkSession
    seen = Observation(f"run-{uuid.uuid4().hex}")
    write(rows.observe(
        seen, F.count(F.lit(1)).alias("records"), F.min(F.col(day).cast("string")).alias("start_date"), F.max(F.col(day).cast("string")).alias("end_date"),
        *[F.count_if(F.col("vendor") == v).alias(f"records_{v}") for v in vendors]))
    got = seen.get
    fields = "run_id string, output string, records long, start_date string, end_date string, " + ", ".join(f"records_{v} long" for v in vendors)
    row = (run_id, output, got["records"], got["start_date"], got["end_date"], *[got[f"records_{v}"] for v in vendors])
    spark.createDataFrame([row], fields).write.mode("overwrite").parquet(f"{path}/manifests/run={run_id}")
    spark.createDataFrame([(run_id, i, output) for i in inputs], "run_id string, input string, output string").write.mode("overwrite").parquet(f"{path}/lineage/run={run_id}")
    manifest = spark.read.schema(fields).parquet(f"{path}/manifests/run={run_id}")
    return manifest.join(spark.read.schema("run_id string, input string, output string").parquet(f"{path}/lineage/run={run_id}"), ["run_id", "output"])
