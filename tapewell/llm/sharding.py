"""Two-pass external shuffle, in DataFrame functions only.

Pass one scatters whole records uniformly into buckets of a memory-sized share of the bytes, by a seeded hash of id and
text.  Pass two takes each bucket into memory, one bucket to a task, puts it into an order that depends on the records
alone and applies Spark's Fisher-Yates ``shuffle`` with the seed.  A record's place in the whole order is its bucket's
offset plus its place there; places are dealt to the shards in turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tapewell.session import checkpointed

BUCKET_BYTES = 8_000_000
SHARDS = 8


def external_shuffle(documents: DataFrame, shards: int = SHARDS, seed: int = 20, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``documents`` with ``bucket``, ``place`` (0 to rows - 1, in random order), ``shard`` and ``slot``.

    Law of the shards: row counts differ by one at most, and slots run from 0 without gaps.  The order is a function of
    ids, texts and the seed; rows alike in both are interchangeable and share a bucket.  Null ids and texts are values
    like others.  Columns named like the added ones are replaced;
    others may have any name and type, maps at the top level included.
    """
    documents = documents.drop("bucket", "place", "shard", "slot")
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    total = documents.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_bytes))
    maps = {f.name for f in documents.schema if isinstance(f.dataType, MapType)}  # have no order, their entries do
    fields = [(F.map_entries(F.col(f"`{c}`")) if c in maps else F.col(f"`{c}`")).alias(c) for c in documents.columns]
    # The record goes as one struct, so no column of it can clash.
    record = F.struct(F.xxhash64(F.lit(seed), "doc_id", "text").alias("hash"), F.struct(*fields).alias("doc"))
    hashed = documents.select(record.alias("r")).select(F.pmod("r.hash", F.lit(buckets)).cast("int").alias("bucket"), "r")
    counts = hashed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    # Written first, so that its size is known when the join is planned: records are shuffled again only beyond a broadcast.
    offsets = checkpointed(counts.select(F.col("bucket").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    held = hashed.repartitionById(buckets, F.col("bucket"))
    # A bucket is bucket_bytes of text on average, whatever the corpus: safe to hold.
    mixed = held.groupBy("bucket").agg(F.shuffle(F.array_sort(F.collect_list("r")), seed).alias("rs"))
    rows = mixed.select("bucket", F.posexplode("rs").alias("i", "r"))
    placed = rows.join(offsets, F.col("bucket") == F.col("of")).select("bucket", "r", (F.col("offset") + F.col("i")).alias("place"))
    doc = F.col("r.doc")
    columns = [(F.map_from_entries(doc[c]) if c in maps else doc[c]).alias(c) for c in documents.columns]
    return placed.select(*columns, "bucket", "place", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def write_shards(documents: DataFrame, path: str, **options) -> None:
    """Write the shuffled records, a folder per shard; files of a folder hold their records in slot order."""
    out = external_shuffle(documents, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
