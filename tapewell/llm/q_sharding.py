from pyspark.sql import functions as F

from tapewell.llm import sharding
from tapewell.llm.queries import query, table


@query("op5_external_shuffle")
def op5_external_shuffle(spark, sf_dir):
    out = sharding.external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
