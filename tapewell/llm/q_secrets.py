from pyspark.sql import functions as F

from tapewell.llm import secrets
from tapewell.llm.queries import query, table


@query("op7_secret_scan")
def op7_secret_scan(spark, sf_dir):
    out = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
    )
