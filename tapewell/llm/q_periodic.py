from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewell.llm import periodic
from tapewell.llm.queries import query, table


def tiled(doc_id: Column, text: Column) -> Column:
    """The text; in one document of ten its words repeat from one place on, with a period that depends on the id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
    new = F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(new, " ")).otherwise(text)


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", tiled(F.col("doc_id"), F.col("text")).alias("text"))
    out = periodic.runs(documents)
    # The greatest length; of those the smallest start, then period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("fall"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    length = -F.col("best.fall")
    return out.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
