from pyspark.sql import functions as F

from tapewell.llm import substring
from tapewell.llm.queries import query, table


@query("op3_substring_dedup")
def op3_substring_dedup(spark, sf_dir):
    out = substring.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
