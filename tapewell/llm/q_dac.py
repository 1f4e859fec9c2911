import public_tokenizers
from pyspark.sql import functions as F

from tapewell.llm import dac
from tapewell.llm.queries import query, table
from tapewell.session import scratch_path


@query("op11_token_file")
def op11_token_file(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    dac.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return dac.read(dac.read_segments(spark, path)).select(
        "doc_id",
        "start",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
