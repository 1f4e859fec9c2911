import public_tokenizers
from pyspark.sql import functions as F

from tapewell.llm import bpe
from tapewell.llm.queries import query, table


@query("op8_bpe_automaton")
def op8_bpe_automaton(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(documents, path).drop("text")
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
