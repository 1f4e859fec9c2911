from tapewell.llm import quality
from tapewell.llm.queries import query, table


@query("op2_quality_classifier")
def op2_quality_classifier(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(documents, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
