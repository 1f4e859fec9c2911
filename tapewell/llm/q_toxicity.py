from tapewell.llm import toxicity
from tapewell.llm.queries import query, table


@query("op10_toxicity_severity")
def op10_toxicity_severity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.severity(documents, table(spark, sf_dir, "labels")).drop("text")
