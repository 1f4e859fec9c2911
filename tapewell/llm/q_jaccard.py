from tapewell.llm import jaccard
from tapewell.llm.queries import query, table


@query("op9_ngram_jaccard_join")
def op9_ngram_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))
