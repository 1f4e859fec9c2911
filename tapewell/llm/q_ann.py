from tapewell.llm import ann
from tapewell.llm.queries import query, table


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where("vec_id % 50 = 0"))
