from tapewell.llm import decontaminate
from tapewell.llm.queries import query, table


@query("op1_benchmark_decontamination")
def op1_benchmark_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
