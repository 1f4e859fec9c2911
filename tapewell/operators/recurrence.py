"""Path-dependent work per key, in bounded chunks that run side by side.

A step whose result depends on the previous result cannot be a window expression.  Every key is cut
into chunks of consecutive rows.  All chunks first run from a guessed state; then each chunk whose
predecessor ended in another state than guessed runs again, until nothing changes.  Rules that forget
their past (a reached target, an expired hold) settle after one or two rounds, and no group is larger
than a chunk.  The result is that of the plain loop in every case.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewell.operators.keyed import RN
from tapewell.session import checkpointed

CHAIN_CONF = "spark.tapewell.chain.rows"
CHAIN_ROWS = 16_384

Step = Callable[[str, pd.DataFrame], tuple[pd.DataFrame, str]]


def chain(df: DataFrame, keys: Sequence[str], step: Step, start: str, schema: str) -> DataFrame:
    """Run ``step(state, rows) -> (output rows, state)`` along ``_rn`` within each key.

    ``rows`` is one chunk in order, states are strings, ``schema`` describes the output rows.
    """
    keys = list(keys)
    size = int(df.sparkSession.conf.get(CHAIN_CONF, str(CHAIN_ROWS)))
    rows = checkpointed(df.withColumn("_chunk", F.floor((F.col(RN) - 1) / size)))
    key_fields = [rows.schema[k] for k in [*keys, "_chunk"]]
    ends_schema = T.StructType([*key_fields, T.StructField("_end", T.StringType())])
    group = [*keys, "_chunk"]

    def last_state(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(RN, kind="mergesort")
        _, state = step(pdf["_state"].iloc[0], pdf)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in group}, "_end": [state]})

    def output(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(RN, kind="mergesort")
        return step(pdf["_state"].iloc[0], pdf)[0]

    states = rows.select(*group).distinct().withColumn("_state", F.lit(start))
    if rows.select(F.max("_chunk")).first()[0]:
        before = Window.partitionBy(*keys).orderBy("_chunk")
        todo, ends = states, None
        while True:
            ran = rows.join(todo, group).groupBy(*group).applyInPandas(last_state, ends_schema)
            if ends is not None:
                ran = ran.unionByName(ends.join(todo.select(*group), group, "left_anti"))
            ends = checkpointed(ran)
            nxt = ends.select(*group, F.coalesce(F.lag("_end").over(before), F.lit(start)).alias("_new"))
            moved = states.join(nxt, group)
            todo = moved.filter(F.col("_state") != F.col("_new")).select(*group, F.col("_new").alias("_state"))
            states = checkpointed(moved.select(*group, F.col("_new").alias("_state")))
            todo = checkpointed(todo)
            if todo.isEmpty():
                break
    return rows.join(states, group).groupBy(*group).applyInPandas(output, schema)
