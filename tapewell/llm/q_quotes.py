from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewell.llm import quotes
from tapewell.llm.queries import query, table


def mail_threads(messages: DataFrame) -> DataFrame:
    """The conversations as a mail archive: from its third turn on, a message quotes the turn before it and, one level
    deeper, the turn before that; a second turn quotes the first."""
    m = messages.select("conv_id", "turn", "role", "text")
    quoted = lambda c, sign: F.regexp_replace(c, r"(?m)^", sign)
    one = m.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("one"))
    two = m.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("two"))
    j = m.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    parts = [F.when(F.col("one").isNotNull() & F.col("two").isNotNull(), quoted(F.col("two"), ">> ")), quoted(F.col("one"), "> "), F.col("text")]
    return j.select("conv_id", "turn", "role", F.concat_ws("\n", *parts).alias("text"))


ORACLE = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS norm,
         array_to_string(list_filter(string_split_regex(text, '\\r?\\n'), lambda s: trim(s, ' ') <> ''), chr(10)) AS own
  FROM conversations),
q AS (
  SELECT a.conv_id, a.turn, 1 AS level, b.norm FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE b.own <> ''
  UNION ALL
  SELECT a.conv_id, a.turn, 2, c.norm FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1
  JOIN m c ON a.conv_id = c.conv_id AND c.turn = a.turn - 2 WHERE c.own <> ''),
found AS (
  SELECT q.conv_id, q.turn, q.level, max(s.turn) AS source
  FROM q JOIN m s ON s.conv_id = q.conv_id AND s.norm = q.norm AND s.turn < q.turn AND q.norm <> '' GROUP BY ALL),
linked AS (
  SELECT m.conv_id, m.turn, m.role, m.own AS text,
         (SELECT count(*) FROM q WHERE q.conv_id = m.conv_id AND q.turn = m.turn) AS n_quotes,
         (SELECT count(*) FROM found f WHERE f.conv_id = m.conv_id AND f.turn = m.turn) AS n_linked,
         (SELECT arg_min(source, level) FROM found f WHERE f.conv_id = m.conv_id AND f.turn = m.turn) AS reply_to
  FROM m),
walk AS (
  SELECT conv_id, turn, turn AS root, CAST(0 AS BIGINT) AS depth FROM linked WHERE reply_to IS NULL
  UNION ALL
  SELECT l.conv_id, l.turn, w.root, w.depth + 1 FROM linked l JOIN walk w ON l.conv_id = w.conv_id AND l.reply_to = w.turn)
SELECT l.conv_id, w.root, w.depth, l.turn, l.role, l.reply_to, l.n_quotes, l.n_linked, l.text
FROM linked l JOIN walk w USING (conv_id, turn)
"""


@query("op4_quotation_linking", ORACLE)
def op4_quotation_linking(spark, sf_dir):
    return quotes.conversations(mail_threads(table(spark, sf_dir, "conversations")))
