"""Quote levels, links and reply order."""

import duckdb
from pyspark.sql import functions as F

from tapewell.llm import q_quotes, quotes

SF = "/root/testdata/sf0.01"
M = "conv_id long, turn long, role string, text string"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    rel = con.execute(q_quotes.ORACLE)
    names = [d[0] for d in rel.description]
    want = sorted(rel.fetchall(), key=repr)
    df = q_quotes.op4_quotation_linking(spark, SF)
    got = sorted((tuple(r) for r in df.select(names).collect()), key=repr)
    assert got == want and len(got) > 300
    assert max(r[2] for r in got) > 2


def test_levels(spark):
    text = "> a\n>b\n>> c\n> > d\n\n>>\nown one\n   > e\nown >two\n>f"
    row = spark.createDataFrame([(text,)], "t string").select(quotes.passages(F.col("t")).alias("p")).first()
    assert [(p.level, p.text) for p in row.p] == [(1, "a\nb"), (2, "c\nd"), (0, "own one"), (1, "e"), (0, "own >two"), (1, "f")]


def test_links_by_normal_form_and_out_of_order_replies(spark):
    rows = [(1, 0, "user", "How do I, then?\nSecond line"), (1, 1, "user", "Other topic!"), (1, 2, "bot", "> how do i then\n> second   line\nLike this."),
            (1, 3, "bot", "> OTHER topic\nNo."), (1, 4, "user", ">> Other topic!\n> No.\nWhy?"), (1, 5, "user", "> never said\nHm"), (2, 0, "user", "> No.\nQuote of another conversation")]
    got = {(r.conv_id, r.turn): (r.reply_to, r.root, r.depth, r.n_quotes, r.n_linked, r.text) for r in quotes.conversations(spark.createDataFrame(rows, M)).collect()}
    assert got[1, 2] == (0, 0, 1, 1, 1, "Like this.")
    assert got[1, 3] == (1, 1, 1, 1, 1, "No.")
    assert got[1, 4] == (3, 1, 2, 2, 2, "Why?")
    assert got[1, 5] == (None, 5, 0, 1, 0, "Hm") and got[2, 0] == (None, 0, 0, 1, 0, "Quote of another conversation")


def test_odd_rows(spark):
    rows = [(1, 0, "u", None), (1, 1, "u", ""), (None, 0, "u", "> a\nb"), (1, None, "u", "x"), (1, 2, "u", "!!!"), (1, 3, "u", "> !!!\n>"), (1, 4, None, "a"), (1, 4, None, "a"), (1, 5, "u", "> a\n" * 2000 + "z"), (1, 6, "u", "> a\nq")]
    df = spark.createDataFrame([(*r, 7) for r in rows], M + ", depth int")
    out = quotes.conversations(df).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    assert by[1, 6].reply_to == 4 and by[1, 3].reply_to is None and by[None, 0].text == "b" and by[None, 0].root is None and by[1, 0].text == ""
    assert quotes.conversations(df.where("false")).count() == 0


def test_long_chain(spark):
    rows = [(1, 0, "u", "m0")] + [(1, k, "u", f"> m{k - 1}\nm{k}") for k in range(1, 100)]
    out = quotes.conversations(spark.createDataFrame(rows, M)).collect()
    assert sorted((r.depth, r.root) for r in out) == [(k, 0) for k in range(100)]
