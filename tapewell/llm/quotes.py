"""Quotation linking, in DataFrame functions only.

Lines are cut into quote levels by their leading ``>`` signs; consecutive lines of one level make a passage.  Quoted
passages and messages' own passages are hashed in normal form (case, spaces and signs put aside) and joined within a
conversation, which links each quote to the earlier message it comes from.  A message answers the one that its
outermost quote comes from; conversations are rebuilt without quotes, in reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewell.session import checkpointed

PASSAGE = "array<struct<level:int,text:string>>"


def passages(text: Column) -> Column:
    """The passages of a text in order: (level, text).  ``> >x`` and ``>>x`` are level 2; empty lines between belong to
    no passage and don't end one."""
    marks = r"^(?:\x20{0,3}>\x20?)*"
    line = F.transform(
        F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1),
        lambda s: F.struct(F.length(F.translate(F.regexp_extract(s, marks, 0), " ", "")).alias("level"), F.regexp_replace(s, marks, "").alias("text")),
    )
    line = F.filter(line, lambda s: F.trim(s["text"]) != "")

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["level"].alias("level"), F.concat(last["text"], F.lit("\n"), s["text"]).alias("text"))))
        return F.when((F.size(acc) > 0) & (last["level"] == s["level"]), grown).otherwise(F.concat(acc, F.array(s)))

    # A text without quotes is one passage: no need to walk its lines.
    plain = F.filter(F.array(F.struct(F.lit(0).alias("level"), F.array_join(F.transform(line, lambda s: s["text"]), "\n").alias("text"))), lambda s: s["text"] != "")
    quoted = F.exists(line, lambda s: s["level"] > 0)
    return F.when(quoted, F.aggregate(line, F.array().cast(PASSAGE), add)).otherwise(plain.cast(PASSAGE))


def normal_hash(text: Column) -> Column:
    """128 bits of a passage's letters and digits, lower-cased; null if it has none."""
    kept = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    return F.when(kept != "", F.substring(F.sha2(kept, 256), 1, 32))


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own, n_quotes, n_linked, reply_to) of every message (conv_id, turn, role, text).

    ``own`` is the text without quotes; ``n_quotes`` counts quoted passages, ``n_linked`` those found in an earlier
    message of the conversation; ``reply_to`` is the turn its outermost linked quote comes from (the latest such
    message; the last such quote if there are several), null if there is none.  Null and empty texts have no passages.
    Rows with a null conv_id or turn keep their own text and link with nothing; repeated rows are kept.  Other columns
    are ignored.
    """
    m = messages.select("conv_id", "turn", "role", passages(F.col("text")).alias("ps"))
    m = checkpointed(m.select("conv_id", "turn", "role", F.array_join(F.transform(F.filter("ps", lambda p: p["level"] == 0), lambda p: p["text"]), "\n").alias("own"), F.col("ps"), F.xxhash64("ps").alias("_row")))
    known = m.where("conv_id is not null and turn is not null")
    quotes = known.select("conv_id", "turn", "_row", F.posexplode("ps").alias("at", "p")).where("p.level > 0")
    quotes = quotes.select("conv_id", "turn", "_row", "at", F.col("p.level").alias("level"), normal_hash(F.col("p.text")).alias("hash")).where("hash is not null").distinct()
    source = known.select("conv_id", F.col("turn").alias("from"), F.explode("ps").alias("p")).where("p.level = 0").select("conv_id", "from", normal_hash(F.col("p.text")).alias("hash"))
    whole = known.select("conv_id", F.col("turn").alias("from"), normal_hash(F.col("own")).alias("hash"))
    source = source.union(whole).where("hash is not null").distinct()
    # One row per quote and hash: the turns that have the passage shrink to the latest earlier one.
    latest = _latest_before(quotes, source)
    best = F.max_by("from", F.struct(-F.col("level"), "at"))
    found = latest.groupBy("conv_id", "turn", "_row").agg(F.count("*").alias("n_linked"), best.alias("reply_to"))
    return m.join(found, ["conv_id", "turn", "_row"], "left").select(
        "conv_id", "turn", "role", "own",
        F.size(F.filter("ps", lambda p: p["level"] > 0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to",
    )


def _latest_before(quotes: DataFrame, source: DataFrame) -> DataFrame:
    """Each quote with the latest turn before it that has its passage, by one ordered pass over both per (conversation,
    hash); no pairs of quotes and sources are made."""
    from pyspark.sql import Window

    none = F.lit(None)
    both = quotes.select("conv_id", "hash", "turn", "_row", "at", "level", none.cast("long").alias("here")).union(
        source.select("conv_id", "hash", "from", none, none, none, F.col("from").cast("long")))
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("from", F.max("here").over(before))
    return out.where("level is not null and `from` is not null").select("conv_id", "turn", "_row", "at", "level", "from")


def threads(linked: DataFrame) -> DataFrame:
    """``linked`` with ``root`` (the turn its chain of replies starts from) and ``depth`` (replies from there).

    Pointers double each round, so a chain of n replies takes log2(n) rounds of one join on (conv_id, turn); only
    messages whose pointer has not reached the start of its chain take part in a round.
    """
    known = linked.where("conv_id is not null and turn is not null")
    state = known.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up"))
    state = checkpointed(state.select("conv_id", "turn", F.coalesce("up", "turn").alias("root"), F.col("up").isNotNull().cast("long").alias("depth"), F.col("up").isNotNull().alias("live")))
    while not state.where("live").isEmpty():
        up = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        moved = state.where("live").join(up, ["conv_id", "root"])
        moved = moved.select("conv_id", "turn", F.col("r2").alias("root"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("d2") > 0).alias("live"))
        state = checkpointed(state.where("not live").unionByName(moved))
    return linked.join(state.drop("live"), ["conv_id", "turn"], "left")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, root, depth, turn, role, reply_to, n_quotes, n_linked and its text without quotes.

    Reply order is by (conv_id, root, depth, turn): a message stands behind the one it answers, whatever turns lie
    between.  Rows of a conversation aren't gathered into one row, so its length has no bound.
    """
    return threads(link(messages)).select("conv_id", "root", "depth", "turn", "role", "reply_to", "n_quotes", "n_linked", F.col("own").alias("text"))


def write_conversations(messages: DataFrame, path: str) -> None:
    """Write the rebuilt conversations range-partitioned and sorted in reply order."""
    order = ["conv_id", "root", "depth", "turn"]
    conversations(messages).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
