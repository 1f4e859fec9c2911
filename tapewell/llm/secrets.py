"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates in every whole text.  The values' hashes are counted by distinct repositories and owners over
the whole corpus: a value that many owners have is a widely copied example; a value that few have is taken for live,
unless it is plainly a placeholder.  Long mixed tokens that match no pattern's context are candidates too, and are
reported where few owners have them and they look like a credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewell.session import checkpointed

# Kinds in their order, with their patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "token")
ASSIGN_CHARS = 6
EXAMPLE_OWNERS = 3  # a value of so many owners is an example
BLOCK = 64
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is worked out once although ``body`` names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(sizes: Column) -> Column:
    """The sum of all elements before each one, by sums of blocks; the array isn't empty."""
    add = lambda a, x: a + x

    def of(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(x, k * BLOCK + 1, BLOCK), F.lit(0), add))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, s: F.array_append(acc, F.element_at(acc, -1) + s))
        return _let(starts, lambda st: F.transform(x, lambda _, i: F.element_at(st, F.floor(i / BLOCK).cast("int") + 1) + F.aggregate(F.slice(x, i - i % BLOCK + 1, i % BLOCK), F.lit(0), add)))

    return _let(sizes, of)


def _spans(text: Column, rank: int, pattern: str, found: Column) -> Column:
    """(start, rank, end, value) of all matches, in code points: lengths of the pieces between them and of themselves add up.

    A match's value is its secret part: group 2 of an assignment, else all of it; too short assignments fall out.
    """
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    match = F.zip_with(found, pieces, lambda m, p: F.struct(
        F.length(p).alias("gap"), F.length(m).alias("size"), (F.regexp_extract(m, pattern, 2) if rank == 0 else m).alias("value")))

    def placed(ms: Column) -> Column:
        return F.zip_with(ms, _before(F.transform(ms, lambda x: x["gap"] + x["size"])), lambda x, at: F.struct(
            (at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")))

    spans = _let(match, placed)
    if rank == 0:
        spans = F.filter(spans, lambda x: F.length(x["value"]) >= ASSIGN_CHARS)
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(SPAN))


def candidates(documents: DataFrame, repository: str, owner: str) -> DataFrame:
    """(doc_id, row, repository, owner, base, tokens) of every document; ``row`` identifies id and text together."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), text.alias("text"))
    patterns = (ASSIGN, ACCESS, HEX, TOKEN)
    rows = rows.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"found{k}") for k, p in enumerate(patterns)])
    spans = [_spans(F.col("text"), k, p, F.col(f"found{k}")) for k, p in enumerate(patterns)]
    return rows.select("doc_id", "row", "repository", "owner", F.array_sort(F.concat(*spans[:3])).alias("base"), spans[3].alias("tokens"))


def live_looking(value: Column) -> Column:
    """Letters and digits mixed, twelve characters at least, and no character four times in a row."""
    return (F.length(value) >= 12) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(r"(.)\1{3}")


def placeholder(value: Column) -> Column:
    """One or two distinct characters apart from the prefix of an access key, the alphabet or digits in order, or nothing
    but the names that an assignment starts with."""
    core = F.regexp_replace(value, "^(?:AKIA){1,100}", "")
    rest = F.replace(core, F.substring(core, 1, 1), F.lit(""))
    few = F.replace(rest, F.substring(rest, 1, 1), F.lit("")) == ""
    low = F.lower(value)
    ordered = "^([a-z]{0,26})([0-9]{0,10})$"
    in_order = low.rlike(ordered) & F.lit("abcdefghijklmnopqrstuvwxyz").contains(F.regexp_extract(low, ordered, 1)) & F.lit("01234567890").contains(F.regexp_extract(low, ordered, 2))
    names = F.regexp_replace(low, "password|passwd|secret|token|api_?key|[^a-z0-9]", "") == ""
    return few | in_order | names


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(hash, repositories, owners, verdict) of every candidate value in the corpus.

    A value of few owners is live where a pattern's context names it and it is no placeholder, or where it looks live.
    Counts go up by (hash, owner, repository), then (hash, owner), then hash, each with partial sums, so a value that a
    third of all documents hold is a few rows per task before it is shuffled.  A missing owner counts as one owner.
    """
    values = found.select("repository", F.coalesce("owner", F.lit("")).alias("owner"), F.explode(F.concat("base", "tokens")).alias("s"))
    value = F.col("s.value")
    live = live_looking(value) | ((F.col("s.rank") < KINDS.index("token")) & ~placeholder(value))
    values = values.select(F.sha2(value, 256).alias("hash"), "owner", "repository", live.alias("live"))
    each = values.groupBy("hash", "owner", "repository").agg(F.max("live").alias("live"))
    each = each.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.max("live").alias("live"))
    counts = each.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"), F.max("live").alias("live"))
    verdict = F.when(F.col("owners") >= example_owners, "example").when(F.col("live"), "live").otherwise("weak")
    return counts.select("hash", "repositories", "owners", verdict.alias("verdict"))


def scan(documents: DataFrame, repository: str = "doc_id", owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(doc_id, row, base, spans, live) of every row of ``documents``.

    ``base``: spans of the patterns, by start, then kind; ``spans``: those and the long tokens whose value is live and
    that are no base span or its value; ``live``: spans of the values to take out.  Each is an array of (start, rank,
    end, value), offsets in code points, rank the kind's place in ``KINDS``.  Null texts count as empty; repeated rows
    each get their spans; null ids and owners are kept.  Columns other than id, text, repository and owner are ignored.
    """
    found = checkpointed(candidates(documents, repository, owner))
    verdicts = ownership(found, example_owners).where("verdict = 'live'").select("hash")
    some = found.where((F.size("base") > 0) | (F.size("tokens") > 0)).select("doc_id", "row", "base", "tokens").dropDuplicates(["doc_id", "row"])
    one = some.select("doc_id", "row", "base", F.explode(F.concat("base", "tokens")).alias("s"))
    values = F.transform("base", lambda b: F.struct((b["end"] - F.length(b["value"])).alias("a"), b["end"].alias("b")))
    here = F.struct(F.col("s.start").alias("a"), F.col("s.end").alias("b"))
    one = one.select("doc_id", "row", "s", F.sha2(F.col("s.value"), 256).alias("hash"), F.array_contains(values, here).alias("known"))
    live = one.join(verdicts, "hash").groupBy("row", F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("s", "known")).alias("hits"))  # spans of one text
    out = found.select("doc_id", "row", "base").join(live.withColumnRenamed("row", "r"), (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    hits = F.coalesce("hits", F.array().cast(f"array<struct<s:{SPAN[6:-1]},known:boolean>>"))
    added = F.transform(F.filter(hits, lambda h: (h["s"]["rank"] == 3) & ~h["known"]), lambda h: h["s"])
    cut = F.transform(hits, lambda h: F.struct((h["s"]["end"] - F.length(h["s"]["value"])).alias("start"), h["s"]["rank"].alias("rank"), h["s"]["end"].alias("end"), h["s"]["value"].alias("value")))
    return out.select("doc_id", "row", "base", F.array_sort(F.concat("base", added)).alias("spans"), F.array_sort(cut).alias("live"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(documents: DataFrame, repository: str = "doc_id", owner: str = "source", mark: str = "[secret]") -> DataFrame:
    """``documents`` with ``mark`` in place of every live value, and ``n_chars`` of the new text; all rows stay.

    Overlapping values are taken out together.  Rows without live values keep their text and count, nulls included.
    """
    live = scan(documents, repository, owner).where(F.size("live") > 0).select("doc_id", "row", "live").dropDuplicates(["doc_id", "row"])
    live = live.select(F.struct("doc_id", "row").alias("of"), "live")
    # The whole document goes as one struct, so no column of it can clash.
    rows = documents.select(F.struct("doc_id", F.xxhash64("doc_id", "text").alias("row")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))
    joined = rows.join(live, (F.col("key.row") == F.col("of.row")) & F.col("key.doc_id").eqNullSafe(F.col("of.doc_id")), "left")
    given = F.col("doc")["text"]

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], F.substring(given, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(given, acc["at"] + 1, F.length(given)))
    text = F.when(F.col("live").isNull(), given).otherwise(F.aggregate("live", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest))
    out = joined.select("doc", F.col("live").isNotNull().alias("cut"), text.alias("new"))
    columns = {c: F.col("doc")[c] for c in documents.columns} | {"text": F.col("new")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("cut"), F.length("new").cast("long")).otherwise(columns["n_chars"])
    return out.select(*[columns[c].alias(c) for c in documents.columns])
