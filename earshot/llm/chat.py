"""Chat formatting by quotation linking, in DataFrame operations only.

Lines that begin with > are quotes, nested by the number of >. Quoted lines, and windows of words of the paragraphs that lines of
one level make up, are normalised and hashed, and joined to the latest earlier message of the conversation that says the same in
its own words, however its lines are broken; that message is the one replied to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Turns of one bucket of a conversation in the as-of join.
SPAN = 256
#: Words of a window; shorter passages link as whole lines only.
WINDOW = 4
_QUOTE = r"^((?:[ \t]*>)+)[ \t]?(.*)$"
_WROTE = r"(?i)^on\b.{0,300}\bwrote:\s*$"


def _norm(text):
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def latest_before(queries: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """For each distinct (keys, t) of queries the greatest t of sources with equal keys that is less: keys, t, before.

    Rows of a key are cut into buckets of SPAN turns; what lies before a bucket comes in as one maximum, so a key with very
    many turns is many small groups.
    """
    both = sources.select(*keys, "t", F.col("t").alias("src")).union(queries.select(*keys, "t", F.lit(None).cast("long").alias("src"))).distinct()
    both = both.withColumn("bucket", F.floor(F.col("t") / SPAN))
    inside = Window.partitionBy(*keys, "bucket").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("src").over(inside)).where("src is null").drop("src")
    tops = both.groupBy(*keys, "bucket").agg(F.max("src").alias("top"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.withColumn("carry", F.max("top").over(earlier)).drop("top")
    return near.join(carry, [*keys, "bucket"]).select(*keys, "t", F.coalesce("near", "carry").alias("before"))


def parsed(messages: DataFrame) -> DataFrame:
    """mid, conv_id, t, lines, quoted (levels by line), text without quotes, max_level."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    m = messages.select(F.xxhash64("conv_id", "turn", "role", "text").alias("mid"), "conv_id", F.col("turn").cast("long").alias("t"), "role", lines.alias("lines"))
    level = F.transform("lines", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _QUOTE, 1), "[ \t]", "")))
    m = m.withColumn("levels", level)
    leads = lambda i: F.get("lines", i).rlike(_WROTE) & (F.coalesce(F.get("levels", i + 1), F.lit(0)) > 0)
    kept = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (F.get("levels", i) == 0) & ~leads(i))
    body = F.regexp_replace(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"), r"^\s+|\s+$", "")
    return m.select("mid", "conv_id", "t", "role", "lines", "levels", F.array_max("levels").alias("max_level"), body.alias("body"))


def quote_links(messages: DataFrame) -> DataFrame:
    """Quoted lines with the message they come from: mid, conv_id, t, level, passage (hash), chars, source_turn (null: not found).

    A line of WINDOW words or more comes from the message that says it as a line; else from the one that says most of the windows
    over it, the later in a tie. For a shorter line the windows of its paragraph come first, as many messages may say it by itself.
    """
    p = parsed(messages).dropDuplicates(["mid"])
    long_enough = F.length("n") > 0
    quoting = p.where("max_level > 0").select("mid", "conv_id", "t", F.posexplode(F.arrays_zip("lines", "levels")).alias("at", "x")).select(
        "mid", "conv_id", "t", "at", F.col("x.levels").alias("level"), F.regexp_extract("x.lines", _QUOTE, 2).alias("line")).where("level > 0")
    quoting = quoting.withColumn("n", _norm(F.col("line"))).where(long_enough).withColumn("passage", F.xxhash64("n"))
    asked = quoting.select("mid", "conv_id", "t", "level", "passage", F.length("n").alias("chars"), (F.size(F.split("n", " ")) < WINDOW).alias("short")).distinct()
    # Only conversations with quotes are searched, and only lines that are their author's own.
    own = p.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "t", "body")
    lines = own.select("conv_id", "t", F.explode(F.split("body", "\n")).alias("line")).withColumn("n", _norm(F.col("line"))).where(long_enough)
    said = lines.select("conv_id", F.xxhash64("n").alias("passage"), "t").distinct()
    found = latest_before(asked.select("conv_id", "passage", "t"), said, ["conv_id", "passage"]).withColumnRenamed("before", "as_line")

    # A paragraph is a run of lines of one level; a quoted line without words ends it.
    run = F.col("at") - F.row_number().over(Window.partitionBy("mid", "level").orderBy("at"))
    word = lambda l: F.transform(F.split(l["n"], " "), lambda w: F.struct(l["passage"].alias("passage"), w.alias("w")))  # noqa: E731, E741
    runs = quoting.withColumn("run", run).groupBy("mid", "conv_id", "t", "level", "run").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "n", "passage"))), word)).alias("words"))
    asking = runs.select("mid", "conv_id", "t", "level", F.explode(_windows(F.col("words"))).alias("x")).select("mid", "conv_id", "t", "level", F.xxhash64(F.array_join("x.w", " ")).alias("h"), F.array_distinct("x.passage").alias("passages"))
    telling = own.select("conv_id", "t", F.explode(_windows(F.split(_norm(F.col("body")), " "))).alias("x")).select("conv_id", F.xxhash64(F.array_join("x", " ")).alias("h"), "t").distinct()
    at = latest_before(asking.select("conv_id", "h", "t"), telling, ["conv_id", "h"]).where("before is not null")
    votes = asking.join(at, ["conv_id", "h", "t"]).select("mid", "level", "before", F.explode("passages").alias("passage")).groupBy("mid", "level", "passage", "before").agg(F.count(F.lit(1)).alias("n"))
    voted = votes.groupBy("mid", "level", "passage").agg(F.max(F.struct("n", "before"))["before"].alias("as_words"))
    linked = asked.join(found, ["conv_id", "passage", "t"], "left").join(voted, ["mid", "level", "passage"], "left")
    source = F.when(F.col("short"), F.coalesce("as_words", "as_line")).otherwise(F.coalesce("as_line", "as_words"))
    return linked.select("mid", "conv_id", "t", "level", "passage", "chars", source.alias("source_turn"))


def _windows(words):
    """Every WINDOW words that follow one another; none where there are fewer."""
    last = F.size(words) - WINDOW + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(words, i, WINDOW)))


def reply_paths(quoting: DataFrame) -> DataFrame:
    """For each message that replies to a quoted one, (conv_id, t, quoted_turn), its path: what each reply by quotation on the way to it quotes, negative, and its turn.

    A message without quotes follows the turn before, so between two replies by quotation lies a run of turns with one path. Paths
    grow by doubling: each round appends to a path that of the run it came from, and halves what is left of the way.
    """
    runs = quoting.select("conv_id", "t").distinct()
    at = latest_before(quoting.select("conv_id", (F.col("quoted_turn") + 1).alias("t")).distinct(), runs, ["conv_id"]).select("conv_id", (F.col("t") - 1).alias("quoted_turn"), F.col("before").alias("up"))
    step = F.array(F.struct((-F.col("quoted_turn")).alias("quoted"), F.col("t").alias("turn")))
    state = materialize(quoting.join(at, ["conv_id", "quoted_turn"], "left").select("conv_id", "t", "up", step.alias("path")), "paths")
    while state.where("up is not null").take(1):
        over = state.select("conv_id", F.col("t").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        grown = state.join(over, ["conv_id", "up"], "left").select("conv_id", "t", F.col("next").alias("up"), F.concat(F.coalesce("above", F.array().cast("array<struct<quoted:bigint,turn:bigint>>")), "path").alias("path"))
        before, state = state, materialize(grown, "paths")
        discard(before)
    return state.select("conv_id", "t", "path")


def reply_order(messages: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, text without quotes, parent_turn, root_turn, depth, reply_path, quote_levels, n_quotes, n_linked.

    - parent_turn is the message whose words the first level of quotes holds most of (in characters, the later one in a tie);
      without such quotes the turn before in the conversation; null for the first. root_turn is where its thread begins.
    - depth counts the replies by quotation on the way from the root, and reply_path lists them: ordered by conv_id, reply_path and turn,
      each message comes after the one it replies to and before what comes later to an earlier one (see conversations).
    - Lines such as "On Monday X wrote:" go with the quote they introduce. A quote is linked only within its conversation.
    - Null text is empty. Messages with null conv_id or turn keep their row and have no parent. Repeated rows give a row each.
    - Passages without letters or digits link to nothing. An empty table gives an empty result. A text of any length is one row. Other columns are ignored.
    """
    links = quote_links(messages)
    by_source = links.where("level = 1 and source_turn is not null").groupBy("mid", "source_turn").agg(F.sum("chars").alias("chars"))
    parents = by_source.groupBy("mid").agg(F.max(F.struct("chars", "source_turn"))["source_turn"].alias("quoted_turn"))
    counts = links.groupBy("mid").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("source_turn").alias("n_linked"))
    told = counts.join(parents, "mid", "left")
    turns = messages.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("t")).distinct()
    before = latest_before(turns, turns, ["conv_id"]).join(turns.groupBy("conv_id").agg(F.min("t").alias("root_turn")), "conv_id")
    p = parsed(messages.select("conv_id", "turn", "role", "text")).drop("lines", "levels")
    rows = materialize(p.join(told, "mid", "left").join(before, ["conv_id", "t"], "left"), "messages")
    path = "array<struct<quoted:bigint,turn:bigint>>"
    quoting = rows.where("quoted_turn is not null").groupBy("conv_id", "t").agg(F.max("quoted_turn").alias("quoted_turn"))
    if quoting.take(1):
        paths = reply_paths(quoting)
        run = latest_before(turns.select("conv_id", (F.col("t") + 1).alias("t")), paths.select("conv_id", "t"), ["conv_id"]).select("conv_id", (F.col("t") - 1).alias("t"), F.col("before").alias("run"))
        placed = run.join(paths.select("conv_id", F.col("t").alias("run"), "path"), ["conv_id", "run"]).select("conv_id", "t", "path")
        rows = rows.join(placed, ["conv_id", "t"], "left")
    else:
        rows = rows.withColumn("path", F.lit(None).cast(path))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    full = F.coalesce("path", F.array().cast(path))
    return rows.select(
        "conv_id", F.col("t").alias("turn"), "role", F.col("body").alias("text"), F.coalesce("quoted_turn", "before").alias("parent_turn"), "root_turn", F.size(full).cast("long").alias("depth"), full.alias("reply_path"),
        F.coalesce(F.col("max_level"), F.lit(0)).cast("long").alias("quote_levels"), zero("n_quotes"), zero("n_linked"))


def conversations(messages: DataFrame) -> DataFrame:
    """reply_order's rows in reply order: all of them sorted by conversation, path and turn, a long conversation over many tasks."""
    return reply_order(messages).orderBy("conv_id", "reply_path", "turn", "role", "text")
