"""Quotation linking: quoted passages joined to the messages they quote.

A line's quote level is its count of leading '>' marks. Runs of lines of one level are passages; a passage
and each of its lines are hashed after lower-casing and squeezing white space, and joined by conversation
and hash to what earlier messages said themselves (the whole of it, its paragraphs, its lines). A message
answers the latest message that its outermost passages match best. Conversations are then put in the order of
their replies: threads by first turn, and in a thread each message before its answers, these by turn.

DataFrame functions only. Nothing is gathered by conversation or by passage alone, for either may be common: turns
are cut into spans of SPAN, and what spans need of one another is one row for each span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import drop_path, written

_MARKS = "^[ \\t]*((?:>[ \\t]?)+)"
#: The line that introduces a quote and names who is quoted (a fixed pattern).
ATTRIBUTION = "^[ \\t]*(?i:on)[ \\t].*[ \\t](?i:wrote):[ \\t]*$"
#: Turns of a span.
SPAN = 1_024


def level(line: Column) -> Column:
    """The count of leading quote marks."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def unquoted(line: Column) -> Column:
    return F.regexp_replace(line, _MARKS, "")


def normal(text: Column) -> Column:
    """Lower case, white space squeezed to single spaces and cut at both ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[\\x20\\x09-\\x0D]+", " "))


def _digest(text: Column) -> Column:
    return F.md5(normal(text))


def passages(messages: DataFrame) -> DataFrame:
    """m, conv_id, turn, level, text: runs of lines of one level, in order (run). Attributions of quotes are left out."""
    rows = messages.select("m", "conv_id", "turn", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    rows = rows.withColumn("level", level(F.col("line")))
    order = Window.partitionBy("m").orderBy("n")
    introduces = (F.col("level") == 0) & F.col("line").rlike(ATTRIBUTION) & (F.coalesce(F.lead("level").over(order), F.lit(0)) > 0)
    rows = rows.withColumn("introduces", introduces).where("not introduces").select("m", "conv_id", "turn", "n", "level", F.when(F.col("level") > 0, unquoted(F.col("line"))).otherwise(F.col("line")).alias("line"))
    change = F.when(F.col("level") == F.lag("level").over(order), 0).otherwise(1)
    rows = rows.withColumn("change", change).withColumn("run", F.sum("change").over(order))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return rows.groupBy("m", "conv_id", "turn", "run", "level").agg(F.array_join(lines, "\n").alias("text"))


def _units(text: Column) -> Column:
    """A text's digests: of the whole, of its paragraphs and of its lines; blank ones are left out."""
    parts = F.flatten(F.array(F.array(text), F.split(text, "\n[ \\t]*\n"), F.split(text, "\n")))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: normal(p) != ""), _digest))


def _span(turn: str, span: int) -> Column:
    return F.floor(F.col(turn) / span).alias("span")


def latest_before(events: DataFrame, asked: DataFrame, keys: list[str], span: int = SPAN) -> DataFrame:
    """asked (keys, turn; distinct) with found: the latest turn of the events (keys, turn) of the same keys before its own."""
    events, asked = events.select(*keys, "turn", _span("turn", span)), asked.select(*keys, "turn", _span("turn", span))
    by = [*keys, "span"]
    tops = events.groupBy(*by).agg(F.max("turn").alias("top")).unionByName(asked.select(*by).distinct().withColumn("top", F.lit(None).cast("long")))
    tops = tops.groupBy(*by).agg(F.max("top").alias("top"))
    earlier = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.withColumn("carried", F.last("top", ignorenulls=True).over(earlier)).select(*by, "carried").where("carried is not null")
    both = events.withColumn("origin", F.col("turn")).unionByName(asked.withColumn("origin", F.lit(None).cast("long"))).groupBy(*by, "turn").agg(F.max("origin").alias("origin"), F.bool_or(F.col("origin").isNull()).alias("asks"))
    within = Window.partitionBy(*by).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.last("origin", ignorenulls=True).over(within)).where("asks").select(*by, "turn", "near")
    return near.join(carried, by, "left").select(*keys, "turn", F.coalesce("near", "carried").alias("found"))


def next_after(rows: DataFrame, keys: list[str], span: int = SPAN) -> DataFrame:
    """rows (keys, turn; distinct) with following: the next turn of the same keys."""
    by = [*keys, "span"]
    rows = rows.select(*keys, "turn", _span("turn", span))
    later = Window.partitionBy(*keys).orderBy("span")
    firsts = rows.groupBy(*by).agg(F.min("turn").alias("first")).withColumn("then", F.lead("first").over(later)).select(*by, "then")
    near = rows.withColumn("near", F.lead("turn").over(Window.partitionBy(*by).orderBy("turn")))
    return near.join(firsts, by).select(*keys, "turn", F.coalesce("near", "then").alias("following"))


def link(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """conv_id, turn, role, reply_to, thread, position, n_quotes, n_linked, max_level, text of every message.

    text is the message without quoted lines and the lines that introduce them; reply_to the turn it quotes (null if
    none was found) and thread the first turn of its chain of replies; position numbers a conversation's messages
    from 1, by thread, then each before its answers, then by turn. Passages link only to earlier turns of their
    conversation. Messages without a conv_id or turn link to nothing; null conv_ids form one conversation, null turns
    come first. Rows of one turn are messages of their own and stand together, by role and text; where they quote
    different turns, the earliest decides the place of all. A null or empty text has no quotes. Other columns are
    ignored.
    """
    messages, at = written(conversations.select(F.monotonically_increasing_id().alias("m"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"), "messages")
    spans, spans_at = written(passages(messages), "passages")
    body = spans.where("level = 0").groupBy("m", "conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "\n").alias("body"))
    counted = spans.groupBy("m").agg(F.count_if(F.col("level") > 0).alias("n_quotes"), F.max("level").alias("max_level"))
    said = body.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode_outer(_units(F.col("body"))).alias("h")).where("h is not null").distinct()
    quotes = spans.where("level > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", "m", "run", "level", F.explode_outer(_units(F.col("text"))).alias("h")).where("h is not null")
    quotes, quotes_at = written(quotes, "quotes")
    # only what somebody quotes is dealt out
    wanted = quotes.select("conv_id", "h").distinct()
    answers = latest_before(said.join(wanted, ["conv_id", "h"], "left_semi"), quotes.select("conv_id", "h", "turn").distinct(), ["conv_id", "h"], span)
    hits, hits_at = written(quotes.join(answers.where("found is not null"), ["conv_id", "h", "turn"]).select("m", "run", "level", "found"), "hits")
    votes = hits.groupBy("m", "level", "found").agg(F.count("*").alias("n"))
    linked = votes.groupBy("m").agg(F.min_by("found", F.struct("level", -F.col("n"), -F.col("found"))).alias("reply_to"))
    n_linked = hits.select("m", "run").distinct().groupBy("m").agg(F.count("*").alias("n_linked"))
    rows = messages.select("m", "conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("digest")).join(counted, "m", "left").join(body.select("m", "body"), "m", "left").join(linked, "m", "left").join(n_linked, "m", "left")
    rows, rows_at = written(rows, "linked")
    for path in (at, spans_at, quotes_at, hits_at):
        drop_path(messages.sparkSession, path)
    places, places_at = written(_places(rows, span), "places")
    rows = rows.join(places, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("root", "turn"))
    out = _numbered(rows, ["conv_id"], [F.col(c).asc_nulls_first() for c in ("thread", "place", "turn", "role", "digest")])
    for path in (rows_at, places_at):
        drop_path(messages.sparkSession, path)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "turn", "role", "reply_to", "thread", "position", count("n_quotes"), count("n_linked"), count("max_level"), F.coalesce("body", F.lit("")).alias("text"))


def _numbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with position: their number among those of the same keys. Sorted by ranges, so common keys are several tasks'."""
    parted, path = written(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = parted.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), "_base")
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return parted.withColumn("_inner", inner).join(based, same).withColumn("position", (F.col("_base") + F.col("_inner")).cast("long"))


def _places(rows: DataFrame, span: int) -> DataFrame:
    """conv_id, turn, root, place of all turns of threads: the thread's first turn, and the number in its pre-order.

    A thread's tour enters a turn, then tours its answers, then leaves it. Each step knows its next, and the count of
    turns still to be entered comes by pointer jumping: a join of two shuffled sides a round.
    """
    spark = rows.sparkSession
    up, up_at = written(rows.where("reply_to is not null").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("parent")), "answers")
    roots, roots_at = _jumped(up.select("conv_id", F.col("turn").alias("step"), F.col("parent").alias("next"), F.lit(0).alias("n")), keep_last=True)
    roots = roots.select("conv_id", F.col("step").alias("turn"), F.col("next").alias("root"))
    parents = up.groupBy("conv_id", "parent").agg(F.min("turn").alias("child")).withColumnRenamed("parent", "turn")
    siblings = next_after(up.select("conv_id", "parent", "turn"), ["conv_id", "parent"], span)
    nodes = roots.unionByName(roots.select("conv_id", F.col("root").alias("turn"), "root").distinct())
    enter = nodes.join(parents, ["conv_id", "turn"], "left").select("conv_id", (F.col("turn") * 2).alias("step"), F.coalesce(F.col("child") * 2, F.col("turn") * 2 + 1).alias("next"), F.lit(1).alias("n"))
    leave = siblings.select("conv_id", (F.col("turn") * 2 + 1).alias("step"), F.coalesce(F.col("following") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(0).alias("n"))
    tour, tour_at = _jumped(enter.unionByName(leave), keep_last=False)
    entered = tour.where("pmod(step, 2) = 0").select("conv_id", F.expr("step div 2").alias("turn"), F.col("n").alias("to_come"))
    counted, counted_at = written(nodes.join(entered, ["conv_id", "turn"]), "counted")
    total = counted.where("turn = root").select("conv_id", "root", F.col("to_come").alias("all"))
    out, _ = written(counted.join(total, ["conv_id", "root"]).select("conv_id", "turn", "root", (F.col("all") - F.col("to_come") + 1).alias("place")), "places")
    for path in (up_at, roots_at, tour_at, counted_at):
        drop_path(spark, path)
    return out


def _jumped(steps: DataFrame, keep_last: bool) -> tuple[DataFrame, str]:
    """steps (conv_id, step, next, n) with n summed over all that come after; next becomes the last step that has none
    of its own (keep_last), or null."""
    now, path = written(steps.select("conv_id", "step", "next", F.col("n").cast("long").alias("n"), F.lit(True).alias("moved")), "steps")
    while now.where("moved").take(1):
        ahead = now.select("conv_id", F.col("step").alias("next"), F.col("next").alias("then"), F.col("n").alias("more"), F.lit(True).alias("met"))
        both = now.join(ahead, ["conv_id", "next"], "left")
        onward = F.when(F.col("met"), F.col("then"))
        new, new_at = written(both.select("conv_id", "step", (F.coalesce(onward, "next") if keep_last else onward).alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("met", F.lit(False)).alias("moved")), "steps")
        drop_path(steps.sparkSession, path)
        now, path = new, new_at
    return now, path
