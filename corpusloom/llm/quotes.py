"""Quotation linking for chat formatting, in DataFrame functions only.

A line's quote level is the number of ">" that it begins with. Lines of one level that stand together are unwrapped and cut
into sentences; a sentence is normalised (lower case, letters and digits only) and hashed, and what meets by its hash is compared
as text. A message's own sentences name it as their origin; of equal sentences in one conversation the first message is the
origin. A message replies to the earlier message of its conversation with which the quotes of a level share most words (at equal
counts the later one); where there is none, quotes may link it to a message of another conversation, if they share LEAST_WORDS
words with it: of the messages that have a sentence, the one that stands earliest, by time where a column tells it, else by turn,
and only then by conversation. Levels are looked up by themselves, and the shallowest that is found counts, so that a message
hangs on its nearest known ancestor. Replies follow what they reply to: a thread begins with a message that replies to none,
threads stand in the order of their beginnings, and messages in a thread by turn. Quotes, and lines that only say who wrote what
follows, are taken out of the text.

Defined cases: null or empty texts are empty messages; rows with a null conv_id or turn link nothing and stand in a
conversation of their own kind, nulls first; rows with the same conv_id and turn are one message for links and share its
place in the order, told apart by role and text; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import numbered, stored

#: Words that a message must share with one of another conversation to be linked with it.
LEAST_WORDS = 5
QUOTED = r"^(?:[ \t]{0,3}>)+"
WROTE = r"^.{1,200}\b(?:wrote|writes|schrieb|escribió|a écrit) ?:[ \t]*$"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTED, 0), "[^>]", ""))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, lines): body is the text without quotes; lines are structs of level and content, own lines that name an author left out."""
    lines = messages.select(F.col("conv_id"), F.col("turn"), F.col("role"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r?\n").alias("raw"))
    levels = lines.withColumn("levels", F.transform("raw", _level))
    named = lambda line, i: line.rlike(WROTE) & (F.coalesce(F.get("levels", i + 1), F.lit(0)) > 0) & (F.get("levels", i) == 0)
    kept = levels.withColumn("lines", F.transform("raw", lambda line, i: F.struct(F.when(named(line, i), F.lit(-1)).otherwise(F.get("levels", i)).alias("level"), F.trim(F.regexp_replace(line, QUOTED, "")).alias("content"), line.alias("line"))))
    own = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"])
    return kept.select("conv_id", "turn", "role", F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "").alias("body"), "lines")


def _sentences(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, level, key, s, words) of each sentence: lines of a level are joined; another level, or an empty line, ends a passage."""
    joins = lambda x, i: F.when((x["content"] == "") | (F.coalesce(F.get("lines", i - 1)["level"], F.lit(-2)) != x["level"]), F.lit("\n")).otherwise(F.lit(" "))
    levels = lines.select("conv_id", "turn", "lines", F.explode(F.array_distinct(F.transform("lines", lambda x: x["level"]))).alias("level")).where("level >= 0")
    piece = lambda x, i: F.when(x["level"] == F.col("level"), F.concat(F.when(i == 0, F.lit("\n")).otherwise(joins(x, i)), x["content"])).otherwise("")
    text = levels.select("conv_id", "turn", "level", F.array_join(F.transform("lines", piece), "").alias("text"))
    cut = text.select("conv_id", "turn", "level", F.explode(F.split("text", r"[.!?]+\s+|\n")).alias("s"))
    clean = cut.select("conv_id", "turn", "level", F.trim(F.regexp_replace(F.lower("s"), r"[^\p{L}\p{N}]+", " ")).alias("s")).where("s <> ''")
    return clean.select("conv_id", "turn", "level", F.xxhash64("s", F.length("s")).alias("key"), "s", F.size(F.split("s", " ")).alias("words"))


def _replies(sentences: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, to_conv, to_turn): one row for each message whose quotes are found, at the shallowest level that is found. times: (conv_id, turn, time)."""
    at_level, passage = ["conv_id", "turn", "level"], ["key", "s"]
    quotes = sentences.where("level >= 1").groupBy(*at_level, *passage).agg(F.max("words").alias("words"))
    own = sentences.where("level = 0").join(quotes.select(*passage).distinct(), passage, "left_semi")  # what nobody quotes is left out
    first = own.groupBy("conv_id", *passage).agg(F.min("turn").alias("to_turn"))
    inside = quotes.join(first, ["conv_id", *passage]).where("to_turn < turn").groupBy(*at_level, "to_turn").agg(F.sum("words").alias("w"))
    inside = inside.groupBy(*at_level).agg(F.max(F.struct("w", "to_turn")).alias("best")).select(*at_level, F.col("conv_id").alias("to_conv"), "best.to_turn")
    timed = own.withColumn("time", F.lit(0)) if times is None else own.join(times, ["conv_id", "turn"])
    anywhere = timed.groupBy(*passage).agg(F.min(F.struct(F.col("time").isNull().alias("no_time"), "time", "turn", "conv_id")).alias("at"))
    left = quotes.join(inside.select(*at_level), at_level, "left_anti").join(anywhere, passage).where(F.col("at.conv_id") != F.col("conv_id"))
    outside = left.groupBy(*at_level, "at").agg(F.sum("words").alias("w")).where(F.col("w") >= LEAST_WORDS).groupBy(*at_level).agg(F.max_by("at", F.struct("w", "at")).alias("at"))
    found = inside.union(outside.select(*at_level, "at.conv_id", "at.turn"))
    return found.groupBy("conv_id", "turn").agg(F.min_by(F.struct("to_conv", "to_turn"), "level").alias("to")).select("conv_id", "turn", "to.to_conv", "to.to_turn")


def _roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of messages that reply within their conversation, by pointer doubling: log(depth) turns, each written."""
    up = stored(replies.where("to_conv = conv_id").select("conv_id", "turn", F.col("to_turn").alias("root"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        over = up.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        if up.join(over, ["conv_id", "root"], "left_semi").isEmpty():
            return up
        up = stored(up.join(over, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "replies")


def reply_ordered(messages: DataFrame, time: str | None = None) -> DataFrame:
    """One row for each message: conv_id, turn, role, text without quotes, quoted_lines, quote_levels, reply_to, linked_conv, linked_turn, root, depth, position.
    time: a column that tells when a message was written; it decides which conversation a passage comes from."""
    p = parsed(messages)
    quoted = p.where(F.exists("lines", lambda x: x["level"] > 0)).where("conv_id is not null and turn is not null")
    if quoted.isEmpty():  # nothing to look up: no message's sentences are needed
        replies = p.limit(0).select("conv_id", "turn", F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"))
        roots = replies.select("conv_id", "turn", F.col("turn").alias("root"), F.lit(0).cast("long").alias("depth"))
    else:
        times = None if time is None else messages.groupBy("conv_id", "turn").agg(F.min(time).alias("time"))
        replies = stored(_replies(_sentences(p.where("conv_id is not null and turn is not null")), times), "replies")
        roots = _roots(replies)
    count = F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long")
    most = F.greatest(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).cast("long")
    out = p.select("conv_id", "turn", "role", F.col("body").alias("text"), count.alias("quoted_lines"), most.alias("quote_levels"))
    out = out.join(replies.select("conv_id", "turn", F.when(F.col("to_conv") == F.col("conv_id"), F.col("to_turn")).alias("reply_to"), F.col("to_conv").alias("linked_conv"), F.col("to_turn").alias("linked_turn")), ["conv_id", "turn"], "left")
    out = out.join(roots, ["conv_id", "turn"], "left").withColumns({"root": F.coalesce("root", "turn"), "depth": F.coalesce("depth", F.lit(0).cast("long"))})
    return numbered(out, "conv_id", ["root", "turn", "role", "text"], "position")


def chat_lines(messages: DataFrame) -> DataFrame:
    """(conv_id, position, line): messages in reply order, formatted as "<|role|>" and the text without quotes."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("text"))
    return reply_ordered(messages).select("conv_id", "position", line.alias("line"))


def with_quotes(messages: DataFrame) -> DataFrame:
    """Messages of a table without quotes that quote each other, by a fixed rule, in the way mail does: of each four messages one quotes the message before it, one
    that and, a level deeper, the one before, one only that deeper level, and one none; every third conversation begins with a quote from the one before it."""
    one = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("t"))
    earlier = lambda k, name: one.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("t").alias(name))
    other = one.where("turn = 0").select((F.col("conv_id") + 1).alias("conv_id"), F.lit(0).alias("turn"), F.col("t").alias("t0"))
    m = messages.select("conv_id", "turn", "role", "text").join(earlier(1, "t1"), ["conv_id", "turn"], "left").join(earlier(2, "t2"), ["conv_id", "turn"], "left")
    m = m.join(other.withColumn("turn", F.col("turn").cast(messages.schema["turn"].dataType)), ["conv_id", "turn"], "left")
    quoted = lambda t, mark: F.concat(F.lit(mark), F.regexp_replace(t, "\r?\n", "\n" + mark), F.lit("\n"))
    rule = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    first, second = F.coalesce(quoted(F.col("t1"), "> "), F.lit("")), F.coalesce(quoted(F.col("t2"), "> > "), F.lit(""))
    start = F.when(F.pmod("conv_id", F.lit(3)) == 0, F.coalesce(quoted(F.col("t0"), "> "), F.lit(""))).otherwise("")
    lead = F.when(F.col("turn") == 0, start).when(rule == 1, first).when(rule == 2, F.concat(second, first)).when(rule == 3, second).otherwise("")
    return m.select("conv_id", "turn", "role", F.concat(lead, F.coalesce("text", F.lit(""))).alias("text"))
