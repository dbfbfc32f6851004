"""Quotation linking: reply-ordered conversations without quotes.

Lines that begin with ``>`` marks are quotes; the number of marks is the level.
Quoted passages (runs of lines of one level, else their lines) are normalised and
hashed, and joined to the earliest message of the conversation that wrote them
itself. The message quoted at the lowest linked level is the one replied to.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_total, saved

#: Quote marks of a line: ``>`` with optional blanks between them.
MARKS = r"^[ \t]*((?:>[ \t]?)*)"
#: "Ana wrote:" and the like, which introduce a quote (fixed forms in four languages).
INTRO = r"(?i)^\s*\S.{0,200}\b(?:wrote|writes|schrieb|schreibt|escribió|écrit|a écrit)\s*:\s*$"


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def unquoted(line: Column) -> Column:
    return F.regexp_replace(line, MARKS, "")


def normalised(line: Column) -> Column:
    """Lower case, runs of characters other than letters and digits as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(unquoted(line)), r"[^\p{L}\p{N}]+", " "))


def message_lines(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, run, part, passage`` for every line of every
    message whose normalised form is not empty: hashes of the run of lines of one
    level, of its part up to a blank line, and of the line, each normalised and
    without regard to where lines break."""
    def pieces(of: str) -> Column:
        end = lambda k: F.coalesce(F.get("starts", k + 1), F.size(of))
        return F.explode(F.transform("starts", lambda s, k: F.slice(of, s + 1, end(k) - s)))

    def starts(of: str, new) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(of) - 1), lambda i: (i == 0) | new(F.get(of, i - 1), F.get(of, i)))

    def hashed(keys: Column) -> Column:
        return F.md5(F.array_join(F.filter(keys, lambda k: k != ""), " "))

    lines = F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r")
    marked = messages.select("conv_id", "turn", F.transform(
        lines, lambda x: F.struct(quote_level(x).alias("level"), normalised(x).alias("key"))).alias("lines"))
    runs = (marked.withColumn("starts", starts("lines", lambda a, b: a["level"] != b["level"]))
            .select("conv_id", "turn", pieces("lines").alias("lines"))
            .select("conv_id", "turn", F.get("lines", F.lit(0))["level"].alias("level"), F.col("lines.key").alias("keys")))
    parts = (runs.withColumns({"run": hashed(F.col("keys")), "starts": starts("keys", lambda a, b: a == "")})
             .select("conv_id", "turn", "level", "run", pieces("keys").alias("keys")))
    return (parts.select("conv_id", "turn", "level", "run", hashed(F.col("keys")).alias("part"), F.explode("keys").alias("key"))
            .where("key != ''").withColumn("passage", F.md5("key")).drop("key"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, source_turn, n_lines``: how many quoted lines of a
    level of a message were first written by an earlier message of the conversation.

    A run of quoted lines of one level goes as a whole to the first message that
    has it as its own text (a run, a part or a line), else part by part between
    blank lines, else line by line. Matched by hash within the conversation (one
    row a passage), never pair by pair.
    """
    lines = message_lines(messages).where("conv_id is not null and turn is not null")
    hashes = F.array("run", "part", "passage")
    own = (lines.where("level = 0").select("conv_id", "turn", F.explode(F.array_distinct(hashes)).alias("hash"))
           .groupBy("conv_id", "hash").agg(F.min("turn").alias("source_turn")))
    line = ["conv_id", "turn", "level", "run", "part", "passage"]
    quoted = lines.where("level > 0").groupBy(line).agg(F.count("*").alias("n")).select(
        "*", F.posexplode(hashes).alias("rank", "hash"))
    return (quoted.join(own, ["conv_id", "hash"]).where("source_turn < turn")
            .groupBy(line).agg(F.max("n").alias("n"), F.min(F.struct("rank", "source_turn")).alias("m"))
            .groupBy("conv_id", "turn", "level", F.col("m.source_turn").alias("source_turn"))
            .agg(F.sum("n").alias("n_lines")))


def _without_quotes(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r")
    kept = F.filter(lines, lambda x, i: (quote_level(x) == 0) & ~(
        x.rlike(INTRO) & (quote_level(F.coalesce(F.get(lines, i + 1), F.lit(""))) > 0)))
    # texts without a mark stay as they are
    return F.when(F.coalesce(text, F.lit("")).contains(">"), F.trim(F.array_join(kept, "\n"))).otherwise(
        F.coalesce(text, F.lit("")))


def thread(messages: DataFrame) -> DataFrame:
    """Return one row per message: ``conv_id, turn, role, reply_to, root, depth,
    n_quoted, max_level, position, text, formatted``.

    ``reply_to`` is the turn that most quoted lines of the first level come from
    (ties: the latest), or of the next level if none of that level is linked, and
    ``n_quoted`` the linked lines of that level; else it is the latest earlier turn of the conversation that the table
    holds, NULL for the first. ``root`` is the first turn of the thread: quotes
    lead to their source's thread, a message without linked quotes goes on with
    the thread before it; ``depth`` counts its replies from the root.
    ``position`` numbers a conversation's messages from 0 by (root, turn).
    ``formatted`` is ``<|role|>``, a line feed and the text without quotes.
    NULL text counts as empty, a NULL role as ``user``. Rows with NULL conv_id
    or turn are conversations of their own (no reply, root turn, depth and
    position 0). Repeated (conv_id, turn) rows share their links and stand next
    to each other. An empty table gives no rows.
    """
    marked = messages.select("conv_id", "turn", "role", "text")
    turns = saved(marked.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct(), "chat-turns")
    linked = (link_quotes(marked).groupBy("conv_id", "turn", "level")
              .agg(F.max(F.struct("n_lines", "source_turn")).alias("m"), F.sum("n_lines").alias("n_quoted"))
              .groupBy("conv_id", "turn").agg(F.min(F.struct("level", "m", "n_quoted")).alias("first"))
              .select("conv_id", "turn", F.col("first.m.source_turn").alias("quoted_turn"), F.col("first.n_quoted").alias("n_quoted")))
    parents = saved(_previous(turns).join(linked, ["conv_id", "turn"], "left")
                    .withColumn("reply_to", F.coalesce("quoted_turn", "previous")), "chat-parents")
    rooted = _roots(parents)
    return _formatted(marked, rooted)


def _previous(turns: DataFrame) -> DataFrame:
    """Add the next smaller turn of the conversation, by blocks of turns."""
    block = F.shiftright("turn", 8)
    t = turns.withColumn("block", block)
    inside = F.lag("turn").over(Window.partitionBy("conv_id", "block").orderBy("turn"))
    ends = (t.groupBy("conv_id", "block").agg(F.max("turn").alias("end"))
            .withColumn("before", F.lag("end").over(Window.partitionBy("conv_id").orderBy("block"))).drop("end"))
    return (t.withColumn("inside", inside).join(ends, ["conv_id", "block"])
            .withColumn("previous", F.coalesce("inside", "before")).select("conv_id", "turn", "previous"))


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``reply_to`` to the thread's root by pointer doubling. A message
    whose parent is merely the one before it belongs to that one's thread, so
    only conversations with a linked quote need more than one thread."""
    split = parents.where("n_quoted is not null").select("conv_id").distinct()
    plain = parents.join(split, "conv_id", "left_anti")
    first = plain.groupBy("conv_id").agg(F.min("turn").alias("root"))
    straight = _numbered(plain.select("conv_id", "turn", "reply_to", "n_quoted"), "depth").join(first, "conv_id")
    far = saved(parents.join(split, "conv_id", "left_semi")
                .select("conv_id", "turn", "reply_to", "n_quoted", F.coalesce("reply_to", "turn").alias("root"),
                        F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long").alias("depth")), "chat-roots")
    longest = far.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(longest, 2)))):
        step = far.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        far = saved(far.join(step, ["conv_id", "root"])
                    .select("conv_id", "turn", "reply_to", "n_quoted", F.col("next").alias("root"),
                            (F.col("depth") + F.col("more")).alias("depth")), "chat-roots")
    return straight.select(*far.columns).unionByName(far)


def _numbered(rows: DataFrame, out: str) -> DataFrame:
    """Number the turns of a conversation from 0, by blocks of turns."""
    with_block = rows.withColumns({"_block": F.shiftright("turn", 8), "_one": F.lit(1).cast("long")})
    return running_total(with_block, "conv_id", "_block", [F.col("turn")], "_one", out).drop("_block", "_one")


def _formatted(messages: DataFrame, rooted: DataFrame) -> DataFrame:
    counts = (messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn")
              .agg(F.count("*").alias("_rows")))
    sized = rooted.join(counts, ["conv_id", "turn"])
    # positions by (root, turn): whole threads first, then turns within a thread
    threads = sized.groupBy("conv_id", "root").agg(F.sum("_rows").alias("_in_thread"))
    threads = threads.withColumn("_part", F.shiftright("root", 8))
    starts = running_total(threads, "conv_id", "_part", [F.col("root")], "_in_thread", "_start").select(
        "conv_id", "root", "_start")
    keyed = sized.withColumns({"_thread": F.struct("conv_id", "root"), "_part": F.shiftright("turn", 8)})
    placed = (running_total(keyed, "_thread", "_part", [F.col("turn")], "_rows", "_in")
              .join(starts, ["conv_id", "root"])
              .withColumn("_at", F.col("_start") + F.col("_in"))
              .drop("_thread", "_part", "_rows", "_start", "_in"))
    level = F.array_max(F.transform(F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r"), quote_level))
    clean = messages.withColumns({"max_level": level, "text": _without_quotes(F.col("text")),
                                  "role": F.coalesce("role", F.lit("user"))})
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    tied = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1
    placed = (clean.where(whole).withColumn("_tied", tied).join(placed, ["conv_id", "turn"])
              .withColumn("position", F.col("_at") + F.col("_tied")))
    nothing = F.lit(None).cast("long")
    loose = clean.where(~whole).withColumns({"reply_to": nothing, "root": F.col("turn"), "depth": nothing,
                                             "n_quoted": nothing, "position": nothing})
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (placed.unionByName(loose, allowMissingColumns=True)
            .select("conv_id", "turn", "role", "reply_to", "root", zero("depth"), zero("n_quoted"), "max_level",
                    zero("position"), "text",
                    F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text")).alias("formatted")))
