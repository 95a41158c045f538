"""Quotation linking: conversations ordered by reply, without their quotes. DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, by_hot_and_cold, pick

#: Words that a quoted passage has at least if it is looked for within a message's text.
RUN_WORDS = 4
#: The marks at the start of a quoted line, and one space after them.
MARKS = r"^((?:[ \t]*>)+) ?"


def normalised(text: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def passage_key(text: Column) -> Column:
    """A hash of the normalised text; null if nothing is left of it."""
    plain = normalised(text)
    return F.when(plain != "", F.md5(plain))


def words_of(text: Column) -> Column:
    return F.filter(F.split(normalised(text), " "), lambda w: w != "")


def run_key(words: Column, start: Column, n: Column) -> Column:
    """The passage key of ``n`` words."""
    return F.md5(F.array_join(F.slice(words, start, n), " "))


def with_few(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``keys``, by broadcast if those are few: then a key that many rows hold moves none of them."""
    keys = keys.select(key).distinct()
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys, key, "left_semi")


def excerpts(scratch: Scratch, quotes: DataFrame, messages: DataFrame) -> DataFrame:
    """k, conv_id, turn: passages of ``RUN_WORDS`` words or more that are successive words of a message's own text.

    Lines may be broken anywhere in either. Each distinct own text is looked through
    once: where it has a passage's first words, the keys of runs of the lengths
    are made that passages with these first words have. So no passage meets a text in vain
    more often than such lengths number, whatever the number of equal passages, or of equal texts.
    """
    runs = scratch.keep(quotes.filter(F.col("n") >= RUN_WORDS).select("k", "n", "head").distinct())
    own = messages.select("conv_id", "turn", words_of(F.col("own_text")).alias("own")).filter(F.size("own") >= RUN_WORDS).withColumn("text", F.md5(F.array_join("own", " ")))
    texts = own.select("text", "own").dropDuplicates(["text"])
    heads = F.transform(F.sequence(F.lit(1), F.size("own") - (RUN_WORDS - 1)), lambda i: F.struct(i.alias("i"), run_key(F.col("own"), i, F.lit(RUN_WORDS)).alias("head")))
    met = with_few(texts.select("text", F.explode(heads).alias("at")).select("text", "at.*"), runs, "head")
    met = met.join(runs.select("head", "n").distinct(), "head").join(texts, "text").filter(F.col("i") + F.col("n") - 1 <= F.size("own"))
    held = with_few(met.select("text", run_key(F.col("own"), F.col("i"), F.col("n")).alias("k")).distinct(), runs, "k")
    return held.join(own.select("conv_id", "turn", "text"), "text").select("k", "conv_id", "turn")


def let(value: Column, f) -> Column:
    """f of the value, computed once however often f, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def passages(text: Column) -> Column:
    """The text as an array of (level, body): runs of lines of one quote level, in order, marks taken off.

    Level 0 is the message's own. All in the row, in time proportional to its length: nothing is shuffled.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")))

    def starts(line: Column) -> Column:
        changed = lambda i: F.element_at(line, i)["level"] != F.element_at(line, F.greatest(i - 1, F.lit(1)))["level"]
        return F.filter(F.sequence(F.lit(1), F.size(line)), lambda i: (i == 1) | changed(i))

    def runs(line: Column, start: Column) -> Column:
        def run(i: Column, k: Column) -> Column:
            end = F.coalesce(F.get(start, k + 1), F.size(line) + 1)
            return F.struct(F.element_at(line, i)["level"].alias("level"), F.array_join(F.transform(F.slice(line, i, end - i), lambda x: x["body"]), "\n").alias("body"))

        return F.transform(start, run)

    return let(lines, lambda line: let(starts(line), lambda start: runs(line, start)))


def link_quotations(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """One row for each message of (conv_id, turn, role, text), in a place of its thread.

    conv_id, turn, role; own_text (without quoted lines, trimmed at the ends);
    quote_depth (highest level); n_quotes (quoted passages with a word),
    n_linked (those found in an earlier message); parent_conv_id, parent_turn;
    thread_conv_id, thread_turn (the message that the chain of parents begins
    with) and depth (steps to it).

    * A quoted passage is looked up by the hash of its normalised text among the
      messages' own texts: whole ones, paragraphs (runs without an empty line)
      and single lines; one of ``RUN_WORDS`` words or more also among all runs of successive own
      words, so that excerpts, answers between quotes and lines broken anew are found. If several earlier messages hold it, the
      first of the same conversation is meant, else the first of all.
      Earlier means a smaller (conv_id, turn).
    * The parent is the origin of the first linked passage of the lowest level;
      without one, the message of the turn before; else there is none. Parents are
      always earlier, so chains end.
    * Parents before replies: order by thread_conv_id, thread_turn, conv_id, turn.
      ``reply_ordered`` does.

    Null text counts as empty, with no own text or quotes. Messages with a null
    conv_id or turn are threads of their own and origin of none. Rows that
    repeat conv_id and turn stay, each with what it quotes; as a parent
    they are one. An empty table gives no rows.
    """
    scratch = Scratch(spark)
    m = pick(messages, conv_id="long", turn="long", role="string", text="string")
    m = m.withColumn("parts", passages(F.coalesce("text", F.lit(""))))
    own = F.array_join(F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["body"]), "\n")
    words = lambda p: let(words_of(p["body"]), lambda w: F.struct(F.size(w).alias("n"), run_key(w, F.lit(1), F.lit(RUN_WORDS)).alias("head")))
    quoted = F.filter(F.transform("parts", lambda p, i: F.struct(p["level"].alias("level"), i.alias("i"), passage_key(p["body"]).alias("k"), words(p).alias("w"))), lambda q: (q["level"] > 0) & q["k"].isNotNull())
    m = m.select("conv_id", "turn", "role", F.regexp_replace(own, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("own_text"), F.array_max(F.transform("parts", lambda p: p["level"])).alias("quote_depth"), quoted.alias("quotes"))
    m = scratch.keep(m.withColumn("row", F.monotonically_increasing_id()))

    # What is quoted, and the first message of each conversation, and of all, that says it itself.
    quotes = scratch.keep(m.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND size(quotes) > 0").select("row", "conv_id", "turn", F.explode("quotes").alias("q")).select("row", "conv_id", "turn", "q.level", "q.i", "q.k", "q.w.*"))
    units = F.array_union(F.array(F.col("own_text")), F.array_union(F.split("own_text", r"\n[\x20\x09-\x0D]*\n"), F.split("own_text", "\n")))
    known = m.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    said = known.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(units, passage_key))).alias("k"))
    said = with_few(said, quotes, "k").unionByName(excerpts(scratch, quotes, known)).groupBy("k", "conv_id").agg(F.min("turn").alias("turn"))
    said = scratch.keep(said)
    # A passage may be quoted by a third of all messages, in one conversation too: joins by size of the key.
    first = said.groupBy("k").agg(F.min(F.struct("conv_id", "turn")).alias("there"))
    first = scratch.keep(first.join(quotes.groupBy("k").agg(F.count("*").alias("n_quotes")), "k"))
    linked = by_hot_and_cold(quotes, first, "k", "n_quotes").drop("n_quotes")
    linked = scratch.keep(linked.withColumn("kc", F.md5(F.concat_ws(":", "k", "conv_id"))))
    here = said.select(F.md5(F.concat_ws(":", "k", "conv_id")).alias("kc"), F.col("turn").alias("here_turn"))
    here = scratch.keep(linked.groupBy("kc").agg(F.count("*").alias("n_here")).join(here, "kc", "left"))
    linked = by_hot_and_cold(linked, here, "kc", "n_here").drop("kc", "n_here")
    origin = F.when(F.col("here_turn") < F.col("turn"), F.struct("conv_id", F.col("here_turn").alias("turn"))).when(F.col("there.conv_id") < F.col("conv_id"), F.col("there"))
    linked = linked.withColumn("origin", origin).filter("origin IS NOT NULL")
    linked = linked.groupBy("row").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", "i", "origin"))["origin"].alias("origin"))

    before = m.filter("conv_id IS NOT NULL").select("conv_id", (F.col("turn") + 1).alias("turn"), F.struct("conv_id", "turn").alias("previous")).filter("turn IS NOT NULL").dropDuplicates(["conv_id", "turn"])
    m = m.join(linked, "row", "left").join(before, ["conv_id", "turn"], "left")
    m = scratch.keep(m.withColumn("parent", F.coalesce("origin", "previous")).drop("origin", "previous"))

    # Each message knows an ancestor and how far it is; the distance doubles each round, until it is the root.
    node = F.struct("conv_id", "turn")
    up = m.filter("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy(node.alias("node")).agg(F.min("parent").alias("up"))
    up = scratch.keep(up.select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("up").isNull().alias("done")))
    while not up.filter("not done").isEmpty():
        # Many messages may have one ancestor.
        waiting = up.filter("not done")
        via = waiting.groupBy("up").agg(F.count("*").alias("n_below")).join(up.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("done").alias("done2")), "up")
        moved = by_hot_and_cold(waiting, scratch.keep(via), "up", "n_below")
        moved = moved.select("node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("done2").alias("done"))
        up = scratch.keep(up.filter("done").unionByName(moved))
    root = up.select(F.col("node.conv_id").alias("conv_id"), F.col("node.turn").alias("turn"), F.col("up").alias("root"), F.col("steps").alias("depth"))
    # A row's own parent decides; rows that repeat a turn may differ from it in theirs.
    out = m.join(root, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "own_text", "quote_depth", F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.col("parent.conv_id").alias("parent_conv_id"), F.col("parent.turn").alias("parent_turn"),
        F.coalesce("root.conv_id", "conv_id").alias("thread_conv_id"), F.coalesce("root.turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )


def reply_ordered(linked: DataFrame) -> DataFrame:
    """The conversations: threads one after another, parents before replies; a sort by range, whatever a thread's size."""
    return linked.orderBy("thread_conv_id", "thread_turn", "conv_id", "turn", "own_text")
