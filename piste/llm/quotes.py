"""Quotation linking, in DataFrame functions only.

A message's lines are parsed into levels by their leading ``>`` marks.  Lines of level 0 are its
own text; runs of quoted lines of one level are passages.  Text is normalised (white space, case)
and hashed by sentence, line, paragraph and run, so re-wrapped and partly quoted passages and
unpunctuated lines still match.  Every quoted unit is joined to its original: the first message of
the same conversation that says it as its own text, if that is earlier, else the first one of the
least other conversation.

A message answers the message of its conversation from which most of its level 1 units come
(ties: the later one), if that is earlier; without such a quote, the message before it; the first
one answers nothing, or a message of another conversation that it quotes.  Threads are the trees of
these answers.

Rows equal in conversation, turn, role and text are one message, with their number in ``copies``.
A null conversation is a conversation of its own.  Messages without a turn quote and are quoted,
stand outside the order, each a thread of its own, and answer nothing.  Null text counts as empty;
lines of any length and any number of marks are parsed; other columns, of any name, are ignored.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piste.llm.common import discard, staged

#: Blanks and marks at a line's start; marks stand at most three blanks apart, the first one too.
LEAD = r"^[\s>]*+"
APART = r"\s{4}"
BLOCK = 1024  # turns of a conversation that one window holds
#: Shorter normalised units ("ok", "thanks") are linked inside a conversation only, as they say nothing
#: about which other one they come from.
LEAST_CHARS = 12
#: Where sentences end: marks of several scripts before white space, and those that need none.
ENDS = r"(?<=[.!?\u2026\u061f\u06d4\u0964\u0965\u1362]) |(?<=[\u3002\uff01\uff1f\uff61])"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def marks(line: Column) -> Column:
    """The leading quote marks with the blanks before and between them.  No pattern repeats a group,
    so a line of any number of marks is parsed in constant stack."""
    near = F.split(F.regexp_extract(line, LEAD, 0), APART, 2)[0]
    return F.regexp_extract(near, r"^[\s>]*>", 0)


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(marks(line), r"\s+", ""))


def unmarked(line: Column) -> Column:
    """The line without its quote marks and the blank after them."""
    rest = F.substring(line, F.length(marks(line)) + 1, F.length(line))
    return F.when(marks(line) == "", line).otherwise(F.regexp_replace(rest, r"^\s", ""))


def own_text(text: str | Column) -> Column:
    """The message without its quoted lines and the blank lines left at its ends."""
    text = F.col(text) if isinstance(text, str) else text
    own = F.filter(_lines(text), lambda line: marks(line) == "")
    return F.when(text.isNotNull(), F.btrim(F.array_join(own, "\n"), F.lit(" \t\n")))


def _runs(messages: DataFrame) -> DataFrame:
    """The messages with ``runs``: structs (depth, text) of neighbouring lines of one level, 0 for own lines."""
    lines = F.transform(_lines(F.col("text")), lambda line: F.struct(level(line).alias("depth"), unmarked(line).alias("text")))
    starts = F.expr("filter(sequence(1, size(lines)), i -> i = 1 or lines[i - 1].depth <> lines[i - 2].depth)")
    runs = F.expr("""transform(starts, (s, k) -> struct(lines[s - 1].depth as depth,
        array_join(transform(slice(lines, s, coalesce(get(starts, k + 1), size(lines) + 1) - s), x -> x.text), '\n') as text))""")
    return messages.withColumn("lines", lines).withColumn("starts", starts).withColumn("runs", runs).drop("lines", "starts")


def _units(texts: Column) -> Column:
    """Structs (hash, long) of the passages ``texts``, their paragraphs and lines, and the sentences in
    each of these; ``long``: of ``LEAST_CHARS`` or more."""
    parts = F.flatten(F.transform(texts, lambda t: F.concat(F.array(t), F.split(t, r"\n\s*\n"), F.split(t, r"\n"))))
    plain = F.array_distinct(F.transform(parts, lambda t: F.lower(F.btrim(F.regexp_replace(t, r"\s+", " ")))))
    said = F.flatten(F.transform(plain, lambda t: F.concat(F.array(t), F.transform(F.split(t, ENDS), lambda s: F.btrim(s)))))
    said = F.array_distinct(F.filter(said, lambda s: s != ""))
    return F.transform(said, lambda s: F.struct(F.xxhash64(s).alias("hash"), (F.length(s) >= LEAST_CHARS).alias("long")))


def _at(depth: Column) -> Column:
    return F.transform(F.filter("runs", lambda r: r["depth"] == depth), lambda r: r["text"])


def quoted(messages: DataFrame) -> DataFrame:
    """(id, conv_id, turn, depth, hash, long): every quoted unit, its quote level and its hash.

    Units are those of the runs of quoted lines, so a sentence may span lines, and of all lines of a
    level together, for a passage that other levels interrupt.
    """
    runs = _runs(messages.where(F.col("text").contains(">")))
    depths = F.array_distinct(F.filter(F.transform("runs", lambda r: r["depth"]), lambda d: d > 0))
    each = runs.select("id", "conv_id", "turn", "runs", F.explode(depths).alias("depth")).withColumn("texts", _at(F.col("depth")))
    units = _units(F.concat("texts", F.array(F.array_join("texts", "\n"))))
    return each.select("id", "conv_id", "turn", "depth", F.explode(units).alias("u")).select("id", "conv_id", "turn", "depth", "u.*")


def _conv(c: str = "conv_id") -> Column:
    """A join key in which a null conversation equals itself."""
    return F.struct(F.col(c).isNull().alias("none"), F.coalesce(c, F.lit(0)).alias("conv"))


def links(messages: DataFrame) -> DataFrame:
    """(id, turn, depth, source, source_turn, same, sentences): quoted message per quoting message and
    level; ``same``: of the same conversation.

    Originals are reduced to the first sayer per hash and conversation before any join, and to the two
    least conversations per hash, so a sentence that a third of all messages say or quote joins many
    to one, and a hash of the own conversation is still found in another one.
    """
    asked = staged(quoted(messages), "quoted")
    units = _units(F.concat(_at(F.lit(0)), F.array(F.col("own"))))
    said = (_runs(messages.where(F.col("own") != "")).select("id", "conv_id", "turn", F.explode(F.transform(units, lambda u: u["hash"])).alias("hash"))
            .join(asked.select("hash").distinct(), "hash", "left_semi"))
    who = F.struct(F.col("turn").isNull().alias("unplaced"), "turn", "id")
    here = staged(said.groupBy(_conv().alias("c"), "hash").agg(F.min(who).alias("here")), "said")
    place = F.struct("c", F.col("here").alias("w"))
    first = here.groupBy("hash").agg(F.min(place).alias("first"))
    second = here.join(first, "hash").where(F.col("c") != F.col("first.c")).groupBy("hash").agg(F.min(place).alias("second"))
    found = (asked.withColumn("c", _conv()).join(here, ["c", "hash"], "left").join(first, "hash", "left").join(second, "hash", "left")
             .withColumn("other", F.when(F.col("first.c") != F.col("c"), F.col("first.w")).otherwise(F.col("second.w"))))
    earlier = F.coalesce(F.col("here.turn") < F.col("turn"), F.lit(False))
    elsewhere = F.col("other").isNotNull() & F.col("long")
    return (found.withColumn("same", earlier)
            .withColumn("source", F.when(earlier, F.col("here.id")).when(elsewhere, F.col("other.id")))
            .withColumn("source_turn", F.when(earlier, F.col("here.turn")).when(elsewhere, F.col("other.turn")))
            .where("source is not null").groupBy("id", "depth", "source", "source_turn", "same").agg(F.count("*").alias("sentences")))


def _ranked(rows: DataFrame) -> DataFrame:
    """(id, previous, place) of rows (id, turn, k): the row before by (turn, id) among those of the same
    ``k``, and how many are before.

    Windows hold ``BLOCK`` turns; the first row of a block takes the last one of the block before, and
    the numbers of the blocks before are added up.
    """
    placed = rows.select("id", "turn", "k", F.floor(F.col("turn") / BLOCK).alias("block"))
    inside, blocks = Window.partitionBy("k", "block").orderBy("turn", "id"), Window.partitionBy("k").orderBy("block")
    own = placed.withColumns({"previous": F.lag("id").over(inside), "own": F.row_number().over(inside) - 1})
    ends = placed.groupBy("k", "block").agg(F.max(F.struct("turn", "id"))["id"].alias("last"), F.count("*").alias("n"))
    ends = ends.select("k", "block", F.lag("last").over(blocks).alias("end"),
                       F.coalesce(F.sum("n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return own.join(ends, ["k", "block"]).select("id", F.coalesce("previous", "end").alias("previous"), (F.col("ahead") + F.col("own")).alias("place"))


def _jumped(pointers: DataFrame, tag: str) -> DataFrame:
    """(id, to): every pointer followed to its end, by doubling; a row that points to itself is an end."""
    now = staged(pointers, tag)
    while True:
        after = now.alias("a").join(now.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", F.col("b.to").alias("to"), (F.col("a.to") != F.col("b.to")).alias("moved"))
        after = staged(after, tag)
        discard(now)
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")
        now._staged_path = after._staged_path


def tree_order(nodes: DataFrame) -> DataFrame:
    """(id, thread, place): each message of the reply trees (id, parent, turn) with its tree's root and
    its place in reply order: a message, then all that answers it, answers by (turn, id).

    The order is a linked list: after a message comes its first answer, or else the next sibling of
    the nearest message above that has one.  That message is found, and the list ranked, by pointer
    doubling: a join a round, as many rounds as the logarithm of the longest chain.
    """
    nodes = staged(nodes, "trees")
    answers = nodes.where("parent is not null").select("id", "turn", F.col("parent").alias("k"))
    beside = staged(_ranked(answers).select("id", "previous"), "siblings")
    following = beside.where("previous is not null").select(F.col("previous").alias("id"), F.col("id").alias("sibling"))
    first = beside.where("previous is null").join(answers.select("id", "k"), "id").select(F.col("k").alias("id"), F.col("id").alias("child"))
    known = staged(nodes.select("id", "parent").join(following, "id", "left").join(first, "id", "left"), "siblings")
    upward = known.select("id", F.when(F.col("sibling").isNotNull() | F.col("parent").isNull(), F.col("id")).otherwise(F.col("parent")).alias("to"))
    up = _jumped(upward, "up")
    beyond = known.select(F.col("id").alias("to"), F.col("sibling").alias("beyond"))
    after = known.select("id", "child").join(up, "id").join(beyond, "to").select("id", F.coalesce("child", "beyond").alias("next"))
    listed = staged(after.select("id", F.coalesce("next", "id").alias("to"), F.col("next").isNotNull().cast("bigint").alias("left")), "list")
    while True:
        a, b = listed.alias("a"), listed.alias("b")
        jumped = a.join(b, F.col("a.to") == F.col("b.id")).select(
            "a.id", F.col("b.to").alias("to"), (F.col("a.left") + F.when(F.col("a.to") == F.col("a.id"), F.lit(0)).otherwise(F.col("b.left"))).alias("left"),
            (F.col("a.to") != F.col("b.to")).alias("moved"))
        jumped = staged(jumped, "list")
        discard(listed)
        listed = jumped.drop("moved")
        listed._staged_path = jumped._staged_path
        if jumped.where("moved").isEmpty():
            break
    heads = listed.groupBy("to").agg(F.max(F.struct("left", "id")).alias("head"))
    return listed.join(heads, "to").select("id", F.col("head.id").alias("thread"), (F.col("head.left") - F.col("left")).alias("place"))


def conversations(messages: DataFrame, across: bool = False) -> DataFrame:
    """One row per message: conv_id, turn, role, own (text without quotes), copies, id, parent (id of
    the message answered), by ('quote', 'turn' or null), thread (id of the message that it all
    answers in the end), place (from 0, in the thread's reply order), quoted (ids of all messages
    quoted), laid out by thread and place.

    In reply order a message stands before what answers it, directly and through others, and these
    stand before the next answer to an earlier message.  With ``across`` the first message of a
    conversation answers the message of a conversation of lesser id that it quotes most, which joins
    the two threads; the lesser id keeps threads free of cycles.
    """
    base = (messages.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
            .withColumn("id", F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}), 256).substr(1, 32))
            .withColumn("own", F.coalesce(own_text("text"), F.lit(""))))
    base = staged(base, "messages")
    found = staged(links(base), "links")
    answered = (found.where("depth = 1 and same").groupBy("id")
                .agg(F.max(F.struct("sentences", "source_turn", "source"))["source"].alias("by_quote")))
    placed = base.where("turn is not null").select("id", "turn", _conv().alias("k"))
    before = staged(_ranked(placed), "places")
    linked = before.join(answered, "id", "left")
    if across:
        own, theirs = placed.select("id", F.col("k").alias("own")), placed.select(F.col("id").alias("source"), F.col("k").alias("theirs"))
        other = found.where("depth = 1 and not same").join(before.where("previous is null").select("id"), "id", "left_semi")
        other = other.join(own, "id").join(theirs, "source").where("theirs < own")
        other = other.groupBy("id").agg(F.min(F.struct(-F.col("sentences"), F.col("source")))["source"].alias("of_other"))
        linked = linked.join(other, "id", "left").withColumn("by_quote", F.coalesce("by_quote", "of_other")).drop("of_other")
    linked = staged(linked.withColumn("parent", F.coalesce("by_quote", "previous")).withColumn(
        "by", F.when(F.col("by_quote").isNotNull(), "quote").when(F.col("previous").isNotNull(), "turn")).drop("by_quote"), "parents")
    # conversations in which every message answers the one before are in order already
    bent = linked.where(~F.col("parent").eqNullSafe(F.col("previous"))).select("id", "parent")
    keys = bent.select("id").unionByName(bent.select(F.col("parent").alias("id"))).join(placed, "id").select("k").distinct()
    keys = staged(keys, "bent")
    straight = placed.join(keys, "k", "left_anti").join(linked.select("id", "place"), "id")
    opening = straight.groupBy("k").agg(F.min_by("id", F.struct("turn", "id")).alias("thread"))
    order = straight.join(opening, "k").select("id", "thread", "place")
    if not keys.isEmpty():
        trees = placed.join(keys, "k", "left_semi").select("id", "turn").join(linked.select("id", "parent"), "id")
        order = order.unionByName(tree_order(trees))
    cited = found.groupBy("id").agg(F.array_sort(F.collect_set("source")).alias("quoted"))
    rows = base.drop("text").join(linked.select("id", "parent", "by"), "id", "left").join(order, "id", "left").join(cited, "id", "left")
    rows = rows.withColumns({"thread": F.coalesce("thread", "id"), "place": F.coalesce("place", F.lit(0).cast("bigint"))})
    roots = base.select(F.col("id").alias("thread"), F.col("conv_id").alias("root"))
    rows = rows.join(roots, "thread")
    return (rows.repartitionByRange("root", "thread", "place").sortWithinPartitions("root", "thread", "place")
            .select("conv_id", "turn", "role", "own", "copies", "id", "parent", "by", "thread", "place", "quoted"))
