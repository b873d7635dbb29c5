"""Quotation linking: messages to the messages they quote, in reply order.

A line that starts with ``>`` signs is quoted at that level.  Quoted lines are
parsed into passages (runs of one level); each is normalised (case, white space,
markers) and hashed: whole, by paragraphs, by lines and by neighbouring lines.
Originals are hashed the same way, so a passage meets its original, or the part of
it that it quotes, in an equi-join on two 64-bit hashes; a table of bits of fixed size
keeps pieces that nobody quotes from moving.  Every message that holds a piece is a
candidate, those of other conversations and earlier turns of the own.  A passage links
to the one that holds all of it, else most of its pieces; among equals the own
conversation's last comes first, then the one of smallest (conv_id, turn).

Pieces that many messages hold are not joined with all of them.  Messages met on rarer
pieces are counted in whole, common pieces included.  Only where a message that holds
nothing but common pieces could do as well are those looked at, as sets: messages with
the same common pieces are one set, passages too, and sets are joined with sets; of a set
the smallest places of two conversations and, inside the passage's conversation, the last
one before it are all that can win.  Every passage keeps its link (``links``); a reply's
parent is the original of its shallowest one.

Conversations that quote each other, in any passage, form a thread.  Of the
conversations that one quotes, it follows the one of smallest id; its depth is one
more than that one's.  Depths come from pointer doubling, so a chain of N
conversations takes log N rounds; a cycle of conversations is cut before its
smallest id.  Inside a thread messages are ordered by depth, conversation, turn.
Output is one row a message, without its quotes, so no conversation is gathered in
one row or task.

Null texts count as empty and quote nothing; nulls in role give ``user``; rows
that repeat (conv_id, turn) stay and are ordered by role and text; messages without
conv_id or turn stay (those without conv_id as one thread without id) and link with
nothing; passages of any length link alike; a message never links to itself or a later
turn of its own conversation.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, table
from coppice.llm.ngram_join import bits_set, sieve
from coppice.operators.components import connected_components
from coppice.session import forget, save, ship, spread

COMMON = 64  # messages that hold a piece; more of it: more candidates are counted one by one
SIEVE_BITS = 26
MARKS = re.compile(r"(?:\s{0,3}>)*")
BLANKS = re.compile(r"[\s>]+")
LINE_ENDS, LINE_BREAKS, PARAGRAPHS = re.compile(r"\r?\n"), re.compile(r"\n+"), re.compile(r"\n\s*\n")
PASSAGE = ("conv_id", "turn", "_m", "pos", "level")


def normalised(text: str) -> str:
    return BLANKS.sub(" ", text.lower()).strip()


def split_message(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message's own lines, and its quoted passages (level, text) in order."""
    own, runs, last = [], [], 0
    for line in LINE_ENDS.split(text or ""):
        marks = MARKS.match(line)[0]
        level, rest = marks.count(">"), line[len(marks) :]
        if level == 0:
            own.append(rest)
        elif level == last:
            runs[-1][1].append(rest)
        else:
            runs.append((level, [rest]))
        last = level
    return "\n".join(own).strip(), [(level, "\n".join(lines)) for level, lines in runs]


def pieces(text: str) -> dict[str, bool]:
    """The whole text (true), its paragraphs, lines and neighbouring lines."""
    whole = normalised(text)
    if not whole:
        return {}
    lines = [x for x in map(normalised, LINE_BREAKS.split(text)) if x]
    parts = [*map(normalised, PARAGRAPHS.split(text)), *lines, *(f"{x}\n{y}" for x, y in zip(lines, lines[1:], strict=False))]
    return {x: x == whole for x in (whole, *parts) if x}


def hashed(found: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each text."""
    whole = b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "replace")) for x in found)
    return np.frombuffer(whole, ">i8").astype(np.int64).reshape(-1, 2)


def parse(messages: DataFrame) -> DataFrame:
    """Messages with ``body`` (no quotes) and ``quotes`` (passages) in place of the text, and ``_m``, the text's hash."""
    kinds = dict(messages.dtypes)
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, _m long, body string, quotes array<struct<level:int,body:string>>"
    quote = pa.list_(pa.struct([("level", pa.int32()), ("body", pa.string())]))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [split_message(t) for t in batch.column(4).to_pylist()]
        quotes = [[{"level": level, "body": x} for level, x in found] for _, found in split]
        arrays = [*batch.columns[:4], pa.array([body for body, _ in split], pa.string()), pa.array(quotes, quote)]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", "turn", "role", "_m", "body", "quotes"])

    return arrow_map(messages.select("conv_id", "turn", "role", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_m"), "text"), one, schema)


def asked_pieces(parsed: DataFrame) -> DataFrame:
    """Rows (passage, a, b, whole) of every quoted passage's pieces."""
    kinds = dict(parsed.dtypes)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, texts, flags = [], [], []
        for r, text in enumerate(batch.column(5).to_pylist()):
            for x, whole in pieces(text).items():
                rows.append(r)
                texts.append(x)
                flags.append(whole)
        taken = batch.select(range(5)).take(pa.array(rows, pa.int64()))
        arrays = [*taken.columns, *(pa.array(x.copy()) for x in hashed(texts).T), pa.array(flags, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, [*PASSAGE, "a", "b", "whole"])

    quoted = parsed.where("size(quotes) > 0 and conv_id is not null and turn is not null")
    passage = quoted.select("conv_id", "turn", "_m", F.posexplode("quotes").alias("pos", "q")).select("conv_id", "turn", "_m", "pos", "q.level", "q.body")
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, _m long, pos int, level int, a long, b long, whole boolean"
    return arrow_map(passage, one, schema).distinct()


def held_pieces(parsed: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, a, b) of the pieces of messages that somebody quotes."""
    places = [F.shiftrightunsigned(c, 64 - SIEVE_BITS) for c in ("a", "b")]
    shared = parsed.sparkSession.sparkContext.broadcast(sieve(asked, SIEVE_BITS, *places))  # of a fixed size
    kinds = dict(parsed.dtypes)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, texts = [], []
        for r, text in enumerate(batch.column(2).to_pylist()):
            found = pieces(text)
            rows += [r] * len(found)
            texts += found
        h = hashed(texts)
        bits = h.view(np.uint64) >> np.uint64(64 - SIEVE_BITS)
        keep = np.flatnonzero(bits_set(shared.value, bits[:, 0]) & bits_set(shared.value, bits[:, 1]))
        taken = batch.select([0, 1]).take(pa.array(np.array(rows, np.int64)[keep]))
        return pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(x.copy()) for x in h[keep].T)], ["conv_id", "turn", "a", "b"])

    messages = parsed.where("body <> '' and conv_id is not null and turn is not null").select("conv_id", "turn", "body")
    found = arrow_map(messages, one, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, a long, b long")
    return found.distinct().join(asked.select("a", "b").distinct(), ["a", "b"], "left_semi")


def link(parsed: DataFrame, common: int = COMMON) -> DataFrame:
    """Rows (passage, to_conv, to_turn, far): the message each passage quotes."""
    asked = save(asked_pieces(parsed), "chat-asked")
    held = save(held_pieces(parsed, asked), "chat-held")
    many = held.groupBy("a", "b").agg((F.count("*") > common).alias("common"))
    asked = save(asked.join(many, ["a", "b"]), "chat-pieces")  # pieces that somebody holds
    places = held.select("a", "b", F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"))
    earlier = (F.col("to_conv") != F.col("conv_id")) | (F.col("to_turn") < F.col("turn"))
    rare = asked.where("not common").join(places, ["a", "b"]).where(earlier).select(*PASSAGE, "to_conv", "to_turn", "whole")
    rare = save(rare.groupBy(*PASSAGE, "to_conv", "to_turn").agg(F.max("whole").alias("whole"), F.count("*").alias("matched")), "chat-met")
    shared = rare.join(asked.where("common").drop("whole"), list(PASSAGE)).join(places, ["a", "b", "to_conv", "to_turn"])
    more = shared.groupBy(*PASSAGE, "to_conv", "to_turn").agg(F.count("*").alias("_more"))
    scored = rare.join(more, [*PASSAGE, "to_conv", "to_turn"], "left").withColumn("matched", F.col("matched") + F.coalesce("_more", F.lit(0))).drop("_more")
    # the whole of a passage may be a common piece of a message met on a rarer one
    at_whole = asked.where("common and whole").select(*PASSAGE, "a", "b").join(places, ["a", "b"]).join(rare.drop("whole", "matched"), [*PASSAGE, "to_conv", "to_turn"], "left_semi")
    scored = scored.join(at_whole.select(*PASSAGE, "to_conv", "to_turn", F.lit(True).alias("_whole")), [*PASSAGE, "to_conv", "to_turn"], "left")
    scored = save(scored.withColumn("whole", F.col("whole") | F.coalesce("_whole", F.lit(False))).drop("_whole"), "chat-scored")
    candidates = scored.unionByName(common_candidates(asked, places, scored))
    ranked = candidates.withColumn("far", (F.col("to_conv") != F.col("conv_id")).cast("int"))
    return ranked.groupBy(*PASSAGE).agg(F.min_by(F.struct("to_conv", "to_turn", "far"), worse()).alias("p")).select(*PASSAGE, "p.*")


def worse() -> Column:
    """The order of a passage's candidates (to_conv, to_turn, whole, matched, far), the best first."""
    nearest = F.when(F.col("far") == 0, -F.col("to_turn")).otherwise(F.lit(0))
    return F.struct(~F.col("whole"), F.when(F.col("whole"), 0).otherwise(-F.col("matched")), "far", nearest, "to_conv", "to_turn")


def common_candidates(asked: DataFrame, places: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows (passage, to_conv, to_turn, whole, matched) of messages that hold only common pieces of a passage, where one might win."""
    most = asked.where("common").groupBy(*PASSAGE).agg(F.count("*").alias("_most"), F.max("whole").alias("_whole"))
    best = scored.groupBy(*PASSAGE).agg(F.max("matched").alias("_matched"), F.max("whole").alias("_held"))
    settled = ~F.col("_whole") & (F.coalesce("_held", F.lit(False)) | (F.coalesce("_matched", F.lit(0)) > F.col("_most")))
    open_ = most.join(best, list(PASSAGE), "left").where(~settled).select(*PASSAGE)
    common = asked.where("common").join(open_, list(PASSAGE), "left_semi")
    if common.isEmpty():
        return scored.where(F.lit(False))
    # sets are named by a digest of their pieces; a message's or passage's pieces are few
    name = lambda *c: F.md5(F.to_json(F.struct(F.sort_array(F.collect_set(F.struct(*c))).alias("s"))))
    asking = save(common.groupBy(*PASSAGE).agg(name("a", "b", "whole").alias("ask"), F.collect_set(F.struct("a", "b", "whole")).alias("_s")), "chat-asking")
    asks = asking.groupBy("ask").agg(F.first("_s").alias("_s")).select("ask", F.explode("_s").alias("_p")).select("ask", "_p.*")
    wanted = common.select("a", "b").distinct()
    holding = places.join(wanted, ["a", "b"], "left_semi").groupBy("to_conv", "to_turn").agg(name("a", "b").alias("hold"), F.collect_set(F.struct("a", "b")).alias("_s"))
    holding = save(holding, "chat-holding")
    holds = holding.groupBy("hold").agg(F.first("_s").alias("_s")).select("hold", F.explode("_s").alias("_p")).select("hold", "_p.*")
    met = save(asks.join(holds, ["a", "b"]).groupBy("ask", "hold").agg(F.max("whole").alias("whole"), F.count("*").alias("matched")), "chat-sets")
    # other conversations: the smallest places of two, one of which isn't the passage's own
    place = F.struct("to_conv", "to_turn")
    score = F.struct(~F.col("whole"), F.when(F.col("whole"), 0).otherwise(-F.col("matched")), "to_conv", "to_turn")
    first = save(holding.groupBy("hold").agg(F.min(place).alias("p")), "chat-first")
    second = holding.join(first, "hold").where("to_conv <> p.to_conv").groupBy("hold").agg(F.min(place).alias("p"))
    two = met.join(first.unionByName(second), "hold").select("ask", "whole", "matched", "p.*")
    top = F.min_by(F.struct("to_conv", "to_turn", "whole", "matched"), score).alias("p")
    one = save(two.groupBy("ask").agg(top), "chat-far")
    other = two.join(one.select("ask", F.col("p.to_conv").alias("_first")), "ask").where("to_conv <> _first").groupBy("ask").agg(top)
    far = asking.select(*PASSAGE, "ask").join(one.unionByName(other), "ask").where("p.to_conv <> conv_id").select(*PASSAGE, "p.*")
    # the own conversation: the last message before the passage of each set, from one sorted pass
    here = holding.select(F.col("to_conv").alias("conv_id"), "hold").distinct()
    own = asking.select(*PASSAGE, "ask").join(met, "ask").join(here, ["conv_id", "hold"])
    asked_rows = own.select(*PASSAGE, "hold", "whole", "matched", F.lit(None).cast(dict(places.dtypes)["to_turn"]).alias("held"))
    held_rows = holding.join(own.select(F.col("conv_id").alias("to_conv"), "hold").distinct(), ["to_conv", "hold"], "left_semi")
    kinds = dict(asked_rows.dtypes)
    blank = [F.lit(None).cast(kinds[c]).alias(c) for c in ("_m", "pos", "level", "whole", "matched")]
    held_rows = held_rows.select(F.col("to_conv").alias("conv_id"), F.col("to_turn").alias("turn"), "hold", *blank, F.col("to_turn").alias("held"))
    before = Window.partitionBy("conv_id", "hold").orderBy("turn", F.col("held").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    last = asked_rows.unionByName(held_rows).withColumn("to_turn", F.max("held").over(before)).where("held is null and to_turn is not null")
    near = last.select(*PASSAGE, F.col("conv_id").alias("to_conv"), "to_turn", "whole", "matched")
    return far.unionByName(near)


def roots_by_doubling(parents: DataFrame) -> DataFrame:
    """Rows (node, ptr, dist, least) of (node, ptr): ``ptr`` null once the root is reached, ``dist`` steps away.

    A round doubles the steps of every pointer.  What has no root after more steps
    than there are nodes leads into a cycle; ``least`` is the smallest id on the way.
    """
    state = save(parents.select("node", "ptr", F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.col("node").alias("least")), "chat-roots")
    left, rounds = state.where("ptr is not null").count(), 0
    while left and (1 << rounds) <= left + 1:
        moving = state.where("ptr is not null")
        ahead = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("dist").alias("more"), F.col("least").alias("low"))
        moved = moving.join(ahead, "ptr").select("node", F.col("next").alias("ptr"), (F.col("dist") + F.col("more")).alias("dist"), F.least("least", "low").alias("least"))
        grown = save(state.where("ptr is null").unionByName(moved), "chat-roots")
        forget(state)
        state, before = grown, left
        left, rounds = state.where("ptr is not null").count(), rounds + 1
        left = max(left, before) if left else 0  # pointers that are left may lead into a long cycle
    return state


def conversation_depths(edges: DataFrame) -> DataFrame:
    """Rows (conv_id, thread_id, depth): 0 where a conversation answers no other, else one more than that of the one it follows."""
    threads = connected_components(edges.select(F.col("conv_id").alias("src"), F.col("to_conv").alias("dst")))
    followed = edges.groupBy("conv_id").agg(F.min("to_conv").alias("ptr"))
    parents = save(threads.join(followed, threads.node == followed.conv_id, "left").select("node", "component", "ptr"), "chat-parents")
    found = roots_by_doubling(parents)
    if not found.where("ptr is not null").isEmpty():
        # every pointer left lies on a cycle, and the least id on the way from there is the cycle's
        on = found.select(F.col("ptr").alias("node")).where("node is not null").distinct()
        cut = save(found.join(on, "node", "left_semi").select(F.col("least").alias("node")).distinct(), "chat-cuts")
        free = parents.join(cut.withColumn("cut", F.lit(True)), "node", "left")
        found = roots_by_doubling(free.select("node", F.when(F.col("cut").isNull(), F.col("ptr")).alias("ptr")))
    return parents.join(found.select("node", "dist"), "node").select(
        F.col("node").alias("conv_id"), F.col("component").alias("thread_id"), F.col("dist").cast("int").alias("depth")
    )


def build_threads(messages: DataFrame) -> DataFrame:
    """One row a message: thread_id, position, parent, all links, role, text without quotes."""
    ship(messages.sparkSession)
    parsed = save(parse(messages.select("conv_id", "turn", "role", "text")), "chat-parsed")
    links = save(link(parsed), "chat-links")
    across = links.where("conv_id <> to_conv").select("conv_id", "to_conv").distinct()
    if across.isEmpty():
        placed = parsed.withColumns({"thread_id": F.col("conv_id"), "depth": F.lit(0)})
    else:
        placed = parsed.join(conversation_depths(across), "conv_id", "left").withColumns(
            {"thread_id": F.coalesce("thread_id", "conv_id"), "depth": F.coalesce("depth", F.lit(0))}
        )
    first = F.min_by(F.struct("to_conv", "to_turn", F.col("level").alias("_level")), F.struct("level", "far", "pos", "to_conv", "to_turn"))
    every = F.sort_array(F.collect_list(F.struct("pos", "level", "to_conv", "to_turn")))  # one message's passages
    parents = links.groupBy("conv_id", "turn", "_m").agg(first.alias("_p"), every.alias("links"))
    answered = placed.join(parents.select("conv_id", "turn", "_m", "_p.*", "links"), ["conv_id", "turn", "_m"], "left")
    ordered = positions(
        answered.select(
            "thread_id",
            "depth",
            "conv_id",
            "turn",
            F.coalesce("role", F.lit("user")).alias("role"),
            F.col("body").alias("text"),
            F.size("quotes").alias("quotes"),
            F.col("to_conv").alias("parent_conv"),
            F.col("to_turn").alias("parent_turn"),
            F.col("_level").alias("quote_level"),
            "links",
        )
    )
    return ordered.withColumn(
        "formatted", F.concat(F.lit("<|"), F.lower("role"), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    )


def positions(df: DataFrame) -> DataFrame:
    """A gapless position in every thread, counted in parts so that a long thread is no single task.

    The keys are structs, which are never null and compare the nulls inside them as equal.
    """
    keyed = df.withColumns({"_thread": F.struct("thread_id"), "_part": F.struct("depth", "conv_id", F.expr("turn div 64").alias("block"))})
    order = ("depth", "conv_id", "turn", "role", "text")
    before = Window.partitionBy("_thread").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keyed.groupBy("_thread", "_part").agg(F.count("*").alias("n"))
    starts = parts.select("_thread", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_thread", "_part").orderBy(*order)
    ranked = keyed.withColumn("_at", F.row_number().over(inside) - 1).join(starts, ["_thread", "_part"])
    return ranked.withColumn("position", F.col("_start") + F.col("_at")).drop("_thread", "_part", "_at", "_start")


def op10_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_threads(spread(table(spark, sf_dir, "conversations")))
