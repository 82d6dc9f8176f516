"""Chat formatting from event logs.

A conversation is a log of events by ``seq``: ``open`` starts a message (role), ``delta`` adds text to it, ``edit`` replaces
its text, ``regenerate`` empties it; the last two also take back every later message that was opened before them.
Messages are folded one by one, so a conversation of any length is spread over tasks; only their short heads are put in
order to find what was taken back.  Rendering places blocks of turns on their own, from the sum of sizes of each block; only
reading, whose digests run in order, streams through a whole conversation.  Both hold one message.

Template: ``### role: text</turn>`` and a line end for each message.  In texts ``\\``, ``###`` and ``</turn>`` get a
backslash before them, in roles ``:`` too, so that a reader that takes the character after a backslash as it is gets
the original.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

END = "</turn>"
MARK = "###"
ASSISTANT = "assistant"
# Messages of so many neighbouring turns are placed together.
BLOCK_TURNS = 256
# No text holds half of a surrogate pair, so one can stand for an escaped backslash while others are taken away.
_HALF = "\ud800"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (MARK, END):
        out = F.replace(out, F.lit(control), F.lit("\\" + control))
    return out


def unescaped(text: str) -> str:
    return text.replace("\\\\", _HALF).replace("\\", "").replace(_HALF, "\\")


def _find(text: str, token: str, start: int) -> int:
    """Place of the first ``token`` that no backslash escapes, -1 if there is none."""
    at, found = start, text.find(token, start)
    while found >= 0:
        escape = text.find("\\", at, found)
        if escape < 0:
            return found
        at = escape + 2
        if found < at:
            found = text.find(token, at)
    return -1


def parsed(formatted: str) -> tuple[str, str] | None:
    """Role and text, still escaped, of one rendered message; None if it is none.  Takes memory for copies of the text only."""
    if not formatted.startswith(f"{MARK} "):
        return None
    colon = _find(formatted, ": ", len(MARK) + 1)
    end = _find(formatted, END, colon + 2) if colon >= 0 else -1
    if end < 0 or formatted[end:] != END + "\n":
        return None
    return formatted[len(MARK) + 1:colon], formatted[colon + 2:end]


def messages(events: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, msg, role, text): the final messages of logs (conv_id, turn, msg, seq, kind, role, text).

    ``turn`` and ``msg`` name and order the messages of a conversation.  Null texts and roles are empty.  A message
    that was never opened has an empty role.  Null ids are a conversation of their own; a null ``seq`` or ``turn`` comes
    before all others.
    """
    events = events.select("conv_id", "turn", "msg", F.coalesce("seq", F.lit(-1 << 63)).alias("seq"), "kind", "role",
                           F.coalesce("text", F.lit("")).alias("text"))
    key = ["conv_id", "turn", "msg"]
    part = F.struct("seq", F.col("kind").isin("open", "edit", "regenerate").alias("fresh"), "text")
    folded = events.groupBy(*key).agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.min("seq").alias("opened"),
        F.max_by("role", F.when(F.col("kind") == "open", F.col("seq"))).alias("role"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("cut"))
    last = F.array_max(F.transform(F.filter("parts", lambda p: p.fresh), lambda p: p.seq))
    text = F.array_join(F.transform(F.filter("parts", lambda p: p.seq >= F.coalesce(last, p.seq)), lambda p: p.text), "")
    out = folded.select(*key, F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    # Only conversations in which something was taken back need their messages in order.
    heads = events.groupBy(*key).agg(F.min("seq").alias("opened"), F.max(
        F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("cut"))
    touched = heads.groupBy("conv_id").agg(F.max("cut").alias("any_cut")).where("any_cut is not null").select(
        F.col("conv_id").alias("own"))
    before = W.partitionBy("conv_id").orderBy("turn", "msg").rowsBetween(W.unboundedPreceding, -1)
    gone = heads.join(touched, F.col("conv_id").eqNullSafe(F.col("own")), "left_semi").withColumn(
        "later", F.max("cut").over(before)).where("later > opened").select(*[F.col(c).alias(f"{c}_") for c in key])
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return out.join(gone, same, "left_anti")


def render(final: DataFrame) -> DataFrame:
    """Rows (conv_id, start, formatted, loss_start, loss_end): the text of each conversation in pieces, by ``start``.

    The loss mask of a conversation is the union of its [loss_start, loss_end), code points of the formatted text;
    null for messages that are not the assistant's.
    """
    role = F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:"))
    head = F.concat(F.lit(f"{MARK} "), role, F.lit(": "))
    body = escaped(F.col("text"))
    pieces = final.select("conv_id", "turn", "msg", F.concat(head, body, F.lit(END + "\n")).alias("formatted"), F.when(
        F.col("role") == ASSISTANT, F.struct(F.length(head).alias("a"), (F.length(head) + F.length(body)).alias("b"))).alias("loss"))
    pieces = pieces.select("conv_id", "turn", "msg", "formatted", F.length("formatted").alias("size"), "loss.a", "loss.b",
                           F.floor(F.col("turn") / BLOCK_TURNS).alias("block"))
    # A null turn is a block of its own, before all others.
    sums = pieces.groupBy("conv_id", "block").agg(F.sum("size").alias("sum"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(F.col("conv_id").alias("conv_id_"), F.col("block").alias("block_"),
                        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    pieces = pieces.join(bases, F.col("conv_id").eqNullSafe(F.col("conv_id_")) & F.col("block").eqNullSafe(F.col("block_")))
    pieces = pieces.select("conv_id", "turn", "msg", "formatted", "size", "a", "b", "block", "base")

    def place(batches):
        key, at = object(), 0
        for batch in batches:
            starts = []
            for conv, block, base, size in zip(*(batch.column(i).to_pylist() for i in (0, 7, 8, 4))):
                if (conv, block) != key:
                    key, at = (conv, block), base
                starts.append(at)
                at += size
            shift = [[None if x is None else s + x for s, x in zip(starts, batch.column(i).to_pylist())] for i in (5, 6)]
            yield pa.record_batch([batch.column(0), pa.array(starts, pa.int64()), batch.column(3),
                                   *[pa.array(x, pa.int64()) for x in shift]],
                                  names=["conv_id", "start", "formatted", "loss_start", "loss_end"])

    ordered = pieces.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "msg")
    return ordered.mapInArrow(place, "conv_id long, start long, formatted string, loss_start long, loss_end long")


def read_back(rendered: DataFrame) -> DataFrame:
    """One row a conversation, from the formatted text and its loss mask alone."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches):
        conv, state = None, None
        for batch in batches:
            out = []
            for own, start, formatted, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or own != conv:
                    if state:
                        out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                got = parsed(formatted)
                if not got or start != state[4]:
                    raise ValueError(f"conversation {own} can't be read back at {start}")
                state[0] += 1
                state[1].update(f"{unescaped(got[0])}\n{unescaped(got[1])}\n".encode())
                if a is not None:
                    loss = unescaped(formatted[a - start:b - start])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(formatted)
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if state:
            out = [(conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    ordered = rendered.select("conv_id", "start", "formatted", "loss_start", "loss_end").repartition(
        "conv_id").sortWithinPartitions("conv_id", "start")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                    "formatted_chars long")


def events_of(rows: DataFrame) -> DataFrame:
    """A log of streamed messages that ends in the given rows (conv_id, turn, role, text).

    A text comes in two deltas.  By the hash of their name, three quarters of the messages are first streamed with a wrong
    text and then regenerated, edited and gone on with, or edited as a whole; before the second kind of edit lies a message
    that answers the wrong text and is taken back.  Rows that share a turn, or have none, are streamed without faults,
    as an edit would take back the later of them.  These follow each other in the order of the table, so ``rows`` must
    be a table that is read as written.
    """
    alone = rows.where("turn is not null").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(
        F.col("conv_id").alias("conv_id_"), F.col("turn").alias("turn_"), F.lit(True).alias("alone"))
    text = F.coalesce("text", F.lit(""))
    half = (F.length(text) / 2).cast("int")
    row = rows.select("conv_id", "turn", F.monotonically_increasing_id().alias("msg"), "role", text.alias("text"), half.alias("half"))
    row = row.join(alone, F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("turn") == F.col("turn_")), "left")
    lot = F.when(F.col("alone"), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))).otherwise(F.lit(0))

    def event(step: int, kind: str, said=None, later: bool = False):
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), (F.lit("") if said is None else said).alias("text"),
                        F.lit(later).alias("later"))

    first, second, wrong = F.expr("left(text, half)"), F.expr("substring(text, half + 1)"), F.concat(F.lit("No: "), F.expr("right(text, half)"))
    opened = [event(0, "open"), event(1, "delta", wrong)]
    follow = [event(2, "open", later=True), event(3, "delta", F.lit("An answer to that."), later=True)]
    logs = F.element_at(F.array(
        F.array(event(0, "open"), event(1, "delta", first), event(2, "delta", second)),
        F.array(*opened, event(4, "regenerate"), event(5, "delta", first), event(6, "delta", second)),
        F.array(*opened, *follow, event(4, "edit", first), event(5, "delta", second)),
        F.array(*opened, event(4, "edit", F.col("text")))), (lot + 1).cast("int"))
    return row.select("conv_id", "turn", "msg", "role", F.explode(logs).alias("p")).select(
        "conv_id", "turn", F.when(F.col("p.later"), F.col("msg") + (1 << 62)).otherwise(F.col("msg")).alias("msg"),
        (F.coalesce("turn", F.lit(0)) * 8 + F.col("p.step")).cast("long").alias("seq"), "p.kind",
        F.when(F.col("p.later"), F.lit(ASSISTANT)).otherwise(F.col("role")).alias("role"), "p.text")
