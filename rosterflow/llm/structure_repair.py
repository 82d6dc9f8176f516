"""Repair of conversation structure by rank-convergence parallel Viterbi.

The cheapest edits that give a conversation the role order ``(s?(ua)+)?`` are a shortest path over four states: nothing
written yet, and last written system, user or assistant.  The vector of costs to go runs backward over the rows.  Long
conversations are cut into chunks, all of which start at once from a speculative vector.  Fix-up passes hand each chunk
the vector of the chunk behind it and rerun it until it differs from a known one only by a constant; what a chunk has
been asked is kept, so a pass can hop over all chunks whose answer is known.  From the stitched vectors each chunk traces
the least audit from every state that it may be entered in, and a walk over the chunks picks the one that holds.

Rows that are blank or repeat an earlier one must go whatever the state, so they cost the same everywhere and stay
outside the search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterflow.llm.common import numbered
from rosterflow.operators.joins import join_back
from rosterflow.session import written

CHUNK = 16_384
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
# Costs to go after the last row, by state: what is open is closed by insertions.
END = (0, 2 * INSERT, INSERT, 0)
SPACE = " \t\n\x0b\f\r"
# Codes of rows: 0 must go; initials s, u, a, any other; and so many more if truncated.
INITIALS = "sua"
CUT = 4


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the damage that the hash of a row's name draws; nulls are one space."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    name = F.concat(conv, F.lit(":"), turn)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("lot"))
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("lot <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def items_of(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, idx, turn, role, id, n, blank, cut, first): different rows of each turn in order, ``n`` of each.

    Turns ascend, null first; rows of one turn follow each other by role, then by the hash of their text, so equal ones
    are neighbours.  ``first``: nothing before has this role and text.
    """
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    narrow = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("id"), (end == "").alias("blank"),
                         (~end.isin(".", "!", "?")).alias("cut"))
    alike = written(narrow.groupBy("conv_id", "turn", "role", "id").agg(
        F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")), "items")
    placed = written(numbered(alike, ["conv_id"], ["turn", "role", "id"], "idx"), "items")
    firsts = placed.groupBy("conv_id", "role", "id").agg(F.min("idx").alias("idx")).select(
        "conv_id", "idx", F.lit(True).alias("first"))
    return written(join_back(placed, firsts, ["conv_id", "idx"]).withColumn("first", F.coalesce("first", F.lit(False))), "items")


def code_of(role: Column, cut: Column, live: Column) -> Column:
    place = F.lit(CUT)
    for number, initial in enumerate(INITIALS, 1):
        place = F.when(F.substring(role, 1, 1) == initial, F.lit(number)).otherwise(place)
    return F.when(live, place + F.when(cut, F.lit(CUT)).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("byte")


def chunks_of(items: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (conv_id, chunk, codes): the codes of neighbouring items in order."""
    code = code_of(F.col("role"), F.col("cut"), F.col("first") & ~F.col("blank"))
    coded = items.select("conv_id", F.floor((F.col("idx") - 1) / chunk).cast("long").alias("chunk"), F.struct("idx", code.alias("code")).alias("c"))
    return coded.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("c")).alias("c")).select(
        "conv_id", "chunk", F.transform("c", lambda x: x.code).alias("codes"))


def _written_by(state: int) -> int:
    """State after a user or an assistant turn, whichever may follow."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, code: int) -> int | None:
    """State after the row of this code is kept as it is, if it may be."""
    kind = (code - 1) % CUT
    if kind == 0:
        return SYSTEM if state == NONE else None
    return kind + 1 if kind < 3 and kind + 1 == _written_by(state) else None


_moves: dict[tuple, tuple] = {}


def _before(vector: tuple, code: int) -> tuple[tuple, int]:
    """Costs to go before a row, least 0, from those behind it, and the constant taken off."""
    if not code:
        return vector, 0
    got = _moves.get((vector, code))
    if got is None:
        more = TRUNCATED if code > CUT else 0
        costs = []
        for state in range(4):
            kept = _kept(state, code)
            costs.append(min(DELETE + vector[state], REROLE + more + vector[_written_by(state)],
                             more + vector[kept] if kept is not None else 1 << 40))
        user = min(costs[USER], INSERT + costs[ASSISTANT])
        out = [min(costs[s], INSERT + (user if s != USER else costs[ASSISTANT])) for s in range(4)]
        least = min(out)
        got = _moves[vector, code] = tuple(x - least for x in out), least
    return got


def _costs(codes: list[int], vector: tuple) -> list[tuple]:
    """Vectors before each row and behind the last one, each up to a constant."""
    out = [vector]
    for code in reversed(codes):
        vector = _before(vector, code)[0]
        out.append(vector)
    return out[::-1]


def rerun(codes: list[int], vector: tuple, known: tuple, answer: tuple) -> tuple:
    """The vector before the chunk from ``vector`` behind it; ``answer`` as soon as the way meets that of ``known``."""
    for code in reversed(codes):
        if vector == known:
            return answer
        vector, known = _before(vector, code)[0], _before(known, code)[0]
    return vector


_steps: dict[tuple, tuple] = {}


def _step(behind: tuple, code: int, state: int) -> tuple[str, int]:
    """Least letters of a cheapest way over one row, and the state after it."""
    got = _steps.get((behind, code, state))
    if got is None:
        vector, least = _before(behind, code)
        letters, now = "", state
        while True:
            more, left, kept = TRUNCATED if code > CUT else 0, vector[now] + least, _kept(now, code)
            if DELETE + behind[now] == left:
                letters += "D"
                break
            if INSERT + vector[_written_by(now)] + least == left:
                letters, now = letters + "I", _written_by(now)
                continue
            if kept is not None and more + behind[kept] == left:
                letters, now = letters + "K", kept
                break
            letters, now = letters + "R", _written_by(now)
            break
        got = _steps[behind, code, state] = letters, now
    return got


def trace(codes: list[int], costs: list[tuple], state: int) -> tuple[list[str], int]:
    """Letters of each row along the least audit of a cheapest way from ``state``, and the state behind the chunk."""
    out = []
    for code, behind in zip(codes, costs[1:]):
        letters, state = _step(behind, code, state) if code else ("", state)
        out.append(letters)
    return out, state


def _codes(batch: pa.RecordBatch, column: str = "codes") -> list[bytes]:
    lists = batch.column(column)
    values, at = lists.values.to_numpy().astype(np.uint8), lists.offsets.to_numpy()
    return [values[at[i]:at[i + 1]].tobytes() for i in range(len(lists))]


def _hop(tried: DataFrame) -> DataFrame:
    """Rows (conv_id, chunk, vector, known): the vector behind each chunk as far as answers are known.

    ``tried``: rows (conv_id, chunk, answers).  Where a chunk lacks an answer, that of the nearest chunk behind it that was
    asked the same stands in, else its speculative one; different vectors are few, so most of these guesses hold.
    """
    def walk(batches):
        conv, vector, heard = object(), END, {}
        for batch in batches:
            out = []
            for own, asked in zip(batch.column("conv_id").to_pylist(), batch.column("answers").to_pylist()):
                if own != conv:
                    conv, vector, heard = own, END, {}
                answers = {tuple(a["behind"]): tuple(a["before"]) for a in asked}
                here = vector in answers
                out.append((list(vector), here))
                heard |= answers
                vector = answers[vector] if here else heard.get(vector, answers[END])
            yield pa.record_batch([
                batch.column("conv_id"), batch.column("chunk"), pa.array([x[0] for x in out], pa.list_(pa.int64())),
                pa.array([x[1] for x in out])], names=["conv_id", "chunk", "vector", "known"])

    ordered = tried.select("conv_id", "chunk", "answers").repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.desc("chunk"))
    return ordered.mapInArrow(walk, "conv_id long, chunk long, vector array<long>, known boolean")


_ANSWERS = "conv_id long, chunk long, answers array<struct<behind:array<long>,before:array<long>>>"
_ANSWER = pa.list_(pa.struct([("behind", pa.list_(pa.int64())), ("before", pa.list_(pa.int64()))]))


def stitched(chunks: DataFrame) -> DataFrame:
    """Rows (conv_id, chunk, codes, vector): chunks with the costs to go behind them, each up to a constant."""
    def speculate(batches):
        for batch in batches:
            got = [[{"behind": END, "before": _costs(c, END)[0]}] for c in _codes(batch)]
            yield pa.record_batch([batch.column("conv_id"), batch.column("chunk"), pa.array(got, _ANSWER)], names=["conv_id", "chunk", "answers"])

    def fix(batches):
        for batch in batches:
            out = []
            for codes, vector, asked in zip(_codes(batch), batch.column("vector").to_pylist(), batch.column("answers").to_pylist()):
                answers = {tuple(a["behind"]): tuple(a["before"]) for a in asked}
                answers[tuple(vector)] = rerun(codes, tuple(vector), END, answers[END])
                out.append([{"behind": k, "before": v} for k, v in answers.items()])
            yield pa.record_batch([batch.column("conv_id"), batch.column("chunk"), pa.array(out, _ANSWER)], names=["conv_id", "chunk", "answers"])

    tried = written(chunks.mapInArrow(speculate, _ANSWERS), "tried")
    while True:
        asked = written(_hop(tried), "asked")
        if asked.where("not known").isEmpty():
            break
        open_ = join_back(asked.where("not known"), tried, ["conv_id", "chunk"], "inner")
        more = join_back(open_, chunks, ["conv_id", "chunk"], "inner").mapInArrow(fix, _ANSWERS)
        # Only the chunks that were asked anew have changed.
        still = join_back(tried, asked.where("not known").select("conv_id", "chunk", F.lit(1).alias("gone")), ["conv_id", "chunk"])
        tried = written(still.where("gone is null").drop("gone").unionByName(more), "tried")
    return join_back(chunks, asked.select("conv_id", "chunk", "vector"), ["conv_id", "chunk"])


def traced(chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (conv_id, idx, letters, tail): edits of each item's first row, and those behind a conversation's last one."""
    def ways(batches):
        for batch in batches:
            letters, ends = [], []
            for codes, vector in zip(_codes(batch), batch.column("vector").to_pylist()):
                costs = _costs(codes, tuple(vector))
                found = [trace(codes, costs, s) for s in range(4)]
                letters.append([",".join(f[0]) for f in found])
                ends.append([f[1] for f in found])
            yield pa.record_batch([batch.column("conv_id"), batch.column("chunk"), pa.array(letters, pa.list_(pa.string())),
                                   pa.array(ends, pa.list_(pa.int32()))], names=["conv_id", "chunk", "ways", "ends"])

    def pick(batches):
        conv, state = object(), NONE
        for batch in batches:
            out = []
            for own, found, ends, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ways", "ends", "last"))):
                if own != conv:
                    conv, state = own, NONE
                letters, state = found[state], ends[state]
                out.append((letters, "I" * (END[state] // INSERT) if last else ""))
            yield pa.record_batch([batch.column("conv_id"), batch.column("chunk"), pa.array([x[0] for x in out], pa.string()),
                                   pa.array([x[1] for x in out], pa.string())], names=["conv_id", "chunk", "letters", "tail"])

    found = chunks.select("conv_id", "chunk", "codes", "vector").mapInArrow(
        ways, "conv_id long, chunk long, ways array<string>, ends array<int>")
    lasts = chunks.groupBy("conv_id").agg(F.max("chunk").alias("chunk")).withColumn("last", F.lit(True))
    found = join_back(found, lasts, ["conv_id", "chunk"]).withColumn("last", F.coalesce("last", F.lit(False)))
    ordered = found.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "chunk")
    picked = ordered.mapInArrow(pick, "conv_id long, chunk long, letters string, tail string")
    each = picked.select("conv_id", "chunk", "tail", F.posexplode(F.split("letters", ",")).alias("at", "letters"))
    return each.select("conv_id", (F.col("chunk") * chunk + F.col("at") + 1).alias("idx"), "letters", "tail")


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) a conversation.

    ``rows``: (conv_id, turn, role, text) without null roles or texts; a null conv_id is a conversation of its own, null
    turns come first.  Digest and audit run in order, so the rows of one conversation stream through a task.
    """
    items = items_of(rows)
    chunks = written(chunks_of(items, chunk), "chunks")
    letters = traced(stitched(chunks), chunk)
    order = ["turn", "role", "id"]
    heads = join_back(items, letters, ["conv_id", "idx"]).select(
        "conv_id", *order, F.lit(0).alias("kind"), "n", "blank", "cut", "first", "letters", "tail", F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("id"), F.lit(1).alias("kind"), "text")
    both = heads.unionByName(texts, allowMissingColumns=True)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def fold(batches):
        book = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if book is None or row["conv_id"] != book.conv:
                    if book:
                        out.append(book.closed())
                    book = _Book(row["conv_id"])
                book.take(row)
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if book:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*[book.closed()]), kinds)], names=names)

    along = [F.asc_nulls_first(c) for c in ("conv_id", *order, "kind")]
    return both.repartition("conv_id").sortWithinPartitions(*along).mapInArrow(
        fold, ", ".join(f"{n} {'long' if k == pa.int64() else 'string'}" for n, k in zip(names, kinds)))


class _Book:
    """Running results of one conversation, whose items come in order, each before its texts."""

    def __init__(self, conv):
        self.conv, self.state, self.audit, self.tail = conv, NONE, [], ""
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.last, self.wants, self.sha, self.any = None, None, hashlib.sha256(), False

    def say(self, role: str, text: str) -> None:
        if self.any:
            self.sha.update(b"\n")
        self.any = True
        self.sha.update(f"{role}:{text}".encode())

    def insert(self) -> None:
        self.state = _written_by(self.state)
        self.say(NAMES[self.state], "")
        self.cost += INSERT

    def take(self, row: dict) -> None:
        if row["kind"]:
            if self.wants:
                self.say(self.wants, row["text"])
                self.wants = None
            return
        turn, n, initial = row["turn"], row["n"], row["role"][:1]
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += n - 1
        self.last = initial
        live = row["first"] and not row["blank"]
        self.blank += n if row["blank"] else 0
        self.duplicate += 0 if row["blank"] else n - 1 if live else n
        gone = n - 1 if live else n
        if live:
            self.truncated += row["cut"]
            for letter in row["letters"]:
                if letter == "I":
                    self.insert()
                elif letter == "D":
                    self.cost += DELETE
                else:
                    self.cost += (REROLE if letter == "R" else 0) + (TRUNCATED if row["cut"] else 0)
                    kept = INITIALS.find(initial) + 1 if letter == "K" else _written_by(self.state)
                    self.wants = row["role"] if letter == "K" else NAMES[kept]
                    self.state = kept
            self.audit.append(row["letters"])
        self.cost += DELETE * gone
        self.audit.append("D" * gone)
        self.tail = row["tail"] or self.tail

    def closed(self) -> tuple:
        for _ in self.tail:
            self.insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
                "".join(self.audit) + self.tail, self.sha.hexdigest())


def repair_damage(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Damages the rows, repairs what is left, and returns a row for each original conversation.

    A conversation that lost all its rows has zeros, an empty audit and the digest of nothing.
    """
    given = conversations.select("conv_id", "turn", "role", "text")
    found = repaired(damaged(given), chunk)
    out = join_back(given.select("conv_id").distinct(), found, ["conv_id"])
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce(
        "repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))})
