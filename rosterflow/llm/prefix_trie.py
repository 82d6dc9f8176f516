"""Prefix trie of conversations by splitter skeleton.

A conversation is a path of 16-byte turn digests.  Paths are cut into layers of ``LAYER`` turns, of which all that start
at one node form a trie of their own, so a row stays small however long a conversation is.  Equal paths are one row.
Paths are dealt to shards by splitter paths; a node whose conversations lie in several shards is a prefix of a splitter.
These splitters, a few for each task, are broadcast: a shard walks its sorted paths, finishes every node that is on no
splitter, and hands over partial sums for those that are.  The partial sums of this skeleton are added up by node and
walked once.  Sums of lower layers reach upper ones by doubling steps.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterflow.llm.common import measured, numbered, word_count
from rosterflow.session import written

LAYER = 1024
STEP = 16
# Bytes of a layer's number and of the two hashes of all turns before it.
HEAD = 24
# Paths looked at for each splitter, and bytes of paths that the driver may hold of them on average.
SAMPLED = 20
SAMPLE_BYTES = 8 << 20
# Rows and bytes of paths that a shard should hold.
SHARD_ROWS = 100_000
SHARD_BYTES = 16 << 20
NOTHING = hashlib.sha256(b"").hexdigest()


def digest(role: Column, text: Column) -> Column:
    """Hex SHA-256 of a turn; the length of the role tells the two apart."""
    return F.sha2(F.concat_ws("\n", F.length(role).cast("string"), role, text), 256)


def turns_of(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, turn_id, words) by turn, null first; turns of one number by role, then digest.

    A null role or text is empty.  Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), digest(role, text).alias("turn_id"), word_count(text).alias("words"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    placed = numbered(rows, ["conv_id"], ["turn", "role", "turn_id", "row"], "pos")
    return written(placed.select("conv_id", "pos", "turn_id", "words"), "turns")


def regrafted(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Rows like ``turns`` in which a conversation starts with the first turns of the first one of its family.

    Conversation c takes h = crc32(c) % ``most`` turns of c - c % ``family`` in place of its own first h.  One without
    any turn left is a row with null ``pos``.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = lengths.select("conv_id", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    firsts = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < most)).select(
        F.col("conv_id").alias("base"), "pos", "turn_id", "words")
    heads = convs.join(firsts, "base").where("pos <= h").select("conv_id", "pos", "turn_id", "words")
    given = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shift = convs.join(given, "base", "left").select(
        "conv_id", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("k"))
    tails = turns.join(shift, "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "turn_id", "words")
    rows = written(heads.unionByName(tails), "regrafted")
    bare = convs.select("conv_id").join(rows.select("conv_id").distinct(), "conv_id", "left_anti")
    return rows.unionByName(bare, allowMissingColumns=True)


def _word(value: Column) -> Column:
    return F.lpad(F.hex(value), 16, "0")


def layers(paths: DataFrame, layer: int = LAYER) -> DataFrame:
    """Rows (conv_id, layer, key, path, words, ends, next): the turns of each conversation in pieces of ``layer``.

    ``key`` names the node where the piece starts, ``next`` that where a longer conversation goes on.
    """
    at = F.coalesce(F.floor((F.col("pos") - 1) / layer), F.lit(0)).cast("long")
    turn = F.struct("pos", F.expr(f"left(turn_id, {2 * STEP})").alias("turn"), "words")
    mark = [F.bit_xor(F.xxhash64("pos", "turn_id", F.lit(seed))).alias(f"x{seed}") for seed in (0, 1)]
    cut = paths.groupBy("conv_id", at.alias("layer")).agg(
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), turn))).alias("t"),
        *[F.coalesce(m, F.lit(0)) .alias(f"x{i}") for i, m in enumerate(mark)])
    along = W.partitionBy("conv_id").orderBy("layer")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    for x in ("x0", "x1"):
        cut = cut.withColumn(f"from_{x}", F.coalesce(F.bit_xor(x).over(before), F.lit(0)))
    head = F.concat(_word(F.col("layer")), _word(F.col("from_x0")), _word(F.col("from_x1")))
    after = F.concat(_word(F.col("layer") + 1), _word(F.col("from_x0").bitwiseXOR(F.col("x0"))), _word(F.col("from_x1").bitwiseXOR(F.col("x1"))))
    last = F.lead("layer").over(along).isNull()
    return cut.select(
        "conv_id", "layer", F.unhex(head).alias("key"),
        F.unhex(F.concat(head, F.array_join(F.transform("t", lambda x: x.turn), ""))).alias("path"),
        F.transform("t", lambda x: x.words).alias("words"), last.alias("ends"), F.when(~last, F.unhex(after)).alias("next"))


def digests_of_ends(pieces: DataFrame) -> DataFrame:
    """Rows (end, ends_sha256): of all conversations that end at one path, their ids ascending.

    The digest runs in order, so the ids of one path stream through a task; none are held.
    """
    def run(batches):
        own, state = None, None
        for batch in batches:
            out = []
            for end, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if end != own:
                    if own is not None:
                        out.append((own, state.hexdigest()))
                    own, state = end, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            if out:
                yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], names=["end", "ends_sha256"])
        if own is not None:
            yield pa.record_batch([pa.array([own], pa.binary()), pa.array([state.hexdigest()])], names=["end", "ends_sha256"])

    ends = pieces.where("ends").select(F.unhex(F.md5("path")).alias("end"), "conv_id")
    return ends.repartition("end").sortWithinPartitions("end", "conv_id").mapInArrow(run, "end binary, ends_sha256 string")


def merged(pieces: DataFrame) -> DataFrame:
    """One row for each different path: how many conversations it has, the smallest, and the digest of those that end."""
    paths = pieces.groupBy("layer", "key", "path").agg(
        F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"),
        F.max("ends").alias("any_end"), F.max("next").alias("next"))
    return paths.withColumn("end", F.unhex(F.md5("path"))).join(digests_of_ends(pieces), "end", "left").drop("end", "any_end")


def splitters_of(paths: DataFrame, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> list[bytes]:
    """Ascending paths that cut the sorted paths into shards of about equal numbers, from a sample drawn by hash."""
    rows, size = paths.agg(F.count(F.lit(1)), F.sum(F.length("path"))).first()
    shards = max(rows // shard_rows, (size or 0) // shard_bytes) + 1
    shards = max(shards, min(paths.sparkSession.sparkContext.defaultParallelism, rows // 8 + 1))
    if shards == 1:
        return []
    share = min(1.0, shards * SAMPLED / rows, SAMPLE_BYTES / size)
    drawn = F.pmod(F.xxhash64("path"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    got = sorted(r.path for r in paths.where(drawn).select("path").collect())
    return sorted({bytes(got[len(got) * i // shards]) for i in range(1, shards)} if got else set())


def _common(a: bytes, b: bytes) -> int:
    """Number of leading turns that two paths share; -1 if they start at different nodes."""
    if a[:HEAD] != b[:HEAD]:
        return -1
    n = HEAD
    while n < len(a) and a[n:n + STEP] == b[n:n + STEP]:
        n += STEP
    return (n - HEAD) // STEP


class _Node:
    __slots__ = ("n", "conv", "words", "children", "leaves", "saved", "ends", "waiting", "path")

    def __init__(self, words: int, path: bytes | None):
        self.n, self.conv, self.words, self.path = 0, None, words, path
        self.children = self.leaves = self.saved = 0
        self.ends, self.waiting = None, []

    def add(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(conv, self.conv)


NODE = ("key binary, path binary, depth int, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string, words long")
_KINDS = [pa.binary(), pa.binary(), pa.int32(), pa.binary(), *[pa.int64()] * 6, pa.string(), pa.int64()]
_NAMES = [x.split()[0] for x in NODE.split(", ")]


def _walk(rows, skeleton_depth):
    """Finished nodes and partial skeleton nodes of sorted rows (key, path, words, n, conv_id, ends, children, leaves, saved).

    Rows may repeat a path.  Only the nodes of one path are open at a time; a node waits for its parent's smallest
    conversation, unless the parent is in the skeleton, by whose path it finds it later.  The third to last fields are
    what lies below the end of a path, counted once.
    """
    stack: list[_Node] = []
    key, last, bones = None, None, -1

    def close():
        node, depth = stack.pop(), len(stack)
        if depth <= bones:
            yield (key, node.path, depth, None, node.conv, None, node.n, node.children, node.leaves, node.saved, node.ends, node.words)
            yield from node.waiting
            return
        node.saved += (node.n - 1) * node.words
        node.leaves = node.leaves if node.children else 1
        for row in node.waiting:
            yield (*row[:5], node.conv, *row[6:])
        row = (key, None, depth, None, node.conv, None, node.n, node.children, node.leaves, node.saved, node.ends, node.words)
        if stack:
            up = stack[-1]
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + node.leaves, up.saved + node.saved
            if depth - 1 <= bones:
                yield (*row[:3], up.path, *row[4:])
            else:
                up.waiting.append(row)
        else:
            yield row

    for own, path, words, n, conv, ends, below in rows:
        shared = _common(last, path) if own == key else -1
        while len(stack) > shared + 1:
            yield from close()
        if not stack:
            key = own
        # Skeleton nodes on the open part are on every path below them, so the depth only changes where paths part.
        bones = skeleton_depth(path)
        for node in stack:
            node.add(n, conv)
        for depth in range(len(stack), (len(path) - HEAD) // STEP + 1):
            stack.append(_Node(words[depth - 1] if depth else 0, path[:HEAD + STEP * depth] if depth <= bones else None))
            stack[-1].add(n, conv)
        end = stack[-1]
        end.ends = ends or end.ends
        if below is not None and not end.children:
            end.children, end.leaves, end.saved = end.children + below[0], end.leaves + below[1], end.saved + below[2]
        last = path
    while stack:
        yield from close()


def _batches(nodes, size: int = 4096):
    rows = []
    for node in nodes:
        rows.append(node)
        if len(rows) == size:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)
            rows = []
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


def shard_nodes(paths: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Nodes of all shards: finished ones, and partial ones of the skeleton, which have a ``path``."""
    handed = paths.sparkSession.sparkContext.broadcast(splitters)

    def deal(batches):
        for batch in batches:
            got = [bisect_right(handed.value, p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    def walk(batches):
        cuts = handed.value

        def bones(path):
            at = bisect_right(cuts, path)
            near = [cuts[i] for i in (at - 1, at) if 0 <= i < len(cuts)]
            return max((_common(c, path) for c in near), default=-1)

        # Shards of one task share no unfinished node but those of the skeleton, so these may be summed here already.
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("key", "path", "words", "n", "conv_id", "ends_sha256")),
                               [None if b is None else tuple(b) for b in batch.column("below").to_pylist()])

        yield from _batches(_walk(rows(), bones))

    shown = paths.select("key", "path", "words", "n", "conv_id", "ends_sha256", "below")
    kinds = "key binary, path binary, words array<long>, n long, conv_id long, ends_sha256 string, below array<long>"
    dealt = shown.mapInArrow(deal, "shard int, " + kinds)
    if splitters:
        dealt = dealt.repartition(len(splitters) + 1, "shard")
    else:
        dealt = dealt.coalesce(1)
    return dealt.sortWithinPartitions("path").mapInArrow(walk, NODE)


def skeleton_nodes(partial: DataFrame) -> DataFrame:
    """The nodes of the skeleton from their partial sums; at most as many as splitters times turns of a layer."""
    sums = partial.groupBy("key", "path").agg(
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends_sha256"),
        F.max("words").alias("words"))

    def walk(batches):
        stack: list[dict] = []

        def close():
            node = stack.pop()
            node["saved"] += (node["n"] - 1) * node["words"]
            node["leaves"] = node["leaves"] if node["children"] else 1
            up = stack[-1] if stack else None
            if up:
                for c, more in (("children", 1), ("leaves", node["leaves"]), ("saved", node["saved"])):
                    up[c] += more
            # The parent was opened before and its members are all known, so its smallest is too.
            return (node["key"], node["path"], (len(node["path"]) - HEAD) // STEP, None, node["conv_id"],
                    up["conv_id"] if up else None, node["n"], node["children"], node["leaves"], node["saved"],
                    node["ends_sha256"], node["words"])

        def nodes():
            for batch in batches:
                for row in batch.to_pylist():
                    while stack and not (len(stack[-1]["path"]) < len(row["path"]) and row["path"].startswith(stack[-1]["path"])):
                        yield close()
                    stack.append(row)
            while stack:
                yield close()

        yield from _batches(nodes())

    return sums.repartition("key").sortWithinPartitions("path").mapInArrow(walk, NODE)


def nodes_of(paths: DataFrame, splitters: list[bytes]) -> DataFrame:
    """All nodes of the tries of ``paths``, with the smallest conversation of each parent."""
    found = written(shard_nodes(paths, splitters), "nodes")
    bones = written(skeleton_nodes(found.where("path is not null")), "skeleton")
    ups = measured(bones.select(F.col("path").alias("parent"), F.col("conv_id").alias("up")))
    rest = found.where("path is null")
    hung = rest.where("parent is not null").join(ups, "parent").withColumn("parent_conv_id", F.col("up"))
    return rest.where("parent is null").unionByName(hung.select(*bones.columns)).unionByName(bones)


def below_layers(roots: DataFrame, tree: DataFrame) -> DataFrame:
    """Rows (next, below): children, leaves and saved tokens at and below the root of each lower layer.

    ``roots``: rows (key, n_children, n_leaves, saved_tokens) within the layer alone.  ``tree``: rows (key, next).
    Step i adds the sums of roots 2^i layers below, so the steps are as many as the doublings of the layers.
    """
    up = tree.where("next is not null").groupBy("next").agg(F.max("key").alias("up")).withColumnRenamed("next", "key")
    # A leaf of a layer at which conversations go on is none; every layer below has leaves of its own.
    rows = written(roots.join(up, "key", "left"), "roots")
    own = rows.select("key", "n_children")
    while not rows.where("up is not null").isEmpty():
        lower = rows.where("up is not null").groupBy("up").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        jump = rows.select(F.col("key").alias("up"), F.col("up").alias("upper"))
        rows = written(rows.join(jump, "up", "left").join(lower.withColumnRenamed("up", "key"), "key", "left").select(
            "key", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"), F.col("upper").alias("up")), "roots")
    return rows.join(own, "key").select(F.col("key").alias("next"), F.array("n_children", "n_leaves", "saved_tokens").alias("below"))


def trie(paths: DataFrame, layer: int = LAYER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each different prefix of the conversations ``paths`` (conv_id, pos, turn_id, words).

    ``pos`` counts from 1 within a conversation; a conversation without turns is one row with null ``pos``.  The prefix
    of no turns is the root.  ``n_leaves`` and ``saved_tokens`` are those of the subtree, with its top.  No
    conversation, no row.
    """
    pieces = written(layers(paths, layer), "pieces")
    rows = written(merged(pieces), "paths")
    splitters = splitters_of(rows, shard_rows)
    none = F.lit(None).cast("array<long>")
    if not rows.where("next is not null").isEmpty():
        # Where conversations go on, the end of a layer is no leaf: its leaves come from below.
        hold = F.when(F.col("next").isNotNull(), F.array(F.lit(1), F.lit(0), F.lit(0)).cast("array<long>"))
        first = nodes_of(rows.withColumn("below", hold), splitters)
        roots = first.where("depth = 0").select("key", "n_children", "n_leaves", "saved_tokens")
        below = below_layers(roots, rows.select("key", "next"))
        rows = written(rows.join(below, "next", "left"), "paths")
    else:
        rows = rows.withColumn("below", none)
    found = nodes_of(rows, splitters).withColumn("layer", F.conv(F.hex(F.expr("left(key, 8)")), 16, 10).cast("long"))
    # The parent of a lower layer's first turns also holds the conversations that end above them.
    above = rows.where("next is not null").select(F.col("next").alias("key"), F.col("conv_id").alias("above"))
    top = (F.col("layer") > 0) & (F.col("depth") == 1)
    first = found.where(top).join(above, "key").withColumn("parent_conv_id", F.col("above")).select(found.columns)
    found = found.where(~top).unionByName(first)
    # The root of a lower layer is the end of the layer above.
    return found.where("layer = 0 or depth > 0").select(
        "conv_id", (F.col("layer") * layer + F.col("depth")).alias("depth"), "parent_conv_id", "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
