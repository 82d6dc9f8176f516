"""Similarity join of documents on word shingles as a blocked sparse matrix product.

The documents are the rows and the hashed n-grams the columns of a sparse 0/1 matrix M; overlaps are the entries of
M times its transpose.  Three bounds that follow from the set sizes keep the product small and exact:

* Equal sets are one row of the matrix.
* Of each row only the lowest ``sample`` of its hashes is looked at first.  Two sets of sizes n and m that link share
  at least ceil(0.1 * max(n, m)) of these (for sample 0.3 and similarity 0.8), so they meet in one of the rarest
  columns that remain when as many of the commonest are left off.  Columns of one document need no product.
* Columns that meet in one smallest document form a block.  In a block overlaps are accumulated over slices of
  columns, and a pair is given up where its sizes rule a link out.  Large blocks are cut into pairs of sub-blocks.

A block reports only as many links as it needs to connect its rows, so no group of n copies makes n * n rows.  Where links
are counted, a row of the block reports their number, and a pair counts in the smallest of the blocks in which it meets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterflow.llm.common import bloom_of, holds_ids, mixed, pieces, span_hashes, spans_of
from rosterflow.session import written

WORDS = 5
PERCENT = 80
# Tenths of a set's hashes that the first look takes; any value above 2 is exact.
SAMPLE = 3
# A block of more rows, or more entries, is cut into sub-blocks of about this size.
BLOCK_ROWS = 1500
BLOCK_ENTRIES = 1_000_000
_BLANK = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, borders: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, end to end; and the n + 1 borders between the texts."""
    data = _LOWER[data]
    starts, ends, owner = spans_of(~_BLANK[data], borders)
    hashes = span_hashes(data, starts, ends)
    texts = len(borders) - 1
    n_words = np.bincount(owner, minlength=texts)
    rolled = np.zeros(len(hashes), np.uint64)
    first = np.concatenate(([0], np.cumsum(n_words)))[:-1]
    place = np.arange(len(hashes)) - np.repeat(first, n_words)
    for k in range(words):
        # Words beyond a short text's end count as zero, so a whole short text is one shingle.
        part = np.zeros(len(hashes), np.uint64)
        part[:max(len(hashes) - k, 0)] = hashes[k:]
        part[place + k >= np.repeat(n_words, n_words)] = 0
        rolled = mixed(rolled * np.uint64(3) + part + np.uint64(k + 1))
    whole = np.repeat(np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1)), n_words)
    real = place < whole
    owner, rolled = owner[real], rolled[real]
    order = np.lexsort((rolled, owner))
    owner, rolled = owner[order], rolled[order]
    new = np.ones(len(rolled), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1])
    owner, rolled = owner[new], rolled[new]
    return rolled, np.searchsorted(owner, np.arange(texts + 1))


def _lists(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(values.view(np.int64)))


# Rows of one doc_id with different texts are told apart by so many bits of their signature.
_MARK = (1 << 24) - 1


def _sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    return (total[borders[1:]] - total[borders[:-1]]).view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS, with_sample: int = 0) -> DataFrame:
    """Rows (doc_id, n, a, b[, low]): set size, 128 bits that equal sets share, and the lowest tenths of the hashes."""

    def sign(batches):
        for batch, data, borders in pieces(batches, "text"):
            values, at = shingle_sets(data, borders, words)
            out = [batch.column(0), pa.array(np.diff(at)), pa.array(_sums(values, at)),
                   pa.array(_sums(mixed(values ^ np.uint64(0xA0761D6478BD642F)), at))]
            if with_sample:
                n = np.diff(at)
                taken = n - n * (10 - with_sample) // 10
                low = np.arange(len(values)) - np.repeat(at[:-1], n) < np.repeat(taken, n)
                out.append(_lists(values[low], np.concatenate(([0], np.cumsum(taken)))))
            yield pa.record_batch(out, names=["doc_id", "n", "a", "b", "low"][:len(out)])

    return docs.select("doc_id", "text").mapInArrow(
        sign, "doc_id long, n long, a long, b long" + ", low array<long>" * bool(with_sample))


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, mark, grams) of the documents in ``ids``; a Bloom filter keeps most others from being shuffled."""
    bloom = bloom_of(ids, "doc_id", ids.count())
    handed = docs.sparkSession.sparkContext.broadcast(bloom)

    def build(batches):
        for batch in batches:
            batch = batch.filter(pa.array(holds_ids(handed.value, batch.column(0))))
            for piece, data, borders in pieces([batch], "text"):
                values, at = shingle_sets(data, borders, words)
                yield pa.record_batch([piece.column(0), pa.array(_sums(values, at) & _MARK), _lists(values, at)],
                                      names=["doc_id", "mark", "grams"])

    rows = docs.select("doc_id", "text").mapInArrow(build, "doc_id long, mark long, grams array<long>")
    # Repeated rows of one text are one row of the matrix.
    return rows.groupBy("doc_id", "mark").agg(F.first("grams").alias("grams"))


def blocks(low: DataFrame, percent: int = PERCENT, sample: int = SAMPLE) -> DataFrame:
    """Rows (block, doc_id, mark, n): documents that meet in a rare column, under the smallest document of the column.

    ``low``: rows (doc_id, mark, n, low) of different sets.  Two that link share a block.
    """
    if not 0 < 10 * (10 - sample) < percent:
        raise ValueError("the sample must leave off fewer hashes than linked sets may differ in")
    row = ["doc_id", "mark", "n"]
    entries = low.select(*row, F.explode("low").alias("gram"))
    common = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    shared = entries.join(common, "gram")
    # Sizes n <= m link only with n * 100 >= m * percent and an overlap of percent of m at least.  With k tenths looked
    # at, ceil(percent / 100 * m) - floor((10 - k) / 10 * m) shared hashes are among them, at least this share of n:
    least = F.ceil(F.col("n") * F.lit(percent - 10 * (10 - sample)) / 100)
    taken = F.col("n") - F.floor(F.col("n") * (10 - sample) / 10)
    ranked = shared.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("docs", "gram"))).alias("rare"))
    # Columns of one document alone come first in order of rarity; they use up this prefix but meet nobody.
    ranked = ranked.withColumn("prefix", taken - least + 1 - (taken - F.size("rare"))).where("prefix > 0")
    rare = written(ranked.select(*row, F.explode(F.slice("rare", F.lit(1), F.col("prefix").cast("int"))).alias("r"))
                   .select(*row, F.col("r.gram").alias("gram")), "rare")
    heads = rare.groupBy("gram").agg(F.min("doc_id").alias("block"), F.count(F.lit(1)).alias("docs")).where("docs > 1")
    return rare.join(heads.drop("docs"), "gram").select("block", *row).distinct()


class _Forest:
    """Which rows of one block are connected so far."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class _Tally:
    """Weights of all rows that each row of a cell links with, but for pairs that meet in one of their ``earlier`` blocks."""

    def __init__(self, weights: np.ndarray, earlier: list[np.ndarray]):
        self.weights, self.links = weights, np.zeros(len(weights), np.int64)
        _, code, counts = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
        held = counts[code] > 1
        self.owner = np.repeat(np.arange(len(earlier)), [len(e) for e in earlier])[held]
        self.code = (np.cumsum(counts > 1) - 1)[code[held]]

    def add(self, left: np.ndarray, right: np.ndarray, link: np.ndarray, columns_at_once: int = 2048) -> None:
        met = np.zeros(link.shape, bool)
        place = np.full((2, len(self.weights)), -1)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        for first in range(0, int(self.code.max(initial=-1)) + 1, columns_at_once):
            inside = (self.code >= first) & (self.code < first + columns_at_once)
            factors = [np.zeros((n, columns_at_once), np.float32) for n in link.shape]
            for rows, factor in zip(place, factors):
                row = rows[self.owner[inside]]
                factor[row[row >= 0], self.code[inside][row >= 0] - first] = 1
            met |= factors[0] @ factors[1].T > 0
        once = (link & ~met).astype(np.int64)
        self.links[left] += once @ self.weights[right]
        self.links[right] += once.T @ self.weights[left]


def _product(grams: list[np.ndarray], side: np.ndarray, percent: int, rows_at_once: int = 512, columns_at_once: int = 2048,
             tally: _Tally | None = None):
    """Pairs (i, j) that link and are not connected by earlier ones; ``tally`` takes connected ones too.

    ``side`` false and true: rows of two parts, of which only pairs across count; one value throughout: all pairs.
    """
    sizes = np.array([len(g) for g in grams])
    if len(grams) == 2:
        both = len(np.intersect1d(grams[0], grams[1], assume_unique=True))
        link = both * 100 >= percent * (sizes.sum() - both)
        if link and tally:
            tally.add(np.array([0]), np.array([1]), np.ones((1, 1), bool))
        return [(0, 1)] if link else []
    _, code, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(grams)), sizes)
    # Entries of columns that one row holds add to no overlap; a row that has too many of them links with nothing.
    held = counts[code] > 1
    owner, code = owner[held], (np.cumsum(counts > 1) - 1)[code[held]]
    alive = np.flatnonzero(np.bincount(owner, minlength=len(grams)) * 100 >= percent * sizes)
    alive = alive[np.lexsort((sizes[alive], side[alive]))]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = int(code[-1]) + 1 if len(code) else 0
    cuts = np.searchsorted(code, np.arange(0, width + columns_at_once, columns_at_once))
    rank = np.full(len(grams), -1)
    rank[alive] = np.arange(len(alive))
    own, ordered = rank[owner], sizes[alive]
    across = bool(side[alive].any() and not side[alive].all())
    border = int(np.searchsorted(side[alive], True)) if across else 0
    ends = border if across else len(alive)
    forest, found = _Forest(len(grams)), []
    for top in range(0, ends, rows_at_once):
        left = slice(top, min(top + rows_at_once, ends))
        # Rows are in order of size, so those too small or too large for a whole slice are not multiplied with it.
        first = border + int(np.searchsorted(ordered[border:] * 100, ordered[top] * percent)) if across else top
        last = border + int(np.searchsorted(ordered[border:] * percent, ordered[left.stop - 1] * 100, "right"))
        for low in range(first, last, rows_at_once):
            right = slice(low, min(low + rows_at_once, last))
            overlap = np.zeros((left.stop - left.start, right.stop - right.start), np.float32)
            for k in range(len(cuts) - 1):
                row, column = own[cuts[k]:cuts[k + 1]], code[cuts[k]:cuts[k + 1]] - k * columns_at_once
                factors = []
                for rows in (left, right):
                    inside = (row >= rows.start) & (row < rows.stop)
                    factors.append(np.zeros((rows.stop - rows.start, min(columns_at_once, width)), np.float32))
                    factors[-1][row[inside] - rows.start, column[inside]] = 1
                overlap += factors[0] @ factors[1].T
            both = np.rint(overlap).astype(np.int64)
            link = both * 100 >= percent * (ordered[left][:, None] + ordered[right][None, :] - both)
            if tally:
                tally.add(alive[left], alive[right], np.triu(link, 1) if low == top else link)
            for x, y in zip(*np.nonzero(link)):
                i, j = int(alive[top + x]), int(alive[low + y])
                if i != j and forest.join(i, j):
                    found.append((i, j))
    return found


def links(docs: DataFrame, met: DataFrame, words: int = WORDS, percent: int = PERCENT, weights: DataFrame | None = None) -> DataFrame:
    """Rows (x, y) of doc_ids that link, enough to connect all that are connected within their blocks.

    With ``weights``, rows (doc_id, mark, weight), there are also rows (x, mark, n) without y: document x with this mark
    links with documents of weight n, to be summed.
    """
    met = written(met, "blocks")
    load = met.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("entries"))
    parts = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("entries") / BLOCK_ENTRIES), F.lit(1)).cast("int")
    # A part of a cut block meets itself and each other part once: (0, 0), (0, 1), (1, 1) and so on.
    own = F.pmod(F.xxhash64("doc_id", "mark"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(
        F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))
    placed = met.join(load.where("rows > 1").select("block", parts.alias("parts")), "block").withColumn("own", own)
    placed = placed.select("block", "doc_id", "mark", "own", F.explode(cells).alias("cell"))
    grams = _sets(docs, met.select("doc_id").distinct(), words)
    if weights is not None:
        # A row meets others in fewer blocks than its set has hashes, mostly in one to three.
        others = met.groupBy("doc_id", "mark").agg(F.collect_set("block").alias("others"))
        placed = placed.join(weights.join(others, ["doc_id", "mark"]), ["doc_id", "mark"])
    dealt = placed.join(grams, ["doc_id", "mark"]).select(
        "block", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "doc_id", "own", "grams",
        *(["mark", "weight", "others"] if weights is not None else []))
    dealt = dealt.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "doc_id")

    counting = weights is not None

    def multiply(batches):
        key, rows, out = None, [], []

        def finish():
            side = np.array([key[1] != key[2] and r[1] == key[2] for r in rows]) if rows else np.zeros(0, bool)
            # Two parts meet only where both have rows; those of one part meet in its own cell.
            if len(rows) > 1 and (key[1] == key[2] or side.any() and not side.all()):
                tally = None
                if counting:
                    tally = _Tally(np.array([r[4] for r in rows], np.int64), [r[5][r[5] < key[0]] for r in rows])
                for i, j in _product([r[2] for r in rows], side, percent, tally=tally):
                    out.append((rows[i][0], rows[j][0], None, None))
                if tally:
                    out.extend((rows[i][0], None, rows[i][3], int(tally.links[i])) for i in np.flatnonzero(tally.links))

        def found():
            columns = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["x", "y", "mark", "n"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            ids, owns, grams = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
            values = grams.values.to_numpy()
            at = grams.offsets.to_numpy()
            for r, k in enumerate(keys):
                if k != key:
                    finish()
                    key, rows = k, []
                more = ()
                if counting:
                    more = batch.column(6)[r].as_py(), batch.column(7)[r].as_py(), np.array(batch.column(8)[r].as_py(), np.int64)
                rows.append((ids[r], owns[r], values[at[r]:at[r + 1]].copy(), *more))
            if out:
                yield found()
        finish()
        yield found()

    return dealt.mapInArrow(multiply, "x long, y long, mark long, n long")


def components(edges: DataFrame) -> DataFrame:
    """Rows (doc_id, component_id) of all ends of edges (x, y): the smallest id reachable.

    Each round hangs every end on that end among itself and its neighbours whose hash is lowest, and draws the edges
    between these instead; hashes differ by round, so a constant share of the ends goes each time, in chains too.
    Rounds are written tables, and the driver learns only whether any edge is left.
    """
    spark = edges.sparkSession
    edges = written(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
                    .where("x < y").distinct(), "edges")
    hung = []
    while not edges.isEmpty():
        rank = [F.struct(F.xxhash64(c, F.lit(len(hung))), F.col(c).alias("id")) for c in ("x", "y")]
        both = edges.select("x", rank[1].alias("to")).union(edges.select(F.col("y").alias("x"), rank[0].alias("to")))
        low = both.groupBy("x").agg(F.min("to").alias("to"))
        up = written(low.select("x", F.least(rank[0], F.col("to"))["id"].alias("up")), "up")
        hung.append(up)
        ups = up.select(F.col("x").alias("y"), F.col("up").alias("up_y"))
        edges = written(edges.join(up, "x").join(ups, "y").select(
            F.least("up", "up_y").alias("x"), F.greatest("up", "up_y").alias("y")).where("x < y").distinct(), "edges")
    if not hung:
        return spark.createDataFrame([], "doc_id long, component_id long")
    out = hung[0].select(F.col("x").alias("doc_id"), F.col("up").alias("root"))
    for up in hung[1:]:
        out = out.join(up.select(F.col("x").alias("root"), "up"), "root", "left").select(
            "doc_id", F.coalesce("up", "root").alias("root"))
    out = written(out, "roots")
    return out.join(out.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, sample: int = SAMPLE,
                    count_links: bool = False) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id[, n_links]), one for each row of ``docs`` (doc_id, text).

    Documents without words are linked with nothing.  Rows that share a doc_id are nodes of one name: their links
    are those of all their texts.  A null doc_id is linked with nothing and has a null component.  ``n_links`` is the
    number of other rows, those of the same doc_id included, with which the row's text links, each counted once.
    """
    every = written(signatures(docs, words), "signatures")
    linkable = every.where("n > 0 and doc_id is not null")
    classes = written(linkable.groupBy("n", "a", "b").agg(
        F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("size")), "classes")
    low = signatures(docs, words, sample).where("n > 0 and doc_id is not null")
    heads = low.groupBy("n", "a", "b").agg(F.min("doc_id").alias("doc_id"), F.first("low").alias("low"))
    heads = written(heads.select("doc_id", F.col("a").bitwiseAND(_MARK).alias("mark"), "n", "low"), "heads")
    sizes = classes.select("n", "a", "b", "size", F.col("head").alias("doc_id"), F.col("a").bitwiseAND(_MARK).alias("mark"))
    weights = sizes.select("doc_id", "mark", F.col("size").alias("weight")) if count_links else None
    near = links(docs, blocks(heads, percent, sample), words, percent, weights)
    near = written(near, "links") if count_links else near
    # Members hang on the head of their class; a doc_id with two texts ties two classes together.
    member = linkable.join(classes, ["n", "a", "b"]).select("doc_id", "head").distinct()
    ties = member.where("doc_id <> head").select(F.col("head").alias("x"), F.col("doc_id").alias("y"))
    found = components(near.where("y is not null").select("x", "y").union(ties))
    out = every.join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    shown = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    if not count_links:
        return out.select(shown)
    counted = near.where("y is null").groupBy(F.col("x").alias("doc_id"), "mark").agg(F.sum("n").alias("others"))
    # Only texts that link with any other text, their own copies included, are looked up.
    counted = sizes.join(counted, ["doc_id", "mark"], "left").select(
        "n", "a", "b", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")).where("n_links > 0")
    n_links = F.when(F.col("doc_id").isNotNull(), F.col("n_links"))
    return out.join(counted, ["n", "a", "b"], "left").select(*shown, F.coalesce(n_links, F.lit(0)).cast("long").alias("n_links"))
