"""Helpers the operators of this subpackage share: tables, shared folder, text batches as arrays, Bloom filters.

Wherever a text is hashed the hash is 64 or 128 bits wide.  Work over texts runs in Arrow batches that are cut into
pieces of at most ``PIECE_BYTES``, so memory depends on the longest text, never on the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterflow.operators.joins import join_back
from rosterflow.session import written

PIECE_BYTES = 1 << 20
# Bits of the largest Bloom filter: 32 MB a filter, whatever the input.  Beyond it only more rows pass the filter.
MOST_BLOOM_BITS = 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables.  Arrow batches are kept small, for the sake of very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches by the bytes of a text column.

    Yields the piece, all its bytes in one array, and the n + 1 borders of its texts in them (null: empty).
    """
    for batch in batches:
        texts = batch.column(column)
        if pa.types.is_large_string(texts.type) or texts.null_count:
            texts = pa.array(["" if x is None else x for x in texts.to_pylist()], pa.string())
        if not len(texts):
            continue
        borders = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(borders, borders[start] + PIECE_BYTES, "right")) - 1)
            own = borders[start:stop + 1]
            yield batch.slice(start, stop - start), data[own[0]:own[-1]], own - own[0]
            start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_UNDO = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _usual_powers(base: int) -> np.ndarray:
    return _powers_of(base, PIECE_BYTES + 1)


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    return _usual_powers(base)[:n] if n <= PIECE_BYTES + 1 else _powers_of(base, n)


def spans_of(inside: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each unbroken run of true bytes within a text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[borders[1:-1]] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(borders, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, for all spans at once."""
    spread = mixed(np.arange(1, 257, dtype=np.uint64))[data]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(spread * _powers(_BASE, len(data)), out=sums[1:])
    back = _powers(_UNDO, len(data) + 1)
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


class Bloom:
    """Membership bits of 64-bit hashes, two cells for each; the number of bits follows the count up to a fixed most."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(bits // 64, np.uint64) if words is None else words

    @staticmethod
    def size_for(count: int) -> int:
        return min(MOST_BLOOM_BITS, 1 << max(12, int(16 * max(count, 1) - 1).bit_length()))

    @staticmethod
    def cells(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        low = np.uint64(bits - 1)
        return [hashes & low, mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) & low]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for cell in self.cells(hashes, self.bits):
            out &= (self.words[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) == 1
        return out


def words_of_bits(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets the bits at the given cells: numbers of the 64-bit words that hold any, and these words."""
    cells = np.unique(cells)
    place, bit = cells >> np.uint64(6), np.uint64(1) << (cells & np.uint64(63))
    firsts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
    return place[firsts].astype(np.int64), (np.bitwise_or.reduceat(bit, firsts) if len(firsts) else bit).view(np.int64)


def collected_bits(rows: DataFrame, bits: int) -> Bloom:
    """A filter from rows (place, word); words of one place are united in Spark, so at most ``bits / 64`` rows come."""
    out = Bloom(bits)
    got = rows.groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()
    if got.num_rows:
        out.words[got["place"].to_numpy()] = got["word"].to_numpy().view(np.uint64)
    return out


def bloom_of(ids: DataFrame, column: str, count: int) -> Bloom:
    """A filter of the values of a long column."""
    bits = Bloom.size_for(count)

    def fill(batches):
        for batch in batches:
            got = mixed(batch.column(0).drop_null().to_numpy().astype(np.int64).view(np.uint64))
            place, word = words_of_bits(np.concatenate(Bloom.cells(got, bits)))
            yield pa.record_batch([pa.array(place), pa.array(word)], names=["place", "word"])

    return collected_bits(ids.select(column).mapInArrow(fill, "place long, word long"), bits)


def holds_ids(bloom: Bloom, ids: pa.Array) -> np.ndarray:
    """Which ids the filter may hold; a null id passes."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
    return bloom.holds(mixed(values)) | null


def sized(df: DataFrame, rows: int, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """Marks a table for broadcast if ``rows`` rows of ``row_bytes`` stay below ``most``; else Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= most else df


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the place of each row, from 1, among the rows of its key along ``order``; nulls come first, null is a key.

    Rows are sorted by range, so one key may fill many tasks; a task counts its own rows, and what lies before a task
    comes from one row per key and task.  Rows that are equal in ``order`` share a task: let it tell rows apart.
    """
    along = [F.asc_nulls_first(c) for c in [*keys, *order]]
    rows = written(df.repartitionByRange(*along).sortWithinPartitions(*along).withColumn(
        "_at", F.monotonically_increasing_id()), "numbered").withColumn("_task", F.shiftright("_at", 33))
    starts = rows.groupBy(*keys, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select(*keys, "_task", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return join_back(rows, starts, [*keys, "_task"]).withColumn(
        name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_task", "_first", "_before")


def measured(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """Marks a written table for broadcast if its rows hold at most ``most`` characters as JSON; else Spark shuffles."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no ASCII white space; null has none."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")
