"""Line deduplication with two Bloom filters.

One pass sets a cell for every line key that a document holds, once-seen, and again, twice-seen, where the cell was
set before.  Only keys whose cells are all twice-seen are suspected; these alone are shuffled, confirmed by a 128-bit
hash, and given to the smallest document that holds them.  All other lines never leave their task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterflow.llm.common import Bloom, collected_bits, mixed, words_of_bits
from rosterflow.session import written

STRIPPED = b"\x20\x09\x0a\x0b\x0c\x0d"
SHORTEST = 10
# Stands for a null id: such rows count as one document that comes after all others.
NO_ID = (1 << 63) - 1


def key_hash(line: bytes, shortest: int) -> bytes | None:
    """128 bits of a line's key, None if the key has fewer code points than ``shortest``."""
    key = line.strip(STRIPPED).lower()
    if len(key) < shortest or len(key) < 4 * shortest and len(key.decode()) < shortest:
        return None
    return xxhash.xxh3_128_digest(key)


def _texts(batch: pa.RecordBatch, at: int = 1):
    return [b"" if x is None else x for x in batch.column(at).cast(pa.binary()).to_pylist()]


def _seen(docs: DataFrame, bits: int, shortest: int) -> DataFrame:
    """Rows (twice, place, word): cells that a task has set once and again."""

    def fill(batches):
        once = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            cells = []
            for text in _texts(batch):
                keys = {k for line in text.split(b"\n") if (k := key_hash(line, shortest))}
                if keys:
                    got = np.frombuffer(b"".join(keys), np.uint64)[::2]
                    cells.append(np.unique(np.concatenate(Bloom.cells(mixed(got), bits))))
            if not cells:
                continue
            cells, counts = np.unique(np.concatenate(cells), return_counts=True)
            place, bit = cells >> np.uint64(6), np.uint64(1) << (cells & np.uint64(63))
            again = (counts > 1) | (once[place] & bit != 0)
            own, word = words_of_bits(cells)
            once[own] |= word.view(np.uint64)
            place, word = words_of_bits(cells[again])
            yield pa.record_batch([pa.array(np.ones(len(place), bool)), pa.array(place), pa.array(word)],
                                  names=["twice", "place", "word"])
        place = np.flatnonzero(once)
        for at in range(0, len(place), 1 << 16):
            own = place[at:at + (1 << 16)]
            yield pa.record_batch([pa.array(np.zeros(len(own), bool)), pa.array(own), pa.array(once[own].view(np.int64))],
                                  names=["twice", "place", "word"])

    return docs.mapInArrow(fill, "twice boolean, place long, word long")


def twice_seen(docs: DataFrame, bits: int, shortest: int) -> Bloom:
    """The twice-seen filter of all documents.

    Bits that two tasks have set once are found by carrying sums: with x the number of tasks that set a bit, the
    bit is twice-seen if x > 1, which the pair (or, or of ands) keeps while words are united in any order.
    """
    rows = _seen(docs, bits, shortest)
    once = F.collect_list(F.when(~F.col("twice"), F.col("word")))
    # A place gets at most one row a task with "twice" false, so the list is bounded by the number of tasks.
    united = rows.groupBy("place").agg(once.alias("once"), F.bit_or(F.when(F.col("twice"), F.col("word"))).alias("again"))
    none = F.struct(F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"))
    folded = F.aggregate("once", none, lambda acc, x: F.struct(
        acc.one.bitwiseOR(x).alias("one"), acc.two.bitwiseOR(acc.one.bitwiseAND(x)).alias("two")))
    return collected_bits(united.select(
        "place", F.coalesce("again", F.lit(0).cast("long")).bitwiseOR(folded.two).alias("word")).where("word <> 0"), bits)


def dropped_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Rows (doc_id, keys): hashes of the lines that a document loses; only documents that lose any."""
    size = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    seen = twice_seen(docs, Bloom.size_for(size), shortest)
    handed = docs.sparkSession.sparkContext.broadcast((seen.bits, seen.words))

    def suspects(batches):
        bits, words = handed.value
        seen = Bloom(bits, words)
        for batch in batches:
            ids, out = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch)):
                keys = list(dict.fromkeys(k for line in text.split(b"\n") if (k := key_hash(line, shortest))))
                if keys:
                    held = seen.holds(mixed(np.frombuffer(b"".join(keys), np.uint64)[::2]))
                    own = [k for k, x in zip(keys, held) if x]
                    ids += [NO_ID if doc_id is None else doc_id] * len(own)
                    out += own
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "key"])

    rows = written(docs.mapInArrow(suspects, "doc_id long, key binary"), "suspects")
    # A table of its own, so that Spark can split the rows of a key that a third of the documents hold.
    firsts = written(rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(
        "first < last").select("key", "first"), "firsts")
    return rows.join(firsts, "key").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def dedup_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Every row of ``docs`` as (doc_id, kept, n_lines, n_dropped, kept_sha256), and the columns named in ``docs``.

    A key of at least ``shortest`` code points that two documents hold stays in the smallest ``doc_id`` alone.
    Null or empty text: one empty line.  Rows with one doc_id are one document and share its decisions; a null
    doc_id comes after all others.  ``docs`` needs doc_id and text; other columns are passed through by ``carry``.
    """
    slim = docs.select("doc_id", "text")
    drops = dropped_lines(slim, shortest).select(F.col("doc_id").alias("_rf_id"), F.col("keys").alias("_rf_keys"))
    schema = docs.schema
    names = [f"_rf_{i}" for i in range(len(schema))]
    at_id, at_text = [next(i for i, f in enumerate(schema) if f.name == c) for c in ("doc_id", "text")]
    own = docs.toDF(*names)
    joined = own.join(drops, F.coalesce(names[at_id], F.lit(NO_ID)) == F.col("_rf_id"), "left").select(*names, "_rf_keys")

    def keep(batches):
        for batch in batches:
            texts, kept, before, gone, digests = _texts(batch, at_text), [], [], [], []
            for text, keys in zip(texts, batch.column(len(names)).to_pylist()):
                lines = text.split(b"\n")
                stay = lines
                if keys:
                    keys = set(keys)
                    stay = [line for line in lines if key_hash(line, shortest) not in keys]
                whole = b"\n".join(stay)
                kept.append(whole)
                before.append(len(lines))
                gone.append(len(lines) - len(stay))
                digests.append(hashlib.sha256(whole).hexdigest())
            columns = [batch.column(i) for i in range(len(names)) if i != at_text]
            yield pa.record_batch(
                [*columns, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()),
                 pa.array(gone, pa.int64()), pa.array(digests)], names=out_names)

    others = [n for i, n in enumerate(names) if i != at_text]
    out_names = [*others, "_rf_kept", "_rf_lines", "_rf_dropped", "_rf_sha"]
    kinds = [own.schema[n].dataType.simpleString() for n in others] + ["string", "long", "long", "string"]
    out = joined.mapInArrow(keep, ", ".join(f"{n} {k}" for n, k in zip(out_names, kinds)))

    def named(i: int) -> Column:
        return F.col("_rf_kept" if i == at_text else names[i]).alias(schema[i].name)

    return out.select(*[named(i) for i in range(len(schema))], F.col("_rf_lines").alias("n_lines"),
                      F.col("_rf_dropped").alias("n_dropped"), F.col("_rf_sha").alias("kept_sha256"))
