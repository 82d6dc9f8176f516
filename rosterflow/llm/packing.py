"""Packing of token sequences by non-negative least squares.

Texts are cut at full windows while they are tokenised; what is left of each is shorter than a window.  Of these ends
only the histogram of lengths matters: all pairs and triples of lengths that fill a window exactly are enumerated,
non-negative least squares says how often to use each, the counts are rounded, and what the rounding leaves goes
greedily into the tightest open window.  Ends are packed in independent shards of bounded size, in parallel.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterflow.llm.common import pieces
from rosterflow.session import written

WINDOW = 2048
END_ID = 1
# Ends that one task packs on average.
SHARD = 60_000
STEPS = 100
# A step of the descent looks at sets that gain this share of the best one's gain.
LEAST_GAIN = 0.3


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from texts to lists of ids, equal to those of the tokenizer file without special tokens added.

    A byte-level BPE file whose ids follow its merges is run by a faster library with the same vocabulary; a text
    that spells an added token, or any other kind of file, goes through the file's own library.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)

    def plain(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]

    ranks = _ranks(spec)
    if ranks is None:
        return plain
    import public_tokenizers
    import tiktoken

    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    added = [t["content"] for t in spec.get("added_tokens", [])]

    def encode(texts: list[str]) -> list[list[int]]:
        return [plain([t])[0] if any(a in t for a in added) else fast.encode_ordinary(t) for t in texts]

    sample = "It's 12 o'clock,\n\n  said  the\tvoice: ÄÖ　漢字 🙂 x_y --- 3.14  !"
    return encode if plain([sample]) == encode([sample]) else plain


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes and id of each token, None unless the ids give the order of the merges."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = model["vocab"]
    last = -1
    for merge in model["merges"]:
        got = vocab["".join(merge if isinstance(merge, list) else merge.split(" "))]
        if got <= last:
            return None
        last = got
    added = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}


def cut_texts(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens): full windows of each text, and its end."""

    def cut(batches):
        encode = encoder(tokenizer)
        for batch, data, borders in pieces(batches, "text"):
            ids, rows = batch.column(0).to_pylist(), []
            at, whole = borders.tolist(), data.tobytes()
            for doc_id, got in zip(ids, encode([whole[a:b].decode() for a, b in zip(at, at[1:])])):
                packed = np.append(np.asarray(got, "<u4"), np.uint32(end_id)).astype("<u4")
                rows += [(doc_id, s, min(window, len(packed) - s), zlib.crc32(packed[s:s + window].tobytes()), len(packed))
                         for s in range(0, len(packed), window)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)],
                                  names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fillings(lengths: np.ndarray, window: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c, of given lengths that sum to the window; c is 0 for pairs."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    there[0] = True
    a, b = np.meshgrid(np.flatnonzero(there), np.flatnonzero(there), indexing="ij")
    c = window - a - b
    real = (a >= b) & (b >= c) & (c >= 0) & (b > 0)
    a, b, c = a[real], b[real], c[real]
    real = there[c]
    return np.stack([a[real], b[real], c[real]], 1)


def least_squares(sets: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Counts x >= 0 that bring the lengths used by the sets close to the histogram, in few sets.

    Coordinate descent from zero: a step takes the sets that lessen the squared error most and have no length in common,
    so that the best change of each is the best of all together.  What no step has chosen stays at 0.
    """
    a, b, c = sets.T
    norm = 2.0 + (c > 0) + 2.0 * (a == b) + 2.0 * (b == c) + 2.0 * (a == c)
    missing = histogram.astype(float)
    x = np.zeros(len(sets))
    for _ in range(steps):
        missing[0] = 0
        slope = missing[a] + missing[b] + missing[c]
        change = np.maximum(slope / norm, -x)
        gain = change * (2 * slope - change * norm)
        best = np.flatnonzero(gain > max(LEAST_GAIN * gain.max(), 1e-3))
        if not len(best):
            break
        best = best[np.argsort(-gain[best], kind="stable")]
        while len(best):
            # A set is taken if it comes first among those left for each of its lengths.
            own, rank = sets[best], np.arange(len(best))
            first = np.full(len(histogram), len(best))
            np.minimum.at(first, own, rank[:, None])
            first[0] = len(best)
            chosen = ((first[own] == rank[:, None]) | (own == 0)).all(1)
            taken = best[chosen]
            x[taken] += change[taken]
            np.subtract.at(missing, sets[taken], change[taken][:, None])
            used = np.zeros(len(histogram), bool)
            used[sets[taken]] = True
            used[0] = False
            best = best[~used[own].any(1)]
    return x


def counted_windows(histogram: np.ndarray, window: int = WINDOW) -> list[list[int]]:
    """Lengths of each window that the rounded counts fill, as far as the lengths are there."""
    free, bins = histogram.copy(), []
    sets = fillings(np.flatnonzero(histogram), window)
    if not len(sets):
        return bins
    x = np.rint(least_squares(sets, histogram)).astype(int)
    chosen = np.flatnonzero(x)
    chosen = chosen[np.argsort(-x[chosen], kind="stable")]
    for parts, want in zip(sets[chosen].tolist(), x[chosen].tolist()):
        parts = [p for p in parts if p]
        for _ in range(min(want, *(int(free[p]) // parts.count(p) for p in parts))):
            for p in parts:
                free[p] -= 1
            bins.append(parts)
    return bins


def pack(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each item (all shorter than the window)."""
    order = np.argsort(lengths, kind="stable")
    histogram = np.bincount(lengths, minlength=window + 1)
    firsts = np.concatenate(([0], np.cumsum(histogram)))
    bins = counted_windows(histogram, window)
    free = histogram - np.bincount([p for parts in bins for p in parts], minlength=len(histogram))
    # What is left: longest first, into the window with the least room that suffices.
    by_room: list[list[int]] = [[] for _ in range(window + 1)]
    rooms = np.zeros(window + 1, bool)
    for length in range(window, 0, -1):
        for _ in range(int(free[length])):
            room = length + int(np.argmax(rooms[length:]))
            if rooms[room]:
                own = by_room[room].pop()
                rooms[room] = bool(by_room[room])
            else:
                room, own = window, len(bins)
                bins.append([])
            bins[own] = [*bins[own], length]
            by_room[room - length].append(own)
            rooms[room - length] = room > length
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    given = firsts.copy()
    for number, parts in enumerate(bins):
        at = 0
        for length in parts:
            item = order[given[length]]
            given[length] += 1
            sequence[item], offset[item] = number, at
            at += length
    return sequence, offset


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece of a document.

    Null text: empty, one id.  Each row of ``docs`` (doc_id, text) is packed on its own, whatever repeats.  A sequence
    holds at most ``window`` ids; full windows have negative sequence ids.
    """
    cut = written(cut_texts(docs, tokenizer, window, end_id), "pieces")
    whole = cut.where(F.col("length") == window).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ends = cut.where(F.col("length") < window)
    shards = ends.count() // SHARD + 1
    # Dealt out at random, not by a key, so that no repeated document fills a shard; the seed makes a retry the same.
    dealt = ends.withColumn("shard", F.floor(F.rand(1) * shards))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        sequence, offset = pack(rows["length"].to_numpy(), window)
        own = (key[0].as_py() << 32) + sequence
        return rows.drop_columns(["shard"]).append_column("sequence_id", pa.array(own)).append_column("offset", pa.array(offset))

    packed = dealt.groupBy("shard").applyInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return whole.unionByName(packed)
