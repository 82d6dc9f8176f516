"""Rate limits and lockouts in event time."""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterflow import constants as C
from rosterflow.functions.text import is_blank
from rosterflow.operators import blocks, folds
from rosterflow.operators.joins import join_back


def _per_millisecond(requests: DataFrame, key: str, ts: str) -> DataFrame:
    return requests.select(F.col(key), folds.epoch_millis(ts).alias("ms")).groupBy(key, "ms").agg(
        F.count(F.lit(1)).alias("n"))


def _back_to_requests(requests: DataFrame, folded: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """Requests with the fold result of their millisecond and their place ``j`` in it; a null key is a key like others."""
    same = W.partitionBy(key, "ms").orderBy(seq)
    placed = requests.withColumn("ms", folds.epoch_millis(ts)).withColumn("j", F.row_number().over(same))
    return join_back(placed, folded, [key, "ms"])


# The steps take (ms, n) and return per-millisecond facts; each of the n requests
# then finds its own result from its place j.

def token_bucket_step(capacity: int, refill_per_minute: float):
    def step(state, row):
        tokens, last = state or (float(capacity), row.ms)
        if row.ms > last and refill_per_minute > 0:
            tokens = min(float(capacity), tokens + ((row.ms - last) / 1000.0) * (refill_per_minute / 60.0))
        spent = min(int(row.n), math.floor(tokens))
        return (tokens - spent, row.ms), (tokens, spent)
    return step


def anchored_window_step(window_ms: int):
    def step(state, row):
        start, used = state or (row.ms, 0)
        if row.ms - start > window_ms:
            start, used = row.ms, 0
        return (start, used + int(row.n)), (start, used)
    return step


def sliding_log_step(max_requests: int, window_ms: int):
    def step(state, row):
        log = [t for t in (state or []) if t > row.ms - window_ms]
        accepted = min(int(row.n), max(0, max_requests - len(log)))
        return log + [row.ms] * accepted, (accepted,)
    return step


def lockout_step(max_errors: int, lock_ms: int):
    def step(state, row):
        errors, until = state or (0, None)
        if until is not None and row.ms > until:
            errors, until = 0, None
        if until is not None:
            seconds = until // 1000 - row.ms // 1000
            return (errors, until), ("locked", errors, seconds // 60 + 1)
        if row.result == "ok":
            return (0, None), ("ok", 0, 0)
        errors += 1
        if errors >= max_errors:
            until = row.ms + lock_ms
        return (errors, until), (row.result, errors, 0)
    return step


def _surely_full(key: str, capacity: int, refill_per_minute: float):
    """Marks the first row of a block at which a bucket that was empty before it, and always pays for every request, is
    full: so is any other then."""
    def settled(rows: DataFrame) -> DataFrame:
        inside = W.partitionBy(key, "blk").orderBy("ms")
        refill = F.coalesce(F.col("ms") - F.lag("ms").over(inside), F.lit(0)) * (refill_per_minute / 60_000.0)
        rows = rows.withColumn("refill", refill).withColumn("net", F.sum(F.col("refill") - F.col("n")).over(
            inside.rowsBetween(W.unboundedPreceding, 0)))
        level = F.col("net") - F.min("net").over(inside.rowsBetween(W.unboundedPreceding, 0))
        # A margin above rounding errors, which a long sum may have.
        rows = rows.withColumn("level", level).withColumn("full", F.lag("level").over(inside) + F.col("refill") >= capacity + 1e-3)
        first = F.min(F.when(F.col("full"), F.col("ms"))).over(W.partitionBy(key, "blk"))
        return rows.withColumn("settled", F.coalesce(F.col("ms") == first, F.lit(False))).drop("refill", "net", "level", "full")
    return settled


def _surely_accepted(key: str, max_requests: int, window_ms: int, block_ms: int):
    """Marks rows from which on a whole window of requests is accepted whatever came before.

    That holds where no more requests than allowed lie in the window of each of them; an empty log does as well there.
    Only windows that lie within the block are judged.
    """
    def settled(rows: DataFrame) -> DataFrame:
        inside = W.partitionBy(key, "blk").orderBy("ms")
        start = F.col("blk") * block_ms
        rows = rows.withColumn("seen", F.sum("n").over(inside.rangeBetween(1 - window_ms, 0)))
        unsure = (F.col("seen") > max_requests) | (F.col("ms") - start < window_ms)
        rows = rows.withColumn("unsure", unsure.cast("int"))
        whole = (F.sum("unsure").over(inside.rangeBetween(0, window_ms - 1)) == 0) & (F.col("ms") + window_ms <= start + block_ms)
        # Neighbouring rows need not all start anew.
        rows = rows.withColumn("whole", whole)
        return rows.withColumn("settled", F.col("whole") & ~F.coalesce(F.lag("whole").over(inside), F.lit(False))).drop("seen", "unsure", "whole")
    return settled


def window_table(window_ms: int):
    """Exits of a block of requests for windows that open at a request, by the start of the window it is entered in."""
    def table(rows: pd.DataFrame) -> dict:
        ms, n = rows["ms"].to_numpy(), rows["n"].to_numpy()
        behind = np.concatenate(([0], np.cumsum(n)))
        last = folds.follow(np.searchsorted(ms, ms + window_ms, "right"))
        # A window that is open before the block ends within a window's length of its first request.
        near = int(np.searchsorted(ms, ms[0] + window_ms, "right")) + 1
        ends = last[:near]
        runs = np.flatnonzero(np.concatenate((ends[1:] != ends[:-1], [True])))
        return {"upto": ms[:near][runs].tolist(), "start": ms[ends[runs]].tolist(),
                "used": (behind[-1] - behind[ends[runs]]).tolist(), "first": int(ms[0]), "total": int(behind[-1])}
    return table


def window_hop(window_ms: int):
    def hop(state, exits):
        start, used = state or (exits["first"] - window_ms - 1, 0)
        run = bisect_right(exits["upto"], start + window_ms)
        if run == len(exits["upto"]):
            return [start, used + exits["total"]]
        return [exits["start"][run], exits["used"][run]]
    return hop


def lockout_table(max_errors: int, lock_ms: int):
    """Exits of a block of attempts: for each number of errors it is entered with, and by the time that a lock ends."""
    def table(rows: pd.DataFrame) -> dict:
        ms, wrong = rows["ms"].to_numpy(), (rows["result"] != "ok").to_numpy()
        size = len(ms)
        at = np.arange(size)
        good = np.flatnonzero(~wrong)
        # Row of the next success, and errors without one from each row on.
        next_good = np.append(good, size)[np.searchsorted(good, at)]
        run = next_good - at
        heads = np.flatnonzero(wrong & np.concatenate(([True], ~wrong[:-1])) & (run >= max_errors))
        later = np.append(heads, size)[np.searchsorted(heads, at, "right")]
        locks = np.where(run >= max_errors, at + max_errors - 1, np.where(later < size, later + max_errors - 1, size))
        until = np.append(ms, 0)[locks] + lock_ms
        after = np.where(locks < size, np.searchsorted(ms, until, "right"), size)
        last = folds.follow(after)
        trailing = size - (good[-1] + 1 if len(good) else 0)

        def end(row: int) -> list:
            row = int(last[row])
            if locks[row] < size:
                return [max_errors, int(until[row])]
            return [int(min(size - row, trailing)), None]

        entered = []
        for errors in range(max_errors):
            if run[0] + errors >= max_errors:
                closes = int(ms[max_errors - errors - 1]) + lock_ms
                row = int(np.searchsorted(ms, closes, "right"))
                entered.append(end(row) if row < size else [max_errors, closes])
            else:
                entered.append(end(int(next_good[0])) if next_good[0] < size else [errors + size, None])
        firsts = np.flatnonzero(np.concatenate(([True], ms[1:] != ms[:-1])))
        near = firsts[:int(np.searchsorted(ms[firsts], ms[0] + lock_ms, "right")) + 1]
        same = np.concatenate((last[near][1:] != last[near][:-1], [True])) | (locks[last[near]] >= size)
        runs = near[np.flatnonzero(same)]
        return {"entered": entered, "upto": ms[runs].tolist(), "free": [end(r) for r in runs]}
    return table


def lockout_hop(state, exits):
    errors, until = state or (0, None)
    if until is None:
        return exits["entered"][errors]
    run = bisect_right(exits["upto"], until)
    return [errors, until] if run == len(exits["upto"]) else exits["free"][run]


def token_bucket(
    requests: DataFrame, key: str, capacity: int, refill_per_minute: float, ts: str = "ts", seq: str = "seq",
    block_ms: int = blocks.BLOCK_MILLIS,
) -> DataFrame:
    """``allowed`` and the tokens left after each request; a bucket idle or little used for long enough is full again."""
    # One second on top, so that rounding cannot leave the bucket a hair below full.
    full_after = math.ceil(capacity * 60_000 / refill_per_minute) + 1000
    cut = folds.cut_at_gaps(_per_millisecond(requests, key, ts), key, full_after, block_ms,
                            _surely_full(key, capacity, refill_per_minute))
    folded = folds.fold(
        cut.select(key, "ms", "n", "piece"), [key, "piece"], ["ms"], ["ms", "n"],
        "tokens double, spent bigint", token_bucket_step(capacity, refill_per_minute))
    joined = _back_to_requests(requests, folded.select(key, "ms", "tokens", "spent"), key, ts, seq)
    return joined.withColumns({
        "allowed": F.col("j") <= F.col("spent"),
        "tokens_left": F.col("tokens") - F.least("j", "spent"),
    }).drop("ms", "j", "tokens", "spent")


def anchored_window(
    requests: DataFrame, key: str, max_requests: int, window_seconds: int, ts: str = "ts", seq: str = "seq",
    block_ms: int = blocks.BLOCK_MILLIS,
) -> DataFrame:
    """Window that opens at the first request; refused requests count too; blank keys are refused."""
    window_ms = window_seconds * 1000
    keyed = requests.filter(~is_blank(F.col(key)))
    cut = folds.cut_at_gaps(_per_millisecond(keyed, key, ts), key, window_ms + 1, block_ms)
    folded = folds.fold_blocks(
        cut.select(key, "ms", "n", "piece"), [key, "piece"], ["ms"], ["ms", "n"],
        "window_start bigint, used_before bigint", anchored_window_step(window_ms),
        window_table(window_ms), window_hop(window_ms), block_ms)
    joined = _back_to_requests(
        requests, folded.select(key, "ms", "window_start", "used_before"), key, ts, seq)
    used = F.col("used_before") + F.col("j")
    reset = F.col("window_start") + window_ms
    allowed = F.coalesce(used <= max_requests, F.lit(False))
    return joined.withColumns({
        "allowed": allowed,
        "remaining": F.greatest(F.lit(0), max_requests - used),
        "reset_epoch": F.floor(reset / 1000),
        "retry_after": F.when(allowed, F.lit(0)).otherwise(F.floor((reset - F.col("ms")) / 1000) + 1),
    }).drop("ms", "j", "window_start", "used_before")


def first_in_horizon(
    rows: DataFrame, key: str, horizon_ms: int, ts: str = "ts", seq: str = "seq", block_ms: int = blocks.BLOCK_MILLIS,
) -> DataFrame:
    """``accepted``: the first row of a key, and then the first one more than ``horizon_ms`` after the last accepted.

    Of rows of one millisecond the one with the smallest ``seq`` comes first.  Blocks of a key run side by side.
    """
    cut = folds.cut_at_gaps(_per_millisecond(rows, key, ts), key, horizon_ms + 1, block_ms)
    folded = folds.fold_blocks(
        cut.select(key, "ms", "n", "piece"), [key, "piece"], ["ms"], ["ms", "n"],
        "window_start bigint, used_before bigint", anchored_window_step(horizon_ms),
        window_table(horizon_ms), window_hop(horizon_ms), max(block_ms, horizon_ms))
    joined = _back_to_requests(rows, folded.select(key, "ms", "used_before"), key, ts, seq)
    return joined.withColumn("accepted", F.col("used_before") + F.col("j") == 1).drop("ms", "j", "used_before")


def sliding_log(
    requests: DataFrame, key: str, max_requests: int, window_seconds: int, ts: str = "ts", seq: str = "seq",
    block_ms: int = blocks.BLOCK_MILLIS,
) -> DataFrame:
    """``allowed`` when fewer than ``max_requests`` accepted requests lie in the window before."""
    window_ms = window_seconds * 1000
    # A block is to hold several windows.
    block_ms = max(block_ms, 8 * window_ms)
    cut = folds.cut_at_gaps(_per_millisecond(requests, key, ts), key, window_ms, block_ms,
                            _surely_accepted(key, max_requests, window_ms, block_ms))
    folded = folds.fold(
        cut.select(key, "ms", "n", "piece"), [key, "piece"], ["ms"], ["ms", "n"],
        "accepted bigint", sliding_log_step(max_requests, window_ms))
    joined = _back_to_requests(requests, folded.select(key, "ms", "accepted"), key, ts, seq)
    return joined.withColumn("allowed", F.col("j") <= F.col("accepted")).drop("ms", "j", "accepted")


def lockout(
    attempts: DataFrame, key: str, max_errors: int = C.MAX_ERROR_COUNT, lock_seconds: int = C.LOCK_SECONDS,
    ts: str = "ts", seq: str = "seq", block_ms: int = blocks.BLOCK_MILLIS,
) -> DataFrame:
    """Outcome, error count and remaining lock minutes per attempt.

    A key is cut after every success that no lock can have covered, because more
    than a lock's length lies between it and the attempt before.
    """
    lock_ms = lock_seconds * 1000
    timed = attempts.withColumn("ms", folds.epoch_millis(ts))
    order = ["ms", seq]
    clears = (F.col("result") == "ok") & (F.col("ms") - F.col("prev_ms") > lock_ms)
    cut = folds.cut_after(timed, key, order, clears, block_ms)
    folded = folds.fold_blocks(
        cut.select(*attempts.columns, "ms", "piece"), [key, "piece"], order, ["ms", "result"],
        "outcome string, errors bigint, lock_minutes bigint", lockout_step(max_errors, lock_ms),
        lockout_table(max_errors, lock_ms), lockout_hop, block_ms)
    return folded.drop("ms", "piece")


def burst_count(
    requests: DataFrame, key: str, window_seconds: int, max_requests: int, ts: str = "ts", seq: str = "seq",
) -> DataFrame:
    """Earlier requests of the key within the window, and whether they reach the limit.

    Requests are counted per millisecond first.  Each count is also copied into
    the next window-sized block, so a block plus its copies holds everything its
    own rows can see: at most two entries per millisecond of the window.
    """
    window_ms = window_seconds * 1000
    block = F.floor(F.col("ms") / window_ms)
    copies = F.array(F.struct(block.alias("blk"), F.lit(True).alias("own")),
                     F.struct((block + 1).alias("blk"), F.lit(False).alias("own")))
    spread = _per_millisecond(requests, key, ts).withColumn("c", F.explode(copies)).select(
        key, "ms", "n", "c.blk", "c.own")
    before = W.partitionBy(key, "blk").orderBy("ms").rangeBetween(1 - window_ms, -1)
    seen = spread.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("own")
    joined = _back_to_requests(requests, seen.select(key, "ms", "before"), key, ts, seq)
    return joined.withColumn("recent", F.col("before") + F.col("j") - 1).withColumn(
        "limited", F.col("recent") >= max_requests).drop("ms", "j", "before")
