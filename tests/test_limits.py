"""Limiters against a plain simulation, with a hot key, equal times and many blocks."""

import collections
import datetime as dt
import math
import random

import pandas as pd
from pyspark.sql import functions as F

from rosterflow.operators import folds, limits

START = dt.datetime(2024, 3, 1)


def requests(n=900, seed=3):
    rng = random.Random(seed)
    rows, clock = [], 0
    for seq in range(n):
        clock += rng.choice([0, 0, 40, 900, 5_000, 20_000, 70_000])
        key = "hot" if rng.random() < 0.5 else rng.choice(["k0", "k1", "k2", None])
        rows.append((seq, key, START + dt.timedelta(milliseconds=clock), rng.choice(["ok", "wrong", "wrong", "expired"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, key string, ts timestamp_ntz, result string")


def millis(ts):
    return int((ts - dt.datetime(1970, 1, 1)) / dt.timedelta(milliseconds=1))


def by_seq(df, *columns):
    return {r["seq"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_token_bucket(spark):
    rows, want, state = requests(), {}, {}
    for seq, key, ts, _ in rows:
        tokens, last = state.get(key, (3.0, millis(ts)))
        tokens = min(3.0, tokens + (millis(ts) - last) / 1000.0 * (6 / 60.0))
        want[seq] = (tokens >= 1,)
        state[key] = (tokens - 1 if tokens >= 1 else tokens, millis(ts))
    got = limits.token_bucket(frame(spark, rows), "key", 3, 6, block_ms=120_000)
    assert by_seq(got, "allowed") == want
    assert len({w for w in want.values()}) == 2


def test_anchored_window(spark):
    rows, want, state = requests(), {}, {}
    for seq, key, ts, _ in rows:
        start, used = state.get(key, (millis(ts), 0))
        if millis(ts) - start > 60_000:
            start, used = millis(ts), 0
        used += 1
        state[key] = (start, used)
        allowed = used <= 4
        want[seq] = (allowed, max(0, 4 - used), 0 if allowed else (start + 60_000 - millis(ts)) // 1000 + 1)
        if key is None:
            want[seq] = (False, 0, None)
    got = limits.anchored_window(frame(spark, rows), "key", 4, 60, block_ms=120_000)
    assert by_seq(got, "allowed", "remaining", "retry_after") == want


def test_anchored_window_refuses_blank_keys(spark):
    rows = [(0, " ", START, "ok"), (1, None, START, "ok"), (2, "a", START, "ok")]
    got = limits.anchored_window(frame(spark, rows), "key", 1, 60)
    assert by_seq(got, "allowed") == {0: (False,), 1: (False,), 2: (True,)}


def test_sliding_log(spark):
    rows, want, state = requests(), {}, {}
    for seq, key, ts, _ in rows:
        log = [t for t in state.get(key, []) if t > millis(ts) - 30_000]
        want[seq] = (len(log) < 2,)
        state[key] = log + [millis(ts)] if len(log) < 2 else log
    got = limits.sliding_log(frame(spark, rows), "key", 2, 30, block_ms=120_000)
    assert by_seq(got, "allowed") == want


def test_lockout(spark):
    rows, want, state = requests(), {}, {}
    for seq, key, ts, result in rows:
        errors, until = state.get(key, (0, None))
        now = millis(ts)
        if until is not None and now > until:
            errors, until = 0, None
        if until is not None:
            want[seq] = ("locked", errors)
        elif result == "ok":
            errors, until = 0, None
            want[seq] = ("ok", 0)
        else:
            errors += 1
            until = now + 45_000 if errors >= 4 else None
            want[seq] = (result, errors)
        state[key] = (errors, until)
    got = limits.lockout(frame(spark, rows), "key", 4, 45, block_ms=120_000)
    assert by_seq(got, "outcome", "errors") == want
    assert any(w[0] == "locked" for w in want.values())


def test_burst_count(spark):
    rows = requests()
    want = {
        seq: (sum(1 for s, k, t, _ in rows if k == key and s < seq and millis(t) > millis(ts) - 60_000),)
        for seq, key, ts, _ in rows}
    assert by_seq(limits.burst_count(frame(spark, rows), "key", 60, 3), "recent") == want


def test_pieces_split_the_hot_key(spark):
    from rosterflow.operators import folds
    counted = limits._per_millisecond(frame(spark, requests()), "key", "ts")
    cut = folds.cut_at_gaps(counted, "key", 60_001, 120_000).filter("key = 'hot'")
    assert cut.select("piece").distinct().count() > 10
    rows = sorted((r.ms, r.piece) for r in cut.collect())
    start = None
    for i, (ms, piece) in enumerate(rows):
        if i == 0 or ms - rows[i - 1][0] >= 60_001:
            start = ms
        assert piece == start
    assert math.isfinite(start)
    assert cut.agg(F.sum("n")).first()[0] == sum(1 for r in requests() if r[1] == "hot")


def test_block_tables_equal_the_steps():
    draw = random.Random(1)
    request, attempt = collections.namedtuple("Request", "ms n"), collections.namedtuple("Attempt", "ms result")
    for _ in range(300):
        window, lock, most, good = draw.choice([5, 20, 60]), draw.choice([3, 15, 50]), draw.choice([1, 2, 4]), draw.choice([0, 0.1, 0.5])
        machines = [
            (request, [1, 1, 1, 2, 3, 7, 30], lambda: draw.randrange(1, 4), limits.anchored_window_step(window),
             limits.window_table(window), limits.window_hop(window)),
            (attempt, [0, 0, 1, 1, 2, 3, 7], lambda: "ok" if draw.random() < good else "wrong", limits.lockout_step(most, lock),
             limits.lockout_table(most, lock), limits.lockout_hop)]
        for kind, gaps, value, step, table, hop in machines:
            clock, rows, state, hopped = 0, [], None, None
            for _ in range(draw.randrange(1, 100)):
                clock += draw.choice(gaps)
                rows.append(kind(clock, value()))
            cuts = [0, *sorted(draw.sample(range(1, len(rows)), min(3, len(rows) - 1))), len(rows)]
            for a, b in zip(cuts, cuts[1:]):
                for row in rows[a:b]:
                    state, _ = step(state, row)
                hopped = hop(hopped, table(pd.DataFrame(rows[a:b])))
                assert list(state) == list(hopped)


def hot(gap, n=4000, seed=5, result=lambda rng: "wrong"):
    rng, clock, rows = random.Random(seed), 0, []
    for seq in range(n):
        clock += rng.choice(gap)
        rows.append((seq, "hot", START + dt.timedelta(milliseconds=clock), result(rng)))
    return rows


def folded_groups(monkeypatch):
    """Sizes of the groups that are folded one after the other, largest last."""
    seen, fold = [], folds.fold
    monkeypatch.setattr(folds, "FOLD_ROWS", 100)

    def watched(rows, group, *rest, **more):
        seen.extend(sorted(r["count"] for r in rows.groupBy(*group).count().collect()))
        return fold(rows, group, *rest, **more)

    monkeypatch.setattr(folds, "fold", watched)
    return seen


def test_windows_of_a_key_without_a_gap_run_side_by_side(spark, monkeypatch):
    rows, want, state, sizes = hot([0, 10, 300, 900]), {}, None, folded_groups(monkeypatch)
    for seq, _, ts, _ in rows:
        start, used = state or (millis(ts), 0)
        if millis(ts) - start > 60_000:
            start, used = millis(ts), 0
        state = start, used + 1
        want[seq] = (used < 40, max(0, 39 - used))
    got = limits.anchored_window(frame(spark, rows), "key", 40, 60, block_ms=90_000)
    assert by_seq(got, "allowed", "remaining") == want
    assert len(sizes) > 10 and sizes[-1] < len(rows) / 10


def test_lockouts_of_a_key_without_a_success_run_side_by_side(spark, monkeypatch):
    for result in (lambda rng: "wrong", lambda rng: "ok" if rng.random() < 0.02 else "wrong"):
        rows, want, state, sizes = hot([0, 10, 300, 900], result=result), {}, None, folded_groups(monkeypatch)
        step = limits.lockout_step(5, 45_000)
        for seq, _, ts, said in rows:
            row = collections.namedtuple("Row", "ms result")(millis(ts), said)
            state, want[seq] = step(state, row)
        got = limits.lockout(frame(spark, rows), "key", 5, 45, block_ms=90_000)
        assert by_seq(got, "outcome", "errors", "lock_minutes") == want
        assert len(sizes) > 10 and sizes[-1] < len(rows) / 10


def test_bucket_and_log_start_anew_where_the_load_is_light(spark, monkeypatch):
    # Never idle for long enough, but now and then so little used that the state is known.
    rows, sizes = hot([900, 2_000, 5_000, 7_000], n=1500), folded_groups(monkeypatch)
    rows = [(seq, k, ts, r) for seq, (_, k, ts, r) in enumerate(x for x in rows for _ in range(4 if millis(x[2]) // 300_000 % 3 == 0 else 1))]
    want, state = {}, None
    for seq, _, ts, _ in rows:
        tokens, last = state or (6.0, millis(ts))
        tokens = min(6.0, tokens + (millis(ts) - last) / 1000.0 * (40 / 60.0))
        want[seq] = (tokens >= 1,)
        state = tokens - 1 if tokens >= 1 else tokens, millis(ts)
    assert by_seq(limits.token_bucket(frame(spark, rows), "key", 6, 40, block_ms=300_000), "allowed") == want
    assert len({w for w in want.values()}) == 2 and len(sizes) > 10 and sizes[-1] < len(rows) / 5
    want, log = {}, []
    sizes.clear()
    for seq, _, ts, _ in rows:
        log = [t for t in log if t > millis(ts) - 30_000]
        want[seq] = (len(log) < 22,)
        log += [millis(ts)] if len(log) < 22 else []
    assert by_seq(limits.sliding_log(frame(spark, rows), "key", 22, 30, block_ms=300_000), "allowed") == want
    assert len({w for w in want.values()}) == 2 and len(sizes) > 10 and sizes[-1] < len(rows) / 5


def test_first_in_horizon_follows_the_last_accepted(spark, monkeypatch):
    monkeypatch.setattr(folds, "FOLD_ROWS", 100)
    rows, last, want = hot([0, 10, 300, 900], n=1500) + [(2000 + i, None, START + dt.timedelta(seconds=i), "ok") for i in range(5)], {}, {}
    for seq, key, ts, _ in rows:
        want[seq] = (key not in last or millis(ts) - last[key] > 2_500,)
        if want[seq][0]:
            last[key] = millis(ts)
    got = limits.first_in_horizon(frame(spark, rows), "key", 2_500, block_ms=20_000)
    assert by_seq(got, "accepted") == want
    assert 20 < sum(w[0] for w in want.values()) < 1000
