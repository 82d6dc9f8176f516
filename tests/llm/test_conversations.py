"""Mixing, prefix trie and structure repair against plain versions, on the smallest tables and on odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rosterflow.llm import common, mixing, prefix_trie, queries, structure_repair
from test_numbered import ODD, same

WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
CHAT = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Mixing

def plain_targets(sizes, weights, total, repeats=3):
    """Water filling by trying every number of sources at their limit, from none up."""
    order = sorted(sizes, key=lambda s: repeats * sizes[s] / weights[s])
    for full in range(len(order) + 1):
        rest = sum(weights[s] for s in order[full:])
        level = (total - sum(repeats * sizes[s] for s in order[:full])) / rest if rest else 0
        if all(level * weights[s] <= repeats * sizes[s] for s in order[full:]):
            return {s: repeats * sizes[s] if s in order[:full] else level * weights[s] for s in order}


def sourced(lake, sf):
    given = common.table(lake, sf, "documents").select("doc_id", "text", "source")
    odd = lake.createDataFrame([(d, t, s) for (d, t), s in zip(ODD * 2, itertools.cycle([None, "", "é", "z", "Z"]))],
                               "doc_id long, text string, source string")
    return given.union(odd).withColumns({c: F.lit("x") for c in ("size", "draw", "row", "pattern", "place", "n")})


def test_mixing_meets_the_targets(lake, sf):
    docs = sourced(lake, sf)
    sizes, rows = collections.Counter(), docs.collect()
    for r in rows:
        sizes[r.source] += len(re.findall(WORD, r.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    aims = plain_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(sizes.values()))
    got = mixing.mixed(docs).collect()
    same([(r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got],
         [(r.doc_id, len(re.findall(WORD, r.text or "")), sizes[r.source], round(float(aims[r.source]), 6)) for r in rows])
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    want = collections.Counter()
    for s in names:
        want[sizes[s], round(float(aims[s]), 6)] += round(aims[s])
    assert taken == want
    again = mixing.mixed(docs.repartition(7, "text")).collect()
    same(map(tuple, again), map(tuple, got))
    assert sorted(map(repr, mixing.mixed(docs, seed=1).collect())) != sorted(map(repr, got))
    assert mixing.mixed(docs.where("1 = 0")).count() == 0
    none = mixing.mixed(docs.where("text is null or text = ''")).collect()
    assert none and all((r.size, r.target, r.taken) == (0, 0.0, 0) for r in none)


def test_one_source_of_equal_rows_is_cut_exactly(lake):
    docs = lake.createDataFrame([(1, "a b c", "x")] * 40 + [(2, "d e", "y")], "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    assert sum(r.taken for r in got) == 122 and {r.target for r in got} == {116.0, 6.0}
    assert sorted(collections.Counter(r.taken for r in got if r.doc_id == 1).items()) == [(0, 1), (2, 1), (3, 38)]


def plain_flow(sizes, members, quotas, repeats):
    """Fewest repeated words for the most words routed, by trying all integer flows."""
    best = None
    pairs = [(p, j) for p, own in enumerate(members) for j in own]
    for words in itertools.product(*[range(min(repeats * sizes[p], quotas[j]) + 1) for p, j in pairs]):
        by_p, by_j = collections.Counter(), collections.Counter()
        for (p, j), w in zip(pairs, words):
            by_p[p] += w
            by_j[j] += w
        if all(by_p[p] <= repeats * s for p, s in enumerate(sizes)) and all(by_j[j] <= q for j, q in quotas.items()):
            cost = sum(max(0, by_p[p] - k * s) for p, s in enumerate(sizes) for k in range(1, repeats))
            best = min(best or (0, 10 ** 9), (-sum(words), cost))
    return best


def test_route_is_a_cheapest_largest_flow():
    draw = random.Random(4)
    for _ in range(60):
        members = [sorted(draw.sample([1, 2, 3], draw.choice([1, 2, 2, 3]))) for _ in range(draw.choice([1, 2, 3]))][:2]
        sizes = [draw.randrange(4) for _ in members]
        quotas = {j: draw.randrange(6) for j in (1, 2, 3)}
        flows = mixing.route(sizes, members, quotas, 3)
        use = [sum(f.values()) for f in flows]
        assert all(0 <= w for f in flows for w in f.values()) and all(u <= 3 * s for u, s in zip(use, sizes))
        assert all(sum(f.get(j, 0) for f in flows) <= q for j, q in quotas.items())
        cost = sum(max(0, u - k * s) for u, s in zip(use, sizes) for k in (1, 2))
        assert (-sum(use), cost) == plain_flow(sizes, members, quotas, 3)


def test_overlapping_sources(lake):
    rows = [(i, "w " * (1 + i % 7), [["a"], ["a", "b"], ["b"], ["c", "d"], ["d"], [], None, ["b", "a", "a"]][i % 8]) for i in range(400)]
    docs = lake.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    got, aims = mixing.mix(docs, F.col("sources"), lambda t: t.withColumn("weight", F.col("place")))
    got, aims = got.collect(), {r.source: r for r in aims.collect()}
    by = collections.Counter()
    for r in got:
        by[tuple(r.pattern)] += r.taken
    assert by[()] == 0 and len(got) == 400
    assert abs(by["a",] + by["a", "b"] + by["b",] - aims["a"].target - aims["b"].target) <= 2
    assert abs(by["c", "d"] + by["d",] - aims["c"].target - aims["d"].target) <= 2
    assert by["a",] <= round(aims["a"].target) and by["b",] <= round(aims["b"].target)
    assert aims["a"].source_size == sum(1 + i % 7 for i in range(400) if "a" in (rows[i][2] or []))


# Prefix trie

def plain_turns(rows):
    """Turns of each conversation in order: null first, then role, then digest."""
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append(((t is not None, t or 0, r, sha(f"{len(r)}\n{r}\n{x}")), (r, x)))
    return {c: [turn for _, turn in sorted(v, key=lambda p: p[0])] for c, v in convs.items()}


def plain_trie(convs):
    held = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            held[tuple(turns[:d])].append(c)
    out = []
    for node, members in held.items():
        below = [n for n in held if n[:len(node)] == node]
        leaves = sum(not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in below) for n in below)
        saved = sum((len(held[n]) - 1) * len(re.findall(WORD, n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(node))
        out.append((min(members), len(node), min(held[node[:-1]]) if node else None, len(members),
                    sum(len(n) == len(node) + 1 for n in below), leaves, saved, sha(ends)))
    return out


def grafted(convs):
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + convs[c][h:]
    return out


def odd_chats():
    draw = random.Random(9)
    rows = [(None, 0, "user", "lost"), (0, 0, "user", "a b"), (0, None, None, None), (0, 1, "user", "x"), (0, 1, "user", "x"),
            (19, 0, "user", "a b"), (23, 5, "", " one  two "), (23, 5, "assistant", "é 漢"), (25, 0, "user", "y" * 3000)]
    for c in range(40, 110):
        rows += [(c, t, draw.choice(["user", "assistant"]), draw.choice(["hi there", "ok", "", "no way out"])) for t in range(draw.randrange(7))]
    return rows


def test_prefix_trie_of_odd_conversations(lake):
    rows = odd_chats()
    df = lake.createDataFrame(rows, CHAT).withColumns({c: F.lit(1) for c in ("pos", "words", "key", "path", "n", "layer")})
    turns = prefix_trie.turns_of(df)
    want = plain_turns(rows)
    want_tree = plain_trie(grafted(want))
    same(map(tuple, prefix_trie.trie(prefix_trie.regrafted(turns)).collect()), want_tree)
    # Many shards and short layers give the same nodes.
    for layer, shard in ((1024, 7), (2, 7)):
        same(map(tuple, prefix_trie.trie(prefix_trie.regrafted(turns), layer, shard).collect()), want_tree)
    assert prefix_trie.trie(prefix_trie.regrafted(prefix_trie.turns_of(df.where("conv_id is null")))).count() == 0


def test_prefix_trie_of_long_alike_conversations(lake, monkeypatch):
    rows = [(c, t, "user", f"w{t}" if t != 37 + c else f"other {c}") for c in range(12) for t in range(60 - c)]
    rows += [(100 + c, t, "user", f"w{t}") for c in range(30) for t in range(50)]
    df = lake.createDataFrame(rows, CHAT)
    for layer, shard in ((16, 3),):
        got = prefix_trie.trie(prefix_trie.turns_of(df), layer, shard)
        same(map(tuple, got.collect()), plain_trie(plain_turns(rows)))


def test_skeleton_is_what_splitters_cut(lake):
    rows = [(c, t, "user", f"{t} {c // 3 ** (3 - t)}") for c in range(81) for t in range(4)]
    pieces = prefix_trie.layers(prefix_trie.turns_of(lake.createDataFrame(rows, CHAT)))
    paths = prefix_trie.merged(pieces).withColumn("below", F.lit(None).cast("array<long>"))
    cuts = prefix_trie.splitters_of(paths, 10)
    assert 3 < len(cuts) <= 9
    nodes = prefix_trie.shard_nodes(paths, cuts).collect()
    step, head = prefix_trie.STEP, prefix_trie.HEAD
    bones = {bytes(c[:head + step * d]) for c in cuts for d in range((len(c) - head) // step + 1)}
    assert {bytes(r.path) for r in nodes if r.path is not None} == bones
    # All other nodes were finished once, by one shard.
    assert sum(r.path is None for r in nodes) + len(bones) == len(plain_trie(plain_turns(rows)))


# Structure repair

def plain_damage(rows):
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if lot == 1 else re.sub("[.!?]", "", x) if lot == 2 else x
        yield from [(c, t, "user" if lot == 4 else r, x)] * (0 if lot == 0 else 2 if lot == 3 else 1)


def plain_faults(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        words = x.strip(" \t\n\x0b\f\r")
        out.append("blank" if not words else "duplicate" if (r, x) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((r, x))
    return out


def plain_repair(rows):
    """Cheapest edits and the least audit among them, by the whole rest of each state."""
    faults = plain_faults(rows)
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {}

    def ways(i, state):
        if i < len(rows):
            yield 2, "D", i + 1, state, None
            role, text = rows[i][2:]
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if role and role[0] in follows[state]:
                    yield more, "K", i + 1, role[0], (role, text)
                for name in ("user", "assistant"):
                    if name[0] in follows[state]:
                        yield 1 + more, "R", i + 1, name[0], (name, text)
        for name in ("user", "assistant"):
            if name[0] in follows[state]:
                yield 5, "I", i, name[0], (name, "")

    # Two insertions in a row at the most help anywhere; a third one undoes them.
    def solve(i, state, inserts):
        key = (i, state, inserts)
        if key not in best:
            found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
            for cost, letter, j, after, said in ways(i, state):
                if letter == "I" and inserts == 2:
                    continue
                rest = solve(j, after, inserts + 1 if letter == "I" else 0)
                if rest:
                    found.append((cost + rest[0], letter + rest[1], ((said,) if said else ()) + rest[2]))
            best[key] = min(found, default=None)
        return best[key]

    for i in range(len(rows), -1, -1):
        for state in follows:
            for inserts in (2, 1, 0):
                solve(i, state, inserts)
    return solve(0, "", 0)


def plain_rows(given):
    convs = {c: [] for c, *_ in given}
    for row in plain_damage(given):
        convs[row[0]].append(row)
    out = []
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha(r[3])))
        faults, turns = plain_faults(rows), [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        heads = [r[2][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
        cost, audit, said = plain_repair(rows)
        out.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                    sha("\n".join(f"{r}:{x}" for r, x in said))))
    return out


def odd_talk():
    draw = random.Random(2)
    rows = [(None, 3, "user", "Hi."), (None, None, None, None), (1, 0, "", "x."), (1, 0, "", "x."), (2, None, "system", "Go."),
            (2, None, "system", "Go!"), (3, 0, "assistant", "a" * 5000 + "."), (4, -5, "user", " \n"), (4, 9, "User", "é 漢?\n ")]
    for c in range(20, 90):
        odd = draw.choice([["user", "assistant"], ["user", "assistant", "system"], ["tool", "user"], ["tool"], ["user"], ["assistant", None, "system2"]])
        rows += [(c, draw.choice([t, t, t + 1, None]) if c % 5 == 0 else t, draw.choice(odd), draw.choice(
            ["Yes.", "No!", "cut", f"Say {t}.", f"So {t}?", f"open {t}", "", None])) for t in range(draw.randrange(14))]
    return rows


def test_repair_of_given_conversations(lake, sf):
    given = [tuple(r) for r in common.table(lake, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    same(map(tuple, queries.op13_structure_repair(lake, sf).collect()), plain_rows(given))


def test_repair_of_odd_conversations(lake):
    rows = odd_talk()
    df = lake.createDataFrame(rows, CHAT).withColumns({c: F.lit(1) for c in ("lot", "copy", "n", "idx", "first", "codes", "letters", "kind")})
    want = plain_rows(rows)
    assert len({r[7] for r in want}) > 20
    for chunk in (structure_repair.CHUNK, 3):
        same(map(tuple, structure_repair.repair_damage(df, chunk).collect()), want)
    assert structure_repair.repair_damage(df.where("1 = 0")).count() == 0


@pytest.mark.parametrize("role, text", [(lambda i: "tool", "Go on {}."), (lambda i: "user", "no end {}"), (lambda i: "sua"[i % 3], "Same {}.")])
def test_long_conversations_take_few_passes(lake, monkeypatch, role, text):
    passes, hop = [], structure_repair._hop
    monkeypatch.setattr(structure_repair, "_hop", lambda tried: passes.append(1) or hop(tried))
    rows = [(1, i, role(i), text.format(i)) for i in range(401)]
    df = lake.createDataFrame(rows, CHAT)
    (got,) = structure_repair.repaired(df, 8).collect()
    cost, audit, said = plain_repair(sorted(rows, key=lambda r: r[1]))
    assert (got.cost, got.audit, got.repaired_sha256) == (cost, audit, sha("\n".join(f"{r}:{x}" for r, x in said)))
    assert len(passes) <= 6


def test_least_audit_by_trying_everything():
    draw = random.Random(6)
    for _ in range(40):
        rows = [(1, i, draw.choice(["system", "user", "assistant", "tool"]), draw.choice(["A.", "B!", "cut", ""])) for i in range(draw.randrange(4))]
        faults, found = plain_faults(rows), []
        options = [[("D", None)] + ([] if f in ("blank", "duplicate") else [("K", r[2][0]), ("R", "u"), ("R", "a")]) for r, f in zip(rows, faults)]
        gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
        for picked in itertools.product(*options):
            for put in itertools.product(gaps, repeat=len(rows) + 1):
                heads, audit, cost = "".join(put[0]), "I" * len(put[0]), 5 * len(put[0])
                for (letter, head), f, more in zip(picked, faults, put[1:]):
                    heads, audit = heads + (head or "") + "".join(more), audit + letter + "I" * len(more)
                    cost += {"D": 2, "K": 0, "R": 1}[letter] + (5 if letter != "D" and f == "truncated" else 0) + 5 * len(more)
                if re.fullmatch("(s?(ua)+)?", heads):
                    found.append((cost, audit))
        assert min(found) == plain_repair(rows)[:2]
