"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay.  Looser patterns propose more; on every proposal labelers
vote for, against or not at all: the strict pattern, a check of digits or ranges, gazetteers of prefixes and endings,
words of context before the span, and its surroundings.  Proposals with equal votes and shape are counted together, so
expectation-maximisation (reliability of each labeler by kind) and the final logistic classifier, trained on its
posteriors, work on a table whose size does not depend on the corpus.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterflow.session import written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "check", "gazetteer", "context", "surroundings")
# A proposal that is no base span is added if the classifier gives it at least this.
ADDED_FROM = 0.9
ROUNDS = 50

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Loose patterns: spelled-out addresses, cards in other groups, numbers without a plus.
_LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]{1,63}){1,8}")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./-]{1,2}[0-9]{4}){3}(?![0-9])")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{2,5}\)|0[0-9]{2,4})[ ./-]{0,2}[0-9]{3,4}[ ./-]?[0-9]{3,5}(?![0-9])")
# Fixed values.
_ENDINGS = frozenset("com org net edu gov int info biz io dev de fr es uk it nl ch at eu us ca br cn jp in ru".split())
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
            "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90",
            "91", "92", "93", "94", "95", "98")
_ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "64", "65")
_CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "master", "credit", "tarjeta", "carte", "karte"),
    "phone": ("tel", "phone", "call", "fax", "mobil", "handy", "llam", "appel"),
}


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the strict pattern; each has the first @ after its start, so the search goes from @ to @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _passes(kind: str, span: str) -> bool:
    if kind == "ip":
        # Without leading zeros, of which there may be more than a number may have digits.
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in span.split(".")))
    digits = digits_of(span)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points of all that the strict patterns and their conditions accept."""
    out = [(a, "email", b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if _passes(kind, m[0])]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def _votes(text: str, start: int, kind: str, end: int, base: bool) -> tuple[int, ...]:
    span = text[start:end]
    digits = digits_of(span)
    if kind == "email":
        check = 1 if "@" in span and len(span) <= 254 else 0
        ending = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")] "))[-1].lower()
        known = 1 if ending in _ENDINGS else -1
    elif kind == "ip":
        check = 1 if all(p == "0" or not p.startswith("0") for p in span.split(".")) else -1
        known = -1 if digits == digits[:1] * len(digits) else 0
    elif kind == "card":
        check = 1 if luhn(digits) else -1
        known = 1 if digits.startswith(_ISSUERS) and len(digits) <= 16 else -1
    else:
        check = 1 if 9 <= len(digits) <= 13 else -1
        known = 1 if span.startswith("+") and digits.startswith(_CALLING) else 0
    before = text[max(0, start - 24):start].lower()
    context = 1 if any(w in before for w in _CONTEXT[kind]) else 0
    edges = text[start - 1:start] + text[end:end + 1]
    around = -1 if any(c.isalnum() for c in edges) else 1
    return 1 if base else 0, check, known, context, around


def proposals(text: str) -> list[tuple[str, int, int, bool, int, int]]:
    """(kind, start, end, base, votes, shape): base spans, and looser ones that overlap none of them nor each other."""
    base = base_spans(text)
    taken = sorted((a, b) for a, _, b in base)
    out = [(k, a, b, True) for a, k, b in base]
    loose = []
    if "(at" in text or "[at" in text or "(AT" in text or "[AT" in text:
        loose += [("email", m.start(), m.end()) for m in _LOOSE_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _LOOSE_CARD), ("phone", _LOOSE_PHONE)):
            loose += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    # A span overlaps a base span if one of those that start before its end ends after its start.
    starts, latest = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for kind, a, b in sorted(loose, key=lambda s: (s[1], -s[2])):
        earlier = bisect_left(starts, b)
        if a >= (out[-1][2] if out and not out[-1][3] else 0) and not (earlier and latest[earlier - 1] > a):
            out.append((kind, a, b, False))
    found = []
    for kind, a, b, is_base in out:
        votes = 0
        for v in _votes(text, a, kind, b, is_base):
            votes = votes * 3 + v + 1
        digits = len(digits_of(text[a:b]))
        shape = min(digits // 4, 4) * 3 + min(sum(not c.isalnum() for c in text[a:b]) // 2, 2)
        found.append((kind, a, b, is_base, votes, shape))
    return found


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,votes:int,shape:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
                            ("votes", pa.int32()), ("shape", pa.int32())]))


def find(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, spans): all proposals of each text (null: none)."""

    def scan(batches):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "base", "votes", "shape"), p)) for p in proposals(t or "")]
                     for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(spans, _SPAN)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id long, spans {SPANS}")


def _unpacked(votes: np.ndarray) -> np.ndarray:
    """Votes of -1, 0 and 1, a column for each labeler."""
    return np.stack([votes // 3 ** k % 3 - 1 for k in range(len(LABELERS) - 1, -1, -1)], 1)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for one kind: posterior of each vote pattern, and P(vote | true), P(vote | false)."""
    seen = _unpacked(votes) + 1
    post = np.clip(0.5 + 0.15 * (seen - 1).sum(1), 0.05, 0.95)
    for _ in range(rounds):
        chance = np.ones((len(votes), 2)) * [max((post * counts).sum(), 1e-9), max(((1 - post) * counts).sum(), 1e-9)]
        chance /= chance.sum(1, keepdims=True)
        table = np.ones((2, seen.shape[1], 3))
        for k in range(seen.shape[1]):
            for side, weight in enumerate((post, 1 - post)):
                table[side, k] += np.bincount(seen[:, k], weight * counts, 3)
                table[side, k] /= table[side, k].sum()
                chance[:, side] *= table[side, k][seen[:, k]]
        post = chance[:, 0] / chance.sum(1)
    return post, table


def _features(votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    seen = _unpacked(votes)
    return np.hstack([np.ones((len(votes), 1)), seen, (seen == 0).astype(float), np.eye(15)[shape]])


def train(found: DataFrame) -> dict[str, np.ndarray]:
    """Weights of the span classifier by kind, from the counts of equal proposals of the whole corpus."""
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").agg(
        F.count(F.lit(1)).alias("n")).toArrow().to_pandas()
    weights = {}
    for kind, own in rows.sort_values(["kind", "votes", "shape"]).groupby("kind"):
        votes, shape, n = (own[c].to_numpy() for c in ("votes", "shape", "n"))
        post, _ = reliabilities(votes, n)
        x, w = _features(votes, shape), np.zeros(26)
        for _ in range(100):  # Newton steps on the likelihood with the posteriors as soft labels
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (post - p)) - w
            w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(26), slope)
        weights[kind] = w
    return weights


def scan(docs: DataFrame, threshold: float = ADDED_FROM) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one for each row of ``docs`` (doc_id, text).

    Counts and digest are those of the base spans; ``spans`` also has the proposals that the classifier accepts, as
    kind:start:end in code points.  Null or empty texts have none.
    """
    found = written(find(docs), "proposals")
    weights = train(found)

    def decide(batches):
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                spans = sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"])))
                keep = [s["base"] for s in spans]
                for i, s in enumerate(spans):
                    if not s["base"]:
                        x = _features(np.array([s["votes"]]), np.array([s["shape"]]))
                        keep[i] = 1 / (1 + np.exp(-float((x @ weights[s["kind"]])[0]))) >= threshold
                text = [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]
                base = [t for t, s in zip(text, spans) if s["base"]]
                counts = [sum(s["base"] and s["kind"] == k for s in spans) for k in KINDS]
                rows.append((*counts, hashlib.sha256(",".join(base).encode()).hexdigest(),
                             ",".join(t for t, k in zip(text, keep) if k)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]],
                                   *[pa.array(c, pa.string()) for c in columns[4:]]],
                                  names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return found.mapInArrow(decide, f"doc_id long, {counts}, base_sha256 string, spans string")
