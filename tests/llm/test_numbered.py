"""The numbered operators against plain versions, on the smallest tables and on odd rows."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterflow.llm import (chat, common, decontamination, line_dedup, ngram_join, packing, pii, quality, queries, search,
                            token_counts, warc)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "Word after word " * 4000
ODD = [(None, "a line of its own\nb"), (None, None), (-1, ""), (-2, " \t\n "), (-3, "One"), (-3, "One"), (-3, "another text"),
       (-4, "A LINE of its own \nb\n\nb"), (-5, LONG), (-6, LONG + "end"), (-7, "é É K 漢字 🙂 a b c"), (-8, "x" * 5000),
       (-9, "one two three four five"), (-10, "ONE two\tthree four\nfive"), (-11, "one two three four")]


@pytest.fixture(scope="module")
def docs(lake, sf):
    """Given documents and odd rows, with further columns whose names clash with those of the operators."""
    given = common.table(lake, sf, "documents").select("doc_id", "text")
    odd = lake.createDataFrame(ODD, "doc_id long, text string")
    return given.union(odd).withColumns({c: F.lit("x") for c in ("n", "keys", "id", "own", "stats", "length", "window", "c0")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def plain_sets(rows):
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)] if len(words) > 4 else [tuple(words)] if words else []
        yield frozenset(grams)


def test_near_duplicates(docs, empty):
    rows = rows_of(docs)
    sets = list(plain_sets(rows))
    up = {d: d for d, _ in rows}

    def root(x):
        return x if up[x] == x else root(up[x])

    for i, (x, _) in enumerate(rows):
        for j in range(i):
            y, a, b = rows[j][0], sets[i], sets[j]
            if x is not None and y is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x_root, y_root = root(x), root(y)
                up[max(x_root, y_root)] = min(x_root, y_root)
    want = [(d, len(s), root(d) if d is not None else None) for (d, _), s in zip(rows, sets)]
    same([tuple(r) for r in ngram_join.near_duplicates(docs).collect()], want)
    assert ngram_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block_rows", [3, 1500])
def test_links_are_counted_once(docs, empty, lake, monkeypatch, block_rows):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block_rows)
    words = [f"w{i}" for i in range(60)]
    near = [(10**6 + i, " ".join(f"e{i}" if k in {(i * 7) % 60, (i * 13) % 60} else w for k, w in enumerate(words))) for i in range(40)]
    given = docs.select("doc_id", "text").union(lake.createDataFrame(near + near[:5], "doc_id long, text string"))
    rows = rows_of(given)
    sets = list(plain_sets(rows))
    n_links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= 80 * len(a | b):
                n_links[i] += 1
                n_links[j] += 1
    got = ngram_join.near_duplicates(given, count_links=True).select("doc_id", "n_shingles", "n_links").collect()
    same([tuple(r) for r in got], [(d, len(s), n) for (d, _), s, n in zip(rows, sets, n_links)])
    assert ngram_join.near_duplicates(empty, count_links=True).count() == 0


def test_near_duplicates_of_a_large_group_are_cut_into_blocks(lake, monkeypatch):
    words = [f"w{i}" for i in range(150)]

    def text(i):
        changed = {(i * 7 + 31 * k) % 150 for k in range(1 + i % 6)}
        return " ".join(f"e{i}x{k}" if k in changed else w for k, w in enumerate(words))

    rows = [(i, text(i)) for i in range(150)]
    sets = list(plain_sets(rows))
    edges = [(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = list(range(150))
    for _ in range(150):
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 20)
    got = ngram_join.near_duplicates(lake.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label))
    assert len(set(label)) > 1


def test_product_across_sides():
    import numpy as np

    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 60, 60)
    grams = [np.unique(np.where(draw.random(60) < draw.choice([0.02, 0.1, 0.3]), draw.integers(0, 1 << 60, 60), base)) for _ in range(90)]
    side = np.arange(90) % 2 == 1

    def closed(pairs, n):
        label = list(range(n))
        for _ in range(n):
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        return label

    def links(across):
        return [(i, j) for i in range(90) for j in range(i) if (not across or side[i] != side[j])
                and 100 * len(set(grams[i]) & set(grams[j])) >= 80 * len(set(grams[i]) | set(grams[j]))]

    for across, sides in ((True, side), (False, np.zeros(90, bool))):
        got = ngram_join._product(grams, sides, 80, rows_at_once=16, columns_at_once=32)
        assert closed(got, 90) == closed(links(across), 90)
        assert not across or all(side[i] != side[j] for i, j in got)


def test_components_of_a_chain(lake):
    edges = lake.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000)], "x long, y long")
    got = {r.doc_id: r.component_id for r in ngram_join.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 2000: 1000}


def plain_lines(rows):
    strip = " \t\n\v\f\r"
    holders = collections.defaultdict(set)
    for d, text in rows:
        for line in text.split("\n"):
            holders[line.strip(strip).translate(LOWER)].add(line_dedup.NO_ID if d is None else d)
    for d, text in rows:
        lines = text.split("\n")
        own = line_dedup.NO_ID if d is None else d
        kept = [x for x in lines if len(k := x.strip(strip).translate(LOWER)) < 10 or min(holders[k]) == own]
        yield d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_line_dedup(docs, empty):
    got = line_dedup.dedup_lines(docs)
    assert got.columns[:len(docs.columns)] == docs.columns
    same([tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()], plain_lines(rows_of(docs)))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_with_a_full_filter(docs, monkeypatch):
    monkeypatch.setattr(common, "MOST_BLOOM_BITS", 4096)
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    same([tuple(r) for r in got], plain_lines(rows_of(docs)))


def plain_windows(rows, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for item, text in items:
        words = pattern.findall((text or "").translate(LOWER))
        for i in range(max(1, len(words) - 9) if words and item is not None else 0):
            windows[tuple(words[i:i + 10])].add(item)
    sizes = {len(w) for w in windows}
    for d, text in rows:
        words, hit, found = pattern.findall(text.translate(LOWER)), set(), set()
        for m in sizes:
            for i in range(len(words) - m + 1):
                own = windows.get(tuple(words[i:i + m]))
                if own:
                    hit.update(range(i, i + m))
                    found |= own
        yield d, len(words), len(hit), sorted(found)


def test_decontamination(lake, sf, docs, empty):
    odd = [(10 ** 9, "One"), (10 ** 9, "One"), (10 ** 9 + 1, "another, TEXT"), (10 ** 9 + 2, None), (None, "three"), (10 ** 9 + 3, " ?! "),
           (10 ** 9 + 4, LONG), (10 ** 9 + 5, "É k")]
    items = common.table(lake, sf, "benchmark").select("item_id", "text").union(
        lake.createDataFrame(odd, "item_id long, text string")).withColumn("doc_id", F.lit(0))
    got = decontamination.decontaminate(docs, items).collect()
    want = list(plain_windows(rows_of(docs), [(r.item_id, r.text) for r in items.collect()]))
    same([(r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got], want)
    assert any(hits for _, _, hits, _ in want)
    assert decontamination.decontaminate(empty, items).count() == 0
    clean = decontamination.decontaminate(docs, items.where("1 = 0")).collect()
    assert len(clean) == len(want) and not any(r.n_hit for r in clean)


def plain_pieces(rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for d, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            cut = ids[s:s + 2048]
            yield d, s, len(cut), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in cut)), len(ids)


def padding_of(got):
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 2048 - at if at & (at - 1) else 0
    return padding


def test_packing(docs, empty):
    got = packing.pack_documents(docs, TOKENIZER).collect()
    same([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got], plain_pieces(rows_of(docs)))
    assert padding_of(got) < 0.02 * sum(r.length for r in got)
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


def test_the_packing_query(lake, sf):
    got = queries.op2_packing(lake, sf).collect()
    given = rows_of(common.table(lake, sf, "documents"))
    same([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got], plain_pieces(given))
    assert padding_of(got) < 0.02 * sum(r.length for r in got)


@pytest.mark.parametrize("ends", [1000, 10_000, 60_000])
def test_most_windows_come_from_the_rounded_counts(ends):
    lengths = np.clip(np.random.default_rng(ends).gamma(2.0, 350.0, ends), 1, 2047).astype(int)
    sequence, _ = packing.pack(lengths)
    windows = int(sequence.max()) + 1
    counted = packing.counted_windows(np.bincount(lengths, minlength=2049))
    assert all(sum(parts) == 2048 for parts in counted)
    assert len(counted) > windows / 2
    assert windows * 2048 - lengths.sum() < 0.005 * lengths.sum() + 2048


def test_least_squares_has_the_gradient_of_a_minimum():
    histogram = np.zeros(2049, int)
    histogram[[100, 400, 700, 948, 1000, 1024, 1048, 1348]] = [30, 20, 20, 10, 40, 50, 35, 20]
    sets = packing.fillings(np.flatnonzero(histogram), 2048)
    x = packing.least_squares(sets, histogram, 2000)
    used = np.bincount(sets.ravel(), np.repeat(x, 3), 2049)
    missing = histogram - used
    missing[0] = 0
    slope = missing[sets].sum(1)
    assert x.min() >= 0 and slope.max() < 0.1 and np.abs(slope[x > 0]).max() < 0.1


def test_encoder_equals_the_file_on_odd_texts():
    tokenizer, texts = Tokenizer.from_file(TOKENIZER), [t or "" for _, t in ODD] + [
        "<|endoftext|> a<|endoftext|>", "\u0085᠎​  　x", "don't I'LL we'd 'tis", "१२३ ½ ² x²", "a\r\n\r\n  b", "\x00\x1c\x1d"]
    assert packing.encoder(TOKENIZER)(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(docs, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    edited = queries.edits_of(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    got = token_counts.apply_edits(token_counts.count_tokens(edited, TOKENIZER), TOKENIZER).collect()
    want = []
    for r in edited.collect():
        text = r.text
        for e in r.edits:
            start = min(e.start, len(text))
            text = text[:start] + e.text + text[max(start, min(e.end, len(text))):]
        want.append((r.doc_id, text, len(tokenizer.encode(r.text, add_special_tokens=False).ids),
                     len(tokenizer.encode(text, add_special_tokens=False).ids)))
    same([(r.doc_id, r.text, r.n_tokens_before, r.n_tokens) for r in got], want)
    assert sum(r.n_chars_encoded for r in got) < sum(3 * r.n_chars for r in got) / 2
    no_edits = docs.select("doc_id", "text", F.lit(None).cast(token_counts.EDITS).alias("edits"))
    none = token_counts.apply_edits(token_counts.count_tokens(no_edits, TOKENIZER), TOKENIZER)
    assert none.where("n_tokens <> n_tokens_before or n_edits <> 0").count() == 0 and none.count() == len(want)


def test_many_edits_keep_the_tree_right():
    import random

    draw, encode = random.Random(5), packing.encoder(TOKENIZER)
    text = " ".join(draw.choice(["the", "of", "it's", "naïve", "12", "end.\n", "a  b", "x", "漢字", "Running"]) for _ in range(800))
    tree = token_counts.build(text, encode, 40)
    for _ in range(300):
        a = draw.randrange(len(text) + 3)
        b = a + draw.choice([0, 0, 1, 2, 5, 30, 200])
        new = draw.choice(["", " ", "'s", " big", "big", "\n\n", "1", " the end of it"])
        text, _ = token_counts.edit(text, tree, a, b, new, encode, 40)
        assert tree.tokens == len(encode([text])[0])
        assert tree.sums[1, 0] == len(text)


@pytest.mark.parametrize("unit", ["Слово за словом, и снова 12 слов.\n", "漢字かな交じり文。東京、2024年！", "한국어 문장; ", "120 3456 7 ",
                                  "don't 'tis  \u200b \u0085 x²\r\n", "a\x1c b\u180e \ufeff \u3000 c! ", "<|endoftext|> x "])
def test_edits_in_any_script_encode_little(unit):
    encode = packing.encoder(TOKENIZER)
    text = unit * (24_000 // len(unit))
    tree = token_counts.build(text, encode)
    assert tree.leaves >= 30 and tree.tokens == len(encode([text])[0])
    for at in range(0, len(text), 3001):
        for new in ("字", "б", "7", " ", "'", "s", "\n", ""):
            text, again = token_counts.edit(text, tree, at, at + 1, new, encode)
            assert again <= 3 * token_counts.LEAF
    assert tree.tokens == len(encode([text])[0]) and tree.sums[1, 0] == len(text)


def test_a_leaf_that_grows_is_split():
    encode = packing.encoder(TOKENIZER)
    text = "one word after the other " * 400
    tree, again = token_counts.build(text, encode), []
    for k in range(200):
        text, own = token_counts.edit(text, tree, 5000, 5000, f"{k} inserted words of about a hundred characters, " * 2, encode)
        again.append(own)
    assert tree.tokens == len(encode([text])[0]) and tree.sums[1, 0] == len(text)
    assert max(again) < 4 * token_counts.LEAF


def test_the_token_query(lake, sf):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = {r.doc_id: r for r in queries.op5_token_counts(lake, sf).collect()}
    given = rows_of(common.table(lake, sf, "documents"))
    assert {d: r.n_tokens_before for d, r in got.items()} == {
        d: len(tokenizer.encode(text, add_special_tokens=False).ids) for d, text in given}


def test_quality(lake, sf, docs, empty):
    labels = common.table(lake, sf, "labels")
    odd = lake.createDataFrame([(-1, None), (None, 1), (-3, 0), (-3, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels.select("doc_id", "quality").union(odd)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, marks[r.doc_id]) for r in got if r.held_out and r.doc_id in marks]
    assert sum(a == b for a, b in held) >= 0.9 * len(held) > 0
    # Labels of the held-out fold are not looked at.
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = ({(r.doc_id, r.score) for r in quality.classify(docs, x).collect()} for x in (labels, turned))
    assert first == second
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.where("1 = 0")).collect()} == {0.5}
    assert quality.accepted(docs, labels).columns == docs.columns


def test_isotonic_rises():
    import numpy as np

    points, values = quality.isotonic(np.arange(6.0), np.array([1, 0, 3, 1, 4, 4.0]), np.array([4, 4, 4, 4, 4, 4.0]))
    assert list(values) == sorted(values) and values[0] == 0.125 and len(points) == len(values)


def plain_spans(text):
    emails = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
           if all(int(p) <= 255 for p in m[0].split("."))]
    cards, phones = [], []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            cards.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            phones.append(("phone", m.start(), m.end()))
    order = ["email", "ip", "card", "phone"]
    return sorted(emails + ips + cards + phones, key=lambda s: (s[1], order.index(s[0])))


HARD = ["a@b.c@d.e_f@g.hh x@y a.b@c.d.e- @x.y a@b.c_d@e.f %@1.2", "1.2.3.4.5.6.7.8 256.1.1.1 00.1.1.255 0000255.1.2.3 1.2.3 ..1.2.3.4..",
        "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 5500000000000004 12345678901234567890 378282246310005 0",
        "+1 (988) 555-2485 +12 + 34 +49 30 1234567 8 +1.2.3.4.5.6.7.8.9.0 ++12345678901 +1234567890123456", "é@b.cc 🙂 ab@é.de tel: (030) 1234567",
        "mail: joe (at) example (dot) com, card 4111/1111/1111/1112", "٣٤@a.bc ١٢٣.1.1.1"]


def test_pii(lake, docs, empty):
    hard = docs.select("doc_id", "text").union(lake.createDataFrame([(10 ** 9 + i, t) for i, t in enumerate(HARD * 3)], "doc_id long, text string"))
    got = pii.scan(hard).collect()
    want = []
    for d, text in rows_of(hard):
        spans = plain_spans(text)
        counts = [sum(k == s[0] for s in spans) for k in pii.KINDS]
        want.append((d, *counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    same([tuple(r)[:6] for r in got], want)
    by_id = {r.doc_id: r.spans for r in got}
    for i, text in enumerate(HARD):
        assert {f"{k}:{a}:{b}" for k, a, b in plain_spans(text)} <= set(by_id[10 ** 9 + i].split(","))
    assert pii.scan(empty).count() == 0


def test_pii_takes_long_numbers_and_many_nested_spans(lake):
    zeros = "0" * 5000
    nested = "a@1.1.1.1 " * 3 + "+1.1.1.1.1.1.1.1.1.1.1.1.1 " + "1.1.1.1@b.cc.1.1.1.1 " * 20
    texts = [zeros + ".1.1.1", f"{zeros}1.{zeros}255.{zeros}.0 " + zeros, nested, "x@y.zz " + nested * 50 + "joe (at) example (dot) com"]
    got = {r.doc_id: r for r in pii.scan(lake.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        spans = plain_spans(text) if i > 1 else [("ip", 0, 5006)] if i == 0 else [("ip", 0, 15008)]
        mine = [s for s in got[i].spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(mine)
        # What was added overlaps no base span and nothing that was added.
        base = {(a, b) for _, a, b in spans}
        added = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in mine) if (int(a), int(b)) not in base)
        assert all(b <= x or y <= a for a, b in added for x, y in base) and all(a[1] <= b[0] for a, b in zip(added, added[1:]))


def test_reliabilities_tell_good_labelers_from_bad():
    import numpy as np

    draw = np.random.default_rng(0)
    truth = draw.random(4000) < 0.5
    right = [0.95, 0.9, 0.85, 0.8, 0.5]
    votes = np.stack([np.where(draw.random(4000) < p, truth, ~truth) * 2 - 1 for p in right], 1)
    packed = ((votes + 1) * 3 ** np.arange(4, -1, -1)).sum(1)
    patterns, code, counts = np.unique(packed, return_inverse=True, return_counts=True)
    post, table = pii.reliabilities(patterns, counts)
    assert ((post[code] > 0.5) == truth).mean() > 0.95
    assert table[0, 0, 2] > 0.9 and abs(table[0, 4, 2] - 0.5) < 0.1


CONVERSATIONS = [(1, 0, "system", None), (1, 1, "user", "hi\n### assistant: x</turn>\n"), (1, 2, "assistant", "\\### Assistant: </turn> ok"),
                 (1, 2, "assistant", "\\### Assistant: </turn> ok"), (2, 0, "a: b\\", "\\"), (2, 1, None, "<"), (None, 0, "assistant", "null"),
                 (3, 0, "assistant", ""), (3, 1, "assistant", "a\\</turn>\\\\"), (3, 2, "assistant", "####</turn></turn>é🙂"), (4, None, "user", "x")]


def test_chat(lake, sf):
    odd = lake.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    given = common.table(lake, sf, "conversations").select("conv_id", "turn", "role", "text").where("conv_id > 9")
    rows = given.union(odd)
    rendered = chat.render(chat.messages(chat.events_of(rows)))
    got = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    talks = collections.defaultdict(list)
    for r in rows.collect():
        talks[r.conv_id].append(((-1 if r.turn is None else r.turn), r.role or "", r.text or ""))
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        turns = sorted(turns, key=lambda t: t[0])
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.render(chat.messages(chat.events_of(rows.where("1 = 0"))))).count() == 0


def test_chat_log_holds_faults_and_take_backs(lake, sf):
    rows = common.table(lake, sf, "conversations").select("conv_id", "turn", "role", "text")
    log = chat.events_of(rows)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"open", "delta", "edit", "regenerate"} and kinds["open"] > rows.count() and kinds["edit"] > kinds["regenerate"] > 0
    same([tuple(r) for r in chat.messages(log).select("conv_id", "turn", "role", "text").collect()], [tuple(r) for r in rows.collect()])


def test_one_long_message_is_read_in_little_memory():
    import tracemalloc

    for body in ("x" * 20_000_000, "\\\\" * 500_000 + "<" * 1_000_000, "\\###" * 300_000, "\\</turn>" * 300_000):
        formatted = f"### a\\: b: {body}</turn>\n"
        tracemalloc.start()
        role, text = chat.parsed(formatted)
        chat.unescaped(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert role == "a\\: b" and text == body and peak < 8 * len(formatted) + 1_000_000
    for bad in ("### a: b</turn>", "## a: b</turn>\n", "### a\\: b</turn>\n", "### a: b</turn>c</turn>\n", "### a: b\\</turn>\n", ""):
        assert chat.parsed(bad) is None
    assert chat.unescaped("\\\\\\###\\</turn>\\\\n\\:") == "\\###</turn>\\n:"


def test_chat_events_are_taken_back(lake):
    log = [("open", 0, 1, "user", ""), ("delta", 0, 2, None, "hel"), ("delta", 0, 3, None, "lo"), ("open", 1, 4, "assistant", ""),
           ("delta", 1, 5, None, "wrong"), ("regenerate", 1, 6, None, None), ("delta", 1, 7, None, "ri"), ("delta", 1, 8, None, "ght"),
           ("open", 2, 9, "user", ""), ("delta", 2, 10, None, "later"), ("open", 3, 11, "assistant", "gone"),
           ("edit", 2, 12, None, "edited"), ("delta", 2, 13, None, "!"), ("open", 4, 14, "assistant", ""), ("delta", 4, 15, None, "last")]
    events = lake.createDataFrame([(c, t, 0, s, k, r, x) for c in (1, None) for k, t, s, r, x in log][::-1],
                                  "conv_id long, turn long, msg long, seq long, kind string, role string, text string")
    got = chat.messages(events).orderBy("conv_id", "turn").collect()
    assert [(r.turn, r.role, r.text) for r in got] == [
        (0, "user", "hello"), (1, "assistant", "right"), (2, "user", "edited!"), (4, "assistant", "last")] * 2


def test_a_long_chat_is_placed_in_several_tasks(lake):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    lake.conf.set(key, "false")
    try:
        turns = [(c, t, 0, "user" if t % 2 else "assistant", "x" * (t % 7)) for c in (1, None) for t in range(-300, 3000)] + [(1, None, 0, "user", "first")]
        rendered = chat.render(lake.createDataFrame(turns, "conv_id long, turn long, msg long, role string, text string"))
        rows = rendered.withColumn("task", F.spark_partition_id()).where("conv_id = 1").orderBy("start").collect()
    finally:
        lake.conf.unset(key)
    assert len({r.task for r in rows}) > 1
    assert [r.start for r in rows] == [sum(map(len, (r.formatted for r in rows[:i]))) for i in range(len(rows))]
    assert rows[0].formatted == "### user: first</turn>\n" and len(rows) == 3301
    assert {r.conv_id: (r.n_turns) for r in chat.read_back(rendered).collect()} == {1: 3301, None: 3300}


PAGES = [(5, "http://a/\r\nb", "x"), (3, None, "x"), (3, "http://c", "x"), (9, "é", None), (8, "u", ""), (None, "n", "x"), (None, "m", "only"),
         (11, "v", "y\r\n\r\nWARC/1.1\r\n"), (12, "w", "é" * 100_000), (13, "w", "é" * 100_000)]


@pytest.mark.parametrize("least", [0, 2])
def test_warc(lake, sf, least):
    pages = common.table(lake, sf, "pages").select("page_id", "url", "html").where("page_id > 20").union(
        lake.createDataFrame(PAGES, "page_id long, url string, html string")).withColumn("sha", F.lit(1))
    folder = warc.archive_folder(pages)
    index = warc.write_archives(pages, folder, least)
    got = warc.read_archives(index, folder).collect()
    first = {}
    for r in pages.collect():
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    want = []
    for r in pages.collect():
        body = (r.html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        to = first.get(r.html or "") if len(body) >= least else None
        to = None if to == r.page_id else to
        want.append((r.page_id, r.url, len(body), digest, "response" if to is None else "revisit", to, body if to is None else None))
    same([(*tuple(r)[:6], None if r.payload is None else bytes(r.payload)) for r in got], want)
    some = index.where("page_id % 3 = 0")
    assert warc.read_archives(some, folder, with_payload=False).count() == some.count() > 0
    nothing = warc.write_archives(pages.where("1 = 0"), warc.archive_folder(pages))
    assert warc.read_archives(nothing, folder).count() == 0


def test_warc_ranges_are_joined():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 100 + warc.GAP, 5), ("a", 200 + warc.GAP, warc.MOST_READ), ("b", 0, 3)]
    assert [len(g) for g in warc._ranges(rows)] == [2, 1, 1, 1]


def plain_search(rows, chosen, k, most_terms):
    texts = [re.findall(rb"[0-9a-z\x80-\xff]+", text.translate(LOWER).encode()) for _, text in rows]
    counts = [collections.Counter(t) for t in texts]
    df = collections.Counter(t for c in counts for t in c)
    n, mean = len(rows), sum(map(len, texts)) / len(rows)
    idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    for (query, _), own in zip(rows, counts):
        if query is None or not chosen(query):
            continue
        scored = []
        for (d, _), c, t in zip(rows, counts, texts):
            s = sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in own if w in c)
            if s:
                scored.append((-round(s, 6), d is None, d or 0))
        yield query, [(-s, None if null else d) for s, null, d in sorted(scored)[:k]]


def test_search_of_whole_texts(docs, empty, monkeypatch):
    monkeypatch.setattr(search, "SHARD", 6000)
    monkeypatch.setattr(search, "QUERY_TERMS", 2000)
    rows = rows_of(docs)
    got = collections.defaultdict(list)
    for r in search.search_like(docs, F.col("doc_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.doc_id))
    for query, want in plain_search(rows, lambda d: d % 20 == 0, 10, None):
        assert [d for _, d in got[query]] == [d for _, d in want] or [s for s, _ in got[query]] == pytest.approx([s for s, _ in want], abs=2e-6)
        assert [s for s, _ in got[query]] == pytest.approx([s for s, _ in want], abs=2e-6)
    assert search.search_like(empty, F.col("doc_id") % 20 == 0).count() == 0


def test_search_with_the_rarest_terms(lake):
    texts = ["common alpha beta gamma", "common alpha beta", "common common gamma delta", "common beta own", "", "common", None, "alpha zeta"]
    rows = lake.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in search.search_like(rows, F.col("doc_id") == 0, most_terms=2).orderBy("rank").collect():
        got[r.query_id].append(r.doc_id)
    # Of the query's terms gamma has 2 documents; alpha and beta tie at 3, and either brings documents 1 and one more.
    assert set(got) == {0} and got[0][0] == 0 and set(got[0]) in ({0, 1, 2, 3}, {0, 1, 2, 7})
    again = search.search_like(rows, F.col("doc_id").isin(3, 4, 6), most_terms=1).collect()
    assert {(r.query_id, r.doc_id) for r in again} == {(3, 0), (3, 1), (3, 3)}


def test_the_query_asks_with_all_terms(lake, tmp_path):
    shared = [f"s{i}" for i in range(40)]
    texts = {0: shared, 1: shared[:20], 2: shared[20:], 20: ["all", "its", "own"], 3: ["other"]}
    lake.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.defaultdict(set)
    for r in queries.op10_search(lake, str(tmp_path)).collect():
        got[r.query_id].add(r.doc_id)
    # The 16 rarest terms of document 0 cannot all lie in both halves, and document 20 shares no term.
    assert got == {0: {0, 1, 2}, 20: {20}}


def test_the_query_equals_plain_search(lake, sf):
    rows = rows_of(common.table(lake, sf, "documents"))
    got = collections.defaultdict(list)
    for r in queries.op10_search(lake, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.doc_id))
    want = {q: best for q, best in plain_search(rows, lambda d: d % 20 == 0, 10, None) if best}
    assert set(got) == set(want) and want
    for query, best in want.items():
        assert [s for s, _ in got[query]] == pytest.approx([s for s, _ in best], abs=2e-6)
        # Documents may trade places only where rounding decides between their scores.
        plain = {d: s for s, d in best}
        least = best[-1][0]
        assert all(plain.get(d, least) == pytest.approx(s, abs=2e-6) for s, d in got[query])


def test_pruned_search_equals_full_scores():
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(1)
    texts = [np.unique(draw.zipf(1.3, draw.integers(1, 60)) % 500) for _ in range(3000)]
    rows = pa.table({"doc_id": np.arange(3000), "length": [len(t) for t in texts], "terms": pa.array([t.tolist() for t in texts], pa.list_(pa.int64())),
                     "counts": pa.array([draw.integers(1, 5, len(t)).tolist() for t in texts], pa.list_(pa.int32()))})
    index = search.Index(rows, 20.0)
    for _ in range(40):
        terms = np.unique(draw.integers(0, 500, 12))
        idf = draw.random(len(terms)) * 5
        whole = np.zeros(3000)
        for t, w in zip(terms, idf):
            p = np.searchsorted(index.terms, t)
            if p < len(index.terms) and index.terms[p] == t:
                own = slice(index.at[p], index.at[p + 1])
                whole[index.doc[own]] += index.weight[own] * w
        whole = np.round(whole, search.DIGITS)
        best = np.lexsort((np.arange(3000), -whole))[:10]
        docs, scores = index.top(terms, idf, 10, np.arange(3000))
        assert np.allclose(scores, whole[best][:len(scores)], atol=2e-6)


def test_questions_meet_a_shard_together():
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(2)
    texts = [np.unique(draw.zipf(1.2, draw.integers(1, 80)) % 900) for _ in range(900)]
    texts[700:760] = [texts[3]] * 60
    counts = [draw.integers(1, 5, len(t)) for t in texts]
    counts[700:760] = [counts[3]] * 60
    rows = pa.table({"doc_id": np.arange(900), "length": [len(t) for t in texts], "terms": pa.array([t.tolist() for t in texts], pa.list_(pa.int64())),
                     "counts": pa.array([c.tolist() for c in counts], pa.list_(pa.int32()))})
    index = search.Index(rows, 20.0)
    terms, idf = np.arange(950), draw.random(950) * 5
    # More questions than are multiplied at a time; the last has no term, and the one before no term that a document has.
    questions = [*texts[:600], np.arange(940, 950), np.zeros(0, int)]
    asked = search.Asked(np.cumsum([0, *map(len, questions)]), np.concatenate(questions), terms, idf)
    whole = np.zeros((len(questions), 900))
    for q, own in enumerate(questions):
        for d, (t, c) in enumerate(zip(texts, counts)):
            held = np.isin(t, own)
            tf = c[held]
            whole[q, d] = (idf[t[held]] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / 20.0))).sum()
    whole = np.round(whole, search.DIGITS)
    tie = draw.permutation(900)
    for least in (np.zeros(len(questions)), np.sort(whole, 1)[:, -5]):
        got = {q: (docs, scores) for q, docs, scores in index.tops(asked, 10, tie, least)}
        for q in range(len(questions)):
            fits = np.flatnonzero((whole[q] > 0) & (whole[q] >= least[q] - 2e-6))
            best = fits[np.lexsort((tie[fits], -whole[q][fits]))][:10]
            docs, scores = got.get(q, ([], []))
            assert np.allclose(scores, whole[q][best], atol=2e-6) and len(set(docs)) == len(docs)
            assert np.allclose(whole[q][docs], scores, atol=2e-6)
    # Of 61 equal texts those with the lowest ids are found.
    equal = np.array([3, *range(700, 760)])
    docs = next(docs for q, docs, _ in index.tops(asked, 10, tie, np.zeros(len(questions))) if q == 3)
    assert list(docs) == list(equal[np.argsort(tie[equal])][:10])


def test_only_terms_of_both_sides_are_multiplied(monkeypatch):
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(3)
    # Four languages of 100 common words each; texts are short or long.
    texts = [np.unique(draw.integers(0, 100, draw.choice([5, 60]))) + 100 * (d % 4) for d in range(2048)]
    rows = pa.table({"doc_id": np.arange(2048), "length": [len(t) for t in texts], "terms": pa.array([t.tolist() for t in texts], pa.list_(pa.int64())),
                     "counts": pa.array([[1] * len(t) for t in texts], pa.list_(pa.int32()))})
    questions = texts[:1024]
    asked = search.Asked(np.cumsum([0, *map(len, questions)]), np.concatenate(questions), np.arange(400), draw.random(400) + 1)
    cells = []
    product = search.Index._product

    def counted(asks, weights):
        cells.append(asks.size * weights.shape[1])
        return product(asks, weights)

    monkeypatch.setattr(search.Index, "_product", staticmethod(counted))
    found = {q: docs for q, docs, _ in search.Index(rows, 20.0).tops(asked, 10, np.arange(2048), np.zeros(1024))}
    assert set(found) == set(range(1024)) and all((docs % 4 == q % 4).all() for q, docs in found.items())
    # All terms are common, so questions x documents x terms cells were multiplied before.
    assert 0 < sum(cells) < 1024 * 2048 * 400 / 3


def test_tiles_of_short_texts_are_not_multiplied(monkeypatch):
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(4)
    # 4,096 texts of 20 words and 4,096 of 200 from the same 2,000 words; some of the long ones ask.
    texts = [np.sort(draw.choice(2000, 20 if d < 4096 else 200, replace=False)) for d in range(8192)]
    rows = pa.table({"doc_id": np.arange(8192), "length": [len(t) for t in texts], "terms": pa.array([t.tolist() for t in texts], pa.list_(pa.int64())),
                     "counts": pa.array([[1] * len(t) for t in texts], pa.list_(pa.int32()))})
    questions, idf = texts[7168:], draw.random(2000) + 1
    asked = search.Asked(np.cumsum([0, *map(len, questions)]), np.concatenate(questions), np.arange(2000), idf)
    cells = []
    product = search.Index._product

    def counted(asks, weights):
        cells.append(asks.size * weights.shape[1])
        return product(asks, weights)

    monkeypatch.setattr(search.Index, "_product", staticmethod(counted))
    found = {q: (docs, scores) for q, docs, scores in search.Index(rows, 100.0).tops(asked, 10, np.arange(8192), np.zeros(1024))}
    # Few short texts of a tile have the same word, though each word is common; before, their tiles took as many cells again.
    assert 0 < sum(cells) < 1.6 * 1024 * 4096 * 2000
    has = np.zeros((8192, 2000), bool)
    for d, text in enumerate(texts):
        has[d, text] = True
    weight = 2.2 / (1 + 1.2 * (0.25 + 0.75 * has.sum(1) / 100.0))
    for q in range(0, 1024, 50):
        whole = np.round(has[:, questions[q]] @ idf[questions[q]] * weight, search.DIGITS)
        docs, scores = found[q]
        assert np.allclose(scores, np.sort(whole)[::-1][:10], atol=2e-6) and np.allclose(whole[docs], scores, atol=2e-6)
