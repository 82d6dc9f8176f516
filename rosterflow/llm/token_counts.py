"""Token counts that follow edits.

A text is cut into leaves of about ``LEAF`` characters, only where the tokenizer's pre-tokens always end, whatever the
script: before a space or line end that follows anything else, and between a mark and a letter of a script written without
spaces.  So the counts of the leaves add up to that of the text.  A run without any such place stays in one leaf.  The leaves are the bottom of
a segment tree of characters and tokens.  An edit finds its leaves from the sums, takes in neighbours whose border
it touches, encodes this region alone, and renews the sums on the way to the root; a region that has outgrown a leaf
becomes several.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterflow.llm.common import pieces
from rosterflow.llm.packing import encoder

LEAF = 512
# What some library may take for white space is left out before a space; the letters are in all versions of Unicode.
_BORDER = re.compile("(?<=[^\\s\x1c-\x1f\x85\u180e\u200b\ufeff])[ \n]|(?<=[。，、！？；：])[ぁ-ゖァ-ヺ一-龥가-힣]")


def cut_places(text: str, leaf: int = LEAF) -> list[int]:
    """Borders of the leaves, 0 and the length included: the first safe place after each ``leaf`` characters."""
    places = [0]
    while found := _BORDER.search(text, places[-1] + leaf):
        places.append(found.start())
    return [*places, len(text)]


class Tree:
    """Sums of characters and tokens over leaves; node k has the children 2k and 2k + 1, leaves start at ``size``."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = len(chars)
        self.size = 1 << max(self.leaves - 1, 0).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size:self.size + self.leaves, 0] = chars
        self.sums[self.size:self.size + self.leaves, 1] = tokens
        low = self.size
        while low > 1:
            self.sums[low // 2:low] = self.sums[low:2 * low:2] + self.sums[low + 1:2 * low:2]
            low //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, or the last with any, and where it starts."""
        node, start = 1, 0
        char = min(char, int(self.sums[1, 0]) - 1)
        while node < self.size:
            node *= 2
            if char - start >= self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        self.sums[node] = chars, tokens
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def split(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Puts other leaves in place of the leaves from ``first`` to ``last``; empty ones go."""
        own = self.sums[self.size:self.size + self.leaves]
        whole = np.concatenate([own[:first], np.stack([chars, tokens], 1), own[last + 1:]])
        self.__init__(*whole[whole[:, 0] > 0].T)

    def chars_of(self, leaf: int) -> int:
        return int(self.sums[self.size + leaf, 0])


def build(text: str, encode, leaf: int = LEAF) -> Tree:
    places = cut_places(text, leaf)
    parts = [text[a:b] for a, b in zip(places, places[1:])]
    return Tree([len(p) for p in parts], [len(x) for x in encode(parts)])


def edit(text: str, tree: Tree, start: int, end: int, new: str, encode, leaf: int = LEAF) -> tuple[str, int]:
    """Replaces [start, end) by ``new``; returns the text and the characters that were encoded again.

    Places beyond the text are cut to its length; an end before the start counts as the start.
    """
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    if not text:
        first = last = low = high = 0
    else:
        first, low = tree.leaf_at(start)
        # A border is safe while the characters beside it stay as they are.
        while first and start < low + 2:
            first -= 1
            low -= tree.chars_of(first)
        last, at = tree.leaf_at(max(end - 1, start))
        high = at + tree.chars_of(last)
        while high < len(text) and end > high - 1:
            last += 1
            high += tree.chars_of(last)
        # Leaves that earlier edits have emptied have no character that could be found.
        while high < len(text) and not tree.chars_of(last):
            last += 1
            high += tree.chars_of(last)
    region = text[low:start] + new + text[end:high]
    places = cut_places(region, leaf) if len(region) > 2 * leaf else [0, len(region)]
    parts = [region[a:b] for a, b in zip(places, places[1:])]
    tokens = [len(ids) for ids in encode(parts)]
    if len(parts) > 1:
        tree.split(first, last, [len(p) for p in parts], tokens)
    else:
        tree.put(first, len(region), tokens[0])
        for other in range(first + 1, last + 1):
            if tree.chars_of(other):
                tree.put(other, 0, 0)
    return text[:start] + new + text[end:], len(region)


EDITS = "array<struct<start:int,end:int,text:string>>"


def count_tokens(docs: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """Rows (doc_id, text, edits, leaf_chars, leaf_tokens): each text (null: empty) with the leaves of its tree."""

    def count(batches):
        encode = encoder(tokenizer)
        for batch, data, borders in pieces(batches, "text"):
            at, whole, chars, tokens = borders.tolist(), data.tobytes(), [], []
            for a, b in zip(at, at[1:]):
                text = whole[a:b].decode()
                places = cut_places(text, leaf)
                chars.append([y - x for x, y in zip(places, places[1:])])
                tokens.append([len(x) for x in encode([text[x:y] for x, y in zip(places, places[1:])])])
            yield pa.record_batch([*batch.columns, pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))],
                                  names=["doc_id", "text", "edits", "leaf_chars", "leaf_tokens"])

    return docs.select("doc_id", "text", F.col("edits").cast(EDITS)).mapInArrow(
        count, f"doc_id long, text string, edits {EDITS}, leaf_chars array<int>, leaf_tokens array<int>")


def apply_edits(counted: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """Rows (doc_id, text, n_tokens_before, n_tokens, n_chars, n_edits, n_chars_encoded).

    ``counted``: rows of ``count_tokens``, which keeps ``edits``, an array of (start, end, text) in the order of application (null:
    none); each speaks of the text that the earlier ones left.  Null edit texts are empty.
    """

    def apply(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for text, chars, tokens, edits in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                text, tree, again = text or "", Tree(chars, tokens), 0
                before = tree.tokens
                for e in edits or []:
                    text, own = edit(text, tree, e["start"], e["end"], e["text"] or "", encode, leaf)
                    again += own
                rows.append((text, before, tree.tokens, len(text), len(edits or []), again))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.record_batch(
                [batch.column(0), pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                names=["doc_id", "text", "n_tokens_before", "n_tokens", "n_chars", "n_edits", "n_chars_encoded"])

    return counted.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits").mapInArrow(
        apply, "doc_id long, text string, n_tokens_before long, n_tokens long, n_chars long, n_edits long, n_chars_encoded long")
