"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ``size`` consecutive words of an item (a shorter item is one window).  A document can hold a window only if
it holds all its shingles, so of each window one is enough to find it: the rarest by the counts over all documents.
Documents are joined on these alone; length and position bounds follow from the shingle's place in the window; what
is left is compared word by word.

Candidates are found on fully lower-cased words, which never separates words that agree in A-Z alone, and are
confirmed on words lower-cased in A-Z.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterflow.llm.common import sized
from rosterflow.session import written

SIZE = 10
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text as they stand (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN, -1), "")


def _exact(text: Column) -> Column:
    return words(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _shingles(folded: str, size: int) -> Column:
    """Hashes of the shingles of ``size`` words (one or two) at each place of an array column."""
    if size == 1:
        return F.transform(folded, lambda x: F.xxhash64(x))
    n = F.greatest(F.size(folded) - 1, F.lit(0))
    return F.zip_with(F.slice(folded, F.lit(1), n), F.slice(folded, F.lit(2), n), lambda x, y: F.xxhash64(x, y))


def windows(items: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Different windows (window, m), and rows (window, item_id).  Items without id or words have none."""
    split = items.select("item_id", _exact(F.col("text")).alias("w")).where("item_id is not null and size(w) > 0")
    last = F.greatest(F.size("w") - size + 1, F.lit(1))
    cut = split.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(F.col("w"), i, F.lit(size)), " "))).alias("window"))
    of_items = written(cut.distinct(), "window-items")
    return of_items.select("window").distinct().select("window", F.size(F.split("window", " ")).alias("m")), of_items


def _placed(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, same, n_words, pos, shingle): every shingle of every document."""
    split = docs.select("doc_id", F.xxhash64("text").alias("same"), words(F.col("text")).alias("w"))
    split = split.select("doc_id", "same", F.size("w").alias("n_words"), F.transform("w", lambda x: F.lower(x)).alias("w"))
    return split.select("doc_id", "same", "n_words", F.posexplode(_shingles("w", size)).alias("pos", "shingle"))


def candidates(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows (doc_id, same, start, m, window): places where a window may stand in a document."""
    folded = cut.select("window", "m", F.transform(F.split("window", " "), lambda x: F.lower(x)).alias("w"))
    found = None
    for size, own in ((1, folded.where("m = 1")), (2, folded.where("m > 1"))):
        own = written(own.select("window", "m", F.posexplode(_shingles("w", size)).alias("off", "shingle")), "shingles")
        rows = own.count()
        if not rows:
            continue
        wanted = sized(own.select("shingle").distinct(), rows, 32)
        counts = _placed(docs, size).select("shingle").join(wanted, "shingle").groupBy("shingle").count()
        # A shingle that no document holds has no count; its window is found nowhere and falls out with it.
        ranked = own.join(counts, "shingle", "left").groupBy("window", "m").agg(
            F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "off")).alias("rare"))
        prefix = written(ranked.where("rare.count > 0").select("window", "m", "rare.shingle", "rare.off"), "prefixes")
        here = _placed(docs, size).join(sized(prefix, rows, 160), "shingle").withColumn("start", F.col("pos") - F.col("off"))
        here = here.where("start >= 0 and start + m <= n_words").select("doc_id", "same", "start", "m", "window")
        found = here if found is None else found.union(here)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, items), one for each row of ``docs`` (doc_id, text).

    ``n_hit`` counts the words that stand inside any window, ``items`` has the ids of items with a window in the text.
    Null or empty texts have no words, and no items; repeated rows give equal results; a repeated item counts once.
    """
    docs = docs.select("doc_id", "text")
    cut, of_items = windows(items, size)
    found = candidates(docs, cut)
    none = F.lit(None).cast("array<struct<start:int,m:int,window:string>>")
    if found is None:
        held = docs.select("doc_id", F.xxhash64("text").alias("same"), "text", none.alias("may"))
    else:
        per_doc = written(found.groupBy("doc_id", "same").agg(F.collect_list(F.struct("start", "m", "window")).alias("may"))
                          .select(F.col("doc_id").alias("id"), F.col("same").alias("own"), "may"), "candidates")
        total = per_doc.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("may")).alias("places")).first()
        per_doc = sized(per_doc, total["n"] + (total["places"] or 0), 120)
        keyed = docs.select("doc_id", F.xxhash64("text").alias("same"), "text")
        held = keyed.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("same") == F.col("own")), "left")
    split = held.select("doc_id", "same", "may", F.when(F.col("may").isNull(), words(F.col("text")))
                        .otherwise(_exact(F.col("text"))).alias("w"))
    sure = F.filter("may", lambda c: F.array_join(F.slice(F.col("w"), c.start + 1, c.m), " ") == c.window)
    split = split.select("doc_id", "same", F.size("w").alias("n_words"), F.sort_array(F.coalesce(sure, F.array())).alias("hits"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    covered = F.aggregate("hits", start, lambda acc, c: F.struct(
        F.greatest(acc.end, c.start + c.m).alias("end"),
        (acc.hit + F.greatest(c.start + c.m - F.greatest(acc.end, c.start), F.lit(0))).alias("hit")), lambda acc: acc.hit)
    base = written(split.select("doc_id", "same", F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"),
                                F.array_distinct(F.transform("hits", lambda c: c.window)).alias("windows")), "hits")
    items_of = base.where("n_hit > 0").select("doc_id", "same", F.explode("windows").alias("window")).join(
        of_items, "window").groupBy("doc_id", "same").agg(F.collect_set("item_id").alias("items"))
    items_of = items_of.select(F.col("doc_id").alias("id"), F.col("same").alias("own"), "items")
    return base.join(items_of, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("same") == F.col("own")), "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast(items_of.schema["items"].dataType)).alias("items"))
