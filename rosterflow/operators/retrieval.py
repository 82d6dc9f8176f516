"""Hybrid text retrieval: BM25, bigram overlap, fused score, top-K.

The chunks carry an index (term counts and bigrams, see ``sources.knowledge``), a
row for each, so all features of a chunk are in one task.  Few questions are held
by every task and scored in passes over the index (``operators.scan``): nothing is
shuffled but the best K of each task.

The features of more questions become posting lists that chunk features are joined
with, and are summed per (chunk, question).  A term that occurs in every chunk is
never grouped into one task.  For many questions and chunks the best K are found without scoring the rest
(:func:`top_scores`).  Overlap is 1
at most, so a chunk needs a certain BM25 to be among the best, which a few chunks
with the rarest terms of the question tell.  Terms whose largest contributions
together stay below that cannot lift a chunk alone; only chunks with another term
are looked up, and only those whose sum may reach it are scored.

``chunks`` below always means the indexed table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterflow import constants as C
from rosterflow.functions import text
from rosterflow.operators import scan
from rosterflow.session import written

_TERM, _GRAM = 0, 1
# Scores that differ only by the order of summation must tie.
RANK_DIGITS = 9
# Questions per posting list (on average).
POSTING_LENGTH = 1000
# Posting lists are broadcast while the question texts have at most this many
# characters: every character makes at most one bigram and one term entry of
# about 24 bytes, so the lists stay below 100 MB.
BROADCAST_QUESTION_CHARS = 2_000_000
# Postings of a question, rarest terms first, that are read for its first
# threshold, and chunks scored for that, as a multiple of K.
SEED_POSTINGS = 2_000
SEEDS = 4
# Pairs of questions and chunks from which pruning pays: it reads the index five
# times instead of twice.  The results are the same.
PRUNED_PAIRS = 50_000_000
# Share of the threshold that the terms left out may carry together: less means
# more postings, and fewer chunks that are scored in full.
LEFT_OUT = 0.08
# What sums in another order may differ by, relative to the largest.
MARGIN = 1e-9


@dataclass(frozen=True)
class Statistics:
    """Stored counts of an index: (category, feature, df, max_tf, min_ratio), and (category, n_chunks, content_len)."""

    terms: DataFrame
    totals: DataFrame

    def of(self, category: str | None) -> Statistics:
        if category is None:
            return self
        return Statistics(*[t.filter(F.col("category") == category) for t in (self.terms, self.totals)])


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and mean number of content tokens (1 when there are none)."""
    mean = F.avg("content_len")
    return chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.when(mean > 0, mean).otherwise(F.lit(1.0)).alias("avg_len"))


def term_stats(chunks: DataFrame) -> DataFrame:
    """Chunks containing each term, and its occurrences, with map-side counts."""
    return chunks.select(F.explode("terms").alias("t")).groupBy(F.col("t.feature").alias("term")).agg(
        F.count(F.lit(1)).alias("df"), F.sum("t.tf").alias("occurrences"))


def idf(df: Column, total: Column) -> Column:
    return F.log(1 + (total - df + 0.5) / (df + 0.5))


def _totals(chunks: DataFrame, stats: Statistics | None) -> tuple[int, float]:
    """The two corpus numbers, from the stored counts where there are any."""
    if stats is None:
        row = corpus_stats(chunks).first()
        return row.n_chunks, row.avg_len
    row = stats.totals.agg(F.sum("n_chunks").alias("n"), F.sum("content_len").alias("length")).first()
    return row.n or 0, (row.length or 0) / row.n if row.length else 1.0


def _term_weights(
    questions: DataFrame, chunks: DataFrame, total: int, stats: Statistics | None, avg_len: float = 1.0,
) -> DataFrame:
    """(question, term, weight): idf times the occurrences in the question, and the most it adds to any chunk.

    The table is as large as the questions; it is written once, so that the
    document frequencies are not counted again by every pass that reads it.
    """
    terms = (
        questions.select("question_id", F.explode(text.tokenize(F.col("question"))).alias("feature"))
        .groupBy("question_id", "feature").agg(F.count(F.lit(1)).alias("times"))
    )
    counted = stats.terms if stats else chunks.select("dl", F.explode("terms").alias("t")).select(
        F.col("t.feature").alias("feature"), F.lit(1).alias("df"), F.col("t.tf").alias("max_tf"), (F.col("dl") / F.col("t.tf")).alias("min_ratio"))
    mentioned = terms.select("feature").distinct()
    if _small(questions):  # the counts of all terms stay where they are
        mentioned = F.broadcast(mentioned)
    df = (
        counted.join(mentioned, "feature", "left_semi")
        .groupBy("feature").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_ratio").alias("min_ratio"))
    )
    # Larger counts and shorter chunks for a count both raise the contribution.
    most = (C.BM25_K1 + 1) / (1 + C.BM25_K1 * (1 - C.BM25_B) / F.col("max_tf") + C.BM25_K1 * C.BM25_B * F.col("min_ratio") / avg_len)
    weights = terms.join(df, "feature").withColumn("weight", idf(F.col("df"), F.lit(total)) * F.col("times")).select(
        "question_id", F.lit(_TERM).alias("kind"), "feature", "weight", F.lit(0).alias("n_question"), "df",
        (F.col("weight") * most).alias("ceiling"))
    return written(weights, "term-weights")


def _question_grams(questions: DataFrame) -> DataFrame:
    grams = questions.select("question_id", text.bigrams(F.col("question")).alias("g"))
    return grams.select(
        "question_id", F.lit(_GRAM).alias("kind"), F.explode("g").alias("feature"),
        F.lit(0.0).alias("weight"), F.size("g").alias("n_question"))


def _small(questions: DataFrame) -> bool:
    """Whether the measured size of the questions allows broadcasting their features."""
    chars = questions.agg(F.sum(F.length("question"))).first()[0]
    return (chars or 0) <= BROADCAST_QUESTION_CHARS


def _saturated(tf: Column, dl: Column, avg_len: float) -> Column:
    return tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * dl / avg_len))


def _pairs(chunks: DataFrame, wanted: DataFrame, grams: bool, small: bool, avg_len: float) -> DataFrame:
    """(question, chunk, bm25, overlap) for pairs that share at least one feature.

    With ``small`` questions the lists are broadcast and only partial sums move;
    otherwise both sides are shuffled by feature and AQE splits the hot ones.

    ``wanted`` becomes one posting list per feature, so a chunk looks every
    feature up once per slice.  A list holds the questions of one slice only, so
    that a feature shared by all questions is no unbounded group.
    """
    slices = wanted.agg(F.ceil(F.count_distinct("question_id") / POSTING_LENGTH).alias("n")).select("n").scalar()
    postings = wanted.withColumn(
        "slice", F.pmod(F.xxhash64("question_id"), F.greatest(slices, F.lit(1)))
    ).groupBy("kind", "feature", "slice").agg(
        F.collect_list(F.struct("question_id", "weight", "n_question")).alias("postings"))

    def tagged(kind: int, values: Column, feature, tf) -> Column:
        return F.transform(values, lambda v: F.struct(
            F.lit(kind).alias("kind"), feature(v).alias("feature"), tf(v).alias("tf")))

    if small:
        postings = F.broadcast(postings)
    if grams:
        features = F.concat(tagged(_TERM, F.col("terms"), lambda v: v["feature"], lambda v: v["tf"]),
                            tagged(_GRAM, F.col("grams"), lambda v: v, lambda v: F.lit(0)))
        rows = chunks.select("chunk_no", "dl", F.size("grams").alias("n_chunk"), features.alias("features")).select(
            "chunk_no", "dl", "n_chunk", F.inline("features"))
    else:
        rows = chunks.select("chunk_no", "dl", F.lit(0).alias("n_chunk"), F.inline("terms")).withColumn("kind", F.lit(_TERM))
    saturated = _saturated(F.col("tf"), F.col("dl"), avg_len)
    hits = rows.join(postings, ["kind", "feature"]).select(
        "chunk_no", "n_chunk", "kind",
        F.when(F.col("kind") == _TERM, saturated).otherwise(F.lit(0.0)).alias("saturated"),
        F.explode("postings").alias("p")).select("*", "p.*")
    smaller = F.max(F.least("n_question", "n_chunk"))
    return hits.groupBy("chunk_no", "question_id").agg(
        F.sum(F.col("weight") * F.col("saturated")).alias("bm25"),
        F.when(smaller > 0, F.count_if(F.col("kind") == _GRAM) / smaller).otherwise(F.lit(0.0)).alias("overlap"))


def bm25_scores(questions: DataFrame, chunks: DataFrame, stats: Statistics | None = None) -> DataFrame:
    """BM25 of every matching pair and its ``rank`` in the question; ``zero_chunks`` further chunks scored 0."""
    total, avg_len = _totals(chunks, stats)
    weights = _term_weights(questions, chunks, total, stats)
    mine = W.partitionBy("question_id")
    asked = scan.held(questions, weights, None) if scan.few(questions) else None
    if asked:
        pairs = scan.matches(chunks, asked, avg_len)
    else:
        pairs = _pairs(chunks, weights, False, _small(questions), avg_len).drop("overlap").withColumn(
            "matched", F.count(F.lit(1)).over(mine))
    return pairs.withColumns({
        "rank": F.row_number().over(mine.orderBy(F.round("bm25", RANK_DIGITS).desc(), "chunk_no")),
        "zero_chunks": F.lit(total) - F.col("matched")}).drop("matched")


def hybrid_scores(questions: DataFrame, chunks: DataFrame, stats: Statistics | None = None) -> DataFrame:
    """Fused score of every pair: overlap and BM25 relative to the question's best."""
    total, avg_len = _totals(chunks, stats)
    weights = _term_weights(questions, chunks, total, stats)
    small = _small(questions)
    best = _pairs(chunks, weights, False, small, avg_len).groupBy("question_id").agg(F.max("bm25").alias("best"))
    if small:  # one row per question: the pairs stay where they are
        best = F.broadcast(best)
    wanted = weights.drop("df", "ceiling").unionByName(_question_grams(questions))
    pairs = _pairs(chunks, wanted, True, small, avg_len)
    relative = F.when(F.col("best") > 0, F.col("bm25") / F.col("best")).otherwise(F.lit(0.0))
    score = C.VECTOR_WEIGHT * F.col("overlap") + C.BM25_WEIGHT * relative
    return pairs.join(best, "question_id", "left").withColumn("score", score).select(
        "question_id", "chunk_no", "bm25", "overlap", "score").filter(F.col("score") > 0)


def _scored(pairs: DataFrame, asked: DataFrame, weights: DataFrame, chunks: DataFrame, avg_len: float) -> DataFrame:
    """(question, chunk, bm25, overlap) of the given pairs alone, which share a term each, from the features of both sides."""
    held = chunks.select("chunk_no", "dl", "terms", F.col("grams").alias("chunk_grams"))
    both = pairs.select("question_id", "chunk_no").join(held, "chunk_no").join(asked, "question_id")
    shared = F.coalesce(text.overlap(F.col("question_grams"), F.col("chunk_grams")), F.lit(0.0))
    # In a projection of its own, else it would be computed anew for each term of the chunk.
    both = both.select("question_id", "chunk_no", "dl", "terms", shared.alias("overlap"))
    terms = both.select("question_id", "chunk_no", "dl", "overlap", F.inline("terms")).join(weights, ["question_id", "feature"])
    return terms.groupBy("question_id", "chunk_no").agg(
        F.sum(F.col("weight") * _saturated(F.col("tf"), F.col("dl"), avg_len)).alias("bm25"), F.first("overlap").alias("overlap"))


def _floors(found: DataFrame, k: int) -> DataFrame:
    """(question, best, floor): largest BM25 found, and what a chunk needs of it to come into the best ``k`` found."""
    best = F.max("bm25").over(W.partitionBy("question_id"))
    need = F.col("bm25") - C.VECTOR_WEIGHT / C.BM25_WEIGHT * (1 - F.col("overlap")) * F.col("best")
    ranked = found.withColumn("best", best).withColumn("need", need).withColumn(
        "place", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("need"))))
    return ranked.filter(F.col("place") == k).select(
        "question_id", "best", (F.col("need") - F.greatest(F.lit(1.0), "best") * MARGIN * 10).alias("floor"))


def top_scores(questions: DataFrame, chunks: DataFrame, k: int, stats: Statistics | None = None) -> DataFrame:
    """Fused scores of chunks among which are the best ``k`` of each question, ties included.

    Questions whose threshold does not exclude chunks without any of their terms
    are scored against all chunks that share a feature.
    """
    total, avg_len = _totals(chunks, stats)
    weights = _term_weights(questions, chunks, total, stats, avg_len)
    small = _small(questions)
    asked = written(questions.select("question_id", text.bigrams(F.col("question")).alias("question_grams")), "asked")
    asked, each = [F.broadcast(t) if small else t for t in (asked, weights.select("question_id", "feature", "weight"))]
    mine = W.partitionBy("question_id")
    read = mine.orderBy("df", "feature").rowsBetween(W.unboundedPreceding, -1)
    rare = weights.withColumn("before", F.coalesce(F.sum("df").over(read), F.lit(0))).filter(F.col("before") + F.col("df") <= F.greatest(F.lit(SEED_POSTINGS), "df"))
    seeds = _pairs(chunks, rare.select("question_id", "kind", "feature", "weight", "n_question"), False, small, avg_len)
    seeds = seeds.withColumn("place", F.row_number().over(mine.orderBy(F.desc("bm25"), "chunk_no"))).filter(F.col("place") <= SEEDS * k)
    found = written(_scored(seeds, asked, each, chunks, avg_len), "scored")
    done = pending = None
    while True:
        floors = _floors(found, k)
        if done is not None:
            # A higher best lowers the floor; the chunks between the two have not been looked up.
            floors = floors.join(done.withColumnRenamed("floor", "old"), "question_id").filter(F.col("floor") < F.col("old")).drop("old")
        pending = written(floors.filter("floor > 0").select("question_id", "floor"), "floors")
        if done is not None and pending.isEmpty():
            break
        small_first = mine.orderBy("ceiling", "feature").rowsBetween(W.unboundedPreceding, 0)
        limited = weights.join(pending, "question_id").withColumn("upto", F.sum("ceiling").over(small_first) * (1 + MARGIN))
        needless = F.col("upto") < F.col("floor") * LEFT_OUT
        needed = limited.filter(~needless).select("question_id", "kind", "feature", "weight", "n_question")
        rest = limited.groupBy("question_id", "floor").agg(F.max(F.when(needless, F.col("upto"))).alias("rest"))
        rest = rest.select("question_id", "floor", (F.col("floor") - F.coalesce("rest", F.lit(0.0))).alias("least"))
        partial = _pairs(chunks, needed, False, small, avg_len)
        near = partial.join(F.broadcast(rest) if small else rest, "question_id").filter(F.col("bm25") >= F.col("least") * (1 - MARGIN))
        near = near.select("question_id", "chunk_no", "bm25", (F.col("floor") - F.col("least")).alias("rest"))
        near = written(near.join(found, ["question_id", "chunk_no"], "left_anti"), "near")
        # The largest of them first: they raise the threshold for the others.
        place = F.row_number().over(mine.orderBy(F.desc("bm25"), "chunk_no"))
        first = near.withColumn("place", place).filter(F.col("place") <= SEEDS * k)
        found = written(found.unionByName(_scored(first, asked, each, chunks, avg_len)), "scored")
        raised = _floors(found, k).select("question_id", F.col("floor").alias("raised"))
        left = near.join(raised, "question_id").filter(F.col("bm25") + F.col("rest") >= F.col("raised") * (1 - MARGIN))
        left = left.join(found, ["question_id", "chunk_no"], "left_anti")
        found = written(found.unionByName(_scored(left, asked, each, chunks, avg_len)), "scored")
        done = pending if done is None else written(
            done.join(pending.select("question_id"), "question_id", "left_anti").unionByName(pending), "floors")
    # Exact bests are known by now for all whose floor was above 0 throughout; one without known terms never had any.
    sure = written(_floors(found, k).filter("floor > 0").select("question_id", "best").join(
        done.select("question_id"), "question_id", "left_semi"), "bests")
    relative = F.when(F.col("best") > 0, F.col("bm25") / F.col("best")).otherwise(F.lit(0.0))
    score = (C.VECTOR_WEIGHT * F.col("overlap") + C.BM25_WEIGHT * relative).alias("score")
    pruned = found.join(sure, "question_id").select("question_id", "chunk_no", "bm25", "overlap", score)
    weak = questions.join(sure.select("question_id"), "question_id", "left_anti")
    if weak.isEmpty():
        return pruned
    return pruned.unionByName(hybrid_scores(weak, chunks, stats))


def scanned_scores(questions: DataFrame, chunks: DataFrame, k: int, stats: Statistics | None = None) -> DataFrame | None:
    """Fused scores of at most ``k`` chunks a task, the best of each question among them; None for too many questions."""
    if not scan.few(questions):
        return None
    total, avg_len = _totals(chunks, stats)
    asked = scan.held(questions, _term_weights(questions, chunks, total, stats), _question_grams(questions))
    return asked and scan.best_fused(chunks, asked, avg_len, k, RANK_DIGITS)


def retrieve(
    questions: DataFrame, chunks: DataFrame, k: int = C.TOP_K, category: str | None = None,
    stats: Statistics | None = None,
) -> DataFrame:
    """Best ``k`` chunks per question (all when ``k`` <= 0) with their display columns.

    The category filter comes first: it prunes partitions, and the statistics are
    those of the candidates: the stored ones, or counted here where ``stats`` is None.
    """
    candidates = chunks if category is None else chunks.filter(F.col("category") == category)
    own = stats and stats.of(category)
    found = few = scanned_scores(questions, candidates, k, own) if k > 0 else None
    if few is None:
        pruned = k > 0 and questions.count() * _totals(candidates, own)[0] >= PRUNED_PAIRS
        found = top_scores(questions, candidates, k, own) if pruned else hybrid_scores(questions, candidates, own)
    scored = found.select("question_id", "chunk_no", "score")
    ranking = W.partitionBy("question_id").orderBy(
        F.round("score", RANK_DIGITS).desc(), F.col("chunk_no"))
    ranked = scored.withColumn("rank", F.row_number().over(ranking))
    if k > 0:
        ranked = ranked.filter(F.col("rank") <= k)
    if few is not None:  # k rows for each of few questions; the texts stay where they are
        ranked = F.broadcast(ranked)
    shown = candidates.select("chunk_no", "chunk_id", "doc_id", "category", "title", "section", "content")
    return ranked.join(shown, "chunk_no").withColumn("snippet", text.snippet(F.col("content"))).drop("content")


def confidence(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """Best score per question and whether it is too low to answer from."""
    top = sources.groupBy("question_id").agg(F.max("score").alias("top_score"))
    return questions.join(top, "question_id", "left").withColumn(
        "low_confidence", F.coalesce(F.col("top_score"), F.lit(0.0)) < C.LOW_CONFIDENCE_THRESHOLD)


def material_list(chunks: DataFrame, identity: str | None) -> DataFrame:
    """Material chunks for one identity, with score 1; nothing without an identity."""
    wanted = (F.col("category") == "MATERIAL") & (F.col("student_category") == F.lit(identity))
    return chunks.filter(wanted).withColumn("score", F.lit(1.0)).withColumn(
        "snippet", text.snippet(F.col("content")))


def faq_fallback(questions: DataFrame, chunks: DataFrame, stats: Statistics | None = None) -> DataFrame:
    """Best FAQ snippet when it scores well enough, else the fixed fallback text."""
    best = retrieve(questions, chunks, 1, "FAQ", stats).select("question_id", "score", "snippet")
    joined = questions.join(best, "question_id", "left")
    hit = F.coalesce(F.col("score") >= C.FAQ_MIN_SCORE, F.lit(False))
    return joined.withColumn("hit", hit).withColumn(
        "reply", F.when(hit, F.col("snippet")).otherwise(F.lit(C.FAQ_FALLBACK_REPLY))
    ).withColumn("score", F.when(hit, F.col("score")).otherwise(F.lit(0.0))).drop("snippet")
