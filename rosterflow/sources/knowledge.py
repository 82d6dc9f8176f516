"""Knowledge tables: ingest, document metadata, category replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterflow.functions import text
from rosterflow.operators import blocks
from rosterflow.operators.joins import keep_first

# Text that one task indexes: with terms and bigrams it sorts some 200 MB by category.
PART_CHARS = 16_000_000
# 320 GB of text; beyond that parts grow, and what a task sorts is spilled.
MOST_PARTS = 20_000


def ingest(sections: DataFrame, seq: str, block_rows: int = blocks.BLOCK_ROWS, parts: int | None = None) -> DataFrame:
    """Chunks with ids ``<doc_id>-c<number>``, numbered over the whole load by ``seq``.

    Only the sequence column is numbered, from per-block counts; the texts are
    joined back by ``seq`` and so spread over all tasks, or dealt out to ``parts``.
    """
    numbers = blocks.running_count(
        sections.select(seq), [], [F.col(seq)], blocks.by_sequence(seq, block_rows), "chunk_no")
    if parts:
        sections, numbers = sections.repartition(parts, seq), numbers.repartition(parts, seq)
    chunk_id = F.concat(F.col("doc_id"), F.lit("-c"), F.col("chunk_no").cast("string"))
    return sections.join(numbers, seq).withColumn("chunk_id", chunk_id)


def document_metadata(sections: DataFrame, seq: str) -> DataFrame:
    """First title and category given for each document."""
    first = keep_first(sections.select("doc_id", "title", "category", seq), ["doc_id"], seq)
    return first.drop(seq)


def index_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with everything retrieval reads: term counts, bigrams and lengths.

    Each row is indexed where it is, so nothing is shuffled and no task holds more
    than a row.  The tokens of a chunk are those of its section followed by those
    of its content, so the content length needs no second pass.
    """
    searchable = text.searchable_text(F.col("section"), F.col("content"))
    tokens = chunks.withColumn("tokens", F.sort_array(text.tokenize(searchable)))
    return tokens.withColumns({
        "grams": text.bigrams(searchable), "terms": text.counted("tokens"), "dl": F.size("tokens"),
        "content_len": F.size("tokens") - F.size(text.tokenize(F.col("section")))}).drop("tokens")


def part_count(total_chars: int, cores: int) -> int:
    """Parts of an index: enough for all cores, and one per ``PART_CHARS`` of text."""
    return max(cores, min(-(-total_chars // PART_CHARS), MOST_PARTS))


def store_index(chunks: DataFrame, name: str, path: str) -> DataFrame:
    """Index as a table partitioned by category: a category filter then prunes files."""
    index_chunks(chunks).write.mode("overwrite").option("path", path).partitionBy("category").saveAsTable(name)
    return chunks.sparkSession.table(name)


def store_statistics(index: DataFrame, name: str, path: str) -> None:
    """Frequencies, bounds and lengths per category as ``<name>_terms`` and ``<name>_totals``, for a stored index.

    ``max_tf`` and ``min_ratio`` (chunk length for each occurrence) bound what a term can add to any chunk.
    """
    terms = index.select("category", "dl", F.explode("terms").alias("t")).groupBy("category", F.col("t.feature").alias("feature")).agg(
        F.count(F.lit(1)).alias("df"), F.max("t.tf").alias("max_tf"), F.min(F.col("dl") / F.col("t.tf")).alias("min_ratio"))
    totals = index.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.col("content_len").cast("bigint")).alias("content_len"))
    for part, rows in (("terms", terms), ("totals", totals)):
        rows.write.mode("overwrite").option("path", f"{path}-{part}").saveAsTable(f"{name}_{part}")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk table partitioned by category, so that a category filter prunes files."""
    chunks.write.mode("overwrite").partitionBy("category").parquet(path)


def replace_category(chunks: DataFrame, category: str, path: str) -> None:
    """Replace one category of the stored table; the other partitions stay."""
    (
        chunks.filter(F.col("category") == category)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("category").parquet(path)
    )
