"""Line dedup by overlapping three-line windows.

A text is cut at every newline.  Each run of three consecutive lines is a window (two 64-bit hashes of its three lines);
a window of blank lines only is none.  All windows of the corpus are counted by hash; of a window that occurs more than
once the first occurrence, by (doc_id, text hash, line number), stays, and every later one is covered.  The covered
windows of a document are merged and their lines removed, so a repeated stretch of any length of three lines or more
goes as a whole, while its first occurrence keeps all lines that no later occurrence of another window covers.  Inside
one document a block that repeats itself leaves its first round.

Texts under three lines have no window and stay.  A null text stays null, null ids sort first.  Rows with the same id
and text are one document: they get the same result.  An empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapline.llm.common import free_name, same

WIDTH = 3


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, at, h1, h2: one row per window of each text.  Only hashes leave the scan."""
    lines = docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines")
    ).where(F.size("lines") >= WIDTH)
    hashed = lines.select(
        "doc_id", "text_hash",
        F.transform("lines", lambda x: F.struct(
            F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")).alias("word")
        )).alias("l"),
    )
    part = lambda i, k, f: F.element_at("l", i + k)[f]
    each = F.transform(F.sequence(F.lit(1), F.size("l") - (WIDTH - 1)), lambda i: F.struct(
        (i - 1).alias("at"),
        F.xxhash64(*[part(i, k, "a") for k in range(WIDTH)]).alias("h1"),
        F.xxhash64(*[part(i, k, "b") for k in range(WIDTH)]).alias("h2"),
        (part(i, 0, "word") | part(i, 1, "word") | part(i, 2, "word")).alias("word"),
    ))
    return hashed.select("doc_id", "text_hash", F.inline(each)).where("word").drop("word")


def later_windows(steps, docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, at of every window that occurs before."""
    found = steps.store(windows(docs))
    place = F.struct("doc_id", "text_hash", "at")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last"))
    return found.join(first, ["h1", "h2"]).where(place > F.col("first")).select("doc_id", "text_hash", "at").distinct()


def dedup_lines(steps, docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs` with the lines removed from `text`, and a struct column `lines` with
    n_lines, n_removed (null text: 0)."""
    out, hashed, at, its_id, its_hash = (free_name(docs, n) for n in ("lines", "_text_hash", "_at", "_id", "_hash"))
    covered = later_windows(steps, docs).groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias(at))
    covered = covered.withColumnsRenamed({"doc_id": its_id, "text_hash": its_hash})
    rows = docs.withColumn(hashed, F.xxhash64("text"))
    rows = rows.join(covered, same(rows["doc_id"], covered[its_id]) & (rows[hashed] == covered[its_hash]), "left")
    lines = F.split("text", "\n", -1)
    gone = F.flatten(F.transform(at, lambda a: F.array(*[a + k for k in range(WIDTH)])))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)  # by hash, so linear in the lines
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    removed = F.when(F.col(at).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("bigint")
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    )
    return rows.select(
        *[text.alias("text") if c == "text" else docs[c] for c in docs.columns],
        F.struct(n_lines.alias("n_lines"), removed.alias("n_removed")).alias(out),
    )


def stage(steps, docs: DataFrame) -> DataFrame:
    """Columns of `docs`; a document that lost all its lines goes, `n_chars` follows the text."""
    out = free_name(docs, "lines")
    rows = dedup_lines(steps, docs)
    rows = rows.where((F.col(f"{out}.n_removed") == 0) | (F.col(f"{out}.n_removed") < F.col(f"{out}.n_lines")))
    if "n_chars" in docs.columns:
        length = F.when(F.col(f"{out}.n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
        rows = rows.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return rows.select(*docs.columns)
