"""Line deduplication over overlapping three-line windows.

Method: the lines of a text that hold more than blanks are trimmed and numbered; every three in a row form a window with
a 128-bit hash. Windows found more than once in the whole table are counted with partial aggregation; each occurrence
but the first, by (doc_id, hash of the text, position), marks its three lines, overlapping marks merge, and marked lines
go, with the blank lines between them. Other blank lines stay. Nothing is hashed by document group, and the two sides of the join on a window
are plain shuffles, which adaptive execution splits where one window is very frequent.

Defined results: a null text counts as empty and gives an empty clean text; a text of under three such lines has no
window and stays as it is; rows that repeat id and text get the same result as each other; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.columns import let, text_or_empty
from tideline.session import materialize

WINDOW = 3
BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(lines: Column) -> Column:
    """Structs (at, line) of the lines that hold more than blanks."""
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(BLANKS)).alias("line")))
    return F.filter(numbered, lambda s: s["line"] != "")


def window_rows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, position, h1, h2) of every window."""

    def windows(filled: Column) -> Column:
        last = F.size(filled) - window

        def one(k: Column) -> Column:
            parts = [filled[k + d]["line"] for d in range(window)]
            return F.struct(k.alias("position"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))

        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one))

    # an outer inline: from an inner one Spark infers a filter that computes all windows a second time
    found = F.inline_outer(let(_filled(_lines(F.col("text"))), windows))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), found).filter("position IS NOT NULL")


def _clean(lines: Column, filled: Column, marks: Column, window: int) -> Column:
    """Text without the marked windows; ``marks`` are sorted window positions, or null."""

    def gap(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(filled[marks[F.greatest(i - 1, F.lit(0))] + (window - 1)]["at"] + 1)
        end = F.when(i == F.size(marks), F.size(lines)).otherwise(filled[marks[F.least(i, F.size(marks) - 1)]]["at"])
        touching = (i > 0) & (i < F.size(marks)) & (F.get(marks, i) - F.get(marks, i - 1) <= window)
        return F.slice(lines, start + 1, F.when(touching, F.lit(0)).otherwise(F.greatest(end - start, F.lit(0))))

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(marks)), gap))
    return F.array_join(kept, "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_lines, n_removed, clean_text for every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    windows = window_rows(docs, window)
    repeated = materialize(
        windows.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "position")).alias("first"))
        .filter("n > 1")
        .drop("n"),
        "repeated-windows",
    )
    place = F.struct("doc_id", "text_hash", "position")
    later = (
        windows.join(repeated, ["h1", "h2"])
        .filter(~place.eqNullSafe(F.col("first")))
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        .agg(F.array_sort(F.collect_set("position")).alias("marks"))
    )
    joined = docs.withColumn("_text_hash", F.xxhash64("text")).join(
        later, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left"
    )

    def cleaned(lines: Column) -> Column:
        def with_filled(filled: Column) -> Column:
            covered = F.col("marks")
            spans = F.aggregate(
                covered,
                F.struct(F.lit(-1).alias("until"), F.lit(0).alias("n")),
                lambda acc, p: F.struct(
                    (p + window).cast("int").alias("until"), (acc["n"] + p + window - F.greatest(p, acc["until"])).cast("int").alias("n")
                ),
            )["n"]
            return F.struct(
                F.size(filled).cast("long").alias("n_lines"),
                F.coalesce(spans, F.lit(0)).cast("long").alias("n_removed"),
                F.when(covered.isNull(), F.col("text")).otherwise(let(covered, lambda m: _clean(lines, filled, m, window))).alias("clean_text"),
            )

        return let(_filled(lines), with_filled)

    return joined.select("doc_id", let(_lines(F.col("text")), cleaned).alias("out")).select("doc_id", "out.*")
