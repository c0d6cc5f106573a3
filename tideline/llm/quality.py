"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every measure is a count or ratio over the whole text; a rule is (measure, smallest allowed, largest allowed) with null
for an open end. ``compile_rules`` turns the table into one boolean column and a column that names the first failed rule,
so that a new rule is a new line of the table and Spark sees a single projection, with no shuffle and no user function. The stop-word ratio counts one stop word more than there is, so that a short
sentence without any is not taken for junk.

Defined results: a null text has no words and fails the base rule; an empty text likewise; ties do not occur; repeated
rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.columns import let, text_or_empty

WORD_BREAKS = "\x20\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5

#: Common function words of the corpus languages.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "on", "as", "are", "this", "be", "by", "at", "from", "or",
    "der", "die", "das", "und", "ist", "von", "zu", "mit", "den", "nicht", "ein", "eine", "auf", "für", "sich", "dem",
    "le", "la", "les", "de", "des", "et", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "du", "est",
    "el", "los", "las", "y", "que", "en", "por", "con", "una", "se", "no", "es", "para", "lo",
]

#: (measure, smallest allowed, largest allowed)
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 10, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.10),
    ("stop_word_ratio", 0.04, None),
    ("dup_line_ratio", None, 0.50),
    ("repeat_word_ratio", None, 0.20),
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")


def _removed(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in the text."""

    def over(words: Column) -> Column:
        last = F.size(words) - REPEAT_WINDOW
        hashes = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.xxhash64(*[words[k + d] for d in range(REPEAT_WINDOW)])
        )
        return F.when(last < 1, F.lit(0)).otherwise(let(hashes, covered))

    def covered(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(repeated(hashes), spans))

    def repeated(hashes: Column) -> Column:
        """Sorted positions of the windows whose hash is not unique."""
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = let(
            pairs,
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, i: F.when(
                        (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]
                    ),
                ),
                lambda p: p.isNotNull(),
            ),
        )
        return F.array_sort(same)

    def spans(at: Column) -> Column:
        total = F.aggregate(
            at,
            F.struct(F.lit(-1).alias("until"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(
                (p + REPEAT_WINDOW).alias("until"), (acc["n"] + p + REPEAT_WINDOW - F.greatest(p, acc["until"])).alias("n")
            ),
        )
        return total["n"]

    return let(words, over)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that the rules read."""
    text = text_or_empty(text_col)
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: F.length(_removed(x, WORD_BREAKS)) > 0)

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    def line_counts(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        )

    n_chars = F.length("text")
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        .select(
            "doc_id",
            F.length(_removed(F.col("text"), WORD_BREAKS)).cast("long").alias("word_chars"),
            (n_chars - F.length(_removed(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
            let(words_of(F.col("text")), counts).alias("w"),
            let(lines, line_counts).alias("l"),
        )
        .select("doc_id", "word_chars", "n_symbols", "w.*", "l.*")
    )


def _ratios() -> dict[str, Column]:
    per_word = lambda n: F.when(F.col("n_words") > 0, F.col(n) / F.col("n_words")).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": per_word("word_chars"),
        "symbol_ratio": F.when(F.col("word_chars") > 0, F.col("n_symbols") / F.col("word_chars")).otherwise(F.lit(0.0)),
        "stop_word_ratio": F.when(F.col("n_words") > 0, (F.col("n_stop_words") + 1) / F.col("n_words")).otherwise(F.lit(0.0)),
        "dup_line_ratio": F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")).otherwise(F.lit(0.0)),
        "repeat_word_ratio": per_word("n_repeat_words"),
    }


def compile_rules(rules: list[tuple[str, float | None, float | None]] = RULES) -> tuple[Column, Column]:
    """(passes all rules, name of the first failed rule) over the columns of ``measures``."""
    ratios, failed = _ratios(), F.lit(None).cast("string")
    for name, low, high in reversed(rules):
        broken = F.lit(False)
        if low is not None:
            broken = broken | (ratios[name] < F.lit(low))
        if high is not None:
            broken = broken | (ratios[name] > F.lit(high))
        failed = F.when(broken, F.lit(name)).otherwise(failed)
    return failed.isNull(), failed


def quality_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, failed_rule and kept."""
    passes, failed = compile_rules(rules)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, id_col, text_col).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines",
        base.alias("base_failed"), failed.alias("failed_rule"), (~base & passes).alias("kept"),
    )
