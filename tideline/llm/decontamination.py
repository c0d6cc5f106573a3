"""Benchmark decontamination: a prefix-filtered set join between item windows and documents.

A window is ``WIDTH`` item words in a row (an item of fewer words is one window), a set of shingles of ``SHINGLE`` words (a
shorter window is one shingle). A window occurs in a text when the text holds it word for word, so all its shingles must
be there and one of them is a necessary prefix: the rarest, by occurrences in all documents.

1. One pass over the texts: a bitmap of the item shingles finds the positions that may hold one. Neighbouring positions
   merge to runs, and runs shorter than any window go (length bound). A bitmap lets a few strange shingles through, never
   the other way. It has ``BITS`` bits a shingle and at most 2**``LARGEST`` words, whatever the size of the benchmark.
2. Shingles of the runs are counted over all documents; each window keeps the rarest of its shingles, and windows with a
   shingle that no document holds are out.
3. Positions meet the prefix shingles. A shingle tells at which offsets of windows it stands, so the start and the end of
   a candidate follow; those that leave the run are out (positional bound).
4. The candidate's words, an item-sized window of the text, must equal the window: an equality join on the words, so a
   shingle shared by many windows and many documents gives no product.

Texts are verified once for all rows that repeat them. All of it is DataFrame functions.

Defined results: null, empty and wordless texts have no words and no hits; items without words have no windows; items of
one id are one item, those without an id hit words but are not counted or listed; windows that items share count for
each; rows that repeat id and text each get the same result; an empty benchmark hits nothing; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.columns import let, text_or_empty
from tideline.session import Scratch, materialize

WIDTH = 10
SHINGLE = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BITS = 64
LARGEST = 21


def words(text: Column) -> Column:
    """Runs of letters, digits and anything beyond ASCII, A to Z lowered."""
    plain = F.length(text) == F.octet_length(text)  # then lower() changes A to Z only, and is much faster
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(lowered, SEPARATORS, -1), lambda w: w != "")


def _gram(source: Column, at: Column, width: Column | int) -> Column:
    return F.array_join(F.slice(source, at + 1, width), " ")


def windows_of(items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, window, width, q): every window of every item as its words with blanks between; q is the shingle width."""
    sized = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    own = F.least(F.size("w"), F.lit(width))
    each = F.explode(F.sequence(F.lit(0), F.size("w") - own)).alias("at")
    return sized.select("item_id", "w", own.alias("width"), each).select(
        "item_id", _gram(F.col("w"), F.col("at"), F.col("width")).alias("window"), "width", F.least("width", F.lit(shingle)).alias("q")
    )


def _shingles(windows: DataFrame) -> DataFrame:
    """(window, width, q, offset, gram) of distinct windows."""
    split = windows.select("window", "width", "q", F.split("window", " ").alias("w"))
    each = F.explode(F.sequence(F.lit(0), F.col("width") - F.col("q"))).alias("offset")
    return split.select("window", "width", "q", "w", each).withColumn("gram", _gram(F.col("w"), F.col("offset"), F.col("q"))).drop("w")


def _hash(hashes: Column, at: Column, q: int) -> Column:
    return F.xxhash64(*[hashes[at + d] for d in range(q)])


def bitmap(grams: DataFrame, q: int, log_words: int) -> DataFrame:
    """One row: an array of 2**log_words longs with a bit set for each gram of ``q`` words."""
    hashes = F.transform(F.split("gram", " "), lambda w: F.xxhash64(w))
    own = grams.filter(F.col("q") == q).select(let(hashes, lambda h: _hash(h, F.lit(0), q)).alias("h"))
    place = F.shiftrightunsigned("h", 64 - log_words).alias("place")
    bits = own.select(place, F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bits"))
    blank = grams.sparkSession.range(1 << log_words).select(F.col("id").alias("place"), F.lit(0).cast("long").alias("bits"))
    merged = bits.unionByName(blank).groupBy("place").agg(F.bit_or("bits").alias("bits"))
    return merged.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "bits"))), lambda s: s["bits"]).alias("b"))


def _runs(source: Column, hashes: Column, bits: Column, q: int, log_words: int, least: int) -> Column:
    """Structs (q, at, words) of the runs of positions whose shingles the bitmap holds, of ``least`` words or more."""

    def held(h: Column) -> Column:
        word = F.get(bits, F.shiftrightunsigned(h, 64 - log_words).cast("int"))
        return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1

    def merged(hits: Column) -> Column:
        starts = F.filter(F.transform(hits, lambda p, i: F.when((i == 0) | (F.get(hits, i - 1) < p - 1), p)), lambda p: p.isNotNull())
        ends = F.filter(F.transform(hits, lambda p, i: F.when((i == F.size(hits) - 1) | (F.get(hits, i + 1) > p + 1), p)), lambda p: p.isNotNull())
        spans = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), (b - a + q).alias("n"))), lambda s: s["n"] >= least)
        return F.transform(spans, lambda s: F.struct(F.lit(q).alias("q"), s["a"].alias("at"), F.slice(source, s["a"] + 1, s["n"]).alias("words")))

    places = F.sequence(F.lit(0), F.greatest(F.size(hashes) - q, F.lit(0)))
    found = F.filter(F.when(F.size(hashes) >= least, places), lambda k: let(_hash(hashes, k, q), held))
    return let(found, merged)


def find_runs(docs: DataFrame, grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, h1, h2, n_words, runs) of every row; h1 and h2 are a 128-bit hash of its text."""
    shapes = grams.groupBy("q").agg(F.count_distinct("gram").alias("n"), F.min("width").alias("least")).orderBy("q").collect()  # a row for each of SHINGLE widths at most
    sized = [(r["q"], max(4, min(LARGEST, ceil(log2(max(1, r["n"] * BITS / 64))))), r["least"]) for r in shapes]
    rows = docs.select("doc_id", "text")
    for q, log_words, _ in sized:  # a scalar subquery can't stand inside a lambda, a column of it can
        rows = rows.withColumn(f"_bits{q}", bitmap(grams, q, log_words).scalar())

    def scanned(source: Column) -> Column:
        def of_hashes(hashes: Column) -> Column:
            found = [_runs(source, hashes, F.col(f"_bits{q}"), q, log_words, least) for q, log_words, least in sized]
            none = F.array().cast("array<struct<q:int,at:int,words:array<string>>>")
            return F.struct(F.size(source).cast("long").alias("n_words"), F.flatten(F.array(none, *[F.coalesce(f, none) for f in found])).alias("runs"))

        return let(F.transform(source, lambda w: F.xxhash64(w)), of_hashes)

    hashed = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    return scratch.write(rows.select("doc_id", *hashed, let(words(F.col("text")), scanned).alias("s")).select("doc_id", "h1", "h2", "s.*"), "runs")


def _positions(found: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each position of a run: its shingle, and the run's words around it, as far as any window reaches."""
    one = found.select(*keep, F.explode("runs").alias("run"))

    def place(k: Column) -> Column:
        first = F.greatest(k - (WIDTH - 1), F.lit(0))
        return F.struct(
            (F.col("run.at") + k).alias("at"),
            _gram(F.col("run.words"), k, F.col("run.q")).alias("gram"),
            (k - first).alias("left"),
            F.slice(F.col("run.words"), first + 1, k - first + WIDTH).alias("around"),
        )

    each = F.transform(F.sequence(F.lit(0), F.size("run.words") - F.col("run.q")), place)
    return one.select(*keep, F.inline(each))


def occurrences(docs: DataFrame, windows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of ``find_runs``, and (h1, h2, start, width, window) of every place where a window occurs in a text."""
    grams = scratch.write(_shingles(windows.select("window", "width", "q").distinct()), "grams")
    found = find_runs(docs, grams, scratch)
    holding = found.filter(F.size("runs") > 0)
    counts = _positions(holding, []).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rated = grams.join(counts, "gram", "left").groupBy("window", "width").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "gram")).alias("rarest"))
    prefixes = scratch.write(rated.filter("rarest.n > 0").select("window", "width", "rarest.offset", "rarest.gram"), "prefixes")
    stands = prefixes.groupBy("gram").agg(F.collect_set(F.struct("offset", "width")).alias("stands"))  # at most WIDTH offsets and widths
    texts = scratch.write(holding.dropDuplicates(["h1", "h2"]).select("h1", "h2", "runs"), "texts")
    met = _positions(texts, ["h1", "h2"]).join(stands, "gram").select("h1", "h2", "at", "left", "around", F.inline("stands"))
    inside = (F.col("left") >= F.col("offset")) & (F.size("around") >= F.col("left") - F.col("offset") + F.col("width"))
    cut = met.filter(inside).select(
        "h1", "h2", (F.col("at") - F.col("offset")).alias("start"), "width", _gram(F.col("around"), F.col("left") - F.col("offset"), F.col("width")).alias("window")
    )
    return found, scratch.write(cut.distinct().join(prefixes.select("window"), "window"), "occurrences")


def _covered(spans: Column) -> Column:
    """Words that sorted spans (start, end) cover."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("until"))
    return F.aggregate(
        spans,
        begin,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["until"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(acc["until"], s["end"]).alias("until"),
        ),
    )["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids as text), contaminated for every row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), text_or_empty(item_text_col).alias("text"))
    with Scratch(docs.sparkSession, "decontamination") as scratch:
        windows = scratch.write(windows_of(items).distinct(), "windows")
        found, met = occurrences(docs, windows, scratch)
        spans = met.groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("width")).alias("end")))).alias("spans"))
        hits = spans.select("h1", "h2", _covered(F.col("spans")).alias("n_hit"))
        links = met.select("h1", "h2", "window").distinct().join(windows.filter("item_id IS NOT NULL").select("window", "item_id"), "window").select("h1", "h2", "item_id").distinct()
        listed = links.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
        by_text = hits.join(listed, ["h1", "h2"], "left")
        bare, holding = found.drop("runs"), found.filter(F.size("runs") > 0).drop("runs")
        none = found.filter(F.size("runs") == 0).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
        some = holding.select(bare.columns).join(by_text, ["h1", "h2"], "left").select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
        )
        out = materialize(none.unionByName(some), "decontaminated")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))
