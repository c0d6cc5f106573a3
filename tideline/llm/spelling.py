"""Spelling variant grouping: words one edit apart, found by the halves of words in Aho-Corasick shards.

A word of the dictionary has two segments, its halves. One inserted, deleted or replaced character leaves one half whole,
at the start or at the end, so a near word holds that half at that offset. What is left between the known prefix and the
known suffix is the word's *gap*.

1. Occurrences are counted per document and task, then summed: words of ``LEAST_LENGTH`` characters and ``LEAST_COUNT``
   occurrences form the dictionary.
2. Every word gives two keys (length, gap, prefix, suffix), one for each half. A key that more than ``GROUP`` words share
   is split: its gap is halved again, so the prefix or the suffix grows and the edit must lie in the rest. Words that
   share a key with a gap of one character differ in that character only, so no group outgrows GROUP or the alphabet,
   whatever the words; no pairs of a large group are ever met.
3. Keys go to shards by hash, and every word goes to the shards of the keys that a near dictionary word would have. A
   shard with many words to scan is copied, and the words are dealt to the copies by hash.
4. A task builds an automaton of a shard's segments, scans the words, keeps segments found at the right offset with
   compatible lengths and rest, and verifies the distance. It hands on a count and the best near word, not the pairs.
   A pair that several keys of a word would find counts for the first of them.

A word's form is its near word of most occurrences, if that has at least ``RATIO`` times its own; the root is at the end
of the forms, found by doubling. Counts grow along the forms, so there are no cycles and few steps.

Typing noise, as the contract defines it: where ``NOISE`` divides the crc32 of `<doc_id>:<word>`, a character goes.

Defined results: null and empty texts have no words; without an id no character goes; repeated rows count again; ties of
the form go by code points; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import tokens
from tideline.llm.columns import text_or_empty
from tideline.session import Scratch, materialize

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
NOISE = 31
GROUP = 32
SHARD_KEYS = 30_000
SHARD_WORDS = 200_000
HELD_WORDS = 300_000
PAIRS = 1 << 19
LONG = 48

#: Latin-1 bytes: letters stay, A to Z are lowered, all else parts words.
TABLE = bytes(b if b >= 0xC0 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
KEY = ["len", "s", "e", "a", "b"]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        get, crc = held.get, zlib.crc32

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in tokens.slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begun = None if doc_id is None else crc(f"{doc_id}:".encode())
                for word in text.encode("latin-1", "replace").translate(TABLE).split():
                    if len(word) >= LEAST_LENGTH:
                        if begun is not None:
                            h = crc(word if word.isascii() else word.decode("latin-1").encode(), begun)
                            if not h % NOISE:
                                word = word[: h % len(word)] + word[h % len(word) + 1 :]
                                if len(word) < LEAST_LENGTH:
                                    continue
                        held[word] = get(word, 0) + 1
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    counted = docs.mapInArrow(tokens.bounded(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _node(length: Column, s: Column, e: Column, own: Column) -> Column:
    """The key of a dictionary word of ``length`` with the gap [s, e), as the column ``word`` of length ``own`` would hold it."""
    tail = length - e
    return F.struct(
        length.alias("len"), s.alias("s"), e.alias("e"), F.substring("word", F.lit(1), s).alias("a"), F.substring("word", own - tail + 1, tail).alias("b")
    )


def _halves(length: Column, s: Column, e: Column, own: Column) -> list[Column]:
    """The two keys whose gaps are the halves of [s, e): the first keeps the left half of it as prefix, the other the right."""
    middle = F.floor((s + e) / 2).cast("int")
    return [_node(length, middle, e, own), _node(length, s, middle, own)]


def _first_keys(words: DataFrame) -> DataFrame:
    own = F.length("word")
    return words.select("word", "n", F.inline(F.array(*_halves(own, F.lit(0), own, own))))


def _first_probes(words: DataFrame) -> DataFrame:
    """Keys that a near dictionary word, of a length one off at most, would have."""
    own = F.length("word")
    keys = [k for d in (-1, 0, 1) for k in _halves(own + d, F.lit(0), own + d, own)]
    return words.select("word", F.inline(F.array(*keys))).filter(F.col("len") >= LEAST_LENGTH)


def _split(rows: DataFrame, keep: list[str]) -> DataFrame:
    halves = _halves(F.col("len"), F.col("s"), F.col("e"), F.length("word"))
    return rows.select(*keep, F.inline(F.array(*halves)))


def bounded_keys(words: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(word, n, key) of the dictionary and (word, key) of the words to scan, no key with more than a bounded group."""
    keys, probes = _first_keys(words), _first_probes(words)
    kept_keys, kept_probes = [], []
    while True:
        hot = scratch.write(keys.groupBy(*KEY).count().filter((F.col("count") > GROUP) & (F.col("e") - F.col("s") > 1)).select(*KEY), "hot")
        kept_keys.append(keys.join(hot, KEY, "left_anti"))
        kept_probes.append(probes.join(hot, KEY, "left_anti"))
        if hot.isEmpty():
            break
        keys = scratch.write(_split(keys.join(hot, KEY, "left_semi"), ["word", "n"]), "keys")
        probes = scratch.write(_split(probes.join(hot, KEY, "left_semi"), ["word"]).filter(F.length("a") + F.length("b") <= F.length("word")), "probes")
    for more_keys, more_probes in zip(kept_keys[1:], kept_probes[1:], strict=True):
        kept_keys[0] = kept_keys[0].unionByName(more_keys)
        kept_probes[0] = kept_probes[0].unionByName(more_probes)
    return kept_keys[0], kept_probes[0]


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word at most LONG Latin-1 codes from the start, the same from its end, zeros behind; and the lengths."""
    raw = [w.encode("latin-1") for w in words]
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    width = int(min(lengths.max(initial=1), LONG)) + 1
    front = b"".join([w[: width - 1].ljust(width, b"\0") for w in raw])
    back = b"".join([w[: -width : -1].ljust(width, b"\0") for w in raw])
    return (*(np.frombuffer(x, dtype=np.uint8).reshape(-1, width) for x in (front, back)), lengths)


def _common(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Equal codes at the start of each pair of rows."""
    width = min(one.shape[1], other.shape[1])
    same = (one[:, :width] == other[:, :width]) & (one[:, :width] != 0)
    same[:, -1] = False
    return same.argmin(axis=1)


def common_start(one: str, other: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(one, other, strict=False)) if x != y), min(len(one), len(other)))


class Shard:
    """Dictionary keys of a shard behind an automaton of their segments."""

    def __init__(self, words: list[str], counts: list[int], keys: list[tuple]):
        import ahocorasick

        order = sorted(range(len(words)), key=keys.__getitem__)
        keys, self.words = [keys[k] for k in order], [words[k] for k in order]
        self.counts = np.array(counts, dtype=np.int64)[order]
        self.ends = np.array([k[2] for k in keys], dtype=np.int64)
        self.front, self.back, self.lengths = _letters(self.words)
        best = sorted(range(len(words)), key=lambda k: (-self.counts[k], self.words[k]))
        self.rank = np.empty(len(words), dtype=np.int64)
        self.rank[best] = np.arange(len(words))
        self.by_rank = best
        by_segment, start = {}, 0
        edges = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
        for end in [*edges, len(keys)]:
            length, s, e, a, b = keys[start]
            front = len(a) >= len(b)
            places = by_segment.setdefault(a if front else b, {})
            places.setdefault((front, length, s, e), {})[b if front else a] = (start, end)
            start = end
        self.automaton = ahocorasick.Automaton()
        for segment, places in by_segment.items():
            self.automaton.add_word(segment, (len(segment), [(*shape, rest) for shape, rest in places.items()]))
        self.automaton.make_automaton()

    def candidates(self, word: str) -> list[tuple[int, int]]:
        """Ranges of dictionary rows whose segments stand in the word at their offsets."""
        own, found = len(word), []
        for last, (size, places) in self.automaton.iter(word):
            at_start, at_end = last + 1 == size, last + 1 == own
            if at_start or at_end:
                for front, length, s, e, rest in places:
                    if -1 <= length - own <= 1 and (at_start if front else at_end):
                        tail = length - e
                        if s + tail <= own and (span := rest.get(word[own - tail :] if front else word[:s])):
                            found.append(span)
        return found

    def near(self, words: list[str], owner: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (word, dictionary row) that one edit parts and that no earlier key of the row's word finds."""
        front, back, lengths = _letters(words)
        own, other = lengths[owner], self.lengths[row]
        start, end = _common(front[owner], self.front[row]), _common(back[owner], self.back[row])
        for k in np.flatnonzero(np.minimum(own, other) >= LONG):  # the letters held do not reach the middle
            one, two = words[owner[k]], self.words[row[k]]
            start[k], end[k] = common_start(one, two), common_start(one[::-1], two[::-1])
        apart = (start + end >= np.maximum(own, other) - 1) & (np.abs(own - other) <= 1) & ~((own == other) & (start == own))
        first = (self.ends[row] == other) | (start < self.ends[row])
        return owner[apart & first], row[apart & first]


def scan(rows: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of rows (bucket, word, n, key), sorted by bucket, dictionary rows (with n) first."""
    names = ["word", "n_near", "best_n", "best"]

    def met(shard: Shard, words: list[str]) -> Iterator[pa.RecordBatch]:
        """What the words find, in parts of about PAIRS pairs; a word's candidates are never parted."""
        spans, owners, held, first = [], [], 0, 0
        for k, word in enumerate(words, 1):
            found = shard.candidates(word)
            spans += found
            owners += [k - 1 - first] * len(found)
            held += sum([b - a for a, b in found])
            if spans and (held >= PAIRS or k == len(words)):
                part = words[first:k]
                edges = np.array(spans, dtype=np.int64)
                sizes = edges[:, 1] - edges[:, 0]
                owner = np.repeat(np.array(owners, dtype=np.int64), sizes)
                row = np.arange(held) + np.repeat(edges[:, 0] - np.cumsum(sizes) + sizes, sizes)
                owner, row = shard.near(part, owner, row)
                count = np.bincount(owner, minlength=len(part))
                best = np.full(len(part), len(shard.words), dtype=np.int64)
                np.minimum.at(best, owner, shard.rank[row])
                some = np.flatnonzero(count)
                top = [shard.by_rank[r] for r in best[some].tolist()]
                columns = [pa.array([part[i] for i in some.tolist()], pa.string()), pa.array(count[some], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shard.counts[top], pa.int64()), pa.array([shard.words[t] for t in top], pa.string())], names)
            if held >= PAIRS:
                spans, owners, held, first = [], [], 0, k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, shard, own = None, None, ([], [], [])
        for batch in batches:
            at, words = batch.column(0).to_numpy(), batch.column(1)
            listed = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (listed[1:] != listed[:-1])) + 1).tolist(), len(at)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if at[a] != bucket:
                    bucket, shard, own = at[a], None, ([], [], [])
                if listed[a]:
                    part = [c.slice(a, b - a).to_pylist() for c in batch.columns[1:]]
                    for held, more in zip(own, (part[0], part[1], zip(*part[2:], strict=True)), strict=True):
                        held.extend(more)
                    continue
                if shard is None and own[0]:
                    shard, own = Shard(*own), ([], [], [])
                if shard is not None:
                    yield from met(shard, words.slice(a, b - a).to_pylist())

    return rows.mapInArrow(tokens.bounded(run), "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n_near, best): the count of near words, and a struct (-n, word) of the best, for words that have any."""
    keys, probes = bounded_keys(words, scratch)
    shard = F.xxhash64("a", "b")  # without the lengths: a word goes to fewer shards
    keys = scratch.write(keys.withColumn("shard", shard), "dictionary")
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    keys = keys.withColumn("shard", F.pmod("shard", F.lit(shards)))
    probes = probes.select("word", F.pmod(shard, F.lit(shards)).alias("shard")).distinct()
    probes = scratch.write(probes, "scanned")
    sizes = scratch.write(probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_WORDS).cast("int").alias("copies")), "copies")
    copied = keys.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "word", "n", *KEY)
    copied = copied.select(F.xxhash64("shard", "copy").alias("bucket"), "word", "n", *KEY)
    no_key = [F.lit(None).cast(t).alias(c) for c, t in zip(KEY, ("int", "int", "int", "string", "string"), strict=True)]
    dealt = probes.join(sizes, "shard").select(
        F.xxhash64("shard", (F.pmod(F.xxhash64("word"), F.col("copies")) + 1).cast("int")).alias("bucket"), "word", F.lit(None).cast("long").alias("n"), *no_key
    )
    both = copied.unionByName(dealt).repartition(shards, "bucket").sortWithinPartitions("bucket", F.desc_nulls_last("n"))
    found = scan(both)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, doubling the distance in each round."""
    steps = scratch.write(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = scratch.write(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "steps")
        if joined.filter("next IS NOT NULL").isEmpty():
            return joined.select("word", "root")
        steps = joined.drop("next")


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the dictionary."""
    docs = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    with Scratch(docs.sparkSession, "spelling") as scratch:
        words = scratch.write(count_words(docs), "words")
        near = near_words(words, scratch)
        likely = F.col("best.n") * -1 >= RATIO * F.col("n")
        formed = words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(likely, F.col("best.word")).alias("form"), F.when(likely, -F.col("best.n")).alias("form_n")
        )
        formed = materialize(formed, "spelling-forms")
        roots = materialize(_roots(formed.filter("form IS NOT NULL"), scratch), "spelling-roots")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
