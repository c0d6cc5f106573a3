"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, one of texts labelled toxic and one of ordinary texts, score every word of a
text. A pair counts once in every text that holds it, so a long text that repeats itself weighs once. A class's bigram
level takes one absolute discount off every pair and backs off to the class's continuation counts, the number of distinct
words seen before a word. These take a discount of their own and back off to the sum of both classes' continuation
counts, which a uniform share of the slots completes. Each discount is the usual estimate n1 / (n1 + 2 n2) from the
numbers of entries that count one and two. The signed difference of the two log-likelihoods per word, with the weight of
the words that speak strongly for toxic by the bigram and by the continuation level, goes through a logistic calibration
fitted on labelled rows that the models have not seen. How strong is strong is the one of ``STRONG`` with which that
calibration has the least log loss on those rows.

Words are runs of letters and digits in lower case, hashed to ``WORD_SLOTS``. Bigrams are kept as pairs of words, each with
its exact counts, and found through an index of 2**``PAIR_BITS`` ranges that only narrows the search. The models are fitted on at most ``MAX_FIT_ROWS`` labelled rows of each class, the first by a hash of the id: a documented
bound on a classifier's sample. Their texts stay on the executors, which count them; the driver gets the counts of each
distinct pair of the sample and the features of the calibration rows. Every text is scored whole.

Defined results: null and empty texts have no words and get the calibrated score of no evidence; ids without labels are
only scored; a labelled id that repeats takes the larger label; without labels of both classes all scores are 0;
repeated rows give equal rows; a score of exactly 0.5 is predicted as 1; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.columns import crc_of_id
from tideline.llm.tokens import bounded, slices
from tideline.session import Scratch

WORD_SLOTS = 1 << 20
PAIR_BITS, KEY_BITS, SPREAD = 22, 40, 0x27D4EB
STRONG = (1.0, 2.0, 3.0, 4.0)
MAX_FIT_ROWS = 10_000
CALIBRATION_PART = 5
CACHE_WORDS = 200_000
WORDS = re.compile(r"[^\W_]+")


class _Slots(dict):
    """Slot of every word, filled on demand."""

    def __missing__(self, word: str) -> int:
        slot = self[word] = zlib.crc32(word.encode("utf-8", "replace")) & (WORD_SLOTS - 1)
        return slot


def word_slots(text: str | None, cache: _Slots | None = None) -> np.ndarray:
    """Slots of the words of a text; ``cache`` keeps them from text to text."""
    cache = _Slots() if cache is None else cache
    if len(cache) > CACHE_WORDS:
        cache.clear()
    return np.array([cache[w] for w in WORDS.findall((text or "").lower())], dtype=np.int64)


def pair_keys(words: np.ndarray) -> np.ndarray:
    """Key of (previous word, word) for every word; the first has the start mark before it."""
    return np.concatenate([[0], words[:-1]]).astype(np.int64) * WORD_SLOTS + words


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, rest) of keys: a mixture of the key that can be undone, so two keys of a slot differ in the rest."""
    mixed = (keys * SPREAD) & (WORD_SLOTS * WORD_SLOTS - 1)
    return mixed >> (KEY_BITS - PAIR_BITS), (mixed & ((1 << (KEY_BITS - PAIR_BITS)) - 1)).astype(np.uint32)


def discount(ones: int, twos: int) -> float:
    """n1 / (n1 + 2 n2), or one half where nothing counts one or nothing counts two."""
    return ones / (ones + 2 * twos) if ones and twos else 0.5


class Counts(NamedTuple):
    """Counts of both classes: by pair, in the order of slots (with the discount off), by word before and by word."""

    slot: np.ndarray
    rest: np.ndarray
    pair: np.ndarray
    before: np.ndarray
    texts_after: np.ndarray
    kinds_after: np.ndarray
    word: np.ndarray
    kinds_before: np.ndarray
    less: list[float]


class KneserNey:
    """Tables of both classes (0 ordinary, 1 toxic)."""

    def __init__(self, counts: Counts):
        self.total = np.ones((2, WORD_SLOTS), dtype=np.float32)
        self.backoff = np.ones((2, WORD_SLOTS), dtype=np.float32)
        held = np.zeros((2, WORD_SLOTS))
        self.rest, self.pair = counts.rest, counts.pair
        self.first = np.concatenate([[0], np.cumsum(np.bincount(counts.slot, minlength=1 << PAIR_BITS))]).astype(np.int32)
        for label in (0, 1):
            total, kinds = counts.texts_after[label], counts.kinds_after[label]
            seen = total > 0
            at = counts.before[seen]
            held[label, counts.word] = counts.kinds_before[label]  # distinct words before each word
            self.total[label, at] = total[seen]
            self.backoff[label, at] = counts.less[label] * kinds[seen] / total[seen]
        shared = (held.sum(axis=0) + 0.5) / (held.sum() + 0.5 * WORD_SLOTS)
        mass = held.sum(axis=1, keepdims=True)
        less = np.array([[discount(int((h == 1).sum()), int((h == 2).sum()))] for h in held])
        freed = less * (held > 0).sum(axis=1, keepdims=True) + (mass == 0)
        self.lower = ((np.maximum(held - less, 0) + freed * shared) / np.maximum(mass, 1.0)).astype(np.float32)
        self.weights, self.strong = np.zeros(4), STRONG[0]

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """Places of the keys in ``pair``, -1 where no text of either class has the pair."""
        slot, rest = places(pairs)
        at, end = self.first[slot].astype(np.int64), self.first[slot + 1]
        out = np.full(len(pairs), -1)
        open_ = np.flatnonzero(at < end)
        while len(open_):  # as often as the fullest range that is met has keys
            here = at[open_]
            hit = self.rest[here] == rest[open_]
            out[open_[hit]] = here[hit]
            at[open_] += 1
            open_ = open_[~hit & (at[open_] < end[open_])]
        return out

    def evidence(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | toxic) - log P(word | ordinary) of every word after its context, and by the continuation level alone."""
        keys = pair_keys(words)
        before, place = keys // WORD_SLOTS, self.find(keys)
        lower, known = self.lower[:, words], np.flatnonzero(place >= 0)
        logs = []
        for c in (0, 1):
            p = self.backoff[c, before] * lower[c]
            p[known] += self.pair[c, place[known]] / self.total[c, before[known]]
            logs.append(np.log(p))
        return logs[1] - logs[0], np.log(lower[1] / lower[0])

    def features(self, words: np.ndarray, strong: tuple[float, ...] = ()) -> tuple[float, ...]:
        """Signed difference of the log-likelihoods per word; then for each of ``strong`` (by default the chosen one) the
        weight a word of what single words have beyond it, by pairs and by continuation."""
        strong = strong or (self.strong,)
        if not len(words):
            return (0.0,) * (1 + 2 * len(strong))
        each, alone = self.evidence(words)
        return float(each.mean()), *(math.log1p(100 * float((np.maximum(x - s, 0) ** 2).mean())) for s in strong for x in (each, alone))

    def calibrate(self, found: np.ndarray, labels: np.ndarray) -> None:
        """Weights and the choice of ``STRONG``, from rows of features for all of them."""
        losses = []
        for k, strong in enumerate(STRONG):
            own = found[:, [0, 1 + 2 * k, 2 + 2 * k]]
            self.weights, self.strong = _logistic(own, labels), strong
            p = np.clip(self.score(own), 1e-12, 1 - 1e-12)
            losses.append((-float(np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))), k, self.weights))
        _, k, self.weights = min(losses, key=lambda x: x[:2])
        self.strong = STRONG[k]

    def score(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + found @ self.weights[1:], -30, 30)))


def _logistic(found: np.ndarray, labels: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.ones(len(labels)), found])
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (labels - p) - 0.01 * weights
        bend = (x.T * (p * (1 - p))) @ x + 0.01 * np.eye(x.shape[1])
        weights += np.linalg.solve(bend, slope)
    return weights


def count_pairs(texts: DataFrame) -> Counts:
    """What ``KneserNey`` is made from, of (words, toxic). Spark counts; the driver gets a row for each distinct pair of the
    sample and for each word, as Arrow columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found: list[tuple[np.ndarray, ...]] = []
            for raw, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.frombuffer(raw, "<i4").astype(np.int64)
                if len(words):
                    pairs = np.unique(pair_keys(words))
                    found.append((pairs, np.full(len(pairs), toxic)))
            if found:
                pairs, toxic = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(toxic, pa.int32())], ["pair", "toxic"])

    each = texts.select("words", "toxic").mapInArrow(bounded(run), "pair long, toxic int")
    of_class = lambda label: F.count(F.when(F.col("toxic") == label, 1)).cast("int").alias(f"n{label}")
    with Scratch(texts.sparkSession, "toxicity-pairs") as scratch:
        pairs = scratch.write(each.groupBy("pair").agg(of_class(0), of_class(1)), "pairs")
        is_ = lambda label, n: F.count(F.when(F.col(f"n{label}") == n, 1))
        ones = pairs.agg(is_(0, 1), is_(0, 2), is_(1, 1), is_(1, 2)).first()
        less = [discount(*ones[:2]), discount(*ones[2:])]
        kinds = [F.count(F.when(F.col(f"n{label}") > 0, 1)).cast("int").alias(f"k{label}") for label in (0, 1)]
        sums = [F.sum(f"n{label}").cast("int").alias(f"s{label}") for label in (0, 1)]
        after = pairs.groupBy(F.shiftright("pair", KEY_BITS // 2).cast("int").alias("at")).agg(*sums, *kinds).toArrow()
        ahead = pairs.groupBy(F.col("pair").bitwiseAND(F.lit(WORD_SLOTS - 1)).cast("int").alias("at")).agg(*kinds).toArrow()
        mixed = F.pmod(F.col("pair") * SPREAD, F.lit(1 << KEY_BITS))
        values = [F.when(F.col(f"n{label}") > 0, F.col(f"n{label}") - less[label]).otherwise(0.0).cast("float").alias(f"v{label}") for label in (0, 1)]
        slot = F.shiftright(mixed, KEY_BITS - PAIR_BITS).cast("int").alias("slot")
        rest = mixed.bitwiseAND(F.lit((1 << (KEY_BITS - PAIR_BITS)) - 1))
        listed = pairs.select(slot, rest.alias("rest"), *values).orderBy("slot", "rest").toArrow()
        listed = {name: listed.column(name).to_numpy() for name in listed.column_names}
    column = lambda table, name: table.column(name).to_numpy()
    both = lambda table, name: [column(table, f"{name}{label}") for label in (0, 1)]
    return Counts(
        listed["slot"], listed["rest"].astype(np.uint32), np.stack([listed["v0"], listed["v1"]]),
        column(after, "at"), np.stack(both(after, "s")), np.stack(both(after, "k")), column(ahead, "at"), np.stack(both(ahead, "k")), less,
    )


def _features_of(texts: DataFrame, model: KneserNey) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of (words, toxic) on the driver: a few numbers for each calibration row."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.features(np.frombuffer(x, "<i4").astype(np.int64), STRONG) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, pa.float64()) for c in zip(*found, strict=True))], names)

    names = ["toxic", *(f"x{k}" for k in range(1 + 2 * len(STRONG)))]
    found = texts.select("words", "toxic").mapInArrow(bounded(run), "toxic int, " + ", ".join(f"{n} double" for n in names[1:])).toArrow()
    shared.destroy()
    rows = np.column_stack([found.column(c).to_numpy() for c in names])
    rows = rows[np.lexsort(rows.T)]  # the sums of the fit do not depend on the order of tasks
    return rows[:, 1:], rows[:, 0].astype(float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_FIT_ROWS) -> KneserNey | None:
    """The models and their calibration, or None without labels of both classes."""
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    first = F.xxhash64("doc_id")
    chosen = known.filter("toxic = 1").orderBy(first, "doc_id").limit(max_rows).unionByName(known.filter("toxic = 0").orderBy(first, "doc_id").limit(max_rows))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Slots()
        for batch in slices(batches):
            found = [word_slots(t, cache).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["doc_id", "words", "toxic"])

    # at most 2 x max_rows rows of two numbers are broadcast
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        rows = picked.mapInArrow(bounded(words), "doc_id long, words binary, toxic int").dropDuplicates(["doc_id", "words"])
        fold = F.pmod(F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string")).cast("binary")), F.lit(CALIBRATION_PART)) == 0
        rows = scratch.write(rows.withColumn("calibrates", fold), "words")
        sides = {(r["calibrates"], r["toxic"]) for r in rows.select("calibrates", "toxic").distinct().collect()}
        if {x for _, x in sides} != {0, 1}:
            return None
        held, base = (rows.filter("calibrates"), rows.filter("NOT calibrates")) if len(sides) == 4 else (rows, rows)
        model = KneserNey(count_pairs(base))  # the calibration holds for this model, not for one of more texts
        model.calibrate(*_features_of(held, model))
    return model


def predict(docs: DataFrame, model: KneserNey | None, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of fixed size and the pairs of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, _Slots()
        for batch in slices(batches):
            scores = np.zeros(batch.num_rows)
            if own is not None:
                scores = own.score(np.array([own.features(word_slots(t, cache)) for t in batch.column(at).to_pylist()]).reshape(-1, 3))
            more = [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(bounded(run), schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learned from rows outside the held-out fold."""
    remainder = F.pmod(crc_of_id(id_col), F.lit(folds))
    model = fit(docs, labels.filter(remainder != held), id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(remainder == held, F.lit(False)).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "score", "predicted")
