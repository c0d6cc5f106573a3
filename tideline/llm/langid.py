"""Language identification by mixture inference.

Every language has a table of byte n-gram log probabilities, counted over all training texts (n-grams of the text in
lower case, hashed to ``BUCKETS``; add-one smoothing). A text is cut into units of ``UNIT`` bytes; a unit's likelihood
under a language is the product over its n-grams. Expectation-maximisation estimates the share of each language in the
text from these likelihoods. The set of languages is chosen by penalised likelihood: from the full set, the language with
the least share leaves as long as log-likelihood - PENALTY * languages * log(units) / 2 does not fall. The prediction is
the language with the largest share, and the score that share.

The tables are languages x BUCKETS numbers whatever the corpus; counting is a partial sum per task and one aggregation.
More than ``MAX_LANGUAGES`` languages are refused before any table is made. Texts are taken in slices that shrink with the
number of languages, and n-grams are looked up in blocks; a text's units are kept whole, languages / 4 bytes a byte of text.

Defined results: null texts and texts without letters are ``und`` with score 0; ties go to the language that sorts first;
repeated rows give equal rows; with no training rows every text is ``und``; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.columns import crc_of_id
from tideline.llm.tokens import bounded, slices
from tideline.session import materialize

ORDER = 3
BUCKETS = 1 << 16
UNIT = 32
STEPS = 8
PENALTY = 2.0
MAX_LANGUAGES = 256
BLOCK_CELLS = 1 << 20
SLICE_CELLS = 4 << 20
UNKNOWN = "und"


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngrams(text: str) -> np.ndarray:
    """Bucket of the n-gram that ends at each byte of the text in lower case, behind a leading space."""
    raw = np.frombuffer(b"  " + text.lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    mixed = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) ^ (raw[2:] * np.uint32(0xC2B2AE3D))
    return (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Log probabilities of the n-gram buckets by language, over all rows with a language and a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(ngrams(text), minlength=BUCKETS)
                sums[lang] = sums[lang] + found if lang in sums else found
        for lang, found in sums.items():
            (at,) = found.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    summed = rows.mapInArrow(bounded(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = materialize(summed, "langid-counts")
    langs = sorted(r["lang"] for r in summed.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = summed.toArrow()  # at most languages x BUCKETS rows of three numbers
    place = {lang: k for k, lang in enumerate(langs)}
    counts = np.ones((len(langs), BUCKETS))
    codes = found.column("lang").combine_chunks().dictionary_encode()
    rows = np.array([place[x] for x in codes.dictionary.to_pylist()], dtype=np.int64)[codes.indices.to_numpy()] if len(codes) else np.zeros(0, np.int64)
    counts[rows, found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    return {lang: np.log(own / own.sum()).astype(np.float32) for lang, own in zip(langs, counts, strict=True)}


def _mixture(units: np.ndarray, doc: np.ndarray, starts: np.ndarray, allowed: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM from ``shares`` within the allowed languages of each text; (shares, log-likelihoods)."""
    sizes = np.diff(np.append(starts, len(doc)))[:, None]
    shares = np.where(allowed, np.maximum(shares, 1e-6), 0.0)
    shares /= shares.sum(axis=1, keepdims=True)
    top = np.where(allowed[doc], units, -np.inf).max(axis=1, keepdims=True)
    likely = np.where(allowed[doc], np.exp(units - top), 0.0)
    for step in range(STEPS + 1):
        joint = likely * shares[doc]
        total = joint.sum(axis=1, keepdims=True)
        if step == STEPS:
            break
        shares = np.add.reduceat(joint / total, starts, axis=0) / sizes
        shares = np.where(allowed, np.maximum(shares, 1e-6), 0.0)
        shares /= shares.sum(axis=1, keepdims=True)
    fit_of = np.add.reduceat((np.log(total) + top)[:, 0], starts)
    return shares, fit_of


def _unit_scores(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log-likelihood of every unit of a text (units x languages), a block of units at a time."""
    step = UNIT * max(1, BLOCK_CELLS // (UNIT * table.shape[1]))
    blocks = (grams[at : at + step] for at in range(0, len(grams), step))
    return np.concatenate([np.add.reduceat(table[b], np.arange(0, len(b), UNIT), axis=0).astype(np.float64) for b in blocks])


def infer(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Shares (texts x languages) in the chosen set of languages. ``table``: BUCKETS x languages."""
    langs = table.shape[1]
    grams = [ngrams(t) for t in texts]
    counts = np.array([-(-len(g) // UNIT) for g in grams])
    units = np.concatenate([_unit_scores(g, table) for g in grams])
    doc, starts = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts) - counts
    cost = PENALTY * np.log(np.maximum(counts, 2)) / 2
    allowed = np.ones((len(texts), langs), dtype=bool)
    shares, fit_of = _mixture(units, doc, starts, allowed, np.full(allowed.shape, 1 / langs))
    open_ = np.arange(len(texts))
    while len(open_) and langs > 1:
        open_ = open_[allowed[open_].sum(axis=1) > 1]
        if not len(open_):
            break
        trial = allowed[open_].copy()
        least = np.where(trial, shares[open_], np.inf)
        trial[np.arange(len(open_)), langs - 1 - least[:, ::-1].argmin(axis=1)] = False
        pick = np.isin(doc, open_)
        sizes = counts[open_]
        fewer, lower = _mixture(units[pick], np.repeat(np.arange(len(open_)), sizes), np.cumsum(sizes) - sizes, trial, shares[open_])
        better = lower + cost[open_] >= fit_of[open_]
        open_, trial, fewer, lower = open_[better], trial[better], fewer[better], lower[better]
        allowed[open_], shares[open_], fit_of[open_] = trial, fewer, lower
    return shares


def predict(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and lang_shares (map of the chosen languages to their shares)."""
    langs = sorted(model)
    table = np.stack([model[x] for x in langs], axis=1) if langs else None
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_shares", T.MapType(T.StringType(), T.DoubleType()))])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128, SLICE_CELLS // max(1, len(langs))):
            texts = batch.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if table is not None and t and has_letters(t)]
            lang, score, held = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if known:
                found = infer([texts[i] for i in known], table)
                for i, row, best in zip(known, found.tolist(), found.argmax(axis=1).tolist(), strict=True):
                    lang[i], score[i] = langs[best], min(1.0, row[best])
                    held[i] = [(x, s) for x, s in zip(langs, row, strict=True) if s > 0]
            more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(held, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "score", "lang_shares"])

    return docs.mapInArrow(bounded(run), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows outside the held-out fold."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    remainder = F.pmod(crc_of_id(), F.lit(folds))
    model = fit(rows.filter(F.coalesce(remainder != held, F.lit(True))))
    rows = rows.select("doc_id", "text", F.coalesce(remainder == held, F.lit(False)).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
