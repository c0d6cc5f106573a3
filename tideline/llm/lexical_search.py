"""Ranked lexical search as a blocked sparse matrix product: item-term multiplicities times term-document impacts.

The vocabulary is the terms of a block of items, at most ``ITEM_BYTES`` of text (a longer item is a block of its own), which
bounds what is sent to tasks; a larger benchmark takes more blocks, each over all documents.

1. One pass over the texts writes the sparse rows of a block: a document's length, the numbers of the block's terms that
   it holds, and how often. N and L are sums over this table, df counts its term numbers, with partial aggregation.
2. Each task turns ``BLOCK`` documents at a time into columns by term and their impacts, 64-bit integers. The product is
   Gustavson's: an item's row is the sum of the impact columns of its terms, times their multiplicities, merged into one
   dense row of the block. Per task, the best ``top`` of each item go on, and a last ranking merges the tasks' lists.

Integers are divided rounding down; a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))).

Defined results: null and empty texts and items have no terms and no rows; equal scores go by ascending id, null ids last,
and rows that repeat an id each take a rank; rows of the items that repeat id and text are one item, those that share an
id only are ranked one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import tokens
from tideline.llm.columns import text_or_empty
from tideline.session import Scratch, materialize

TOP = 10
BLOCK = 8192
ITEM_BYTES = 4 << 20

#: Letters, digits and all bytes of characters beyond ASCII stay, A to Z are lowered, all else parts terms.
TABLE = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def terms(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(TABLE).split()


def _rows(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tf): sparse rows over the vocabulary, a broadcast dict of numbers from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in tokens.slices(batches):
            sizes, edges, keys, counts = [], [0], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                split = terms(raw)
                own, tf = np.unique(np.fromiter(filter(None, map(number, split)), dtype=np.int32), return_counts=True)
                sizes.append(len(split))
                edges.append(edges[-1] + len(own))
                keys.append(own - 1)
                counts.append(tf)
            offsets = pa.array(edges, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x or [[]]).astype(np.int32))) for x in (keys, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(tokens.bounded(run), "doc_id long, n long, terms array<int>, tf array<int>")


def impacts(tf: np.ndarray, n: np.ndarray, count: int, length: int) -> np.ndarray:
    m = 100 - 75 + (75 * n * count) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Best:
    """The best ``top`` (score, doc) of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.lists = top, [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * items

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        held = self.lists[item]
        if len(held[0]) == self.top:
            likely = scores >= held[0][-1]
            scores, docs, null = scores[likely], docs[likely], null[likely]
        if len(scores) > self.top:
            likely = scores >= np.partition(scores, -self.top)[-self.top]
            scores, docs, null = scores[likely], docs[likely], null[likely]
        if not len(scores):
            return
        scores, docs, null = (np.concatenate(x) for x in zip(held, (scores, docs, null), strict=True))
        order = np.lexsort((docs, null, -scores))[: self.top]
        self.lists[item] = scores[order], docs[order], null[order]


def _product(rows: DataFrame, shared, top: int) -> DataFrame:
    """(item, doc_id, score): the best of each item in each task. ``shared``: items' rows, weights, N and L, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_rows, weights, count, length = shared.value
        best = Best(len(item_rows), top)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                block = batch.slice(start, BLOCK)
                ids, lists = block.column(0), block.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                at, tf = lists.flatten().to_numpy().astype(np.int64), block.column(3).flatten().to_numpy().astype(np.int64)
                if not len(at):
                    continue
                doc = np.repeat(np.arange(len(sizes)), sizes)
                n = block.column(1).to_numpy()
                value = weights[at] * impacts(tf, n[doc], count, length)
                order = np.argsort(at, kind="stable")
                at, doc, value = at[order], doc[order], value[order]
                present, first = np.unique(at, return_index=True)
                columns = dict(zip(present.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True), strict=True))
                null = ids.is_null().to_numpy(zero_copy_only=False)
                doc_ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                merged = np.zeros(len(sizes), dtype=np.int64)
                for item, row in enumerate(item_rows):
                    merged[:] = 0
                    for term, times in row:
                        if span := columns.get(term):
                            merged[doc[span[0] : span[1]]] += times * value[span[0] : span[1]]
                    hit = np.flatnonzero(merged > 0)
                    if len(hit):
                        best.add(item, merged[hit], doc_ids[hit], null[hit])
        for item, (scores, docs, null) in enumerate(best.lists):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), item), pa.int32()), pa.array(docs, pa.int64(), mask=null), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item int, doc_id long, score long")


def _one_block(docs: DataFrame, items: list[tuple[int, str]], top: int, scratch: Scratch) -> DataFrame:
    """(key, doc_id, score, rank) for one block of items (key, text)."""
    spark = docs.sparkSession
    bags = [Counter(terms(text)) for _, text in items]
    number = {term: k for k, term in enumerate(sorted(set().union(*bags)), 1)}
    rows = scratch.write(_rows(docs, spark.sparkContext.broadcast(number)), "rows")
    count, length = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each term of the block at most
    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(number))], dtype=np.int64)
    item_rows = [sorted((number[t] - 1, times) for t, times in bag.items()) for bag in bags]
    lists = scratch.write(_product(rows, spark.sparkContext.broadcast((item_rows, weights, count, max(length, 1))), top), "lists")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = lists.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)  # Spark cuts each task's part first
    keys = spark.createDataFrame([(k, key) for k, (key, _) in enumerate(items)], "item int, key long")
    return ranked.join(keys, "item").select("key", "doc_id", "score", "rank")


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``top`` documents of each item with a score above 0."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    with Scratch(docs.sparkSession, "search") as scratch:
        distinct = items.select(F.col(item_col).alias("item_id"), text_or_empty(item_text_col).alias("text")).distinct()
        numbered = scratch.write(distinct.withColumn("key", F.monotonically_increasing_id()), "items")
        blocks = math.ceil((numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / ITEM_BYTES)
        found = docs.sparkSession.createDataFrame([], "key long, doc_id long, score long, rank int")
        for k in range(blocks):
            block = numbered.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k).select("key", "text")
            if rows := [tuple(r) for r in block.collect()]:
                found = found.unionByName(_one_block(docs, rows, top, scratch))
        return materialize(found.join(numbered.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score"), "search")
