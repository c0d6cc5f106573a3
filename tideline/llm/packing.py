"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens: its documents (ids, then an end id) one after the other, in the order of the input.
A queue is dealt out in quanta of ``QUANTUM`` tokens; a window (sequence) of ``WINDOW`` tokens takes WINDOW / QUANTUM
quanta. Every queue's deficit grows with time at the rate of its weight; when it reaches one quantum, the queue is served
and pays one. What is left of a deficit stays with the queue from window to window, so every window meets the targets to
within the quanta that are owed.

The schedule is a sort: a queue's j-th quantum is due when its deficit has grown to j + 1, at (j + 1) / weight, and
quanta are served in the order of these times (ties by queue). So the deficits at the start of any partition of that
order follow from the time alone, partitions are made in parallel, and their places follow from the partitions' sizes.
Nothing is held per queue in one task or in the driver, whatever the number of sources. The last, partial quantum of
every queue goes to the closing windows, end to end, so only the last window is padded.

Weights default to the queues' own sizes, which spends all queues together. With other weights a queue that runs dry
drops out and the others keep their proportions.

The ids are written once and never shuffled unless the table of starts (tasks x queues) is too large to broadcast: each
task notes where a text starts among the tokens of its queue in that task, and the tasks' totals are summed up per queue.

Defined results: a null text is empty and packs the end id alone; a null source is a queue of its own, of weight 1 where
weights are given; sources without a weight have weight 1; repeated rows are packed as often as they come; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import tokens
from tideline.session import Scratch, materialize

WINDOW = 2048
QUANTUM = 256
CHUNK = 1 << 16


def running_totals(rows: DataFrame, order: list[str], amounts: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with before_<amount>: the sum of each amount over all rows that come earlier in ``order``, which is total.

    Range partitions are summed up on their own; one row of sums a partition reaches the driver.
    """
    before = [f"before_{a}" for a in amounts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, upto = TaskContext.get().partitionId(), np.zeros(len(amounts), dtype=np.int64)
        for batch in batches:
            own = np.stack([batch.column(batch.schema.get_field_index(a)).to_numpy(zero_copy_only=False) for a in amounts]).astype(np.int64)
            sums = own.cumsum(axis=1)
            starts = [pa.array(x, pa.int64()) for x in sums - own + upto[:, None]]
            upto = upto + sums[:, -1] if batch.num_rows else upto
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), *starts], [*batch.schema.names, "_part", *before])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", _part int, " + ", ".join(f"{n} long" for n in before)
    ranged = scratch.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "ranged")
    sums = sorted(tuple(r) for r in ranged.groupBy("_part").agg(*[F.sum(a) for a in amounts]).collect())
    starts, upto = [], [0] * len(amounts)
    for part, *own in sums:
        starts.append((part, *upto))
        upto = [x + y for x, y in zip(upto, own, strict=True)]
    of_part = rows.sparkSession.createDataFrame(starts, "_part int, " + ", ".join(f"_{n} long" for n in before))
    placed = ranged.join(F.broadcast(of_part), "_part")  # a row for each partition
    return placed.select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in before])


def schedule(queues: DataFrame, scratch: Scratch) -> DataFrame:
    """(queue, quantum, slot) of (queue, weight, full): the order in which deficits reach one quantum.

    A queue's quanta are made in chunks, so that one with a third of all tokens does not fill a task.
    """
    chunks = queues.filter("full > 0").select("queue", "weight", "full", F.explode(F.expr(f"sequence(0L, full - 1, {CHUNK}L)")).alias("first"))
    each = F.explode(F.expr(f"sequence(first, least(first + {CHUNK}L, full) - 1)")).alias("quantum")
    quanta = chunks.repartition("queue", "first").select("queue", "weight", each).select("queue", "quantum", ((F.col("quantum") + 1) / F.col("weight")).alias("due"), F.lit(1).alias("slot"))
    return running_totals(quanta, ["due", "queue"], ["slot"], scratch).select("queue", "quantum", F.col("before_slot").alias("slot"))


def _tokenized(rows: DataFrame, spec: str, end_id: int) -> DataFrame:
    """(doc_id, source, ids, n, queue, part, at): a text's ids, and where they start among those of its task and queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, upto = tokens.encoder(spec, True).encode, TaskContext.get().partitionId(), defaultdict(int)
        small = tokens.load_tokenizer(spec).get_vocab_size() <= 1 << 16
        for batch in tokens.slices(batches, size=tokens.ENCODE_BYTES):
            ids = [np.append(own, np.uint32(end_id)) for own in encode(batch.column(1).to_pylist())]
            queues, starts = batch.column(3).to_pylist(), []
            for queue, own in zip(queues, ids, strict=True):
                starts.append(upto[queue])
                upto[queue] += len(own)
            packed = pa.array([x.astype("<u2" if small else "<u4").tobytes() for x in ids], pa.binary())
            counts, places = pa.array([len(x) for x in ids], pa.int64()), pa.array(starts, pa.int64())
            parts = pa.array([part] * len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), packed, counts, batch.column(3), parts, places], names)

    names = ["doc_id", "source", "ids", "n", "queue", "part", "at"]
    return rows.mapInArrow(tokens.bounded(run, encodes=True), "doc_id long, source string, ids binary, n long, queue string, part int, at long")


def pack(
    docs: DataFrame,
    spec: str,
    end_id: int = 1,
    weights: dict[str, float] | None = None,
    window: int = WINDOW,
    quantum: int = QUANTUM,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids (32-bit, binary).

    The checksum is taken from the piece's ids. Who drops the ids moves none of them through the last shuffle.
    """
    if window % quantum:
        raise ValueError("a window must be a whole number of quanta")
    if any(w <= 0 for w in (weights or {}).values()):
        raise ValueError("weights must be above 0")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))  # a null source is told from an empty one
    queued = materialize(_tokenized(rows.withColumn("queue", named), spec, end_id), "packing-tokens")
    with Scratch(spark, "packing") as scratch:
        by_part = queued.groupBy("queue", "part").agg(F.sum("n").alias("part_n"))
        before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = scratch.write(by_part.withColumn("part_start", F.coalesce(F.sum("part_n").over(before), F.lit(0))), "starts")
        sizes = starts.groupBy("queue").agg(F.sum("part_n").alias("tokens")).select("queue", "tokens", F.expr(f"tokens div {quantum}").alias("full"), F.expr(f"tokens % {quantum}").alias("tail"))
        weighted = sizes.withColumn("weight", F.col("tokens").cast("double"))
        if weights:
            given = spark.createDataFrame([(f"={k}", float(w)) for k, w in weights.items()], "queue string, weight double")
            weighted = sizes.join(given, "queue", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        numbered = running_totals(weighted.withColumn("one", F.lit(1)), ["queue"], ["one", "full", "tail"], scratch)
        queues = scratch.write(numbered.withColumnRenamed("before_one", "number"), "queues")
        whole = queues.agg(F.max(F.col("before_full") + F.col("full"))).first()[0] or 0
        order = schedule(queues.select(F.col("number").alias("queue"), "weight", "full"), scratch)
        # both are read by the result; they grow with the input, which Spark can tell from the written size only
        slots = materialize(order, "packing-slots")
        places = queues.select("queue", "number", (F.col("full") * quantum).alias("tail_at"), (F.lit(whole * quantum) + F.col("before_tail")).alias("tail_start"))
        starts = materialize(starts.join(places, "queue").drop("part_n"), "packing-starts")

    placed = queued.join(starts, ["queue", "part"]).select(
        "doc_id", "source", "ids", "n", "number", (F.col("part_start") + F.col("at")).alias("at"), "tail_at", "tail_start"
    )

    wide = 2 if tokens.load_tokenizer(spec).get_vocab_size() <= 1 << 16 else 4

    def pieces_of(batch: pa.RecordBatch, rows: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """Pieces [start, end) of the queue, of the texts ``rows`` (piece by piece: ``row``), whose ids are ``ids``, end to end."""
        at, n, number, tail, closing = (batch.column(k).to_numpy()[rows][row] for k in (5, 3, 4, 6, 7))
        own = batch.select([0, 1]).take(pa.array(rows[row]))
        last = start >= tail
        edges = np.concatenate([[0], np.cumsum(end - start)]) * 4
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges.astype("<i8")), pa.py_buffer(ids)]).cast(pa.binary())
        quantum_of = start // quantum
        position = np.where(last, start + closing - tail, start - quantum_of * quantum)
        columns = [start - at, end - start, n, pa.array(number, mask=last), pa.array(quantum_of, mask=last), position]
        return pa.RecordBatch.from_arrays([*own.columns, *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns], packed], schema=cut_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches):
            raw = batch.column(2)
            edges = np.frombuffer(raw.buffers()[1], "<i4")[raw.offset : raw.offset + len(raw) + 1]
            ids = np.frombuffer(raw.buffers()[2], "<u2" if wide == 2 else "<u4")[edges[0] // wide : edges[-1] // wide].astype("<u4")
            at, n, tail, closing = (batch.column(k).to_numpy() for k in (5, 3, 6, 7))
            closes = at + n > tail
            rows = np.flatnonzero(~closes)
            if len(rows):  # cut where quanta end
                first = at[rows] // quantum
                count = (at[rows] + n[rows] - 1) // quantum - first + 1
                row = np.repeat(np.arange(len(rows)), count)
                step = (first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * quantum
                start, end = np.maximum(step, at[rows][row]), np.minimum(step + quantum, (at + n)[rows][row])
                yield pieces_of(batch, rows, row, start, end, ids[np.repeat(~closes, n)] if closes.any() else ids)
            rows = np.flatnonzero(closes)
            if len(rows):  # the closing windows cut where they end, not where quanta do
                row, start, end = [], [], []
                for k, r in enumerate(rows.tolist()):
                    a, b, t, shift = int(at[r]), int(at[r] + n[r]), int(tail[r]), int(closing[r] - tail[r])
                    marks = [e for e in range(a // quantum * quantum + quantum, b, quantum) if e <= t]
                    marks += [p - shift for p in range((max(a, t) + shift) // window * window + window, b + shift, window)]
                    row += [k] * (len(marks) + 1)
                    start += [a, *marks]
                    end += [*marks, b]
                yield pieces_of(batch, rows, np.array(row), np.array(start), np.array(end), ids[np.repeat(closes, n)])

    cut_schema = pa.schema(
        [("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())]
        + [("queue", pa.int64()), ("quantum", pa.int64()), ("position", pa.int64()), ("ids", pa.binary())]
    )
    columns = "doc_id long, source string, start long, length long, doc_tokens long"
    pieces = placed.mapInArrow(tokens.bounded(cut), f"{columns}, queue long, quantum long, position long, ids binary").withColumn("ids_crc32", F.crc32("ids"))
    position = F.coalesce(F.col("slot") * quantum, F.lit(0)) + F.col("position")
    return pieces.join(slots, ["queue", "quantum"], "left").select(
        "doc_id", "source", "start", "length", "ids_crc32", "doc_tokens",
        F.floor(position / window).cast("long").alias("sequence_id"), F.pmod(position, F.lit(window)).cast("long").alias("offset"), "ids",
    )
