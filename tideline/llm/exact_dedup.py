"""Exact deduplication over a bucketed cuckoo-filter index of live digests.

Method: every text becomes its SHA-256 digest; equal digests are counted before any shuffle, salted so that no digest
gathers in one task. Digests go to buckets; each bucket owns a cuckoo filter of 16-bit fingerprints, four to a slot group,
and every fingerprint points to a stored key. An insertion asks the filter: a miss is new and reads no key; a hit is
verified against the keys that the matching fingerprints point to, so a collision of fingerprints never merges two texts.
When a row with a larger id replaces the keeper, the live digest is deleted and inserted anew. An insertion that finds no
free slot after the allowed evictions doubles the filter and refills it from the stored keys.

The index is a table with a row per bucket: filter, pointers and keys in columns of their own. ``probe`` reads the
filters alone and takes only hits on to the keys; ``update_index`` applies deletions and insertions to the stored filters.

Defined results: a null text counts as empty; of equal texts the row with the largest id stays (a null id is smallest);
of rows that repeat an id and its text exactly one is kept; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.columns import text_or_empty
from tideline.session import materialize

SLOTS = 4
MAX_EVICTIONS = 200
KEYS_PER_BUCKET = 20_000
PROBES_PER_PART = 50_000
SALTS = 32
INDEX = (
    "bucket int, buckets int, groups int, prints binary, refs binary, digests array<binary>, keep_ids array<bigint>, "
    "group_sizes array<bigint>, false_hits bigint, resizes bigint"
)


class CuckooFilter:
    """Fingerprints in groups of ``SLOTS``, zero where a slot is free.

    A digest has two groups; each follows from the other and the fingerprint, which allows deletion and eviction.
    """

    def __init__(self, groups: int, prints: bytes | None = None):
        self.groups = groups
        self.prints = np.frombuffer(prints, "<u2").tolist() if prints is not None else [0] * (groups * SLOTS)

    def places(self, digest: bytes) -> tuple[int, int, int]:
        fingerprint = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & (self.groups - 1)
        return fingerprint, first, self.other(first, fingerprint)

    def other(self, place: int, fingerprint: int) -> int:
        return (place ^ (fingerprint * 0x5BD1E995)) & (self.groups - 1)

    def hits(self, digest: bytes) -> list[int]:
        """Slots that hold the fingerprint of a digest in one of its groups."""
        fingerprint, first, second = self.places(digest)
        found = []
        for place in {first, second}:
            base = place * SLOTS
            found += [k for k in range(base, base + SLOTS) if self.prints[k] == fingerprint]
        return found


class CuckooIndex:
    """Live digests of one bucket: the filter in front, and the keys that its fingerprints point to."""

    def __init__(self, capacity: int = 1024):
        groups = 1
        while groups * SLOTS * 0.9 < max(capacity, 1):
            groups *= 2
        self.digests: list[bytes | None] = []
        self.payloads: list[tuple | None] = []
        self.free: list[int] = []
        self.resizes = self.false_hits = 0
        self._reset(groups)

    def _reset(self, groups: int) -> None:
        self.filter, self.refs = CuckooFilter(groups), [-1] * (groups * SLOTS)

    @classmethod
    def stored(cls, row) -> CuckooIndex:
        """The index of a row of the index table; nothing is inserted anew."""
        index = cls(0)
        index.filter, index.refs = CuckooFilter(int(row["groups"]), row["prints"]), np.frombuffer(row["refs"], "<i4").tolist()
        index.digests = [bytes(d) for d in row["digests"]]
        index.payloads = [(None if k is None or k != k else int(k), int(n)) for k, n in zip(row["keep_ids"], row["group_sizes"], strict=True)]
        index.false_hits, index.resizes = int(row["false_hits"]), int(row["resizes"])
        return index

    def dump(self) -> dict:
        """The columns of the index table, without the keys that were deleted."""
        live = [k for k, d in enumerate(self.digests) if d is not None]
        place = {k: n for n, k in enumerate(live)}
        refs = np.array([place[k] if k >= 0 else -1 for k in self.refs], dtype="<i4")
        return {
            "groups": self.filter.groups, "prints": np.array(self.filter.prints, dtype="<u2").tobytes(), "refs": refs.tobytes(),
            "digests": [self.digests[k] for k in live], "keep_ids": [self.payloads[k][0] for k in live],
            "group_sizes": [int(self.payloads[k][1]) for k in live], "false_hits": self.false_hits, "resizes": self.resizes,
        }

    def _slot(self, digest: bytes) -> int | None:
        """The slot of a live digest; a hit counts only if the key that it points to is the same."""
        for slot in self.filter.hits(digest):
            if self.digests[self.refs[slot]] == digest:
                return slot
            self.false_hits += 1
        return None

    def get(self, digest: bytes) -> tuple | None:
        slot = self._slot(digest)
        return None if slot is None else self.payloads[self.refs[slot]]

    def _place(self, digest: bytes, key: int) -> bool:
        cuckoo, refs = self.filter, self.refs
        fingerprint, first, second = cuckoo.places(digest)
        place = first
        for step in range(-1, MAX_EVICTIONS):
            base = place * SLOTS
            for slot in range(base, base + SLOTS):
                if not cuckoo.prints[slot]:
                    cuckoo.prints[slot], refs[slot] = fingerprint, key
                    return True
            if step < 0:
                place = second
                continue
            slot = base + step % SLOTS
            fingerprint, cuckoo.prints[slot] = cuckoo.prints[slot], fingerprint
            key, refs[slot] = refs[slot], key
            place = cuckoo.other(place, fingerprint)
        return False  # one fingerprint is homeless; the caller refills from the stored keys

    def insert(self, digest: bytes, payload: tuple) -> None:
        """Add a digest that is not live."""
        if self.free:
            key = self.free.pop()
            self.digests[key], self.payloads[key] = digest, payload
        else:
            key = len(self.digests)
            self.digests.append(digest)
            self.payloads.append(payload)
        placed = self._place(digest, key)
        while not placed:
            self.resizes += 1
            self._reset(self.filter.groups * 2)
            placed = all(self._place(d, k) for k, d in enumerate(self.digests) if d is not None)

    def delete(self, digest: bytes) -> tuple | None:
        """Remove a live digest and give back its payload; None if it is not live."""
        slot = self._slot(digest)
        if slot is None:
            return None
        key = self.refs[slot]
        self.filter.prints[slot], self.refs[slot] = 0, -1
        payload, self.digests[key], self.payloads[key] = self.payloads[key], None, None
        self.free.append(key)
        return payload

    def add(self, digest: bytes, keep: int | None, size: int) -> None:
        """Insert, or replace the live digest by one with the larger id and both sizes."""
        old = self.delete(digest)
        if old is not None:
            keep, size = (keep if _newer(keep, old[0]) else old[0]), size + old[1]
        self.insert(digest, (keep, size))


def _newer(a, b) -> bool:
    """Whether id ``a`` is larger than ``b``; null is smallest."""
    return b is None if a is not None and b is None else a is not None and a > b


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, copies): repeated rows are counted before the shuffle."""
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)).alias("digest"))
        .groupBy("doc_id", "digest")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def _bucket(digest: str, buckets) -> F.Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


def _rows_of(frame: pd.DataFrame) -> Iterator[tuple[bytes, int | None, int]]:
    known = frame["max_id"].notna()
    for digest, there, keep, size in zip(frame["digest"], known, frame["max_id"], frame["n"], strict=True):
        yield bytes(digest), (int(keep) if there else None), int(size)


def _built(keys: DataFrame, buckets: int) -> DataFrame:
    """The index table of (digest, max_id, n) in so many buckets."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        index = CuckooIndex(len(frame))
        for digest, keep, size in _rows_of(frame):
            index.add(digest, keep, size)
        return pd.DataFrame([{"bucket": int(frame["bucket"].iloc[0]), "buckets": buckets} | index.dump()])

    return keys.select("digest", "max_id", "n", _bucket("digest", buckets).alias("bucket")).groupBy("bucket").applyInPandas(build, INDEX)


def live_index(rows: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """The index table of (doc_id, digest, copies).

    Partial counts for (digest, salt) bound what one digest can bring to a bucket to ``SALTS`` rows; the number of
    buckets follows that of the rows, so a bucket stays near ``keys_per_bucket`` keys at any size.
    """
    partial = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        .groupBy("digest", "salt")
        .agg(F.max("doc_id").alias("max_id"), F.sum("copies").alias("n"))
    )
    return _built(partial, max(1, -(-rows.count() // keys_per_bucket)))


def index_keys(index: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of the stored keys."""
    each = F.explode(F.arrays_zip("digests", "keep_ids", "group_sizes")).alias("key")
    return index.select(each).select(F.col("key.digests").alias("digest"), F.col("key.keep_ids").alias("keep_id"), F.col("key.group_sizes").alias("group_size"))


def _buckets_of(index: DataFrame) -> int:
    row = index.select("buckets").limit(1).collect()
    return row[0]["buckets"] if row else 1


def dealt_probes(digests: DataFrame, index: DataFrame, part: int) -> tuple[DataFrame, DataFrame]:
    """(digest, bucket, part) and (bucket, groups, prints, part): of a bucket with more than ``part`` digests to ask, the
    filter goes to as many parts, and the digests are dealt to them by hash."""
    bucketed = digests.select("digest", _bucket("digest", _buckets_of(index)).alias("bucket"))
    sizes = bucketed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))  # a row for each bucket
    salt = F.pmod(F.xxhash64(F.lit("part"), "digest"), F.col("parts")).cast("int")
    filters = index.join(sizes, "bucket").select("bucket", "groups", "prints", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return bucketed.join(sizes, "bucket").select("digest", "bucket", salt.alias("part")), filters


def filter_hits(digests: DataFrame, index: DataFrame, part: int = PROBES_PER_PART) -> DataFrame:
    """The digests (column digest, each once) that the filters of a written index may hold; keys are not read.

    A small index bounds no task by its number of buckets: see ``dealt_probes``.
    """

    def ask(asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(filters) or not len(asked):
            return asked[["digest"]].iloc[:0]
        row = filters.iloc[0]
        cuckoo = CuckooFilter(int(row["groups"]), row["prints"])
        return asked[["digest"]][[bool(cuckoo.hits(bytes(d))) for d in asked["digest"]]]

    asked, filters = dealt_probes(digests, index, part)
    return asked.groupBy("bucket", "part").cogroup(filters.groupBy("bucket", "part")).applyInPandas(ask, "digest binary")


def probe(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with the keeper of their digest in an earlier, written ``live_index``; null where the text is new.

    Filters are asked first. Only digests that they may hold are looked up among the keys; without any, no key is read.
    """
    rows = materialize(digest_rows(docs, id_col, text_col), "probe-digests")
    hits = materialize(filter_hits(rows.select("digest").distinct(), index), "probe-hits")
    if not hits.limit(1).count():
        return rows.select("*", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    found = index_keys(index).join(hits, "digest", "left_semi")
    return rows.join(found, "digest", "left").select("doc_id", "digest", "copies", "keep_id", "group_size")


def with_buckets(index: DataFrame, buckets: int) -> DataFrame:
    """The index with so many buckets, refilled from the stored keys."""
    keys = index_keys(index).select("digest", F.col("keep_id").alias("max_id"), F.col("group_size").alias("n"))
    return _built(keys, buckets)


def update_index(index: DataFrame, inserts: DataFrame, deletes: DataFrame, keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """Apply deletions, then insertions, to the stored filters and keys of a written index.

    ``inserts`` has (digest, keep_id, group_size), ``deletes`` a column digest. Deleting a digest that is not live
    changes nothing; inserting a live one keeps the larger id and adds the counts. Insertions of one digest are merged
    before the shuffle. Where the keys would outgrow ``keys_per_bucket`` a bucket, buckets are split first, so no group
    outgrows it by more than chance; a filter that overflows doubles and is refilled from its keys; buckets without changes
    pass as they are.
    """
    merged = inserts.groupBy("digest").agg(F.max("keep_id").cast("long").alias("max_id"), F.sum("group_size").cast("long").alias("n"))
    merged = materialize(merged, "index-inserts")
    buckets = _buckets_of(index)
    keys = (index.agg(F.sum(F.size("digests"))).first()[0] or 0) + merged.count()
    times = 1
    while keys > keys_per_bucket * buckets * times:
        times *= 2
    if times > 1:
        buckets *= times
        index = materialize(with_buckets(index, buckets), "index-split")
    changes = (
        deletes.select("digest").distinct()
        .select("digest", F.lit(None).cast("long").alias("max_id"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("kind"))
        .unionByName(merged.withColumn("kind", F.lit(1)))
        .withColumn("bucket", _bucket("digest", buckets))
    )

    def apply(changed: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(changed):
            return stored
        live = CuckooIndex.stored(stored.iloc[0]) if len(stored) else CuckooIndex(len(changed))
        changed = changed.sort_values("kind", kind="stable")
        for kind, (digest, keep, size) in zip(changed["kind"], _rows_of(changed), strict=True):
            if kind == 0:
                live.delete(digest)
            else:
                live.add(digest, keep, size)
        return pd.DataFrame([{"bucket": int(changed["bucket"].iloc[0]), "buckets": buckets} | live.dump()])

    return changes.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(apply, INDEX)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(digest_rows(docs, id_col, text_col), "digests")
    index = index_keys(materialize(live_index(rows), "cuckoo-index"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return (
        rows.join(index, "digest")
        .select("doc_id", "keep_id", "group_size", "digest", copy)
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, all columns; rows that repeat id and text give one row."""
    rows = materialize(digest_rows(docs, id_col, text_col), "digests")
    kept = index_keys(live_index(rows)).select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep_id"))
    keyed = docs.withColumn("_digest", F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)))
    same = (keyed["_digest"] == kept["_digest"]) & keyed[id_col].eqNullSafe(kept["_keep_id"])
    return keyed.join(kept, same, "left_semi").dropDuplicates([id_col, "_digest"]).drop("_digest")
